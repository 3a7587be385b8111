"""Queries over cycles: peaks, troughs, states, leads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators import classify as cl
from tidewell.operators import cycles, features, joins, metrics, panel, shapes, storage
from tidewell.registry import query
from tidewell.sources.adapter import Tables

#: Strict local maxima and minima of the metro mean and of the councils' means, which SQL can name too.
_TURNS = """m AS (SELECT price_date, round(price, 6) AS price FROM metro),
mt AS (SELECT price_date, price, lag(price) OVER w AS b, lead(price) OVER w AS a, lead(price_date) OVER w AS next_day FROM m WINDOW w AS (ORDER BY price_date)),
peaks AS (SELECT price_date AS peak_date, next_day AS confirmed_on FROM mt WHERE price > b + 0.5 AND price > a + 0.5),
lows AS (SELECT price_date AS anchor_date FROM mt WHERE price < b AND price < a),
cm AS (SELECT council, price_date, round(avg(decicents) / 10, 6) AS price FROM panel GROUP BY 1, 2),
ct AS (SELECT council, price_date, price, lag(price) OVER w AS b, lead(price) OVER w AS a FROM cm WINDOW w AS (PARTITION BY council ORDER BY price_date)),
events AS (SELECT council, price_date AS event_date FROM ct WHERE price < b AND price < a)"""


def turns(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Peaks and lows of the metro mean, lows of the councils' means; the panel is filled and summed up once for all."""
    groups = storage.stored(t.panel.groupBy("council", "price_date").agg(F.sum("decicents").alias("total"), F.count(F.lit(1)).alias("n")), "council-days")
    metro = groups.groupBy("price_date").agg((F.sum("total") / F.sum("n") / 10).alias("price"))
    w, v = Window.partitionBy().orderBy("price_date"), Window.partitionBy("council").orderBy("price_date")
    m = metro.withColumn("price", F.round("price", 6)).withColumns({"b": F.lag("price").over(w), "a": F.lead("price").over(w), "next_day": F.lead("price_date").over(w)})
    c = groups.select("council", "price_date", F.round(F.col("total") / F.col("n") / 10, 6).alias("price")).withColumns({"b": F.lag("price").over(v), "a": F.lead("price").over(v)})
    peaks = m.where("price > b + 0.5D and price > a + 0.5D").select(F.col("price_date").alias("peak_date"), F.col("next_day").alias("confirmed_on"))
    return peaks, m.where("price < b and price < a").select(F.col("price_date").alias("anchor_date")), c.where("price < b and price < a").select("council", F.col("price_date").alias("event_date"))


@query(f"""WITH {_TURNS}, d AS (SELECT price_date, 'metro' AS s FROM m),
j AS (SELECT d.price_date, max(peak_date) AS last_peak, min(peak_date) AS first_peak, count(peak_date) AS n FROM d LEFT JOIN peaks ON confirmed_on <= d.price_date GROUP BY 1)
SELECT price_date, n AS n_peaks, last_peak, price_date - last_peak AS days_since, round(CAST(last_peak - first_peak AS DOUBLE) / nullif(n - 1, 0), 2) AS mean_length,
 round((price_date - last_peak) / nullif(round(CAST(last_peak - first_peak AS DOUBLE) / nullif(n - 1, 0), 2), 0), 4) AS pct_through FROM j""")
def cycle_state(t: Tables) -> DataFrame:
    """TS4-6: the state on each day from the peaks confirmed by then."""
    peaks, _, _ = turns(t)
    days = t.metro.select("price_date", F.lit("metro").alias("series"))
    s = cycles.cycle_state(days, peaks.withColumn("series", F.lit("metro")), ["series"])
    return s.select("price_date", "n_peaks", "last_peak", F.col("days_since").cast("long").alias("days_since"), "mean_length", "pct_through")


@query(f"""WITH {_TURNS}, c AS (SELECT a.anchor_date, e.council, e.event_date, a.anchor_date - e.event_date AS lead, row_number() OVER (PARTITION BY a.anchor_date, e.council ORDER BY abs(a.anchor_date - e.event_date), e.event_date) AS k
 FROM lows a JOIN events e ON abs(a.anchor_date - e.event_date) <= 10) SELECT council, anchor_date, event_date, lead FROM c WHERE k = 1""")
def nearest_match(t: Tables) -> DataFrame:
    """JN9."""
    _, lows, events = turns(t)
    return joins.nearest_within(lows, events, "council", 10).withColumn("lead", F.col("lead").cast("long"))


@query(f"""WITH {_TURNS}, c AS (SELECT a.anchor_date, e.council, a.anchor_date - e.event_date AS lead, row_number() OVER (PARTITION BY a.anchor_date, e.council ORDER BY abs(a.anchor_date - e.event_date), e.event_date) AS k
 FROM lows a JOIN events e ON abs(a.anchor_date - e.event_date) <= 60)
SELECT council, median(lead) AS median_lead, round(1 / nullif(stddev_pop(lead), 0), 6) AS consistency, round(count(*) / (SELECT count(*) FROM lows), 4) AS matched FROM c WHERE k = 1 GROUP BY 1""")
def leadership_score(t: Tables) -> DataFrame:
    """AG43, TS10."""
    _, lows, events = turns(t)
    return cycles.leadership(lows, events, "council")


@query(f"""WITH {_TURNS}, i AS (SELECT peak_date AS a, lead(peak_date) OVER (ORDER BY peak_date) AS b FROM peaks)
SELECT council, a AS cycle_start, b AS cycle_end, arg_min(price_date, (price, price_date)) AS trough_date, min(price) AS trough FROM i JOIN cm ON price_date BETWEEN a AND b GROUP BY 1, 2, 3""")
def interpeak_trough(t: Tables) -> DataFrame:
    """JN17, TS11: the lowest day of each series between two peaks, both included. A day belongs to one interval, or two at a peak."""
    peaks, _, _ = turns(t)
    i = peaks.select(F.col("peak_date").alias("cycle_start"), F.lead("peak_date").over(Window.partitionBy().orderBy("peak_date")).alias("cycle_end")).dropna()
    days = i.select("cycle_start", "cycle_end", F.explode(F.sequence("cycle_start", "cycle_end")).alias("price_date"))
    c = panel.mean_price(t.panel, "council").withColumn("price", F.round("price", 6))
    return c.join(days, "price_date").groupBy("council", "cycle_start", "cycle_end").agg(F.min_by("price_date", F.struct("price", "price_date")).alias("trough_date"), F.min("price").alias("trough"))


@query(f"""WITH {_TURNS}, l AS (SELECT peak_date, peak_date - lag(peak_date) OVER (ORDER BY peak_date) AS len FROM peaks), r AS (SELECT CASE WHEN peak_date < DATE '1998-07-01' THEN 'before' ELSE 'after' END AS regime, CAST(len AS DOUBLE) AS len FROM l WHERE len IS NOT NULL),
p AS (SELECT median(len) AS prior FROM r), x AS (SELECT regime, len FROM r UNION ALL SELECT DISTINCT regime, prior FROM r, p UNION ALL SELECT DISTINCT regime, prior FROM r, p)
SELECT regime, median(len) AS typical, count(*) - 2 AS observed FROM x GROUP BY 1""")
def regime_cycle_length(t: Tables) -> DataFrame:
    """TS12: median length by regime, with two further observations of the overall median."""
    peaks, _, _ = turns(t)
    w = Window.partitionBy().orderBy("peak_date")
    l = peaks.select("peak_date", F.datediff("peak_date", F.lag("peak_date").over(w)).cast("double").alias("len")).dropna()  # noqa: E741
    prior = l.agg(F.median("len").alias("p")).scalar()
    r = l.withColumns({"regime": F.when(F.col("peak_date") < "1998-07-01", "before").otherwise("after"), "prior": prior})
    g = r.groupBy("regime").agg(F.collect_list("len").alias("lens"), F.max("prior").alias("prior"))
    every = g.select("regime", F.size("lens").cast("long").alias("observed"), F.explode(F.concat("lens", F.array_repeat("prior", 2))).alias("len"))
    return every.groupBy("regime").agg(F.median("len").alias("typical"), F.max("observed").alias("observed"))


@query(f"""WITH {_TURNS}, n AS (SELECT price_date, min(anchor_date) AS next_low FROM m LEFT JOIN lows ON anchor_date > price_date GROUP BY 1)
SELECT n.price_date, next_low - n.price_date AS days_to_low, round(m.price - x.price, 6) AS depth FROM n JOIN m USING (price_date) LEFT JOIN m x ON x.price_date = next_low""")
def next_trough(t: Tables) -> DataFrame:
    """TS16: days to the next low, and how much deeper it is: a look ahead, for diagnosis."""
    _, lows, _ = turns(t)
    m = t.metro.withColumn("price", F.round("price", 6)).join(lows.select(F.col("anchor_date").alias("price_date"), F.lit(True).alias("low")), "price_date", "left")
    ahead = Window.partitionBy().orderBy("price_date").rowsBetween(1, Window.unboundedFollowing)
    n = m.withColumn("next", F.min(F.when(F.col("low"), F.struct("price_date", "price"))).over(ahead))
    return n.select("price_date", F.datediff("next.price_date", "price_date").cast("long").alias("days_to_low"), F.round(F.col("price") - F.col("next.price"), 6).alias("depth"))


_FEATURES = """f AS (SELECT d.station_code, d.price_date, d.decicents, council, brand FROM panel d),
cmn AS (SELECT price_date, council, avg(decicents) / 10 AS council_mean, count(*) AS n FROM panel GROUP BY 1, 2), bm AS (SELECT price_date, brand, avg(decicents) / 10 AS brand_mean FROM panel GROUP BY 1, 2 HAVING count(*) >= 3),
sd AS (SELECT price_date, stddev_samp(decicents / 10) AS px_std FROM daily GROUP BY 1)"""


@query(f"""WITH {_FEATURES} SELECT f.station_code, f.price_date, f.decicents / 10 AS today, round(metro.price, 4) AS metro_mean, round(CASE WHEN cmn.n >= 3 THEN council_mean END, 4) AS council_mean, round(brand_mean, 4) AS brand_mean,
 round(sd.px_std, 4) AS px_std, f.decicents - b.decicents AS delta_7d, round(f.decicents / 10 - metro.price, 4) AS premium, tgp.tgp IS NOT NULL AS has_upstream
FROM f JOIN metro USING (price_date) LEFT JOIN cmn ON cmn.price_date = f.price_date AND cmn.council = f.council LEFT JOIN bm ON bm.price_date = f.price_date AND bm.brand = f.brand LEFT JOIN sd ON sd.price_date = f.price_date
LEFT JOIN daily b ON b.station_code = f.station_code AND b.price_date = f.price_date - 7 LEFT JOIN tgp ON tgp_date = f.price_date""")
def feature_frame(t: Tables) -> DataFrame:
    """JN3: features that SQL can say too, by left joins of tables with a row a day, or a day and group; an absent aggregate is null and drops no row."""
    daily = storage.stored(t.panel, "panel")  # filled once, read by each part
    rows = joins.exact_lag(daily, 7)
    council = panel.mean_price(daily, "council", least=3, name="council_mean")
    brand = panel.mean_price(daily, "brand", least=3, name="brand_mean")
    up = t.tgp.select(F.col("tgp_date").alias("price_date"), F.lit(True).alias("up"))
    # a row a day, or a day and group, of a fixed calendar and fixed groups: the panel's rows stay where they are
    j = rows.join(F.broadcast(panel.mean_price(daily, name="metro_mean")), "price_date").join(F.broadcast(council), ["price_date", "council"], "left").join(F.broadcast(brand), ["price_date", "brand"], "left")
    j = j.join(F.broadcast(panel.dispersion(daily)), "price_date", "left").join(F.broadcast(up), "price_date", "left")
    today = F.col("decicents") / 10
    return j.select("station_code", "price_date", today.alias("today"), *[F.round(c, 4).alias(c) for c in ("metro_mean", "council_mean", "brand_mean", "px_std")], (F.col("decicents") - F.col("decicents_lag")).alias("delta_7d"), F.round(today - F.col("metro_mean"), 4).alias("premium"), F.col("up").isNotNull().alias("has_upstream"))


@query("""WITH b AS (SELECT station_code, price_date, decicents / 10 AS p, median(decicents / 10) OVER (PARTITION BY station_code ORDER BY price_date RANGE BETWEEN INTERVAL 90 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING) AS base FROM daily)
SELECT station_code, price_date, round(p - base, 4) AS elongation, round((p - base) * ((price_date - DATE '1995-01-01') % 28) / 28.0, 4) AS interaction FROM b""")
def elongation(t: Tables) -> DataFrame:
    """TS14."""
    rows = panel.usual_price(t.daily, 90).withColumn("p", F.col("decicents") / 10)
    gap = F.col("p") - F.col("usual")
    phase = F.datediff("price_date", F.lit("1995-01-01")) % 28
    return rows.select("station_code", "price_date", F.round(gap, 4).alias("elongation"), F.round(gap * phase / 28.0, 4).alias("interaction"))


@query("""WITH s AS (SELECT price_date, price, row_number() OVER (ORDER BY price_date) - 1 AS i, count(*) OVER () AS n FROM metro), x AS (SELECT *, greatest(0, least(i - 3, n - 7)) AS st FROM s)
SELECT a.price_date, round(sum(b.price * (1 / 7.0 + (a.i - a.st - 3) * (b.i - a.st - 3) / 28.0 + ((a.i - a.st - 3) ** 2 - 4) * ((b.i - a.st - 3) ** 2 - 4) / 84.0)), 6) AS smooth FROM x a JOIN x b ON b.i BETWEEN a.st AND a.st + 6 GROUP BY 1""")
def savitzky_golay(t: Tables) -> DataFrame:
    """WN13: the fitted parabola of seven days, by orthogonal polynomials in the SQL; tests hold it against a fit."""
    m = t.metro.withColumn("series", F.lit("metro"))
    return cycles.smooth(m, "price", ["series"]).select("price_date", F.round("smooth", 6).alias("smooth"))


@query()
def station_peaks(t: Tables) -> DataFrame:
    """TS3, TS4: confirmed peaks of every station."""
    return cycles.confirmed_peaks(t.daily.withColumn("price", F.col("decicents") / 10), ["station_code"])


@query()
def council_troughs(t: Tables) -> DataFrame:
    """TS7, TS8."""
    return cycles.trough_events(panel.mean_price(t.panel, "council"), ["council"])


@query()
def days_since_trough(t: Tables) -> DataFrame:
    """TS9: of each council on each day, from that day's past alone."""
    return cycles.days_since_trough(panel.mean_price(t.panel, "council"), ["council"])


@query()
def leadership_board(t: Tables) -> DataFrame:
    """TS10, WN20: weekly scores of the councils against the mean of all others, each on the 730 days before."""
    daily = t.panel
    own = panel.mean_price(daily, "council", least=3)
    both = own.join(panel.leave_one_out(daily, "council"), ["price_date", "council"], "full_outer")
    return cycles.leadership_snapshots(both, "council")


@query()
def lead_lag(t: Tables) -> DataFrame:
    """TS11: median lag of each brand's troughs behind the metro's, between the metro's peaks."""
    peaks = cycles.confirmed_peaks(t.metro.withColumn("series", F.lit("metro")), ["series"], distance=7, drop=1.0)
    i = peaks.select(F.col("peak_date").alias("a"), F.lead("peak_date").over(Window.partitionBy().orderBy("peak_date")).alias("b")).dropna()
    days = i.select("a", F.explode(F.sequence("a", "b")).alias("price_date"))
    low = lambda df, *by: df.join(days, "price_date").groupBy("a", *by).agg(F.min_by("price_date", F.struct("price", "price_date")).alias("low"))
    brands, metro = low(panel.mean_price(t.panel, "brand"), "brand"), low(t.metro).withColumnRenamed("low", "metro_low")
    return brands.join(metro, "a").groupBy("brand").agg(F.median(F.datediff("low", "metro_low")).alias("median_lag"), F.count(F.lit(1)).alias("cycles"))


def names(t: Tables) -> tuple[list[str], list[str]]:
    """Councils and brands: the given nations and regions."""
    return tuple(sorted(r[0] for r in t.stations.select(c).distinct().collect()) for c in ("council", "brand"))


@query()
def locked_features(t: Tables) -> DataFrame:
    """TS17: label rows with all feature columns; classes are those of the day itself."""
    classes = cl.classify_every_day(t.panel)
    return features.assemble(cl.labels(t.stored_daily).select("station_code", "price_date", "label", "today", "future_min"), t.panel, classes, t.tgp, *names(t))


@query()
def frame_contract(t: Tables) -> DataFrame:
    """PRJ19, PRJ20: each column of the feature frame with its role and its values; a column without a role is an error."""
    frame = locked_features(t)
    councils, brands = names(t)
    keys, model = ["station_code", "price_date", "label", "today", "future_min"], features.locked(councils)
    held = [c for c in features.columns(councils, brands) if c not in model]
    if left := metrics.unclassified(frame.columns, keys, model, held):
        raise ValueError(f"columns without a role: {left}")
    counts = frame.agg(*[F.count(c).alias(c) for c in frame.columns])
    role = F.when(F.col("column").isin(model), "model").when(F.col("column").isin(keys), "key").otherwise("held out")
    return counts.unpivot([], frame.columns, "column", "values").withColumn("role", role)


#: The cycle's state from the metro's turns, and what it makes of every station's day.
_STATE = _TURNS + """, pk AS (SELECT peak_date, confirmed_on, lag(peak_date) OVER (ORDER BY peak_date) AS prev FROM peaks),
st AS (SELECT m.price_date, count(*) AS n, max(peak_date) AS last_peak, min(peak_date) AS first_peak, max(prev) AS prev FROM m JOIN pk ON confirmed_on <= m.price_date GROUP BY 1 HAVING count(*) >= 2),
bd AS (SELECT prev, peak_date, min(price) AS lo, max(price) AS hi FROM pk JOIN m ON price_date >= prev AND price_date < peak_date GROUP BY 1, 2),
cy AS (SELECT st.price_date, st.price_date - last_peak AS since, n, round(CAST(last_peak - first_peak AS DOUBLE) / (n - 1), 2) AS len, lo, hi FROM st JOIN bd ON bd.prev = st.prev AND bd.peak_date = st.last_peak),
us AS (SELECT *, round(since / len, 4) AS pct, median(len) OVER (ORDER BY price_date RANGE BETWEEN INTERVAL 730 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING) AS usual FROM cy),
ds AS (SELECT station_code, price_date, decicents / 10 AS p, since, len, pct, since / usual AS elongation, CASE WHEN since > 0 THEN (decicents / 10 - hi) / since END AS slope FROM daily JOIN us USING (price_date))"""


def turn_state(t: Tables) -> tuple[DataFrame, DataFrame]:
    """The metro mean, rounded, and the cycle's state on each day from its turns: a detector in place of the usual one."""
    metro = storage.stored(t.metro.withColumn("price", F.round("price", 6)), "metro")
    return metro, storage.stored(features.cycle_features(metro, cycles.turning_peaks), "turn-state")


def station_days(t: Tables, state: DataFrame) -> DataFrame:
    return shapes.descents(t.daily.select("station_code", "price_date", (F.col("decicents") / 10).alias("station_price")).join(state, "price_date"), state)


@query(f"""WITH {_STATE} SELECT price_date, pct AS cycle_pct_through, since AS cycle_days_since_peak, len AS cycle_mean_length, lo AS cycle_last_min, hi AS cycle_last_max, n AS cycle_peak_count FROM us""")
def turn_features(t: Tables) -> DataFrame:
    """TS17, 2.12: the cycle's feature columns with another detector."""
    state = turn_state(t)[1]
    return state.select("price_date", *[F.col(c).cast("long").alias(c) if c in ("cycle_days_since_peak", "cycle_peak_count") else F.col(c) for c in features.CYCLE])


@query(f"""WITH {_STATE}, sd AS (SELECT price_date, stddev_samp(decicents / 10) AS a FROM daily GROUP BY 1), k AS (SELECT *, CAST(coalesce(elongation > 1 AND slope > -0.9, false) AS INTEGER) AS corner FROM ds)
SELECT station_code, price_date, elongation, slope AS slope_so_far, corner AS shallow_long, round(a * corner, 3) AS px_std_corner, round(a * (1 - corner), 3) AS px_std_other,
 round(CASE WHEN slope IS NOT NULL THEN a * elongation * greatest(0, slope + 0.9) END, 3) AS px_std_smooth FROM k LEFT JOIN sd USING (price_date)""")
def descent_shapes(t: Tables) -> DataFrame:
    """TS14: length and slope of each station's descent so far, its long and shallow corner, and the dispersion inside and outside it."""
    _, state = turn_state(t)
    rows = shapes.interactions(station_days(t, state).join(panel.dispersion(t.daily), "price_date", "left"), "px_std")
    return rows.select("station_code", "price_date", "elongation", "slope_so_far", "shallow_long", *[F.round(f"px_std_{c}", 3).alias(f"px_std_{c}") for c in ("corner", "other", "smooth")])


@query(f"""WITH {_STATE}, fo AS (SELECT CAST(range AS INTEGER) AS fold, DATE '1996-01-01' + CAST(730 + 90 * range AS INTEGER) AS val_start, DATE '1996-01-01' + CAST(819 + 90 * range AS INTEGER) AS val_end FROM range(12)),
g AS (SELECT *, (p - lag(p, 14) OVER (PARTITION BY station_code ORDER BY price_date)) / 14 AS back FROM ds), u AS (SELECT fold, station_code, median(len) AS usual FROM g JOIN fo ON price_date < val_start GROUP BY 1, 2)
SELECT fold, count(*) AS n, round(median(back) FILTER (back < 0), 4) AS gradient, round(avg(CAST(pct < 0.5 AS INTEGER)), 4) AS descent_share, round(median(slope) FILTER (pct < 0.5 AND since > 0), 4) AS cycle_slope, round(median(since / usual), 4) AS elongation
FROM g JOIN fo ON price_date BETWEEN val_start AND val_end LEFT JOIN u USING (fold, station_code) GROUP BY 1""")
def fold_descents(t: Tables) -> DataFrame:
    """WN24: positional and cycle-anchored slopes, descending share and elongation of each fold."""
    _, state = turn_state(t)
    found = shapes.fold_shapes(station_days(t, state), metrics.folds(t.spark, "1996-01-01", 12, 730, 90, 90, 7))
    return found.select("fold", "n", *[F.round(c, 4).alias(c) for c in ("gradient", "descent_share", "cycle_slope", "elongation")])


@query(f"""WITH {_TURNS}, e AS (SELECT m.price_date, m.price, last_value(tgp IGNORE NULLS) OVER w AS up, (m.price - lag(m.price, 7) OVER w) / 7 AS slope, anchor_date IS NOT NULL AS low FROM m LEFT JOIN tgp ON tgp_date = m.price_date LEFT JOIN lows ON anchor_date = m.price_date WINDOW w AS (ORDER BY m.price_date)),
nl AS (SELECT m.price_date, min(anchor_date) AS next FROM m JOIN lows ON anchor_date >= m.price_date GROUP BY 1), arms AS (SELECT DISTINCT m.price_date FROM peaks JOIN nl ON nl.price_date = peak_date JOIN m ON m.price_date BETWEEN peak_date AND next),
d AS (SELECT e.*, e.price - up AS gap, e.price - x.price AS depth, next - e.price_date AS days, a.price_date IS NOT NULL AS falling FROM e LEFT JOIN nl USING (price_date) LEFT JOIN m x ON x.price_date = next LEFT JOIN arms a ON a.price_date = e.price_date),
f AS (SELECT *, gap / -slope AS est FROM d WHERE falling AND slope < -0.1 AND gap IS NOT NULL)
SELECT (SELECT count(*) FROM f) AS descending, (SELECT round(corr(gap, depth) ** 2, 4) FROM f) AS r2_depth, (SELECT round(corr(gap, days) ** 2, 4) FROM f) AS r2_days, (SELECT round(corr(est, days) ** 2, 4) FROM f) AS r2_projection,
 count(gap) FILTER (low) AS lows, round(avg(gap) FILTER (low), 4) AS kiss_mean, round(stddev_samp(gap) FILTER (low), 4) AS kiss_sd, round(quantile_cont(gap, 0.1) FILTER (low), 4) AS kiss_p10, round(quantile_cont(gap, 0.5) FILTER (low), 4) AS kiss_p50, round(quantile_cont(gap, 0.9) FILTER (low), 4) AS kiss_p90 FROM d""")
def gap_diagnosis(t: Tables) -> DataFrame:
    """TS16: what the gap to the upstream price tells of the way down that is left, and the gaps at the lows."""
    peaks, lows, _ = turns(t)
    mark = lambda df: df.withColumn("series", F.lit("metro"))
    rows = shapes.before_troughs(mark(t.metro.withColumn("price", F.round("price", 6))), t.tgp, mark(peaks), mark(lows), ["series"])
    return shapes.gap_diagnosis(rows, ["series"]).drop("series")
