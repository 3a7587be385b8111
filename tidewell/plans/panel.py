"""Queries over the price panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators import joins, panel, signals
from tidewell.registry import query
from tidewell.sources.adapter import Tables


@query("""WITH g AS (SELECT price_date, price, lag(price) OVER w AS p, lead(price) OVER w AS n FROM metro WINDOW w AS (ORDER BY price_date))
SELECT price_date, round(price, 4) AS price, round(coalesce((n - p) / 2, n - price, price - p), 4) AS gradient,
       CASE WHEN round(coalesce((n - p) / 2, n - price, price - p), 4) > 0.5 THEN 'BUY' WHEN round(coalesce((n - p) / 2, n - price, price - p), 4) < -0.5 THEN 'WAIT' ELSE 'NEUTRAL' END AS verdict FROM g""")
def metro_verdict(t: Tables) -> DataFrame:
    """TS1, AG1, WN6, DS1: fill, metro mean, gradient, verdict."""
    g = panel.gradient(t.metro, "price").select("price_date", F.round("price", 4).alias("price"), F.round("gradient", 4).alias("gradient"))
    return g.withColumn("verdict", F.when(F.col("gradient") > 0.5, "BUY").when(F.col("gradient") < -0.5, "WAIT").otherwise("NEUTRAL"))


@query("SELECT * FROM daily")
def gap_fill(t: Tables) -> DataFrame:
    return t.daily


@query("SELECT * FROM daily WHERE price_date >= DATE '2001-01-01'")
def gap_fill_since(t: Tables) -> DataFrame:
    return panel.gap_fill_since(t.prices, "2001-01-01", t.last_day)


@query("SELECT price_date, round(price, 4) AS price FROM metro")
def metro_mean(t: Tables) -> DataFrame:
    return t.metro.withColumn("price", F.round("price", 4))


@query("SELECT price_date, round(avg(decicents) / 10, 4) AS price FROM prices GROUP BY 1")
def raw_mean(t: Tables) -> DataFrame:
    return panel.mean_price(t.prices).withColumn("price", F.round("price", 4))


@query("SELECT price_date, round(avg(decicents) / 10, 4) AS price FROM panel WHERE brand IN ('ASIA', 'EUROPE') GROUP BY 1")
def brand_filtered_mean(t: Tables) -> DataFrame:
    return panel.mean_price(t.panel.where(F.col("brand").isin("ASIA", "EUROPE"))).withColumn("price", F.round("price", 4))


@query("SELECT price_date, council, round(avg(decicents) / 10, 4) AS price FROM panel GROUP BY 1, 2 HAVING count(*) >= 3")
def council_mean_floor3(t: Tables) -> DataFrame:
    return panel.mean_price(t.panel, "council", least=3).withColumn("price", F.round("price", 4))


@query("SELECT price_date, brand, median(decicents / 10) AS price FROM panel GROUP BY 1, 2 HAVING count(*) >= 3")
def brand_median(t: Tables) -> DataFrame:
    m = t.panel.groupBy("price_date", "brand").agg(F.median(F.col("decicents") / 10).alias("price"), F.count(F.lit(1)).alias("n"))
    return m.where("n >= 3").drop("n")


@query("SELECT brand, count(DISTINCT station_code) AS stations FROM panel GROUP BY 1 HAVING count(DISTINCT station_code) >= 2")
def distinct_brands(t: Tables) -> DataFrame:
    known = t.prices.select("station_code").distinct()
    return t.stations.join(known, "station_code", "left_semi").groupBy("brand").agg(F.count_distinct("station_code").alias("stations")).where("stations >= 2")


@query("SELECT price_date, council, CAST(sum(decicents) AS BIGINT) AS total, count(*) AS n FROM panel GROUP BY 1, 2 HAVING count(*) >= 3")
def council_sums(t: Tables) -> DataFrame:
    return panel.sums(t.panel, "council")


@query("""WITH own AS (SELECT price_date, council, sum(decicents) AS s, count(*) AS n FROM panel GROUP BY 1, 2), d AS (SELECT price_date, sum(s) AS s, sum(n) AS n FROM own GROUP BY 1), c AS (SELECT DISTINCT council FROM panel),
r AS (SELECT price_date, council, d.s - coalesce(own.s, 0) AS rest, d.n - coalesce(own.n, 0) AS others FROM d CROSS JOIN c LEFT JOIN own USING (price_date, council))
SELECT price_date, council, round(rest / others / 10, 4) AS anchor_price FROM r WHERE others >= 3""")
def loo_anchor(t: Tables) -> DataFrame:
    return panel.leave_one_out(t.panel, "council").withColumn("anchor_price", F.round("anchor_price", 4))


@query("SELECT strftime(price_date, '%Y-%m') AS month, count(DISTINCT station_code) AS stations FROM prices GROUP BY 1 ORDER BY 1 DESC LIMIT 24")
def coverage_by_month(t: Tables) -> DataFrame:
    months = t.prices.groupBy(F.date_format("price_date", "yyyy-MM").alias("month")).agg(F.count_distinct("station_code").alias("stations"))
    return months.orderBy(F.desc("month")).limit(24)


@query("SELECT station_code, strftime(price_date, '%Y-%m') AS month, count(*) AS days FROM daily GROUP BY 1, 2")
def coverage_matrix(t: Tables) -> DataFrame:
    return panel.coverage(t.daily)


@query("""SELECT station_code, count(*) FILTER (quarter(price_date) = 1) AS q1, count(*) FILTER (quarter(price_date) = 2) AS q2,
count(*) FILTER (quarter(price_date) = 3) AS q3, count(*) FILTER (quarter(price_date) = 4) AS q4 FROM daily GROUP BY 1""")
def coverage_pivot(t: Tables) -> DataFrame:
    quarters = t.daily.withColumn("q", F.concat(F.lit("q"), F.quarter("price_date")))
    return quarters.groupBy("station_code").pivot("q", ["q1", "q2", "q3", "q4"]).count().na.fill(0)


@query("SELECT count(*) AS n_rows, count(DISTINCT station_code) AS n_stations, min(price_date) AS first_date, max(price_date) AS last_date, CAST(sum(decicents) AS BIGINT) AS total FROM daily")
def panel_summary(t: Tables) -> DataFrame:
    return t.daily.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("station_code").alias("n_stations"), F.min("price_date").alias("first_date"), F.max("price_date").alias("last_date"), F.sum("decicents").alias("total"))


@query("SELECT price_date, round(stddev_samp(decicents / 10), 4) AS px_std FROM daily GROUP BY 1 HAVING count(*) >= 2")
def network_std(t: Tables) -> DataFrame:
    return panel.dispersion(t.daily).withColumn("px_std", F.round("px_std", 4))


@query("""WITH s AS (SELECT price_date, stddev_samp(decicents / 10) AS px_std FROM daily GROUP BY 1 HAVING count(*) >= 2)
SELECT a.price_date, round(a.px_std, 4) AS px_std, round(a.px_std - b.px_std, 4) AS px_std_delta_3d FROM s a LEFT JOIN s b ON b.price_date = a.price_date - 3""")
def network_std_delta(t: Tables) -> DataFrame:
    s = panel.dispersion(t.daily)
    return s.select("price_date", F.round("px_std", 4).alias("px_std"), F.round(panel.calendar_delta(s, "px_std", 3), 4).alias("px_std_delta_3d"))


@query("""WITH c AS (SELECT price_date, council, avg(decicents) / 10 AS price FROM panel GROUP BY 1, 2)
SELECT price_date, round(stddev_samp(price), 4) AS council_std FROM c GROUP BY 1 HAVING count(*) >= 2""")
def council_std(t: Tables) -> DataFrame:
    """AG12: deviation across councils, over the long form."""
    c = panel.mean_price(t.panel, "council")
    return c.groupBy("price_date").agg(F.round(F.stddev_samp("price"), 4).alias("council_std"), F.count(F.lit(1)).alias("n")).where("n >= 2").drop("n")


@query("""SELECT station_code, max(price_date) FILTER (decicents >= 1750) AS last_high, min(price_date) FILTER (decicents < 1750) AS first_low,
max(price_date) AS last_any FROM prices GROUP BY 1""")
def conditional_bounds(t: Tables) -> DataFrame:
    """AG13: conditional maxima and minima."""
    high = F.col("decicents") >= 1750
    return t.prices.groupBy("station_code").agg(F.max(F.when(high, F.col("price_date"))).alias("last_high"), F.min(F.when(~high, F.col("price_date"))).alias("first_low"), F.max(F.col("price_date")).alias("last_any"))


@query("SELECT council, brand, count(*) AS stations FROM stations GROUP BY 1, 2")
def group_counts(t: Tables) -> DataFrame:
    return t.stations.groupBy("council", "brand").agg(F.count(F.lit(1)).alias("stations"))


@query("""WITH g AS (SELECT council, price_date, price, lag(price) OVER w AS p, lead(price) OVER w AS n FROM (SELECT council, price_date, avg(decicents) / 10 AS price FROM panel GROUP BY 1, 2) WINDOW w AS (PARTITION BY council ORDER BY price_date))
SELECT council, CAST(date_trunc('week', price_date) AS DATE) AS week, round(avg(coalesce((n - p) / 2, n - price, price - p)), 4) AS gradient FROM g GROUP BY 1, 2""")
def gradient_week(t: Tables) -> DataFrame:
    g = panel.gradient(panel.mean_price(t.panel, "council"), "price", by=("council",))
    return g.groupBy("council", F.to_date(F.date_trunc("week", "price_date")).alias("week")).agg(F.round(F.avg("gradient"), 4).alias("gradient"))


@query("""WITH g AS (SELECT price_date, coalesce((lead(price) OVER w - lag(price) OVER w) / 2, lead(price) OVER w - price, price - lag(price) OVER w) AS g FROM metro WINDOW w AS (ORDER BY price_date))
SELECT price_date, round(lag(g, 2) OVER w, 4) AS g1, round(lag(g) OVER w, 4) AS g2, round(g, 4) AS g3 FROM g WINDOW w AS (ORDER BY price_date)""")
def last_gradients(t: Tables) -> DataFrame:
    """WN8: the last three gradients."""
    w = Window.partitionBy().orderBy("price_date")
    g = panel.gradient(t.metro, "price")
    return g.select("price_date", F.round(F.lag("gradient", 2).over(w), 4).alias("g1"), F.round(F.lag("gradient").over(w), 4).alias("g2"), F.round("gradient", 4).alias("g3"))


@query("""SELECT station_code, price_date, decicents - max(decicents) OVER (PARTITION BY station_code ORDER BY price_date RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 7 DAY PRECEDING) AS delta_7d FROM daily""")
def px_lag_self_join(t: Tables) -> DataFrame:
    """JN7: the price exactly seven days before, by a join on unique keys."""
    return joins.exact_lag(t.daily, 7).select("station_code", "price_date", (F.col("decicents") - F.col("decicents_lag")).alias("delta_7d"))


@query("""SELECT station_code, price_date, decicents - max(decicents) OVER (PARTITION BY station_code ORDER BY price_date RANGE BETWEEN INTERVAL 3 DAY PRECEDING AND INTERVAL 3 DAY PRECEDING) AS delta_3d FROM daily""")
def calendar_delta(t: Tables) -> DataFrame:
    """WN9: change from exactly three days before, from the spans of the prices."""
    return panel.filled_delta(t.prices, 3, t.last_day, name="delta_3d")


@query("""WITH d AS (SELECT CAST(unnest(generate_series(CAST((SELECT min(tgp_date) FROM tgp) AS TIMESTAMP), CAST((SELECT max(tgp_date) FROM tgp) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS tgp_date),
f AS (SELECT d.tgp_date, t.tgp FROM d ASOF JOIN tgp t ON d.tgp_date >= t.tgp_date),
s AS (SELECT tgp_date, lag(tgp) OVER (ORDER BY tgp_date) AS known FROM f)
SELECT tgp_date, known - lag(known, 7) OVER (ORDER BY tgp_date) AS tgp_delta_7d FROM s""")
def upstream_pit_delta(t: Tables) -> DataFrame:
    return panel.lagged_delta(t.tgp, "tgp_date", "tgp", 7, "tgp_delta_7d")


@query("""SELECT price_date, quantile_cont(price, 0.5) OVER (ORDER BY price_date RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING) AS baseline FROM (SELECT price_date, round(price, 4) AS price FROM metro)""")
def left_closed_rolling_median(t: Tables) -> DataFrame:
    m = t.metro.withColumn("price", F.round("price", 4))
    return m.select("price_date", F.percentile("price", F.lit(0.5)).over(panel.days_window(start=-30, end=-1)).alias("baseline"))


@query("SELECT price_date, round(avg(price) OVER (ORDER BY price_date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 4) AS smooth FROM metro")
def centered_mean(t: Tables) -> DataFrame:
    return t.metro.select("price_date", F.round(F.avg("price").over(Window.partitionBy().orderBy("price_date").rowsBetween(-3, 3)), 4).alias("smooth"))


@query("""WITH f AS (SELECT station_code, price_date, decicents, coalesce(decicents < lag(decicents) OVER w, false) AS fell FROM prices WINDOW w AS (PARTITION BY station_code ORDER BY price_date)),
i AS (SELECT *, sum(CAST(NOT fell AS INTEGER)) OVER (PARTITION BY station_code ORDER BY price_date) AS island FROM f)
SELECT station_code, price_date, CAST(sum(CAST(fell AS INTEGER)) OVER (PARTITION BY station_code, island ORDER BY price_date) AS BIGINT) AS falls FROM i""")
def runs_islands(t: Tables) -> DataFrame:
    """WN14: length of the present run of falls."""
    fell = t.prices.withColumn("fell", F.coalesce(F.col("decicents") < F.lag("decicents").over(panel.by_station()), F.lit(False)))
    return panel.islands(fell, "fell", ("station_code",), name="falls").select("station_code", "price_date", "falls")


@query("""WITH f AS (SELECT station_code, price_date, decicents - lag(decicents) OVER w >= 100 AS jump FROM prices WINDOW w AS (PARTITION BY station_code ORDER BY price_date))
SELECT station_code, price_date, price_date - max(CASE WHEN jump THEN price_date END) OVER (PARTITION BY station_code ORDER BY price_date) AS days_since FROM f""")
def days_since_jump(t: Tables) -> DataFrame:
    jump = t.prices.withColumn("jump", F.col("decicents") - F.lag("decicents").over(panel.by_station()) >= 100)
    return panel.presence_since(jump, "jump", ("station_code",)).select("station_code", "price_date", F.col("days_since").cast("long").alias("days_since"))


@query("""WITH f AS (SELECT station_code, price_date, decicents, CAST(coalesce(decicents - lag(decicents) OVER w >= 100, false) AS INTEGER) AS reset FROM prices WINDOW w AS (PARTITION BY station_code ORDER BY price_date)),
s AS (SELECT *, CAST(sum(reset) OVER (PARTITION BY station_code ORDER BY price_date) AS BIGINT) AS segment FROM f)
SELECT station_code, segment, min(price_date) AS first_date, max(price_date) AS last_date, count(*) AS n, max(decicents) AS high, min(decicents) AS low, first(decicents ORDER BY price_date) - last(decicents ORDER BY price_date) AS drop FROM s GROUP BY 1, 2""")
def reset_segments(t: Tables) -> DataFrame:
    """WN15: segments between resets, and their shapes."""
    reset = F.coalesce(F.col("decicents") - F.lag("decicents").over(panel.by_station()) >= 100, F.lit(False)).cast("int")
    s = t.prices.withColumn("reset", reset).withColumn("segment", F.sum("reset").over(panel.by_station()))
    return s.groupBy("station_code", "segment").agg(
        F.min(F.col("price_date")).alias("first_date"), F.max(F.col("price_date")).alias("last_date"), F.count(F.lit(1)).alias("n"), F.max("decicents").alias("high"), F.min("decicents").alias("low"),
        (F.min_by("decicents", F.col("price_date")) - F.max_by("decicents", F.col("price_date"))).alias("drop"),
    )


@query("""SELECT station_code, price_date, decicents - lag(decicents, 14) OVER (PARTITION BY station_code ORDER BY price_date) AS slope_14 FROM daily""")
def positional_slope(t: Tables) -> DataFrame:
    return t.daily.select("station_code", "price_date", (F.col("decicents") - F.lag("decicents", 14).over(panel.by_station())).alias("slope_14"))


@query("""SELECT station_code, price_date, median(decicents) OVER (PARTITION BY station_code ORDER BY price_date RANGE BETWEEN INTERVAL 730 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING) AS frozen FROM daily QUALIFY price_date IN (SELECT DATE '1999-01-01' + CAST(90 * range AS INTEGER) FROM range(5))""")
def frozen_baseline(t: Tables) -> DataFrame:
    """WN25: 730-day median before each fold begins, by range join with the folds' first days."""
    starts = F.broadcast(t.spark.range(5).select(F.date_add(F.to_date(F.lit("1999-01-01")), (F.col("id") * 90).cast("int")).alias("fold_start")))
    rows = t.daily.join(starts, F.datediff("fold_start", "price_date").between(0, 730))
    past = F.when(F.col("price_date") < F.col("fold_start"), F.col("decicents"))
    m = rows.groupBy("station_code", "fold_start").agg(F.median(past).alias("frozen"), F.max((F.col("price_date") == F.col("fold_start")).cast("int")).alias("there"))
    return m.where("there = 1").select("station_code", F.col("fold_start").alias("price_date"), "frozen")


@query("""WITH probes AS (SELECT station_code, CAST(make_date(2000, m, 15) AS DATE) AS as_of FROM stations, (SELECT CAST(unnest(generate_series(1, 12)) AS INTEGER) AS m))
SELECT p.station_code, p.as_of, q.price_date, q.decicents FROM probes p ASOF LEFT JOIN prices q ON p.station_code = q.station_code AND p.as_of >= q.price_date""")
def asof_price(t: Tables) -> DataFrame:
    months = F.explode(F.sequence(F.to_date(F.lit("2000-01-15")), F.to_date(F.lit("2000-12-15")), F.expr("interval 1 month")))
    probes = t.stations.select("station_code", months.alias("as_of"))
    return joins.asof(probes, t.prices, "station_code", "as_of", "price_date", ["price_date", "decicents"])


@query("""WITH a AS (SELECT price_date, price FROM (SELECT price_date, avg(decicents) / 10 AS price FROM panel WHERE brand = 'ASIA' GROUP BY 1)), b AS (SELECT price_date, avg(decicents) / 10 AS price FROM panel WHERE brand = 'EUROPE' GROUP BY 1),
d AS (SELECT round(a.price - b.price, 4) AS diff FROM a JOIN b USING (price_date))
SELECT count(*) AS days, count(*) FILTER (diff < -0.1) AS cheaper, count(*) FILTER (abs(diff) <= 0.1) AS equal, count(*) FILTER (diff > 0.1) AS dearer, round(avg(CASE WHEN diff < -0.1 THEN -diff END), 4) AS mean_saving, round(avg(CASE WHEN diff > 0.1 THEN diff END), 4) AS mean_loss FROM d""")
def compare_series(t: Tables) -> DataFrame:
    a = panel.mean_price(t.panel.where("brand = 'ASIA'"))
    b = panel.mean_price(t.panel.where("brand = 'EUROPE'"), name="other")
    return joins.head_to_head(a, b, 0.1)


@query("""WITH a AS (SELECT price_date, avg(decicents) / 10 AS asia FROM panel WHERE brand = 'ASIA' GROUP BY 1), b AS (SELECT tgp_date AS price_date, tgp FROM tgp)
SELECT coalesce(a.price_date, b.price_date) AS price_date, round(asia, 4) AS asia, tgp FROM a FULL JOIN b ON a.price_date = b.price_date""")
def align_series(t: Tables) -> DataFrame:
    """JN16: two series on the union of their days."""
    a = panel.mean_price(t.panel.where("brand = 'ASIA'"), name="asia").withColumn("asia", F.round("asia", 4))
    return a.join(t.tgp.withColumnRenamed("tgp_date", "price_date"), "price_date", "full_outer").select("price_date", "asia", "tgp")


@query("""SELECT station_code, price_date, decicents FROM (SELECT *, row_number() OVER (PARTITION BY station_code ORDER BY price_date DESC) AS k FROM prices) WHERE k <= 5""")
def recent_prices(t: Tables) -> DataFrame:
    """SO2: the last five prices of each station."""
    newest = Window.partitionBy("station_code").orderBy(F.desc("price_date"))
    return t.prices.withColumn("k", F.row_number().over(newest)).where("k <= 5").drop("k")


@query("""SELECT station_code, max(price_date) AS price_date, arg_max(decicents, price_date) AS decicents, count(*) AS events FROM prices GROUP BY 1 ORDER BY 3 DESC NULLS LAST, 1""")
def latest_board(t: Tables) -> DataFrame:
    """SO1: sorted with nulls last."""
    latest = t.prices.groupBy("station_code").agg(F.max(F.col("price_date")).alias("price_date"), F.max_by("decicents", F.col("price_date")).alias("decicents"), F.count(F.lit(1)).alias("events"))
    return latest.orderBy(F.col("decicents").desc_nulls_last(), "station_code")


@query("""WITH k AS (SELECT 'brand' AS kind, brand AS name, count(*) AS n FROM stations GROUP BY 2 UNION ALL SELECT 'council', council, count(*) FROM stations GROUP BY 2),
r AS (SELECT *, CAST(row_number() OVER (ORDER BY CASE kind WHEN 'brand' THEN 0 ELSE 1 END, n DESC, name) AS INTEGER) AS pos, count(*) OVER () AS total FROM k)
SELECT kind, name, n, pos, CAST(total - 10 AS BIGINT) AS hidden FROM r WHERE pos <= 10""")
def capped_series_list(t: Tables) -> DataFrame:
    """SO3: series by priority, the first ten and how many are hidden."""
    kinds = [t.stations.groupBy(F.col(k).alias("name")).agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit(k)) for k in ("brand", "council")]
    order = Window.partitionBy().orderBy(F.when(F.col("kind") == "brand", 0).otherwise(1), F.desc("n"), "name")
    ranked = kinds[0].unionByName(kinds[1]).withColumn("pos", F.row_number().over(order)).withColumn("hidden", F.count(F.lit(1)).over(Window.partitionBy()) - 10)
    return ranked.where("pos <= 10").select("kind", "name", "n", "pos", "hidden")


@query("""WITH a AS (SELECT DISTINCT price_date FROM panel WHERE brand = 'ASIA'), b AS (SELECT DISTINCT tgp_date AS price_date FROM tgp)
SELECT (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS both_days, (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)) AS any_days, (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS only_a""")
def date_sets(t: Tables) -> DataFrame:
    """SE2: intersection, union and difference of two series' days, in one pass over tagged days."""
    a = t.panel.where("brand = 'ASIA'").select("price_date", F.lit(1).alias("a"), F.lit(0).alias("b"))
    b = t.tgp.select(F.col("tgp_date").alias("price_date"), F.lit(0).alias("a"), F.lit(1).alias("b"))
    days = a.unionByName(b).groupBy("price_date").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return days.agg(F.sum(F.col("a") * F.col("b")).alias("both_days"), F.count(F.lit(1)).alias("any_days"), F.sum(F.col("a") * (1 - F.col("b"))).alias("only_a"))


@query("""WITH s AS (SELECT station_code, price_date, decicents / 10 AS p FROM daily WHERE price_date BETWEEN DATE '2000-01-01' AND DATE '2000-03-31'),
r AS (SELECT *, row_number() OVER (PARTITION BY station_code ORDER BY price_date) AS k FROM s)
SELECT station_code, count(*) AS days, round(avg(p), 4) AS mean_price, max(p) AS high, min(p) AS low FROM r GROUP BY 1""")
def window_slice(t: Tables) -> DataFrame:
    """PRJ15: an inclusive range of days."""
    s = t.daily.where(F.col("price_date").between("2000-01-01", "2000-03-31")).withColumn("p", F.col("decicents") / 10)
    return s.groupBy("station_code").agg(F.count(F.lit(1)).alias("days"), F.round(F.avg("p"), 4).alias("mean_price"), F.max("p").alias("high"), F.min("p").alias("low"))


@query("""WITH g AS (SELECT station_code, price_date, decicents - lag(decicents) OVER (PARTITION BY station_code ORDER BY price_date) AS g, row_number() OVER (PARTITION BY station_code ORDER BY price_date DESC) AS k FROM prices),
l AS (SELECT s.council, count(*) AS n, count(*) FILTER (g >= 50) AS big FROM g JOIN stations s USING (station_code) WHERE k = 1 AND g IS NOT NULL GROUP BY 1)
SELECT council, n, big, CASE WHEN big > 0 AND big = n THEN -1 WHEN big > 0 THEN 1 ELSE NULL END AS value, CASE WHEN big > 0 AND big = n THEN 'DONT_BUY' WHEN big > 0 THEN 'BUY' ELSE 'NEUTRAL' END AS signal FROM l""")
def favourites_signal(t: Tables) -> DataFrame:
    """DS1: rises across preferred stations, here those of each council."""
    return signals.favourites(t.prices, t.stations, "council", 50)


@query("""WITH g AS (SELECT price_date, price, coalesce((lead(price) OVER w - lag(price) OVER w) / 2, lead(price) OVER w - price, price - lag(price) OVER w) AS grad,
 min(price) OVER (ORDER BY price_date ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING) AS lo, max(price) OVER (ORDER BY price_date ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING) AS hi,
 (price_date - DATE '1995-01-01') % 28 AS since FROM metro WINDOW w AS (ORDER BY price_date)),
v AS (SELECT price_date, CASE WHEN since / 28.0 > 0.8 THEN 1 WHEN since / 28.0 > 0.4 THEN 0 ELSE -1 END AS cycle,
 CASE WHEN abs(grad) >= 0.5 THEN NULL WHEN since > 14 THEN 1 ELSE -1 END AS flat, CASE WHEN lo IS NULL THEN NULL WHEN round(price, 6) < round(lo + 3, 6) THEN 1 WHEN round(price, 6) > round(hi - 3, 6) THEN -1 ELSE 0 END AS near FROM (SELECT price_date, round(price, 8) AS price, since, round(grad, 6) AS grad, round(lo, 8) AS lo, round(hi, 8) AS hi FROM g))
SELECT price_date, cycle, flat, near, round(m, 4) AS mean_value, CASE WHEN m >= 0.5 THEN 'BUY' WHEN m <= -0.5 THEN 'DONT' ELSE 'WAIT' END AS verdict
FROM (SELECT *, (cycle + coalesce(flat, 0) + coalesce(near, 0)) / CAST(1 + CAST(flat IS NOT NULL AS INTEGER) + CAST(near IS NOT NULL AS INTEGER) AS DOUBLE) AS m FROM v)""")
def combined_signal(t: Tables) -> DataFrame:
    """DS1, DS2: three rules and their mean, on every day of the metro series with a fixed 28-day calendar cycle."""
    w = Window.partitionBy().orderBy("price_date")
    past = w.rowsBetween(-28, -1)
    s = panel.gradient(t.metro, "price").withColumns({"lo": F.min("price").over(past), "hi": F.max("price").over(past), "since": F.datediff(F.col("price_date"), F.lit("1995-01-01")) % 28})
    s = s.select("price_date", F.round("price", 8).alias("price"), F.round("gradient", 6).alias("grad"), F.round("lo", 8).alias("lo"), F.round("hi", 8).alias("hi"), "since")
    v = s.select("price_date", signals.cycle_time(F.col("since") / 28.0).alias("cycle"), signals.flatline([F.col("grad")], F.col("since"), F.lit(28.0)).alias("flat"), signals.near_extremes("price", "lo", "hi", 3.0).alias("near"))
    return signals.combine(v, ["cycle", "flat", "near"])
