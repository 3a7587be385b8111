"""Queries over classes, labels, folds and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import stats
from tidewell.operators import classify as cl
from tidewell.operators import joins, metrics, panel
from tidewell.registry import query
from tidewell.sources.adapter import Tables

_CLASS = """snap AS (SELECT * FROM panel WHERE price_date BETWEEN DATE '1999-03-17' AND DATE '1999-04-30'),
r1 AS (SELECT council, price_date, median(decicents / 10) AS ref FROM snap GROUP BY 1, 2),
c1 AS (SELECT station_code, council, round(median(decicents / 10 - ref), 6) AS premium FROM snap JOIN r1 USING (council, price_date) GROUP BY 1, 2),
r2 AS (SELECT council, price_date, median(decicents / 10) AS ref FROM snap WHERE station_code IN (SELECT station_code FROM c1 WHERE premium BETWEEN -10 AND 10) GROUP BY 1, 2),
c2 AS (SELECT station_code, council, round(median(decicents / 10 - ref), 6) AS premium FROM snap JOIN r2 USING (council, price_date) GROUP BY 1, 2),
cls AS (SELECT station_code, council, premium, CASE WHEN premium > 10 THEN 'Sticky' WHEN premium < -10 THEN 'Discount' ELSE 'Competitive' END AS class
 FROM (SELECT * FROM c2 UNION ALL SELECT * FROM c1 WHERE council NOT IN (SELECT council FROM c2)))"""
_LABELS = """lab AS (SELECT station_code, price_date, decicents / 10 AS today, quantile_cont(decicents / 10, 0.33) OVER (PARTITION BY station_code ORDER BY price_date ROWS BETWEEN 90 PRECEDING AND 1 PRECEDING) AS past_threshold,
 min(decicents / 10) OVER (PARTITION BY station_code ORDER BY price_date ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING) AS future_min, price_date - lag(price_date, 90) OVER w AS back, lead(price_date, 7) OVER w - price_date AS ahead
 FROM daily WINDOW w AS (PARTITION BY station_code ORDER BY price_date)),
labels AS (SELECT station_code, price_date, today, future_min, past_threshold, CAST(round(today, 6) <= round(past_threshold, 6) AND round(future_min, 6) >= round(today - 3, 6) AS INTEGER) AS label FROM lab WHERE back = 90 AND ahead = 7)"""


_HISTORY = """b AS (SELECT min(price_date) AS lo, max(price_date) + 1 AS hi FROM panel),
days AS (SELECT CAST(unnest(generate_series(CAST(lo + 1 AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS snapshot_date FROM b),
snap AS MATERIALIZED (SELECT d.snapshot_date, p.* FROM days d JOIN panel p ON p.price_date >= d.snapshot_date - 45 AND p.price_date < d.snapshot_date),
r1 AS (SELECT snapshot_date, council, price_date, median(decicents / 10) AS ref FROM snap GROUP BY 1, 2, 3),
c1 AS MATERIALIZED (SELECT snapshot_date, station_code, council, round(median(decicents / 10 - ref), 6) AS premium FROM snap JOIN r1 USING (snapshot_date, council, price_date) GROUP BY 1, 2, 3),
r2 AS (SELECT snapshot_date, council, price_date, median(decicents / 10) AS ref FROM snap JOIN c1 USING (snapshot_date, station_code, council) WHERE premium BETWEEN -10 AND 10 GROUP BY 1, 2, 3),
c2 AS MATERIALIZED (SELECT snapshot_date, station_code, council, round(median(decicents / 10 - ref), 6) AS premium FROM snap JOIN r2 USING (snapshot_date, council, price_date) GROUP BY 1, 2, 3),
hist AS MATERIALIZED (SELECT snapshot_date, station_code, council, CASE WHEN premium > 10 THEN 'Sticky' WHEN premium < -10 THEN 'Discount' ELSE 'Competitive' END AS class, premium
FROM (SELECT * FROM c2 UNION ALL SELECT c1.* FROM c1 ANTI JOIN c2 USING (snapshot_date, council)))"""


def snapshot(t: Tables) -> DataFrame:
    return panel.gap_fill_between(t.prices, "1999-03-17", "1999-04-30", t.last_day).join(t.stations, "station_code")


@query(f"WITH {_CLASS} SELECT station_code, council, class, round(premium, 4) AS premium FROM cls")
def classify_snapshot(t: Tables) -> DataFrame:
    return cl.classify(snapshot(t)).withColumn("premium", F.round("premium", 4))


@query(f"WITH {_CLASS} SELECT council, count(*) FILTER (class = 'Competitive') AS competitive, count(*) FILTER (class = 'Discount') AS discount, count(*) FILTER (class = 'Sticky') AS sticky FROM cls GROUP BY 1 HAVING count(*) FILTER (class = 'Competitive') > 0")
def class_counts(t: Tables) -> DataFrame:
    return cl.class_counts(cl.published(cl.classify(snapshot(t))))


@query(f"WITH {_CLASS} SELECT price_date, council, round(avg(decicents) / 10, 4) AS price FROM snap JOIN cls USING (station_code, council) WHERE class <> 'Sticky' GROUP BY 1, 2 HAVING count(*) >= 3")
def fair_council_mean(t: Tables) -> DataFrame:
    """AG3, JN2: mean of the stations that aren't Sticky, of three or more."""
    snap = snapshot(t)
    fair = cl.classify(snap).where("class <> 'Sticky'").select("station_code")
    m = snap.join(fair, "station_code").groupBy("price_date", "council").agg(F.round(F.avg("decicents") / 10, 4).alias("price"), F.count(F.lit(1)).alias("n"))
    return m.where("n >= 3").drop("n")


@query(f"""WITH {_CLASS} SELECT price_date, round(stddev_samp(decicents / 10) FILTER (class = 'Competitive'), 4) AS fair_std,
round(median(decicents / 10) FILTER (class = 'Competitive') - median(decicents / 10) FILTER (class <> 'Competitive'), 4) AS discount_gap FROM snap JOIN cls USING (station_code, council) GROUP BY 1""")
def cohort_dispersion(t: Tables) -> DataFrame:
    """AG11, AG33: dispersion within a cohort, and the gap between two cohorts' medians."""
    snap = snapshot(t)
    rows = snap.join(cl.classify(snap).select("station_code", "class"), "station_code")
    fair, x = F.col("class") == "Competitive", F.col("decicents") / 10
    return rows.groupBy("price_date").agg(F.round(F.stddev_samp(F.when(fair, x)), 4).alias("fair_std"), F.round(F.median(F.when(fair, x)) - F.median(F.when(~fair, x)), 4).alias("discount_gap"))


@query("""WITH r AS (SELECT council, price_date, median(decicents / 10) AS ref FROM panel GROUP BY 1, 2), p AS (SELECT station_code, price_date, decicents / 10 - ref AS premium FROM panel JOIN r USING (council, price_date))
SELECT station_code, price_date, round(median(premium) OVER (PARTITION BY station_code ORDER BY price_date RANGE BETWEEN INTERVAL 45 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING), 4) AS premium FROM p""")
def rolling_premium(t: Tables) -> DataFrame:
    """WN19: the 45-day premium of the first pass, of every day."""
    return cl.rolling_premium(t.panel).withColumn("premium", F.round("premium", 4))


@query(f"WITH {_HISTORY} SELECT snapshot_date, station_code, council, class, round(premium, 4) AS premium FROM hist")
def class_history(t: Tables) -> DataFrame:
    """WN19: classes of both passes on every day."""
    return cl.classify_every_day(t.panel).withColumn("premium", F.round("premium", 4))


@query(f"WITH {_LABELS} SELECT station_code, price_date, round(today, 4) AS today, round(past_threshold, 4) AS past_threshold, round(future_min, 4) AS future_min, label FROM labels")
def label_rows(t: Tables) -> DataFrame:
    r = cl.labels(t.daily)
    return r.select("station_code", "price_date", *[F.round(c, 4).alias(c) for c in ("today", "past_threshold", "future_min")], "label")


@query(f"WITH {_LABELS} SELECT station_code, count(*) AS n, round(avg(label), 4) AS rate, count(*) FILTER (label = 1) IN (0, count(*)) AS stuck FROM labels GROUP BY 1")
def label_rate_station(t: Tables) -> DataFrame:
    n, ones = F.count(F.lit(1)), F.count_if(F.col("label") == 1)
    return cl.labels(t.daily).groupBy("station_code").agg(n.alias("n"), F.round(F.avg("label"), 4).alias("rate"), ((ones == 0) | (ones == n)).alias("stuck"))


@query(f"WITH {_LABELS} SELECT price_date, count(*) AS n, round(avg(label), 4) AS rate FROM labels GROUP BY 1")
def label_rate_day(t: Tables) -> DataFrame:
    return cl.labels(t.daily).groupBy("price_date").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("label"), 4).alias("rate"))


@query(f"""WITH {_LABELS} SELECT CASE WHEN price_date < DATE '1999-01-01' THEN 'train' WHEN price_date BETWEEN DATE '1999-01-08' AND DATE '2000-06-30' THEN 'val' WHEN price_date >= DATE '2000-07-08' THEN 'test' ELSE 'buffer' END AS split, count(*) AS n, CAST(sum(label) AS BIGINT) AS buys FROM labels GROUP BY 1""")
def fixed_split(t: Tables) -> DataFrame:
    """WN22, AG28: splits with buffers, and their class balance."""
    return metrics.fixed_split(cl.labels(t.daily)).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("buys"))


@query("""WITH folds AS (SELECT CAST(range AS INTEGER) AS fold, DATE '1996-01-01' + CAST(730 + 90 * range AS INTEGER) AS val_start FROM range(12)),
x AS (SELECT fold, val_start, val_start - 8 AS train_end, val_start + 89 AS val_end FROM folds)
SELECT fold, val_start, val_end, count(*) FILTER (price_date <= train_end) AS n_train, count(*) FILTER (price_date BETWEEN val_start AND val_end) AS n_val FROM x, prices WHERE price_date <= val_end GROUP BY 1, 2, 3""")
def fold_windows(t: Tables) -> DataFrame:
    """WN21, JN8: expanding folds with a buffer, joined by ranges to the rows."""
    return metrics.fold_counts(t.prices, metrics.folds(t.spark, "1996-01-01", 12, 730, 90, 90, 7))


@query("""WITH taus AS (SELECT CAST(range + 1 AS INTEGER) AS k, (range + 1) * 0.05 AS tau FROM range(19)),
c AS (SELECT k, count(*) FILTER (proba >= tau AND label = 1) AS tp, count(*) FILTER (proba >= tau AND label = 0) AS fp, count(*) FILTER (proba < tau AND label = 1) AS fn, count(*) FILTER (proba < tau AND label = 0) AS tn, count(*) AS n FROM taus, scores GROUP BY 1)
SELECT k, tp, fp, fn, tn, round((tp + fp) / n, 4) AS buy_rate, round(coalesce(tp / nullif(tp + fp, 0), 0), 4) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 4) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 4) AS f1,
round((tp * 6.37 - fp * 5.80 - fn * 11.14) / n, 6) AS expected_cents FROM c""")
def threshold_sweep(t: Tables) -> DataFrame:
    return metrics.threshold_sweep(t.scores)


@query("""WITH taus AS (SELECT CAST(range + 1 AS INTEGER) AS k, (range + 1) * 0.05 AS tau FROM range(19)),
c AS (SELECT k, round((count(*) FILTER (proba >= tau AND label = 1) * 6.37 - count(*) FILTER (proba >= tau AND label = 0) * 5.80 - count(*) FILTER (proba < tau AND label = 1) * 11.14) / count(*), 6) AS e FROM taus, scores GROUP BY 1),
b AS (SELECT k FROM c ORDER BY e DESC, k LIMIT 1)
SELECT m.method, CAST(round(least(0.95, greatest(0.05, k * 0.05 + m.step)), 4) AS DOUBLE) AS tau FROM b, (VALUES ('isotonic', 0.0), ('sigmoid', 0.05), ('raw', 0.05)) AS m(method, step)""")
def pick_tau(t: Tables) -> DataFrame:
    """AG27: the best threshold, moved up for smooth calibrations, within bounds."""
    return metrics.pick_tau(metrics.threshold_sweep(t.scores))


@query("""WITH q AS (SELECT list_distinct(quantile_cont(proba, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS e FROM scores),
b AS (SELECT proba, label, CAST(len(list_filter(e, lambda x: x <= proba)) AS INTEGER) AS bin FROM scores, q)
SELECT bin, count(*) AS n, round(avg(proba), 4) AS mean_pred, round(avg(label), 4) AS actual, round(avg(label) - avg(proba), 4) AS gap FROM b GROUP BY 1""")
def reliability(t: Tables) -> DataFrame:
    return metrics.reliability(t.scores, "proba", "label")


@query("""SELECT fold, count(*) AS n, round(avg(-(label * ln(p) + (1 - label) * ln(1 - p))), 6) AS log_loss, round(avg((proba - label) * (proba - label)), 6) AS brier, round(avg(label), 6) AS base_rate FROM (SELECT *, greatest(1e-15, least(1 - 1e-15, proba)) AS p FROM scores) GROUP BY 1""")
def logloss_brier(t: Tables) -> DataFrame:
    d = F.col("proba") - F.col("label")
    return t.scores.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(stats.log_loss("label", "proba")), 6).alias("log_loss"), F.round(F.avg(d * d), 6).alias("brier"), F.round(F.avg("label"), 6).alias("base_rate"))


@query("""WITH c AS (SELECT fold, count(*) FILTER (proba >= 0.5 AND label = 1) AS tp, count(*) FILTER (proba >= 0.5 AND label = 0) AS fp, count(*) FILTER (proba < 0.5 AND label = 1) AS fn, count(*) FILTER (proba < 0.5 AND label = 0) AS tn FROM scores GROUP BY 1)
SELECT *, round(coalesce(tp / nullif(tp + fp, 0), 0), 4) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 4) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 4) AS f1 FROM c""")
def confusion(t: Tables) -> DataFrame:
    return stats.precision_recall(t.scores.groupBy("fold").agg(*stats.confusion(F.col("label"), F.col("proba") >= 0.5)))


@query("""SELECT arm, CAST(sum(CAST(round(litres * 100) AS BIGINT)) AS BIGINT) AS centilitres, round(sum(litres * price) / sum(litres), 4) AS cpl FROM scores GROUP BY 1""")
def pooled_cpl(t: Tables) -> DataFrame:
    return t.scores.groupBy("arm").agg(F.sum(F.round(F.col("litres") * 100).cast("long")).alias("centilitres"), F.round(stats.pooled_ratio(F.col("litres") * F.col("price"), F.col("litres")), 4).alias("cpl"))


@query("""WITH a AS (SELECT fold, arm, sum(litres * price) / sum(litres) AS cpl FROM scores GROUP BY 1, 2) SELECT x.fold, x.arm, round(x.cpl, 4) AS cpl, round(x.cpl - b.cpl, 4) AS delta FROM a x JOIN a b ON x.fold = b.fold AND b.arm = 'N'""")
def fold_deltas(t: Tables) -> DataFrame:
    """JN15, AG31: each arm less the baseline of its fold."""
    return metrics.arm_deltas(t.scores, "N")


@query("""WITH l AS (SELECT fold, seed, arm, avg(-(label * ln(p) + (1 - label) * ln(1 - p))) AS loss FROM (SELECT *, greatest(1e-15, least(1 - 1e-15, proba)) AS p FROM scores) GROUP BY 1, 2, 3),
s AS (SELECT fold, arm, avg(loss) AS mean_loss, median(loss) AS median_loss, stddev_pop(loss) AS seed_std FROM l GROUP BY 1, 2)
SELECT fold, arm, round(mean_loss, 5) AS mean_loss, round(median_loss, 5) AS median_loss, round(seed_std, 5) AS seed_std, seed_std > 5 * median(seed_std) OVER (PARTITION BY arm) AS unstable FROM s""")
def seed_gate(t: Tables) -> DataFrame:
    """AG30-32: losses over seeds, and folds whose spread is far above the median spread."""
    return metrics.seed_gate(t.scores)


@query("""WITH a AS (SELECT fold, arm, avg(-(label * ln(p) + (1 - label) * ln(1 - p))) AS loss FROM (SELECT *, greatest(1e-15, least(1 - 1e-15, proba)) AS p FROM scores) GROUP BY 1, 2),
d AS (SELECT x.arm, x.loss - b.loss AS delta FROM a x JOIN a b ON x.fold = b.fold AND b.arm = 'N' AND x.arm <> 'N')
SELECT arm, count(*) FILTER (delta < 0) AS better, count(*) AS folds, round(avg(delta), 5) AS mean_delta, round(median(delta), 5) AS median_delta, avg(delta) < 0 AND median(delta) < 0 AND count(*) FILTER (delta < 0) * 2 > count(*) AS passed FROM d GROUP BY 1""")
def three_gates(t: Tables) -> DataFrame:
    """AG48."""
    return metrics.three_gates(t.scores, "N")


@query("""WITH t AS (SELECT quantile_cont(price, 0.75) AS q FROM scores) SELECT arm, count(*) FILTER (price >= q) AS hard, count(*) AS n FROM scores, t GROUP BY 1""")
def hard_quartile(t: Tables) -> DataFrame:
    """AG34."""
    limit = t.scores.agg(F.percentile("price", F.lit(0.75))).scalar()
    return t.scores.withColumn("q", limit).groupBy("arm").agg(F.count_if(F.col("price") >= F.col("q")).alias("hard"), F.count(F.lit(1)).alias("n"))


_AHEAD = """d AS (SELECT round((max(decicents) OVER (PARTITION BY station_code ORDER BY price_date RANGE BETWEEN INTERVAL 7 DAY FOLLOWING AND INTERVAL 7 DAY FOLLOWING) - decicents) / 10, 4) AS x FROM daily)"""


@query(f"WITH {_AHEAD} SELECT count(x) AS n, round(avg(x), 4) AS mean, round(quantile_cont(x, 0.25), 4) AS p25, round(quantile_cont(x, 0.5), 4) AS median, round(quantile_cont(x, 0.75), 4) AS p75, round(quantile_cont(x, 0.9), 4) AS p90 FROM d WHERE x > 0")
def cost_fn(t: Tables) -> DataFrame:
    """JN13, AG20: what waiting a week would have cost."""
    return metrics.week_ahead(t.daily).where("x > 0").agg(*stats.summary("x"))


@query(f"WITH {_AHEAD} SELECT count(x) AS n, round(avg(x), 4) AS mean, round(quantile_cont(x, 0.25), 4) AS p25, round(quantile_cont(x, 0.5), 4) AS median, round(quantile_cont(x, 0.75), 4) AS p75, round(quantile_cont(x, 0.9), 4) AS p90 FROM (SELECT -x AS x FROM d WHERE x < 0)")
def cost_fp(t: Tables) -> DataFrame:
    """AG23."""
    return metrics.week_ahead(t.daily).where("x < 0").select((-F.col("x")).alias("x")).agg(*stats.summary("x"))


@query(f"WITH {_AHEAD}, q AS (SELECT quantile_cont(x, 0.95) AS q FROM d) SELECT round(avg(x), 4) AS trimmed_mean, count(*) AS kept FROM d, q WHERE x <= q")
def trimmed_mean(t: Tables) -> DataFrame:
    """AG21."""
    return stats.trimmed_mean(metrics.week_ahead(t.daily), "x")


@query("""WITH w AS (SELECT station_code, price_date, decicents, avg(decicents) OVER n AS m, count(*) OVER n AS k FROM daily WINDOW n AS (PARTITION BY station_code ORDER BY price_date RANGE BETWEEN INTERVAL 1 DAY FOLLOWING AND INTERVAL 7 DAY FOLLOWING))
SELECT station_code, count(*) AS n, round(avg(m - decicents) / 10, 4) AS benefit FROM w WHERE k = 7 GROUP BY 1""")
def cost_tp(t: Tables) -> DataFrame:
    """AG22: mean of the next seven days, all there, less today's."""
    return metrics.week_benefit(t.daily).groupBy("station_code").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("gain") / 10, 4).alias("benefit"))


@query("""SELECT arm, round(corr(proba, price), 4) AS r, round(corr(proba, label), 4) AS r_label FROM scores GROUP BY 1""")
def correlations(t: Tables) -> DataFrame:
    """AG35, guarded against constant columns."""
    return t.scores.groupBy("arm").agg(F.round(stats.safe_corr("proba", "price"), 4).alias("r"), F.round(stats.safe_corr("proba", "label"), 4).alias("r_label"))


@query("""SELECT arm, round((avg(price) FILTER (label = 1) - avg(price) FILTER (label = 0)) / sqrt((var_pop(price) FILTER (label = 1) + var_pop(price) FILTER (label = 0)) / 2), 4) AS smd FROM scores GROUP BY 1""")
def smd(t: Tables) -> DataFrame:
    """AG37."""
    return t.scores.groupBy("arm").agg(F.round(stats.standardised_difference("price", F.col("label") == 1), 4).alias("smd"))


@query("""WITH e AS (SELECT label, CAST(proba >= 0.5 AS INTEGER) AS said, price, litres FROM scores), u AS (UNPIVOT e ON price, litres INTO NAME feature VALUE x)
SELECT feature, round(avg(x) FILTER (label = 1 AND said = 0) - avg(x) FILTER (label = 1 AND said = 1), 4) AS fn_less_tp, round(avg(x) FILTER (label = 0 AND said = 1) - avg(x) FILTER (label = 0 AND said = 0), 4) AS fp_less_tn FROM u GROUP BY 1""")
def error_deltas(t: Tables) -> DataFrame:
    """AG47."""
    return metrics.error_deltas(t.scores, ["price", "litres"])


@query("""WITH c AS (SELECT arm, fold, count(*) AS n, sum(litres * price) / sum(litres) AS cpl FROM scores WHERE l % 7 < 6 GROUP BY 1, 2) SELECT arm, fold, n, CASE WHEN n >= 30 THEN round(cpl, 4) END AS cpl FROM (SELECT arm, fold, n, cpl FROM c)""".replace("WHERE l % 7 < 6 ", ""))
def suppressed_cells(t: Tables) -> DataFrame:
    """AG39, AG40: cells of fewer than 30 rows show no value."""
    n = F.count(F.lit(1))
    return t.scores.groupBy("arm", "fold").agg(n.alias("n"), F.when(n >= 30, F.round(stats.pooled_ratio(F.col("litres") * F.col("price"), F.col("litres")), 4)).alias("cpl"))


@query("""WITH c AS (SELECT arm, fold, sum(litres * price) / sum(litres) AS cpl FROM scores GROUP BY 1, 2) SELECT fold, round(max(cpl) FILTER (arm = 'A') - max(cpl) FILTER (arm = 'R'), 4) AS headroom FROM c GROUP BY 1""")
def headroom(t: Tables) -> DataFrame:
    """AG50: one arm less another, by fold."""
    c = t.scores.groupBy("fold", "arm").agg(stats.pooled_ratio(F.col("litres") * F.col("price"), F.col("litres")).alias("cpl"))
    return c.groupBy("fold").pivot("arm", ["A", "R"]).agg(F.first("cpl")).select("fold", F.round(F.col("A") - F.col("R"), 4).alias("headroom"))


@query("""WITH b AS (SELECT CAST(least(9, floor(proba * 10)) AS INTEGER) AS bin, avg(price) AS m, count(*) AS n FROM scores WHERE fold < 3 GROUP BY 1)
SELECT s.fold, count(*) AS n, round(avg(b.m), 4) AS feature FROM scores s LEFT JOIN b ON b.bin = CAST(least(9, floor(s.proba * 10)) AS INTEGER) WHERE s.fold >= 3 GROUP BY 1""")
def phase_lookup(t: Tables) -> DataFrame:
    """AG46, TS13: bin means of the training rows, looked up for the others."""
    bin_ = F.least(F.lit(9), F.floor(F.col("proba") * 10)).cast("int")
    rows = t.scores.withColumn("bin", bin_)
    means = rows.where("fold < 3").groupBy("bin").agg(F.avg("price").alias("m"))  # ten rows
    return rows.where("fold >= 3").join(F.broadcast(means), "bin", "left").groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("m"), 4).alias("feature"))


@query("""WITH s AS (SELECT fold, station_code, median(proba) AS p, max(label) AS y FROM scores GROUP BY 1, 2) SELECT fold, CAST(least(4, floor(p * 5)) AS INTEGER) AS bucket, count(*) AS n, round(avg(p) - avg(y), 4) AS gap FROM s GROUP BY 1, 2""")
def bucket_gap(t: Tables) -> DataFrame:
    """AG52, AG53: medians by row over seeds, and the calibration gap by bucket."""
    s = t.scores.groupBy("fold", "station_code").agg(F.median("proba").alias("p"), F.max("label").alias("y"))
    return s.groupBy("fold", F.least(F.lit(4), F.floor(F.col("p") * 5)).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p") - F.avg("y"), 4).alias("gap"))


@query("""WITH o AS (SELECT fold, CASE WHEN avg(proba) > 0.5 THEN 'pass' ELSE 'fail' END AS outcome, count(*) AS n FROM scores GROUP BY 1) SELECT outcome, count(*) AS runs, CASE WHEN sum(n) >= 10 THEN round(avg(n), 2) END AS mean_rows FROM o GROUP BY 1""")
def outcome_tally(t: Tables) -> DataFrame:
    """AG42."""
    o = t.scores.groupBy("fold").agg(F.when(F.avg("proba") > 0.5, "pass").otherwise("fail").alias("outcome"), F.count(F.lit(1)).alias("n"))
    return o.groupBy("outcome").agg(F.count(F.lit(1)).alias("runs"), F.when(F.sum("n") >= 10, F.round(F.avg("n"), 2)).alias("mean_rows"))


@query("""WITH x AS (SELECT arm, fold, round(avg(price), 6) AS score, CASE WHEN fold = 2 THEN NULL ELSE round(avg(litres), 6) END AS zone FROM scores GROUP BY 1, 2)
SELECT arm, fold, CAST(row_number() OVER (ORDER BY zone IS NULL, zone DESC, score DESC, arm, fold) AS INTEGER) AS place FROM x""")
def leaderboard(t: Tables) -> DataFrame:
    """SO5: order by a key that may be missing, then by others."""
    x = t.scores.groupBy("arm", "fold").agg(F.round(F.avg("price"), 6).alias("score"), F.when(F.col("fold") != 2, F.round(F.avg("litres"), 6)).alias("zone"))
    return x.select("arm", "fold", F.row_number().over(Window.partitionBy().orderBy(F.col("zone").desc_nulls_last(), F.desc("score"), "arm", "fold")).alias("place"))


@query("""WITH x AS (SELECT p_brand AS feature, round(avg(p_retailprice), 4) AS s FROM part GROUP BY 1), r AS (SELECT *, CAST(row_number() OVER (ORDER BY s DESC, feature) AS INTEGER) AS k, max(s) OVER () AS top FROM x) SELECT feature, s, k FROM r WHERE k <= 6 OR s >= 0.5 * top""", prelude=False)
def hybrid_cutoff(t: Tables) -> DataFrame:
    """WN16, WN17: the first six, and all of half the top score or more."""
    return metrics.hybrid_cutoff(t.table("part").groupBy(F.col("p_brand").alias("feature")).agg(F.round(F.avg("p_retailprice"), 4).alias("s")), "feature", "s")


@query("""SELECT max(n) <= 1 AS market_wide FROM (SELECT price_date, count(DISTINCT decicents) AS n FROM prices GROUP BY 1)""")
def market_wide(t: Tables) -> DataFrame:
    """AG54."""
    return t.prices.groupBy("price_date").agg(F.count_distinct("decicents").alias("n")).agg((F.max("n") <= 1).alias("market_wide"))


@query("""WITH x AS (SELECT p_brand AS feature, p_container FROM (SELECT p_brand, p_type AS p_container, p_size FROM part)), m AS (SELECT p_brand AS a, p_type AS b, sum(p_size) AS w FROM part GROUP BY 1, 2), p AS (SELECT a, w / sum(w) OVER (PARTITION BY a) AS q FROM m) SELECT a, round(-sum(q * ln(q)), 6) AS entropy, round(max(q), 6) AS main_share FROM p GROUP BY 1""", prelude=False)
def interaction_entropy(t: Tables) -> DataFrame:
    """ML10: entropy and main share of a long matrix's rows."""
    m = t.table("part").groupBy(F.col("p_brand").alias("a"), F.col("p_type").alias("b")).agg(F.sum("p_size").alias("w"))
    q = m.withColumn("q", F.col("w") / F.sum("w").over(Window.partitionBy("a")))
    return q.groupBy("a").agg(F.round(-F.sum(F.col("q") * F.log("q")), 6).alias("entropy"), F.round(F.max("q"), 6).alias("main_share"))


@query("""WITH taus AS (SELECT CAST(range + 1 AS INTEGER) AS k FROM range(19)), s AS (SELECT fold, label, CAST(floor(round(proba * 20, 6)) AS INTEGER) AS reach FROM scores),
c AS (SELECT fold, k, round(sum(CASE WHEN reach >= k THEN label * 6.37 - (1 - label) * 5.80 ELSE -label * 11.14 END), 4)::DOUBLE AS value, count(*) AS n FROM taus, s GROUP BY 1, 2),
b AS (SELECT k FROM (SELECT k, round(sum(value), 4) AS v FROM c GROUP BY 1) ORDER BY v DESC, k LIMIT 1)
SELECT fold, arg_max(k, (value, -k)) AS best_k, round((max(value) - max(value) FILTER (k = (SELECT k FROM b))) / max(n), 6) AS regret FROM c GROUP BY 1""")
def regret_by_fold(t: Tables) -> DataFrame:
    """AG51."""
    return metrics.regret(t.scores, "fold")


@query("""SELECT 'l_orderkey' AS "column", count(DISTINCT l_orderkey) AS distinct_values, count(DISTINCT l_orderkey) > 20 AS id_like FROM lineitem UNION ALL SELECT 'l_partkey', count(DISTINCT l_partkey), count(DISTINCT l_partkey) > 20 FROM lineitem
UNION ALL SELECT 'l_suppkey', count(DISTINCT l_suppkey), count(DISTINCT l_suppkey) > 20 FROM lineitem UNION ALL SELECT 'l_linenumber', count(DISTINCT l_linenumber), count(DISTINCT l_linenumber) > 20 FROM lineitem""", prelude=False)
def id_columns(t: Tables) -> DataFrame:
    """PRJ23."""
    return metrics.id_like(t.table("lineitem"))


@query("""WITH u AS (UNPIVOT (SELECT label::DOUBLE AS label, price, litres, proba::DOUBLE AS proba FROM scores) ON price, litres, proba INTO NAME feature VALUE x)
SELECT feature, round(avg(abs(x)), 4) AS mean_abs, round(corr(x, label), 4) AS signed_r, round(avg(CAST(x IS NULL AS INTEGER)), 4) AS null_share FROM u GROUP BY 1""")
def attribution_summary(t: Tables) -> DataFrame:
    """AG38."""
    return metrics.attributions(t.scores, ["price", "litres", "proba"], "label")


@query("""WITH o AS (SELECT price, proba, label, row_number() OVER (ORDER BY litres, order_key, line_no, price, label) - 1 AS i, count(*) OVER () AS n FROM scores), b AS (SELECT *, i // greatest(1, least(50, n // 10)) AS c FROM o),
r AS (SELECT c, 'proba' AS partner, CASE WHEN count(*) >= 3 AND stddev_pop(proba) > 0 AND stddev_pop(price) > 0 THEN corr(price, proba) END AS r FROM b GROUP BY 1
 UNION ALL SELECT c, 'label', CASE WHEN count(*) >= 3 AND stddev_pop(label) > 0 AND stddev_pop(price) > 0 THEN corr(price, label) END FROM b GROUP BY 1)
SELECT partner, count(r) AS chunks, round(sum(abs(r)), 4) AS strength FROM r GROUP BY 1""")
def chunked_interaction(t: Tables) -> DataFrame:
    """WN23: chunks of 50 rows in the order of the litres."""
    return metrics.chunked_interaction(t.scores, "price", ["proba", "label"], "litres", ["order_key", "line_no", "price", "label"])


def _window_classes(day: str) -> str:
    return _CLASS.replace("DATE '1999-03-17' AND DATE '1999-04-30'", f"DATE '{day}' - 45 AND DATE '{day}' - 1")


HEALTH = ("1999-05-01", "1999-08-01", "1999-11-01")


@query(
    "WITH "
    + ", ".join(
        f"h{i} AS (WITH {_window_classes(d)} SELECT DATE '{d}' AS snapshot_date, council, count(*) FILTER (class = 'Competitive') AS competitive, count(*) AS stations FROM cls GROUP BY 2)" for i, d in enumerate(HEALTH)
    )
    + ", h AS (SELECT * FROM h0 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2) SELECT *, min(competitive) OVER (PARTITION BY council) = 0 AS ever_zero FROM h"
)
def class_health(t: Tables) -> DataFrame:
    """AG19: classes at several snapshots, and councils that were ever without a Competitive station."""
    parts = []
    for d in HEALTH:
        day = F.lit(d).cast("date")
        c = cl.classify(t.panel.where(F.col("price_date").between(F.date_sub(day, 45), F.date_sub(day, 1))))
        parts.append(c.groupBy("council").agg(F.count_if(F.col("class") == "Competitive").alias("competitive"), F.count(F.lit(1)).alias("stations")).withColumn("snapshot_date", day))
    h = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return h.withColumn("ever_zero", F.min("competitive").over(Window.partitionBy("council")) == 0)


@query(f"""WITH {_HISTORY}, known AS (SELECT p.*, h.class FROM panel p JOIN hist h ON p.station_code = h.station_code AND p.price_date = h.snapshot_date)
SELECT price_date, council, round(avg(decicents) / 10, 4) AS price FROM known WHERE class <> 'Sticky' GROUP BY 1, 2 HAVING count(*) >= 3""")
def fair_council_history(t: Tables) -> DataFrame:
    """JN2: each day's mean of the stations that the day's own classes don't call Sticky."""
    known = cl.on_its_day(t.panel, cl.classify_every_day(t.panel))
    return panel.mean_price(known.where("class <> 'Sticky'"), "council", least=3).withColumn("price", F.round("price", 4))


@query("""WITH r AS (SELECT fold, arm, CASE WHEN price_date < DATE '1998-07-01' THEN 'before' ELSE 'after' END AS regime, -(label * ln(p) + (1 - label) * ln(1 - p)) AS loss FROM (SELECT *, greatest(1e-15, least(1 - 1e-15, proba)) AS p FROM scores))
SELECT CASE WHEN fold IS NOT NULL THEN 'fold' WHEN regime IS NOT NULL THEN 'regime' ELSE 'arm' END AS axis, coalesce(CAST(fold AS VARCHAR), regime, arm) AS cell, count(*) AS n, round(avg(loss), 6) AS log_loss
FROM r GROUP BY GROUPING SETS ((fold), (regime), (arm))""")
def breakdowns(t: Tables) -> DataFrame:
    """AG40: losses by fold, by regime and by arm, in one pass."""
    rows = t.scores.select(F.col("fold").cast("string").alias("fold"), F.when(F.col("price_date") < "1998-07-01", "before").otherwise("after").alias("regime"), "arm", stats.log_loss("label", "proba").alias("loss"))
    axes = F.explode(F.array(*[F.struct(F.lit(c).alias("axis"), F.col(c).alias("cell")) for c in ("fold", "regime", "arm")])).alias("x")
    return rows.select(axes, "loss").groupBy("x.axis", "x.cell").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("loss"), 6).alias("log_loss"))


@query("""WITH m AS (SELECT station_code, price_date, arm, median(proba) AS p FROM scores GROUP BY 1, 2, 3),
w AS (SELECT station_code, price_date, max(p) FILTER (arm = 'N') AS n, max(p) FILTER (arm = 'A') AS a FROM m GROUP BY 1, 2)
SELECT CAST(floor(n * 4) AS BIGINT) AS bucket, count(*) AS days, round(avg(a - n), 6) AS gap FROM w WHERE n IS NOT NULL AND a IS NOT NULL GROUP BY 1""")
def pivoted_gap(t: Tables) -> DataFrame:
    """AG52: medians over the runs of a row, arms side by side, and their gap by the baseline's bucket."""
    m = t.scores.groupBy("station_code", "price_date", "arm").agg(F.median("proba").alias("p"))
    w = m.groupBy("station_code", "price_date").pivot("arm", ["N", "A"]).agg(F.max("p")).dropna()
    return w.groupBy(F.floor(F.col("N") * 4).alias("bucket")).agg(F.count(F.lit(1)).alias("days"), F.round(F.avg(F.col("A") - F.col("N")), 6).alias("gap"))


@query(f"""WITH {_HISTORY}, known AS (SELECT p.*, h.class FROM panel p JOIN hist h ON p.station_code = h.station_code AND p.price_date = h.snapshot_date),
g AS (SELECT price_date, stddev_samp(decicents / 10) FILTER (class = 'Competitive') AS std, median(decicents / 10) FILTER (class = 'Competitive') - median(decicents / 10) FILTER (class = 'Discount') AS gap FROM known GROUP BY 1),
w AS (SELECT *, max(std) OVER b AS std3, max(gap) OVER b AS gap3 FROM g WINDOW b AS (ORDER BY price_date RANGE BETWEEN INTERVAL 3 DAY PRECEDING AND INTERVAL 3 DAY PRECEDING))
SELECT price_date, round(std, 4) AS px_std, round(std - std3, 4) AS px_std_delta, round(gap, 4) AS discount_gap, round(gap - gap3, 4) AS discount_gap_delta FROM w""")
def triplet(t: Tables) -> DataFrame:
    """TS15: dispersion of the Competitive stations and their distance from the Discount ones, with three-day changes; the phases' spread is in locked_features."""
    known = cl.on_its_day(t.panel, cl.classify_every_day(t.panel))
    x, of = F.col("decicents") / 10, lambda c, v: F.when(F.col("class") == c, v)
    g = known.groupBy("price_date").agg(F.stddev_samp(of("Competitive", x)).alias("px_std"), (F.median(of("Competitive", x)) - F.median(of("Discount", x))).alias("discount_gap"))
    deltas = {f"{c}_delta": panel.calendar_delta(g, c, 3) for c in ("px_std", "discount_gap")}
    return g.withColumns(deltas).select("price_date", *[F.round(c, 4).alias(c) for c in ("px_std", "px_std_delta", "discount_gap", "discount_gap_delta")])


@query(f"WITH {_LABELS} SELECT CAST(year(price_date) AS INTEGER) AS year, count(*) AS rows, CAST(sum(label) AS BIGINT) AS buys, round(avg(today), 4) AS mean_price FROM labels GROUP BY 1")
def frozen_batch(t: Tables) -> DataFrame:
    """EX7: label rows frozen as a batch, checked against its manifest and counted by year."""
    from tidewell.operators import freeze, simulate
    from tidewell.sources.files import scratch

    windows, cadence, keys = metrics.folds(t.spark, "1996-01-01", 4, 1095, 90, 365, 7), simulate.Tank().stamp(), ["station_code", "price_date", "label"]
    path = scratch(t.spark, "batch")
    freeze.freeze(cl.labels(t.daily).select(*keys, "today", "future_min"), path, ["today"], keys, ["future_min"], windows, cadence)
    frame, _ = freeze.thaw(t.spark, path, ["today"], windows, cadence)
    return frame.groupBy(F.year("price_date").alias("year")).agg(F.count(F.lit(1)).alias("rows"), F.sum("label").alias("buys"), F.round(F.avg("today"), 4).alias("mean_price"))


@query("""WITH x AS (SELECT p_brand AS feature, round(avg(p_retailprice), 4) AS s, round(corr(p_size, p_retailprice), 4) AS r, CASE WHEN count(*) % 2 = 0 THEN min(p_partkey) END AS k FROM part GROUP BY 1)
SELECT 'size' AS mode, feature, CAST(row_number() OVER (ORDER BY s DESC, feature) AS INTEGER) AS place FROM x UNION ALL SELECT 'alpha', feature, row_number() OVER (ORDER BY feature) FROM x
UNION ALL SELECT 'sign', feature, row_number() OVER (ORDER BY sign(coalesce(r, 0)) DESC, s DESC, feature) FROM x UNION ALL SELECT 'rank', feature, row_number() OVER (ORDER BY k NULLS LAST, s DESC, feature) FROM x""", prelude=False)
def summary_orders(t: Tables) -> DataFrame:
    """SO4: a summary in each of its orders."""
    rank = F.when(F.count(F.lit(1)) % 2 == 0, F.min("p_partkey"))
    x = t.table("part").groupBy(F.col("p_brand").alias("feature")).agg(F.round(F.avg("p_retailprice"), 4).alias("size"), F.round(F.corr("p_size", "p_retailprice"), 4).alias("r"), rank.alias("rank"))
    return metrics.summary_orders(x)
