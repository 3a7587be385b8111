"""Queries that try candidate features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions.stats import log_loss
from tidewell.operators import panel, trials
from tidewell.registry import query
from tidewell.sources import files
from tidewell.sources.adapter import Tables


def _features(rows: DataFrame) -> DataFrame:
    m = panel.mean_price(rows)
    return m.select("price_date", F.round("price", 6).alias("price"), F.round(panel.calendar_delta(m, "price", 3), 6).alias("delta"))


@query("SELECT 'leakfree' AS feature, CAST(0 AS BIGINT) AS changed, count(*) AS days FROM metro UNION ALL SELECT 'leaky', CAST(1 AS BIGINT), count(*) FROM metro WHERE price_date <= DATE '1999-06-30'")
def pit_check(t: Tables) -> DataFrame:
    """EX1: a feature of the past doesn't change when the future is cut off; a central difference does, on the last day."""
    clean = trials.leaks(_features, t.daily, "1999-06-30").where("side = 'whole'").agg(F.count(F.lit(1)).alias("changed"))
    leaky = trials.leaks(lambda r: panel.gradient(panel.mean_price(r), "price").select("price_date", F.round("gradient", 6).alias("g")), t.daily, "1999-06-30").where("side = 'whole'").agg(F.count(F.lit(1)).alias("changed"))
    days = t.metro.agg(F.count(F.lit(1)).alias("days")).scalar()
    upto = t.metro.where("price_date <= '1999-06-30'").agg(F.count(F.lit(1)).alias("days")).scalar()
    return clean.select(F.lit("leakfree").alias("feature"), "changed", days.alias("days")).unionByName(leaky.select(F.lit("leaky").alias("feature"), "changed", upto.alias("days")))


@query("""WITH s AS (SELECT price_date, round(price, 6) AS price, row_number() OVER (ORDER BY price_date) - 1 AS i, count(*) OVER () AS n FROM metro),
x AS (SELECT *, CASE WHEN i // 90 < n // 90 THEN (i // 90 + 4) % (n // 90) * 90 + i % 90 ELSE i END AS j FROM s)
SELECT a.price_date, a.price, b.price AS placebo FROM x a JOIN x b ON b.j = a.i""")
def block_placebo(t: Tables) -> DataFrame:
    """EX3."""
    return trials.block_placebo(t.metro.withColumn("price", F.round("price", 6)), "price", 90, 4)


@query("""WITH s AS (SELECT price_date, round(price, 6) AS price, row_number() OVER (ORDER BY price_date) - 1 AS i, count(*) OVER () AS n FROM metro),
d AS (SELECT range + 1 AS draw FROM range(12)), x AS (SELECT draw, price_date, price, i, CASE WHEN i // 90 < n // 90 THEN (i // 90 + draw) % (n // 90) * 90 + i % 90 ELSE i END AS j FROM s, d)
SELECT CAST(a.draw AS INTEGER) AS draw, round(corr(a.price, b.price), 4) AS r, abs(corr(a.price, b.price)) <= 0.6 AS passed FROM x a JOIN x b ON b.j = a.i AND a.draw = b.draw GROUP BY 1""")
def placebo_screen(t: Tables) -> DataFrame:
    """EX4: draws whose values still look like the series are passed over."""
    s = t.metro.withColumn("price", F.round("price", 6))
    draws = None
    for k in range(1, 13):
        one = trials.block_placebo(s, "price", 90, k).withColumn("draw", F.lit(k))
        draws = one if draws is None else draws.unionByName(one)
    r = draws.groupBy("draw").agg(trials.safe_corr("price", "placebo").alias("r"))
    return r.select("draw", F.round("r", 4).alias("r"), (F.abs("r") <= 0.6).alias("passed"))


@query("""WITH c AS (SELECT corr(proba, price) AS a, corr(proba, litres) AS b, corr(price, litres) AS c FROM scores)
SELECT x, y, round(r, 4) AS rho, CASE WHEN abs(r) >= 0.85 THEN 'redundant' ELSE 'pass' END AS verdict FROM (SELECT 'proba' AS x, 'price' AS y, a AS r FROM c UNION ALL SELECT 'proba', 'litres', b FROM c UNION ALL SELECT 'price', 'litres', c FROM c)
UNION ALL SELECT v, 'flat', NULL, 'uncomputable' FROM (VALUES ('proba'), ('price'), ('litres')) AS z(v)""")
def redundancy_screen(t: Tables) -> DataFrame:
    """AG35, EX6: a constant column can't be computed, and doesn't pass."""
    p = trials.redundancy(trials.pairwise(t.scores.withColumn("flat", F.lit(1.0)), ["proba", "price", "litres", "flat"]))
    return p.select(F.col("a").alias("x"), F.col("b").alias("y"), F.round("rho", 4).alias("rho"), "verdict")


@query("""SELECT arm, round(regr_r2(price, litres), 4) AS r2 FROM scores GROUP BY 1""")
def single_r2(t: Tables) -> DataFrame:
    """AG36 with one predictor."""
    return t.scores.groupBy("arm").agg(F.round(F.regr_r2("price", "litres"), 4).alias("r2"))


@query("""WITH d AS (SELECT arm, station_code % 20 AS draw, avg(proba - label) AS v FROM scores GROUP BY 1, 2), o AS (SELECT arm, avg(proba - label) AS observed FROM scores GROUP BY 1)
SELECT d.arm, count(v) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round((max(observed) - avg(v)) / stddev_samp(v), 4) AS z, round(avg(CAST(v < observed AS INTEGER)), 4) AS share_below FROM d JOIN o ON d.arm = o.arm GROUP BY 1""")
def noise_band(t: Tables) -> DataFrame:
    """AG41."""
    v = F.avg(F.col("proba") - F.col("label"))
    d = t.scores.groupBy("arm", F.col("station_code") % 20).agg(v.alias("v"))
    o = t.scores.groupBy("arm").agg(v.alias("observed"))
    return trials.noise_band(d.join(o, "arm"), "v", F.col("observed"), "arm")


@query("""SELECT 'spread' AS "column", count(*) AS rows, count(*) FILTER (label = 1 AND price > 300) AS nulls, round(count(*) FILTER (label = 1 AND price > 300) / count(*), 6) AS null_rate FROM (SELECT price, CASE WHEN price > 300 THEN 1 ELSE 0 END AS label FROM scores)""")
def candidate_check(t: Tables) -> DataFrame:
    """EX2: a candidate computed from its declared inputs, and its share of nulls."""
    c = trials.Candidate("spread", ["price", "litres"], ["spread"], lambda df: df.withColumn("spread", F.when(F.col("price") <= 300, F.col("price") - F.col("litres"))))
    return trials.validate(c, t.scores).withColumn("null_rate", F.round("null_rate", 6))


@query()
def facts(t: Tables) -> DataFrame:
    """EX9: results of each arm as a nested JSON document, with the stamp that they are to be quoted with."""
    from tidewell.operators.simulate import Tank

    cells = t.scores.groupBy("arm", "fold").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(log_loss("label", "proba")), 6).alias("log_loss"))
    doc = cells.groupBy("arm").agg(F.array_sort(F.collect_list(F.struct("fold", "n", "log_loss"))).alias("folds"))
    return doc.select("arm", F.to_json(F.struct(F.lit(Tank().stamp()).alias("cadence"), "arm", "folds")).alias("facts"))


@query("""WITH d AS (SELECT DISTINCT fold, arm FROM scores WHERE arm <> 'N')
SELECT fold, arm, '/run' AS path FROM d WHERE fold % 2 = 1 UNION ALL SELECT fold, arm, '/parts/0' FROM d""")
def stamp_scan(t: Tables) -> DataFrame:
    """EX10: results written as JSON documents, a file each, and read back: the costs that don't say at which cadence they hold."""
    cpl = F.round(F.sum(F.col("price") * F.col("litres")) / F.sum("litres"), 4)
    said = lambda when: F.when(when, F.lit("1 d")).alias("cadence")
    part = lambda when: F.struct(F.col("cpl").alias("pooled_cpl"), said(when))
    run = F.struct("cpl", said(F.col("fold") % 2 == 0)).alias("run")
    whole = F.struct(run, F.array(part(F.lit(False)), part(F.lit(True))).alias("parts"), said(F.col("arm") == "N"))
    path = files.scratch(t.spark, "results")
    t.scores.groupBy("fold", "arm").agg(cpl.alias("cpl")).select("fold", "arm", F.to_json(whole).alias("document")).write.partitionBy("fold", "arm").text(path)
    found = t.spark.read.schema("document string, fold int, arm string").text(path, wholetext=True)
    return trials.unstamped_results(found)
