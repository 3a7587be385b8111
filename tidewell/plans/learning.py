"""Queries that fit models; rows only, held to invariants by tests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions import stats
from tidewell.operators import models
from tidewell.registry import query
from tidewell.sources.adapter import Tables

FEATURES = ["proba", "price", "litres"]


def rows(t: Tables) -> DataFrame:
    return t.scores.select("fold", "seed", "arm", "price_date", "label", F.col("proba").alias("proba"), "price", "litres")


def renamed(t: Tables) -> DataFrame:
    return rows(t).withColumnRenamed("proba", "signal")


USE = ["signal", "price", "litres"]


@query()
def logistic_folds(t: Tables) -> DataFrame:
    """ML1, ML3, ML5: out-of-fold losses of a logistic regression."""
    return models.score(models.out_of_fold(models.logistic(USE), renamed(t), "fold", [0, 1, 2, 3, 4]), "label", "proba", "fold")


@query()
def boosted_test(t: Tables) -> DataFrame:
    """ML2, ML7: boosted trees, trained on some folds, scored on another."""
    r = renamed(t)
    model = models.boosted(USE, rounds=10, depth=3).fit(r.where("fold < 4"))
    return models.score(models.predict(model, r.where("fold = 4")), "label", "proba", "arm")


@query()
def calibrated(t: Tables) -> DataFrame:
    """ML4."""
    method, out = models.calibrate(rows(t).select("fold", "label", "proba"))
    return models.score(out, "label", "calibrated", "fold").withColumn("method", F.lit(method))


@query("""WITH c AS (SELECT count(*) AS n, corr(price, litres) AS a, corr(price, proba) AS b, corr(litres, proba) AS c FROM scores) SELECT n, round((a * a + b * b - 2 * a * b * c) / (1 - c * c), 6) AS r2 FROM c""")
def explained_variance(t: Tables) -> DataFrame:
    """AG36 with many predictors."""
    x = models.r2(t.scores, "price", ["litres", "proba"])
    return t.scores.agg(F.count(F.lit(1)).alias("n")).withColumn("r2", F.round(F.lit(x), 6))


@query()
def feature_clusters(t: Tables) -> DataFrame:
    """ML9: columns that go together, by average linkage of their correlations; a column's cluster is a number."""
    import numpy as np

    from tidewell.operators import trials

    s = t.scores.select("price", "litres", "proba", (F.col("price") * 1.1 + F.col("litres")).alias("gross"), (F.col("price") + F.col("proba")).alias("near_price"))
    names = s.columns
    rho = np.eye(len(names))
    for r in trials.pairwise(s, names).collect():  # a row for each two columns
        i, j = names.index(r.a), names.index(r.b)
        rho[i, j] = rho[j, i] = r.rho or 0.0
    found = models.clusters(names, rho, 0.5)
    label = F.lit(None).cast("int")
    for k, group in enumerate(found):
        label = F.when(F.col("feature").isin(group), k).otherwise(label)
    long = s.agg(*[F.avg(c).alias(c) for c in names]).unpivot([], names, "feature", "mean")
    return long.withColumn("cluster", label)


def _windows(t: Tables, n: int = 2) -> DataFrame:
    """Years of validation windows of 90 days, each behind all the days before it."""
    from tidewell.operators import metrics

    return metrics.folds(t.spark, "1996-01-01", n, 1095, 90, 365, 7)


ARMS = {"base": ["today", "gap"], "trial": ["today", "gap", "delta_7d"]}


@query()
def paired_backtest(t: Tables) -> DataFrame:
    """ML12: two arms over two folds, with what each would have paid at its own threshold and at the baseline's."""
    from tidewell.operators import backtest, simulate

    return backtest.paired_backtest(price_frame(t), t.stored_daily, _windows(t), ARMS, "base", backtest.Setup(simulate.Tank()))


@query()
def cached_backtest(t: Tables) -> DataFrame:
    """ML12: the same where the first fold's baseline has been fitted and kept before, arms pooled over the folds."""
    from tidewell.operators import backtest, simulate
    from tidewell.sources.files import scratch

    frame, setup, cache = price_frame(t), backtest.Setup(simulate.Tank()), backtest.FoldCache(scratch(t.spark, "folds"))
    backtest.paired_backtest(frame, t.stored_daily, _windows(t, 1), {"base": ARMS["base"]}, "base", setup, cache)
    got = backtest.paired_backtest(frame, t.stored_daily, _windows(t), ARMS, "base", setup, cache)
    return backtest.pooled(got, "base")


@query()
def fit_stability(t: Tables) -> DataFrame:
    """EX5: what the seed of boosted trees alone changes in the realised cost, two pairs of seeds over two folds."""
    from tidewell.operators import backtest, simulate

    make = lambda use, seed: models.boosted(use, rounds=3, depth=3, seed=seed)
    setup = backtest.Setup(simulate.Tank(), inner=2, make=make, method="boosted")
    return backtest.fit_stability(price_frame(t), t.stored_daily, _windows(t), ["today", "gap"], setup, [1, 2], [3, 4])


def price_frame(t: Tables) -> DataFrame:
    """Label rows with three features, stored: the model queries below pass over them many times."""
    from tidewell.operators import classify, panel, storage

    daily = t.stored_daily
    delta = (F.round(F.col("today") * 10).cast("int") - F.col("before")).cast("double")
    frame = classify.labels(daily, lag=7).join(F.broadcast(panel.mean_price(daily)), "price_date").withColumns({"gap": F.col("today") - F.col("price"), "delta_7d": delta})
    return storage.stored(frame.select("station_code", "price_date", "label", "today", "gap", "delta_7d"), "price-frame")


INPUTS = ["today", "gap", "delta_7d"]


def _fitted(t: Tables):
    """(all rows, as models.cells; boosted trees of those before 1999)."""
    seen = models.cells(price_frame(t).withColumn("early", F.col("price_date") < "1999-01-01"), ["early", "label", *INPUTS])
    return seen, models.boosted(INPUTS, rounds=5, depth=6).fit(seen.where("early"))


@query()
def tree_attribution(t: Tables) -> DataFrame:
    """ML8, AG38, WN16: Shapley attributions of boosted trees over all rows, by feature and rank."""
    from pyspark.sql import Window

    from tidewell.operators import attribution

    seen, model = _fitted(t)
    n = F.sum(models.COUNT)
    parts = attribution.attributed(model, seen, INPUTS, [models.COUNT])
    by = parts.groupBy("feature").agg((F.sum(F.abs("attribution") * F.col(models.COUNT)) / n).alias("mean_abs"), stats.safe_corr("value", "attribution", models.COUNT).alias("signed_r"), n.alias("n"))
    return by.withColumn("rank", F.rank().over(Window.partitionBy().orderBy(F.desc("mean_abs"))))  # a row for each feature


@query()
def tree_partners(t: Tables) -> DataFrame:
    """ML8: strength of the interaction of each two features, mean over all rows."""
    from tidewell.operators import attribution

    seen, model = _fitted(t)
    return attribution.partners(model, seen, INPUTS).groupBy("a", "b").agg((F.sum("strength") / F.sum("n")).alias("strength"), F.sum("n").alias("n"))


@query()
def leave_one_feature_out(t: Tables) -> DataFrame:
    """ML6, AG30: losses without each feature over seeds, with a verdict."""
    frame = price_frame(t)
    make = lambda use, seed: models.boosted(use, rounds=3, depth=3, seed=seed)
    found = models.ablation(make, frame, INPUTS, F.col("price_date") < "1999-01-01", F.col("price_date") >= "1999-01-01", [1, 2])
    n = frame.agg(F.count(F.lit(1)).alias("n"))
    return n.select("n", F.inline(F.array(*[F.struct(F.lit(f).alias("left_out"), F.lit(m).alias("mean_loss"), F.lit(d).alias("deviation"), F.lit(v).alias("verdict")) for f, m, d, v in found])))


@query()
def gain_importance(t: Tables) -> DataFrame:
    """ML11: gain importance of the features of boosted trees."""
    frame = price_frame(t)
    model = models.boosted(INPUTS, rounds=5, depth=3).fit(models.cells(frame, ["label", *INPUTS]))
    found = models.importance(model, INPUTS)
    return frame.agg(F.count(F.lit(1)).alias("n")).select("n", F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(float(x)).alias("gain")) for f, x in found])))


@query()
def model_artifact(t: Tables) -> DataFrame:
    """SRC10: a model saved with its contract, loaded again, and its losses by year."""
    from tidewell.sources.files import scratch

    frame = price_frame(t)
    path = scratch(t.spark, "model")
    models.save(models.logistic(INPUTS).fit(frame.where("price_date < '1999-01-01'")), path, INPUTS, 0.5)
    model, features, _ = models.load(t.spark, path)
    return models.score(models.predict(model, frame.select("price_date", "label", *features)).withColumn("year", F.year("price_date")), "label", "proba", "year")


@query("""SELECT station_code, price_date, decicents / 10 AS today FROM daily""")
def frame_artifact(t: Tables) -> DataFrame:
    """SNK5, SRC8: a frame written as CSV and Parquet, and read back from the newer one."""
    from tidewell.operators import panel, storage
    from tidewell.sources.files import scratch

    path = scratch(t.spark, "frame")
    rows = panel.filled(storage.stored(panel.spans(t.prices, t.last_day), "spans"))
    storage.save_frame(rows.select("station_code", "price_date", (F.col("decicents") / 10).alias("today")), path)
    return storage.load_frame(t.spark, path, "station_code long, price_date date, today double")


@query()
def placebo_floor(t: Tables) -> DataFrame:
    """EX5: what placebo draws of the metro mean change in the realised cost of a fold."""
    from tidewell.operators import backtest, panel, simulate

    return backtest.noise_floor(price_frame(t), panel.mean_price(t.stored_daily), "price", t.stored_daily, _windows(t, 1), ["today", "gap"], backtest.Setup(simulate.Tank()), [1, 2])


@query()
def candidate_trial(t: Tables) -> DataFrame:
    """EX8: a candidate feature with its status and the reason."""
    from tidewell.operators import backtest, trials

    frame = price_frame(t)
    c = trials.Candidate("gap_squared", ["gap"], ["gap_squared"], lambda df: df.withColumn("gap_squared", F.col("gap") * F.col("gap")))
    status, reason = backtest.try_candidate(c, frame, INPUTS, "price_date < '1999-01-01'", "price_date >= '1999-01-01'", "1998-06-30")
    return frame.agg(F.count(F.lit(1)).alias("rows")).select(F.lit("gap_squared").alias("candidate"), F.lit(status).alias("status"), F.lit(reason).alias("reason"), "rows")


@query()
def family_verdicts(t: Tables) -> DataFrame:
    """AG49: each arm's z against placebo groups, and the critical z for the best of all arms."""
    from tidewell.operators import trials

    v = F.avg(F.col("proba") - F.col("label"))
    draws = t.scores.groupBy("arm", F.col("station_code") % 20).agg(v.alias("v"))
    band = trials.noise_band(draws.join(t.scores.groupBy("arm").agg(v.alias("observed")), "arm"), "v", F.col("observed"), "arm")
    critical = F.lit(trials.family_z(0.95, 3, 20))
    return band.select("arm", "z", critical.alias("critical_z"), (F.abs("z") > critical).alias("beyond"))
