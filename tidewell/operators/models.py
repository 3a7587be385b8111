"""Models by Spark's machine learning library: fits, folds, calibration, ablation, importance, clusters of features.

A fit passes over its rows many times, but doesn't tell rows apart that are equal in its columns. So the rows are counted first, and what is
fitted are the distinct ones, with their counts as weights (see cells): linear models have the same loss, trees the same sums.
"""

from __future__ import annotations

from functools import reduce
from operator import and_
from weakref import WeakKeyDictionary

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, LogisticRegression
from pyspark.ml.feature import Bucketizer, Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor, IsotonicRegression, LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.functions.stats import log_loss
from tidewell.operators.storage import stored
from tidewell.shipping import ship

#: Values at equal steps of a stored frame's columns, for as long as the frame is there: fits of other features and seeds share them.
_known: WeakKeyDictionary = WeakKeyDictionary()
#: How many rows a row stands for; a frame without the column has them one by one.
COUNT = "_count"
#: Buckets of a feature that trees may split between.
BINS = 32
#: Candidate thresholds are taken from the values at so many equal steps of all rows.
STEPS = 1024


def counted(rows: DataFrame) -> Column:
    return F.col(COUNT) if COUNT in rows.columns else F.lit(1)


def cells(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The distinct rows of the columns with COUNT, stored."""
    return stored(rows.groupBy(*columns).agg(F.sum(counted(rows)).alias(COUNT)), "cells")


def at_steps(rows: DataFrame, columns: list[str], steps: int) -> list[list[float]]:
    """For each column its least value and those at `steps` equal steps of its rows, exactly; none of a column without values.

    Rows are counted by value, the values dealt to ranges and summed up inside; only the sums of the ranges and the values at the steps
    leave the tasks.
    """
    pairs = F.inline(F.array(*[F.struct(F.lit(i).alias("_c"), F.col(c).cast("double").alias("_v")) for i, c in enumerate(columns)]))
    values = rows.select(counted(rows).alias("_k"), pairs).where("_v is not null and not isnan(_v)").groupBy("_c", "_v").agg(F.sum("_k").alias("_n"))
    ranges = stored(values.repartitionByRange("_c", "_v").withColumn("_range", F.spark_partition_id()), "values")
    before, every = Window.partitionBy("_c").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("_c")
    sums = ranges.groupBy("_c", "_range").agg(F.sum("_n").alias("_sum"))
    sums = sums.select("_c", "_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"), F.sum("_sum").over(every).alias("_all"))
    place = F.col("_before") + F.sum("_n").over(Window.partitionBy("_c", "_range").orderBy("_v"))
    found = ranges.join(F.broadcast(sums), ["_c", "_range"]).withColumn("_place", place)
    step = lambda x: F.floor(x * steps / F.col("_all"))
    found = found.withColumn("_steps", step(F.col("_place")) - step(F.col("_place") - F.col("_n")) + (F.col("_place") == F.col("_n")).cast("int")).where("_steps > 0")
    out: list[list[float]] = [[] for _ in columns]
    for r in found.select("_c", "_v", "_steps").orderBy("_c", "_v").collect():
        out[r._c] += [r._v] * r._steps
    return out


class Logistic(Pipeline):
    """See logistic."""

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        vector, scale, linear = self.getStages()
        features, label = vector.getInputCols(), linear.getLabelCol()
        rows = cells(dataset, list(dict.fromkeys([*features, label])))
        # the scale knows no weights: two rows have the mean and deviation of all
        there = reduce(and_, [F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double")) for f in features])
        whole, n = rows.where(there), F.sum(COUNT)
        mean = whole.agg(*[(F.sum(F.col(f) * F.col(COUNT)) / n).alias(f) for f in features]).first()
        off = lambda f: F.col(f) - F.lit(mean[f]).cast("double")
        half = whole.agg(*[F.sqrt(F.coalesce(F.try_divide(F.sum(off(f) * off(f) * F.col(COUNT)), n - 1), F.lit(0.0)) / 2).alias(f) for f in features]).first()
        two = dataset.sparkSession.createDataFrame([tuple(float(mean[f] or 0) + k * half[f] for f in features) for k in (-1, 1)], ", ".join(f"`{f}` double" for f in features))
        scaled = scale.fit(vector.transform(two))
        return PipelineModel([vector, scaled, linear.fit(scaled.transform(vector.transform(rows)))])


def logistic(features: list[str], label: str = "label", penalty: float = 1e-4) -> Pipeline:
    """Standardised logistic regression with an L2 penalty per row; rows without a feature are left out."""
    return Logistic(stages=[
        VectorAssembler(inputCols=features, outputCol="_raw", handleInvalid="skip"), StandardScaler(inputCol="_raw", outputCol="_x", withMean=True),
        LogisticRegression(featuresCol="_x", labelCol=label, regParam=penalty, maxIter=50, weightCol=COUNT, standardization=False),
    ])


def thresholds(values: list[float], most: int) -> list[float]:
    """Middles between neighbouring values, `most` of them at equal shares of the values, or all if there are fewer."""
    v, n = np.unique(np.asarray(values, dtype=float), return_counts=True)
    middle, below = (v[:-1] + v[1:]) / 2, np.cumsum(n)[:-1]
    if len(middle) > most:
        middle = middle[np.unique([np.abs(below - k * n.sum() / (most + 1)).argmin() for k in range(1, most + 1)])]
    return sorted(set(middle[np.isfinite(middle)].tolist()))


class Boosted(Pipeline):
    """See boosted."""

    def __init__(self, features: list[str], label: str, rounds: int, depth: int, seed: int, share: float = 0.8, step: float = 0.1):
        super().__init__()
        self.features, self.label, self.rounds, self.depth, self.seed, self.share, self.step = features, label, rounds, depth, seed, share, step

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        features, spark = self.features, dataset.sparkSession
        filled, bins = [f"_filled_{f}" for f in features], [f"_bin_{f}" for f in features]
        rows = dataset.select(self.label, *[F.col(f).cast("double").alias(f) for f in features], counted(dataset).alias(COUNT))
        known = _known.setdefault(dataset, {}) if COUNT in dataset.columns else {}
        new = [f for f in features if f not in known]
        known.update(zip(new, at_steps(rows, new, STEPS) if new else [], strict=True))
        values = [known[f] for f in features]
        medians = spark.createDataFrame([tuple(v[STEPS // 2] if v else None for v in values)], ", ".join(f"`{f}` double" for f in features))
        fill = Imputer(inputCols=features, outputCols=filled, strategy="median").fit(medians)
        edges = [thresholds(v, BINS - 1) or [0.0] for v in values]
        split = Bucketizer(inputCols=filled, outputCols=bins, splitsArray=[[-np.inf, *e, np.inf] for e in edges])
        vector = VectorAssembler(inputCols=bins, outputCol="_x")
        binned = split.transform(fill.transform(rows)).select(self.label, COUNT, *[F.col(b).alias(b, metadata={}) for b in bins])  # numbers in order, not categories
        trees = self._trees(vector.transform(self._drawn(cells(binned, [self.label, *bins]), bins)))
        jvm, gateway = spark._jvm, spark.sparkContext._gateway
        grown = gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, len(trees))
        weights = gateway.new_array(jvm.double, len(trees))
        for k, (w, tree) in enumerate(trees):
            grown[k], weights[k] = tree._java_obj, w
        model = GBTClassificationModel(jvm.org.apache.spark.ml.classification.GBTClassificationModel(self.uid, grown, weights, len(features), 2))
        return PipelineModel([fill, split, vector, model.setFeaturesCol("_x")])

    def _drawn(self, rows: DataFrame, bins: list[str]) -> DataFrame:
        """rows, stored with `_drawn`: for each tree how many of a cell's rows are drawn, each with the probability `share`."""
        rounds, seed, share = self.rounds, self.seed % 2**32, self.share

        @F.pandas_udf("array<long>")
        def draw(n: pd.Series, key: pd.Series) -> pd.Series:
            # seeded by the cell, so that it doesn't matter how cells are dealt to tasks
            return pd.Series([np.random.default_rng([seed, k % 2**64]).binomial(m, share, rounds) for m, k in zip(n.tolist(), key.tolist(), strict=True)])

        ship(rows.sparkSession)
        return stored(rows.withColumn("_drawn", draw(COUNT, F.xxhash64(self.label, *bins))), "drawn")

    def _trees(self, rows: DataFrame) -> list[tuple[float, DecisionTreeRegressionModel]]:
        """(weight, tree): the first is fitted to the labels as -1 and 1, each other one to what the log loss still asks for."""
        y, margin = F.col(self.label) * 2.0 - 1.0, F.lit(0.0)
        trees: list[tuple[float, DecisionTreeRegressionModel]] = []
        for k in range(self.rounds):
            target = y if k == 0 else 4.0 * y / (1.0 + F.exp(2.0 * y * margin))
            drawn = rows.select("_x", target.alias("_target"), F.col("_drawn")[k].cast("double").alias("_weight")).where("_weight > 0")
            # as many bins as tell all buckets apart, with so many cells looked at for them
            tree = DecisionTreeRegressor(featuresCol="_x", labelCol="_target", weightCol="_weight", predictionCol=f"_tree{k}", maxDepth=self.depth, maxBins=256, seed=self.seed + k).fit(drawn)
            weight = 1.0 if k == 0 else self.step
            rows, margin = tree.transform(rows), margin + weight * F.col(f"_tree{k}")
            trees.append((weight, tree))
        return trees


def boosted(features: list[str], label: str = "label", rounds: int = 20, depth: int = 4, seed: int = 42) -> Pipeline:
    """Boosted trees on 0.8 of the rows each; missing values are imputed by the median.

    The steps are those of Spark's GBTClassifier, with its defaults. A tree only splits a feature between the buckets of BINS - 1
    thresholds, taken from all rows' values, so that rows of the same buckets and label are one cell with a count, of which each tree draws its
    share. However many rows there are, they are passed over twice; cells are at most 2 * BINS ** features.
    """
    return Boosted(features, label, rounds, depth, seed)


def predict(model: PipelineModel, rows: DataFrame, name: str = "proba") -> DataFrame:
    out = model.transform(rows).withColumn(name, vector_to_array("probability")[1])
    return out.drop("probability", "prediction", "rawPrediction", "_raw", "_x", *[c for c in out.columns if c.startswith("_") and c != COUNT])


def out_of_fold(pipeline: Pipeline, rows: DataFrame, fold: str, folds: list[int]) -> DataFrame:
    """Each fold's rows scored by a model of the folds before it; the first fold has none."""
    parts = [predict(pipeline.fit(rows.where(F.col(fold) < k)), rows.where(F.col(fold) == k)) for k in folds[1:]]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def score(rows: DataFrame, label: str = "label", proba: str = "proba", *by: str) -> DataFrame:
    d, n = F.col(proba) - F.col(label), F.sum(counted(rows))
    mean = lambda x: F.try_divide(F.sum(x * counted(rows)), F.sum(F.when(x.isNotNull(), counted(rows))))
    return rows.groupBy(*by).agg(F.coalesce(n, F.lit(0)).alias("n"), mean(log_loss(label, proba)).alias("log_loss"), mean(d * d).alias("brier"), mean(F.col(label)).alias("base_rate"))


def calibrate(rows: DataFrame, label: str = "label", proba: str = "proba") -> tuple[str, DataFrame]:
    """The better of sigmoid and isotonic calibration by log loss on a fifth of the rows, fitted on the others; and rows with `calibrated`."""
    test = F.pmod(F.xxhash64(proba, label), F.lit(5)) == 0
    logit = F.log(F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col(proba))) / (1 - F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col(proba)))))
    with_logit = rows.withColumn("logit", logit)
    sigmoid = logistic(["logit"], label, 0.0).fit(with_logit.where(~test))
    iso = IsotonicRegression(featuresCol=proba, labelCol=label, predictionCol="calibrated").fit(rows.select(F.col(proba), F.col(label).cast("double").alias(label)).where(~test))
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c)))
    out = {"sigmoid": predict(sigmoid, with_logit, "calibrated").drop("logit"), "isotonic": iso.transform(rows.withColumn(proba, F.col(proba))).withColumn("calibrated", clip("calibrated"))}
    losses = {k: v.where(test).agg(F.avg(log_loss(label, "calibrated")).alias("l")).first()["l"] for k, v in out.items()}
    best = min(losses, key=losses.get)
    return best, out[best]


def save(model: PipelineModel, path: str, features: list[str], tau: float | None = None) -> None:
    """The fitted pipeline with the features in their order and the threshold that goes with it."""
    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.active()
    spark.createDataFrame([(features, tau)], "features array<string>, tau double").coalesce(1).write.mode("overwrite").json(f"{path}/contract")


def load(spark: SparkSession, path: str) -> tuple[PipelineModel, list[str], float | None]:
    """(pipeline, features, threshold) as saved."""
    r = spark.read.schema("features array<string>, tau double").json(f"{path}/contract").first()
    return PipelineModel.load(f"{path}/model"), list(r.features), r.tau


def importance(model: PipelineModel, features: list[str]) -> list[tuple[str, float]]:
    return sorted(zip(features, model.stages[-1].featureImportances.toArray().tolist(), strict=True), key=lambda x: -x[1])


def r2(rows: DataFrame, target: str, predictors: list[str]) -> float:
    """Share of the target's variance that a linear fit of the predictors explains."""
    x = VectorAssembler(inputCols=predictors, outputCol="_x", handleInvalid="skip").transform(rows.where(F.col(target).isNotNull()))
    return LinearRegression(featuresCol="_x", labelCol=target).fit(x).summary.r2


def clusters(names: list[str], rho: np.ndarray, cut: float) -> list[list[str]]:
    """Average linkage on 1 - |rho| up to the distance `cut`; for the few hundred columns of a feature frame."""
    groups = [[i] for i in range(len(names))]
    d = 1 - np.abs(rho)
    while len(groups) > 1:
        near = min(((float(np.mean(d[np.ix_(a, b)])), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j))
        if near[0] > cut:
            break
        groups[near[1]] += groups.pop(near[2])
    return sorted(sorted(names[i] for i in g) for g in groups)


def ablation(make, rows: DataFrame, features: list[str], train, test, seeds: list[int]) -> list[tuple[str, float, float, str]]:
    """(left out, mean log loss, deviation, verdict) over seeds, for each feature and for none."""
    learn, judge = (cells(rows.where(x), [*features, "label"]) for x in (train, test))

    def loss(use: list[str], seed: int) -> float:
        return score(predict(make(use, seed).fit(learn), judge)).first()["log_loss"]

    base = np.array([loss(features, s) for s in seeds])
    out = [("none", float(base.mean()), float(base.std(ddof=0)), "baseline")]
    for f in features:
        x = np.array([loss([g for g in features if g != f], s) for s in seeds])
        delta, noise = x.mean() - base.mean(), max(base.std(ddof=0), x.std(ddof=0))
        out.append((f, float(x.mean()), float(x.std(ddof=0)), "keep" if delta > noise else "drop" if delta < -noise else "neutral"))
    return out
