"""Cases that the reviewer's fourth round found."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.operators import attribution, backtest, classify, metrics, models, simulate, trials

DAY = dt.date(2020, 1, 1)


@pytest.fixture(scope="module")
def rows(spark):
    """600 rows of 60 kinds, some without a value."""
    r = np.random.default_rng(4)
    kinds = [(float(a), None if k % 17 == 0 else float(b), int(a + b > 0)) for k, (a, b) in enumerate(r.normal(size=(60, 2)).round(2))]
    each = [kinds[i] for i in r.integers(0, 60, 600)]
    return spark.createDataFrame([(i, *k) for i, k in enumerate(each)], "i long, a double, b double, label int").repartition(5).cache()


def test_values_at_steps_are_those_of_the_sorted_rows(spark, rows):
    a, b = models.at_steps(rows, ["a", "b"], 8)
    assert models.at_steps(models.cells(rows, ["a", "b", "label"]), ["a", "b"], 8) == [a, b]
    for got, c in ((a, "a"), (b, "b")):
        x = sorted(r[c] for r in rows.collect() if r[c] is not None)
        assert got == [x[max(0, -(-k * len(x) // 8) - 1)] for k in range(9)]
    assert models.at_steps(rows.where("b is null"), ["b"], 8) == [[]]
    assert models.thresholds([1.0, 1.0, 2.0, 4.0], 5) == [1.5, 3.0] and models.thresholds([3.0] * 4, 5) == [] == models.thresholds([], 5)
    assert models.thresholds([0.0] * 99 + [1.0], 31) == [0.5]


def fitted_on(monkeypatch) -> list[int]:
    """Rows of the tables that linear models and trees are fitted on."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.regression import DecisionTreeRegressor

    seen: list[int] = []
    for kind in (LogisticRegression, DecisionTreeRegressor):
        monkeypatch.setattr(kind, "_fit", lambda self, df, plain=kind._fit: (seen.append(df.count()), plain(self, df))[1])
    return seen


def test_fits_take_each_kind_of_row_once(rows, monkeypatch):
    seen = fitted_on(monkeypatch)
    cells = models.cells(rows, ["a", "b", "label"])
    for make in (lambda: models.logistic(["a", "b"], penalty=1e-3), lambda: models.boosted(["a", "b"], rounds=3, depth=3)):
        one, two = (make().fit(x) for x in (rows, cells))
        p, q = (np.array([x.proba for x in models.predict(m, rows).orderBy("i").collect()]) for m in (one, two))
        assert np.allclose(p, q, atol=1e-6)
    assert max(seen) <= 60 and len(seen) == 8
    model = models.logistic(["a", "b"]).fit(rows)
    plain, counted = (models.score(models.predict(model, x)).first().asDict() for x in (rows, cells))
    assert plain["n"] == counted["n"] and all(abs(plain[k] - counted[k]) < 1e-12 for k in plain)


def test_a_linear_fit_is_that_of_the_rows(spark, rows):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    made = Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="_raw", handleInvalid="skip"), StandardScaler(inputCol="_raw", outputCol="_x", withMean=True), LogisticRegression(featuresCol="_x", labelCol="label", regParam=1e-2, maxIter=50)])
    p, q = (np.array([x.proba for x in models.predict(m.fit(rows), rows).orderBy("i").collect()]) for m in (made, models.logistic(["a", "b"], penalty=1e-2)))
    assert np.allclose(p, q, atol=1e-4)


def test_trees_split_numbers_in_order_and_draw_their_share(spark):
    r = np.random.default_rng(7)
    x = r.normal(size=4000)
    df = spark.createDataFrame([(float(v), int(np.sin(3 * v) > 0)) for v in x], "x double, label int")
    model = models.boosted(["x"], rounds=3, depth=4).fit(df)
    trees = attribution.exported(model)
    assert all(-4 < t < 4 for _, nodes in trees for f, t, *_ in nodes if f == 0)
    drawn = [nodes[0][5] for _, nodes in trees]
    assert len(set(drawn)) == 3 and all(abs(n - 3200) < 150 for n in drawn)
    p = np.array([q.proba for q in models.predict(model, df).collect()])
    margin = np.zeros(len(x))
    for w, nodes in trees:
        for k, v in enumerate(x):
            at = 0
            while nodes[at][0] >= 0:
                at = nodes[at][2] if v <= nodes[at][1] else nodes[at][3]
            margin[k] += w * nodes[at][4]
    assert np.allclose(1 / (1 + np.exp(-2 * margin)), p)
    assert attribution.exported(models.boosted(["x"], rounds=3, depth=4).fit(df.repartition(7))) == trees


def test_boosted_trees_are_those_of_spark(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    r = np.random.default_rng(4)
    kinds = [(float(a), float(b), int(a + b + e > 0)) for a, b, e in zip(r.integers(0, 12, 300), r.integers(-9, 9, 300), r.normal(size=300), strict=True)]
    df = spark.createDataFrame([(i, *kinds[j]) for i, j in enumerate(r.integers(0, 300, 3000))], "i long, a double, b double, label int").cache()
    theirs = Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="_x"), GBTClassifier(featuresCol="_x", labelCol="label", maxIter=3, maxDepth=3)]).fit(df)
    p, q = (np.array([x.proba for x in models.predict(m, df).orderBy("i").collect()]) for m in (theirs, models.Boosted(["a", "b"], "label", 3, 3, 1, share=1.0).fit(df)))
    assert np.allclose(p, q, atol=1e-9)


def test_attributions_of_counted_rows(rows):
    cells = models.cells(rows.na.drop(), ["a", "b", "label"])
    model = models.boosted(["a", "b"], rounds=3, depth=3).fit(cells)
    of = lambda df: attribution.partners(model, df, ["a", "b"]).groupBy("a", "b").agg(F.sum("strength"), F.sum("n")).first()
    one, two = of(rows.na.drop()), of(cells)
    assert one[3] == two[3] == rows.na.drop().count() and abs(one[2] - two[2]) < 1e-6


def test_the_price_before_is_of_the_past_that_is_there(spark):
    days = [(s, DAY + dt.timedelta(d), 1500 + (d * 7919 + s * 31) % 97) for s in (1, 2) for d in [*range(0, 130), *range(150, 260)]]
    daily = spark.createDataFrame(days, "station_code long, price_date date, decicents int")
    price = {(s, d): c for s, d, c in days}
    got = classify.labels(daily, lag=7).collect()
    assert len(got) > 40 and all(r.before == price[r.station_code, r.price_date - dt.timedelta(7)] for r in got)
    assert classify.labels(daily).columns == [c for c in classify.labels(daily, lag=0).columns if c != "before"]
    with pytest.raises(ValueError, match="the past has 90"):
        classify.labels(daily, lag=91)


@pytest.fixture(scope="module")
def market(spark):
    out = []
    for s in range(6):  # three copies of two stations
        cents = 1700 + 150 * np.sin(np.arange(400) / 6 + s % 2)
        for i in range(393):
            out.append((s, DAY + dt.timedelta(i), int(cents[i]), int(cents[i + 1 : i + 8].min() >= cents[i] - 30), float(int(cents[i])) / 10))
    frame = spark.createDataFrame(out, "station_code long, price_date date, decicents int, label int, today double").cache()
    return frame, frame.select("station_code", "price_date", "decicents"), metrics.folds(spark, "2020-01-01", 1, 200, 60, 80, 7)


def test_seeds_share_days_and_training_rows(market, monkeypatch):
    frame, daily, windows = market
    made = []
    for where, name in ((backtest, "training"), (simulate, "evaluation_days")):
        monkeypatch.setattr(where, name, lambda *a, plain=getattr(where, name), name=name: (made.append(name), plain(*a))[1])
    setup = backtest.Setup(simulate.Tank(), inner=2, make=lambda f, s: models.boosted(f, rounds=1, depth=2, seed=s), method="boosted")
    got = backtest.fit_stability(frame, daily, windows, ["today"], setup, [1], [2]).collect()
    assert len(got) == 1 and sorted(made) == ["evaluation_days", "training"]


def test_backtests_fit_distinct_rows(market, monkeypatch):
    frame, daily, windows = market
    seen = fitted_on(monkeypatch)
    got = backtest.paired_backtest(frame, daily, windows, {"base": ["today"]}, "base", backtest.Setup(simulate.Tank())).first()
    assert got.litres_own > 0 and max(seen) <= frame.select("today", "label").distinct().count() < frame.count() / 5


def test_a_candidate_is_not_joined_to_the_frame_that_it_came_from(spark, market, monkeypatch):
    frame = market[0].withColumn("other", F.col("today") * 2 + F.rand(3))
    plans, plain = [], models.cells
    monkeypatch.setattr(models, "cells", lambda df, columns: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), plain(df, columns))[1])
    run = lambda add: backtest.try_candidate(trials.Candidate("c", ["today"], ["c"], add), frame, ["other"], "price_date < '2020-10-01'", "price_date >= '2020-10-01'", "2020-06-30")
    carried = run(lambda df: df.withColumn("c", F.sin(F.col("today"))))
    assert "Join" not in plans[0]
    plans.clear()
    joined = run(lambda df: df.select(*[c for c in ("station_code", "price_date") if c in df.columns], F.sin(F.col("today")).alias("c")))
    assert "Join" in plans[0] and joined == carried and carried[0] in ("promising", "no_gain")


def test_leaks_count_rows_both_ways_with_repeats(spark):
    rows = spark.createDataFrame([(DAY + dt.timedelta(i // 2), float(i // 4), None) for i in range(40)], "price_date date, x double, y double")
    ahead = lambda df: df.crossJoin(df.agg(F.max("x").alias("m"))).select("price_date", F.when(F.col("x") < 1, F.col("m")).alias("m"), "y")
    swap = lambda df: df.select("price_date", *([F.lit(1).alias("x"), F.lit(None).cast("int").alias("y")] if df.count() == 40 else [F.lit(None).cast("int").alias("x"), F.lit(1).alias("y")]))
    for build, each in ((lambda df: df, 0), (ahead, 4), (swap, 20)):
        got = trials.leaks(build, rows, "2020-01-10")
        assert got.columns[-1] == "side" and {r["side"]: r["count"] for r in got.groupBy("side").count().collect()} == ({"whole": each, "cut": each} if each else {})
    days = lambda df: df.agg(F.max("price_date").alias("price_date"), F.lit(1).alias("x"))
    assert [r.side for r in trials.leaks(days, rows, "2020-01-10").collect()] == ["cut"]
