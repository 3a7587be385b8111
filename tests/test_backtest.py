"""Paired backtests: thresholds, the fold cache, seeds; and frozen batches."""

from __future__ import annotations

import datetime as dt
import shutil
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.operators import backtest, freeze, metrics, models, simulate

DAY = dt.date(2020, 1, 1)
ARMS = {"base": ["today"], "trial": ["today", "hint"]}


@pytest.fixture(scope="module")
def market(spark):
    r = np.random.default_rng(21)
    rows = []
    for s in (1, 2):
        cents = 1700 + 150 * np.sin(np.arange(400) / 6 + s) + r.integers(-40, 41, 400)
        for i in range(393):
            low = int(cents[i + 1 : i + 8].min() >= cents[i] - 30)
            rows.append((s, DAY + dt.timedelta(i), int(cents[i]), low, float(cents[i]) / 10, float(low + r.normal(0, 0.6))))
    frame = spark.createDataFrame(rows, "station_code long, price_date date, decicents int, label int, today double, hint double").cache()
    return frame, frame.select("station_code", "price_date", "decicents"), metrics.folds(spark, "2020-01-01", 2, 200, 60, 80, 7)


class Counted:
    def __init__(self):
        self.fits = []

    def __call__(self, features, seed):
        self.fits.append((tuple(features), seed))
        return models.logistic(features)


def test_thresholds_own_and_held(market):
    frame, daily, windows = market
    got = {(r.fold, r.arm): r for r in backtest.paired_backtest(frame, daily, windows, ARMS, "base", backtest.Setup(simulate.Tank())).collect()}
    assert sorted(got) == [(0, "base"), (0, "trial"), (1, "base"), (1, "trial")]
    for (fold, arm), r in got.items():
        base = got[fold, "base"]
        assert r.held_tau == base.own_tau and (r.val_start, r.val_end) == (base.val_start, base.val_end)
        assert abs(r.cpl_own - r.spend_own / r.litres_own) < 1e-9 and abs(r.delta_own - (r.cpl_own - base.cpl_own)) < 1e-9
        assert abs(r.delta_held - (r.cpl_held - base.cpl_held)) < 1e-9 and abs(r.saving_own - (r.always_cpl - r.cpl_own) / r.always_cpl * 100) < 1e-9
        assert arm != "base" or (r.cpl_own == r.cpl_held and r.delta_own == 0)
        assert not r.cached and "interval=1d" in r.cadence
    fixed = {(r.fold, r.arm): r for r in backtest.paired_backtest(frame, daily, windows, ARMS, "base", backtest.Setup(simulate.Tank(), held=0.95)).collect()}
    for k, r in fixed.items():
        assert r.held_tau == 0.95 and r.own_tau == got[k].own_tau and r.cpl_own == got[k].cpl_own
    assert any(abs(fixed[k].cpl_held - fixed[k].cpl_own) > 1e-6 for k in fixed)
    for arms, base in (({"a": ["today"]}, "b"), ({"a": []}, "a")):
        with pytest.raises(ValueError):
            backtest.paired_backtest(frame, daily, windows, arms, base, backtest.Setup(simulate.Tank()))


def test_only_missing_folds_are_fitted(market, tmp_path):
    frame, daily, windows = market
    make = Counted()
    setup, cache = backtest.Setup(simulate.Tank(), inner=2, make=make), backtest.FoldCache(str(tmp_path / "folds"))
    plain = {r.fold: r for r in backtest.paired_backtest(frame, daily, windows, {"base": ["today"]}, "base", setup).collect()}
    each, make.fits = len(make.fits) // 2, []
    run = lambda w, arms=None, **k: {(r.fold, r.arm): r for r in backtest.paired_backtest(frame, daily, w, arms or {"base": ["today"]}, "base", k.pop("setup", setup), cache, **k).collect()}
    assert not run(windows.where("fold = 0"))[0, "base"].cached and len(make.fits) == each
    again = run(windows)
    assert len(make.fits) == 2 * each and again[0, "base"].cached and not again[1, "base"].cached
    make.fits = []
    paired = run(windows, ARMS)
    assert {f for f, _ in make.fits} == {("today", "hint")} and all(paired[k, "base"].cached for k in (0, 1))
    for k in (0, 1):
        a, b = paired[k, "base"].asDict(), plain[k].asDict()
        assert a.pop("cached") and not b.pop("cached") and a == b
    drifted = windows.withColumn("val_end", F.date_add("val_end", F.when(F.col("fold") == 1, 1).otherwise(0)))
    with pytest.raises(ValueError, match=r"other validation days: \[1\]"):
        run(drifted)
    for other, name in ((replace(setup, seed=1), "seed"), (replace(setup, tank=simulate.Tank(interval=2)), "tank"), (replace(setup, inner=3), "inner"), (replace(setup, method="boosted"), "method")):
        with pytest.raises(ValueError, match=f"another setup: .*'{name}'"):
            run(windows, setup=other)
    with pytest.raises(ValueError, match="'data'"):
        run(windows, data="1:x")
    with pytest.raises(ValueError, match="'features'"):
        run(windows, {"base": ["hint"]})
    with pytest.raises(ValueError, match="'stations'"):
        backtest.paired_backtest(frame, daily.where("station_code = 1"), windows, {"base": ["today"]}, "base", setup, cache)
    with pytest.raises(ValueError, match="held one"):
        run(windows, setup=replace(setup, held=0.5))


def test_pooled_costs_are_of_pooled_litres(market):
    frame, daily, windows = market
    rows = backtest.paired_backtest(frame, daily, windows, ARMS, "base", backtest.Setup(simulate.Tank(), inner=2))
    got, each = {r.arm: r for r in backtest.pooled(rows, "base").collect()}, rows.collect()
    for arm in ARMS:
        mine = [r for r in each if r.arm == arm]
        assert got[arm].folds == 2 and abs(got[arm].cpl_held - sum(r.spend_held for r in mine) / sum(r.litres_held for r in mine)) < 1e-9
    assert got["base"].delta_held == 0 and abs(got["trial"].delta_own - (got["trial"].cpl_own - got["base"].cpl_own)) < 1e-9


def test_seeds_in_pairs(market):
    frame, daily, windows = market
    setup = backtest.Setup(simulate.Tank(), inner=2, make=lambda f, s: models.boosted(f, rounds=1, depth=2, seed=s), method="boosted")
    got = backtest.fit_stability(frame, daily, windows.where("fold = 0"), ["today"], setup, [1, 2], [3, 4]).orderBy("pair").collect()
    assert [(r.pair, r.fold, r.seed_a, r.seed_b) for r in got] == [(0, 0, 1, 3), (1, 0, 2, 4)]
    d = [r.delta for r in got]
    assert all(abs(r.delta - (r.cpl_b - r.cpl_a)) < 1e-9 and abs(r.mean - np.mean(d)) < 1e-9 and abs(r.deviation - np.std(d, ddof=1)) < 1e-9 for r in got)
    for a, b in (([1], [2, 3]), ([1, 1], [2, 3]), ([1, 2], [2, 3])):
        with pytest.raises(ValueError):
            backtest.fit_stability(frame, daily, windows, ["today"], setup, a, b)


def test_a_batch_is_frozen_once_and_checked(spark, market, tmp_path):
    frame, _, windows = market
    path, keys = str(tmp_path / "batch"), ["station_code", "price_date", "label", "decicents"]
    with pytest.raises(ValueError, match="without a role: \\['hint'\\]"):
        freeze.freeze(frame, path, ["today"], keys, [], windows, "1d")
    with pytest.raises(ValueError, match="aren't there: \\['more'\\]"):
        freeze.freeze(frame, path, ["today", "more"], keys, ["hint"], windows, "1d")
    with pytest.raises(ValueError, match="no rows"):
        freeze.freeze(frame.limit(0), path, ["today"], keys, ["hint"], windows, "1d")
    with pytest.raises(ValueError, match="no frozen batch"):
        freeze.thaw(spark, path)
    said = freeze.freeze(frame, path, ["today", "hint"], keys, [], windows, "1d")
    got, again = freeze.thaw(spark, path, ["today", "hint"], windows, "1d")
    assert again == said and got.exceptAll(frame).count() == 0 and got.count() == frame.count()
    with pytest.raises(ValueError, match="frozen once"):
        freeze.freeze(frame, path, ["today", "hint"], keys, [], windows, "1d")
    for use, name in ((["hint", "today"], "columns: in another order"), (["today"], "removed \\['hint'\\]"), (["today", "hint", "x"], "added \\['x'\\]")):
        with pytest.raises(ValueError, match=name):
            freeze.thaw(spark, path, use)
    with pytest.raises(ValueError, match=r"folds: \[1\]"):
        freeze.thaw(spark, path, None, windows.where("fold = 0"))
    with pytest.raises(ValueError, match="cadence"):
        freeze.thaw(spark, path, None, windows, "7d")
    changed = frame.withColumn("hint", F.when((F.col("station_code") == 1) & (F.col("price_date") == DAY), F.col("hint") + 1e-9).otherwise(F.col("hint")))
    changed.write.parquet(f"{path}-other")
    shutil.rmtree(f"{path}/frame")
    shutil.move(f"{path}-other", f"{path}/frame")
    with pytest.raises(ValueError, match="content"):
        freeze.thaw(spark, path)


def test_content_is_of_rows_not_of_their_order(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, 3.0), (2, None, 3.0), (None, "2", 0.5)], "a long, b string, c double")
    same = freeze.content(df)
    assert freeze.content(df.repartition(3).orderBy("c")) == same == freeze.content(df.select("c", "a", "b"))
    others = [df.distinct(), df.withColumn("a", F.col("a").cast("int")), df.withColumn("c", F.coalesce("c", F.lit(0.0))), df.select(F.col("b").alias("a"), F.col("a").cast("string").alias("b"), "c"), df.limit(0)]
    assert len({same, *map(freeze.content, others)}) == 6
    swapped = spark.createDataFrame([(None, 1), (1, None)], "a long, b long")
    assert freeze.content(swapped.limit(1)) != freeze.content(swapped.where("a = 1"))
