"""Shapes of descents, detectors and rules put in from outside: known answers, refusals, and a plain version."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.operators import cycles, features, shapes, simulate

D0 = dt.date(2000, 1, 1)
STATE = "price_date date, cycle_days_since_peak int, cycle_mean_length double, cycle_last_max double, cycle_pct_through double"


def day(i: int) -> dt.date:
    return D0 + dt.timedelta(days=i)


def test_descents_of_known_answers(spark):
    state = spark.createDataFrame([(day(i), i % 40, 20.0, 200.0, (i % 40) / 20) for i in range(60)], STATE)
    rows = state.withColumns({"station_code": F.lit(1), "station_price": F.lit(190.0), "a": F.when(F.col("price_date") != day(30), 2.0)})
    got = {(r.price_date - D0).days: r for r in shapes.interactions(shapes.descents(rows, state), "a").collect()}
    assert len(got) == 60 and got[0].elongation is None and got[0].shallow_long == 0  # nothing known before the first day
    assert got[10].elongation == 0.5 and got[10].slope_so_far == -1.0 and got[10].shallow_long == 0
    assert got[25].elongation == 1.25 and got[25].slope_so_far == pytest.approx(-0.4) and got[25].shallow_long == 1
    assert (got[25].a_corner, got[25].a_other, got[25].a_smooth) == (2.0, 0.0, pytest.approx(2 * 1.25 * 0.5))
    assert (got[10].a_corner, got[10].a_other, got[10].a_smooth) == (0.0, 2.0, 0.0)
    assert got[40].slope_so_far is None and got[40].a_smooth is None  # the day of the peak
    assert got[30].a_corner is None and got[30].shallow_long == 1


def test_usual_length_sees_the_days_before_only(spark):
    lengths = [20.0, 30.0, None, 100.0, 100.0]
    state = spark.createDataFrame([(day(i), 1, x, 200.0, 0.1) for i, x in enumerate(lengths)], STATE)
    got = {(r.price_date - D0).days: r.usual for r in shapes.usual_length(state, 2).collect()}
    assert got == {0: None, 1: 20.0, 3: 30.0, 4: 100.0}


def test_fold_shapes_without_rows_that_fall(spark):
    rows = spark.createDataFrame([(1, day(i), 100.0 + i, 5, 20.0, 120.0, 0.9, -1.0) for i in range(40)], "station_code int, price_date date, station_price double, cycle_days_since_peak int, cycle_mean_length double, cycle_last_max double, cycle_pct_through double, slope_so_far double")
    folds = spark.createDataFrame([(0, day(20), day(29)), (1, day(0), day(9)), (2, day(900), day(999))], "fold int, val_start date, val_end date")
    got = {r.fold: r for r in shapes.fold_shapes(rows, folds).collect()}
    assert set(got) == {0, 1} and got[0].n == got[1].n == 10
    assert got[0].gradient is None and got[0].cycle_slope is None and got[0].descent_share == 0 and got[0].elongation == 0.25
    assert got[1].elongation is None  # no row before the fold


def test_before_troughs_as_a_loop_would(spark):
    x = [100 + 10 * math.cos(i / 5) + (i % 3) * 0.3 for i in range(120)]
    inner = range(1, len(x) - 1)
    peaks = [i for i in inner if x[i] > max(x[i - 1], x[i + 1]) and x[i] > 105]
    lows = [i for i in inner if x[i] < min(x[i - 1], x[i + 1]) and x[i] < 95]
    up = {i: 85.0 + i / 40 for i in range(0, 120, 4)}
    frame = lambda at, name: spark.createDataFrame([("s", day(i)) for i in at], f"series string, {name} date")
    series = spark.createDataFrame([("s", day(i), v) for i, v in enumerate(x)], "series string, price_date date, price double")
    rows = shapes.before_troughs(series, spark.createDataFrame([(day(i), v) for i, v in up.items()], "tgp_date date, tgp double"), frame(peaks, "peak_date"), frame(lows, "anchor_date"), ["series"]).cache()
    got = {(r.price_date - D0).days: r for r in rows.collect()}
    falling = {i for p in peaks for i in range(p, next((t for t in lows if t >= p), -1) + 1)}
    for i in range(120):
        nxt = next((t for t in lows if t >= i), None)
        assert got[i].in_descent == (i in falling) and got[i].low == (i in lows) and got[i].days_to_low == (None if nxt is None else nxt - i)
        assert got[i].gap == pytest.approx(x[i] - up[i - i % 4]) and (got[i].depth is None) == (nxt is None)
        assert got[i].slope == (pytest.approx((x[i] - x[i - 7]) / 7) if i >= 7 else None)
    rowsof = [i for i in sorted(falling) if i >= 7 and (x[i] - x[i - 7]) / 7 < -0.1]
    r = shapes.gap_diagnosis(rows, ["series"]).first()
    gaps, depth = [got[i].gap for i in rowsof], [got[i].depth for i in rowsof]
    assert r.descending == len(rowsof) and r.lows == len(lows) and r.r2_depth == pytest.approx(np.corrcoef(gaps, depth)[0, 1] ** 2, abs=1e-4)
    none = shapes.gap_diagnosis(rows.where("false"), ["series"])
    assert none.count() == 0


def test_a_detector_from_outside(spark):
    x = [100.0] * 5 + [110.0] + [100.0] * 9 + [112.0] + [100.0] * 9 + [111.0] + [100.0] * 5
    metro = spark.createDataFrame([(day(i), v) for i, v in enumerate(x)], "price_date date, price double")
    got = {(r.price_date - D0).days: r for r in features.cycle_features(metro, cycles.turning_peaks).collect()}
    assert min(got) == 16 and got[16].cycle_peak_count == 2 and got[16].cycle_mean_length == 10 and got[16].cycle_last_max == 110
    own = lambda series, by: series.where("price_date = date'2000-01-10'").select(*by, F.col("price_date").alias("peak_date"), F.date_sub("price_date", 1).alias("confirmed_on"))
    with pytest.raises(Exception, match="known before its day"):
        features.cycle_features(metro, own).collect()
    with pytest.raises(ValueError, match="confirmed_on"):
        features.cycle_features(metro, lambda series, by: series.select(*by, F.col("price_date").alias("peak_date")))


def test_rules_from_outside(spark):
    days = spark.createDataFrame([(1, i, day(i), 100.0 + i, 0.9 if i % 2 else None) for i in range(4)], "station_code int, i int, day date, price double, proba double")
    got = {(r.strategy, r.i): r.buy for r in simulate.decided(days, {"cheap": F.col("price") < 102, "model": F.col("proba") < 0.5}).collect()}
    assert got == {("cheap", i): i < 2 for i in range(4)} | {("model", i): i % 2 == 0 for i in range(4)}
    assert not any(r.buy for r in simulate.decided(days, {"m": F.col("proba") < 0.5}, default=False).collect())
    with pytest.raises(ValueError, match="boolean"):
        simulate.decided(days, {"price": F.col("price")})
    with pytest.raises(ValueError, match="no rules"):
        simulate.decided(days, {})
