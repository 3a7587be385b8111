"""Classes of every day against the classes of each day, and weekly scores of a group that never has an own price."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.operators import classify, cycles

DAY = dt.date(2000, 1, 1)


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(4)
    out = []
    for station in range(14):
        group = "abc"[station % 3]
        level = 1600 + (0 if group != "c" else 400 * station) + 30 * (station // 3)  # in c no station is near the median but its own
        for i in range(230):
            if r.random() < 0.75 and not (station == 3 and 40 < i < 130):
                out.append((station, group, DAY + dt.timedelta(i), int(level + r.integers(-12, 13) * 10)))
    return out + [(50, "d", DAY + dt.timedelta(3), 1500)]


def test_every_day_has_the_classes_of_its_snapshot(spark, rows):
    panel = spark.createDataFrame(rows, "station_code long, council string, price_date date, decicents int").repartition(3).cache()
    got = {}
    for r in classify.classify_every_day(panel, days=20, block=33).collect():
        got.setdefault(r.snapshot_date, {})[r.station_code] = (r.council, r["class"], round(r.premium, 6))
    assert min(got) == DAY + dt.timedelta(1) and max(got) == DAY + dt.timedelta(230)
    for k in (1, 2, 19, 20, 21, 32, 33, 34, 66, 100, 131, 199, 230):
        day = DAY + dt.timedelta(k)
        seen = panel.where(F.col("price_date").between(day - dt.timedelta(20), day - dt.timedelta(1)))
        assert got[day] == {r.station_code: (r.council, r["class"], round(r.premium, 6)) for r in classify.classify(seen).collect()}
    assert {c for x in got.values() for _, c, _ in x.values()} == {"Competitive", "Discount", "Sticky"}
    other = {(r.snapshot_date, r.station_code, r["class"], r.premium) for r in classify.classify_every_day(panel, days=20, block=90).collect()}
    assert other == {(r.snapshot_date, r.station_code, r["class"], r.premium) for r in classify.classify_every_day(panel, days=20, block=1).collect()}
    assert classify.classify_every_day(panel.limit(0)).count() == 0


def test_a_day_is_judged_by_the_days_before_it(spark, rows):
    panel = spark.createDataFrame(rows, "station_code long, council string, price_date date, decicents int")
    cut = DAY + dt.timedelta(120)
    short = classify.classify_every_day(panel.where(F.col("price_date") < cut), days=20)
    f = lambda df: {(r.snapshot_date, r.station_code): (r["class"], r.premium) for r in df.collect()}
    assert f(short) == {k: v for k, v in f(classify.classify_every_day(panel, days=20)).items() if k[0] <= cut}
    known = classify.on_its_day(panel, classify.classify_every_day(panel, days=20))
    assert known.where("price_date = '2000-01-01'").count() == 0 and known.count() < panel.count()


def test_a_group_without_own_prices_has_no_score(spark):
    wave = [150 + 10 * math.cos(2 * math.pi * i / 45) for i in range(300)]
    rows = [(DAY + dt.timedelta(i), "near", p, p) for i, p in enumerate(wave)] + [(DAY + dt.timedelta(i), "none", None, p) for i, p in enumerate(wave)]
    both = spark.createDataFrame(rows, "price_date date, g string, price double, anchor_price double")
    assert {r.g for r in cycles.leadership_snapshots(both, "g", window=200).collect()} == {"near"}
    assert cycles.leadership_snapshots(both.where("g = 'none'"), "g", window=200).count() == 0
