"""Booking of consumption, paired contrasts, chunks of equal size and tables replaced in one step."""

from __future__ import annotations

import datetime as dt
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.operators import metrics, simulate, versions

DAY = dt.date(2020, 1, 1)
FILLS = "unit long, day date, price double, litres double, emergency boolean"


def driven(r, tank, n):
    """Fills of a tank that some days fill up: (day, price, litres, emergency)."""
    level, out = tank.size / 2, []
    for i in range(n):
        if i:
            level = max(0.0, level - tank.depletion)
        price, low = r.uniform(150, 200), level < tank.depletion or level / tank.size < tank.floor
        if r.random() < 0.3 and level < tank.size:
            out.append((DAY + dt.timedelta(i * tank.interval), price, tank.size - level, False))
            level = tank.size
        elif low and level < tank.size / 2:
            out.append((DAY + dt.timedelta(i * tank.interval), price, tank.size / 2 - level, True))
            level = tank.size / 2
    return out


def by_drops(fills, tank, mode, shift):
    """{day: (litres, spend)} and what is left, with the tank as a list of lots that is burnt an interval at a time."""
    lots, book, level = [], {}, None
    for k, (day, price, litres, emergency) in enumerate(fills):
        level = tank.size / 2 if emergency else tank.size
        if k == 0:
            lots.append([level - litres, None])
        lots.append([litres, price])
        if mode == "average":
            known = [x for x in lots if x[1] is not None and x[0] > 1e-12]
            total = sum(x[0] for x in known)
            lots = [x for x in lots if x[1] is None] + [[total, sum(x[0] * x[1] for x in known) / total]]
        if k + 1 == len(fills):
            break
        for t in range((fills[k + 1][0] - day).days // tank.interval):
            want = min(tank.depletion, level)
            level -= want
            got = spend = 0.0
            for lot in lots:
                part = min(want, lot[0])
                lot[0], want = lot[0] - part, want - part
                if lot[1] is not None:
                    got, spend = got + part, spend + part * lot[1]
            if got > 1e-9:
                book[day + dt.timedelta(t * tank.interval + shift)] = (got, spend)
    left = [(x[0], x[1]) for x in lots if x[1] is not None]
    return book, (sum(a for a, _ in left), sum(a * p for a, p in left))


@pytest.mark.parametrize("mode", ["fifo", "average"])
@pytest.mark.parametrize(("tank", "stamp", "shift"), [(simulate.Tank(), "start", 0), (simulate.Tank(interval=7), "end", 7), (simulate.Tank(interval=7), "mid", 3), (simulate.Tank(daily=9.0, interval=2), "mid", 1)])
def test_consumption_is_booked_lot_by_lot(spark, mode, tank, stamp, shift):
    r = random.Random(3)
    units = {u: driven(r, tank, 60) for u in range(6)}
    rows = [(u, *f) for u, fills in units.items() for f in fills]
    df = spark.createDataFrame(rows, FILLS).repartition(3)
    got, left = defaultdict(dict), {}
    for x in simulate.consumption(df, tank, ["unit"], mode, stamp).collect():
        got[x.unit][x.day] = (x.litres, x.spend)
    for x in simulate.left_over(df, tank, ["unit"], mode).collect():
        left[x.unit] = (x.litres, x.spend)
    for u, fills in units.items():
        book, rest = by_drops(fills, tank, mode, shift)
        assert set(got[u]) == set(book) and np.allclose([got[u][d] for d in sorted(book)], [book[d] for d in sorted(book)], atol=1e-6)
        assert np.allclose(left[u], rest, atol=1e-6)
    for x in simulate.reconciled(df, tank, ["unit"], mode).collect():
        assert abs(x.litres_off) < 1e-6 and abs(x.spend_off) < 1e-4 and x.bought > 0


def test_fills_off_the_lattice_are_refused(spark):
    df = spark.createDataFrame([(1, DAY, 160.0, 25.0, False), (1, DAY + dt.timedelta(10), 150.0, 30.0, False)], FILLS)
    with pytest.raises(Exception, match="whole intervals apart"):
        simulate.consumption(df, simulate.Tank(interval=7), ["unit"]).collect()
    assert [round(x.litres, 6) for x in simulate.consumption(df, simulate.Tank(interval=5), ["unit"]).collect()] == [round(10 * 50 / 14 - 25, 6)]  # what was there before burns first
    for bad in ({"mode": "lifo"}, {"stamp": "noon"}):
        with pytest.raises(ValueError):
            simulate.consumption(df, simulate.Tank(), ["unit"], **bad)
    assert simulate.consumption(df.limit(0), simulate.Tank(), ["unit"]).count() == simulate.reconciled(df.limit(0), simulate.Tank(), ["unit"]).count() == 0


def test_stations_add_up(spark, sf_dir):
    from tidewell import registry

    rows = registry.QUERIES["consumption_reconciled"](spark, sf_dir).collect()
    assert len(rows) == 20 and all(abs(x.litres_off) < 1e-6 * x.bought and abs(x.spend_off) < 1e-6 * 200 * x.bought and x.used > 0 for x in rows)
    both = registry.QUERIES["consumption_ledger"](spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("fifo_spend") / F.col("litres") - F.col("average_spend") / F.col("litres"))).alias("d")).first()
    assert both.n > 500 and both.d > 1


def panel(spark, n=40):
    r = np.random.default_rng(4)
    rows = []
    for u in range(n):
        common = r.normal(0, 8)  # a unit's level is in all its zones
        for zone, up in (("a", 1.0), ("b", 2.0), ("c", 1.0)):
            for arm, base in (("model", up + common), ("bound", 0.0)):
                rows += [(u, zone, arm, float(r.uniform(20, 30)), 0.0, 170 + base + r.normal(0, 0.2))] * (1 + u % 2)
    return spark.createDataFrame([(u, z, a, q, q * p) for u, z, a, q, _, p in rows], "unit long, zone string, arm string, litres double, spend double").cache()


def test_contrasts_are_drawn_together(spark):
    df = panel(spark)
    drawn = simulate.headroom(df, "model", "bound", 150, 7).cache()
    weights = {(x.unit, x.draw): x.w for x in df.select("unit").distinct().withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(149)))).withColumn("w", simulate.poisson_weight("unit", "draw", 7)).collect()}
    assert 0.9 < np.mean(list(weights.values())) < 1.1
    rows = df.collect()

    def plain(draw):
        out = {}
        for z in "abc":
            sums = {arm: [sum((weights[x.unit, draw] if draw >= 0 else 1) * v for x in rows if x.zone == z and x.arm == arm for v in [x[c]]) for c in ("spend", "litres")] for arm in ("model", "bound")}
            out[z] = sums["model"][0] / sums["model"][1] - sums["bound"][0] / sums["bound"][1]
        return out

    each = {k: plain(k) for k in range(-1, 150)}
    assert {(x.draw, x.zone): round(x.headroom, 9) for x in drawn.collect()} == {(k, z): round(v, 9) for k, d in each.items() for z, v in d.items()}
    alone = {x.zone: x for x in simulate.zone_intervals(drawn).collect()}
    pairs = {(x.zone_a, x.zone_b): x for x in simulate.zone_contrasts(drawn).collect()}
    assert set(pairs) == {("a", "b"), ("a", "c"), ("b", "c")}
    for (a, b), x in pairs.items():
        d = np.array([each[k][a] - each[k][b] for k in range(150)])
        assert math.isclose(x["diff"], each[-1][a] - each[-1][b], abs_tol=1e-9)
        assert np.allclose([x.low, x.high, x.share_a_worse], [np.percentile(d, 2.5), np.percentile(d, 97.5), (d > 0).mean()]) and x.separated == (x.low > 0 or x.high < 0)
        assert x.high - x.low < 0.3 * math.hypot(alone[a].high - alone[a].low, alone[b].high - alone[b].low)
    assert pairs["a", "b"].separated and alone["a"].high > alone["b"].low  # clear, though the zones' own intervals overlap


def test_positions_and_chunks(spark):
    r = np.random.default_rng(6)
    rows = [(i, float(r.normal()), None if i % 9 == 0 else float(r.normal()), 1.0, None if i % 50 == 1 else float(r.integers(0, 4))) for i in range(1234)]
    df = spark.createDataFrame(rows, "k long, x double, p double, flat double, by double").repartition(7)
    order = sorted(rows, key=lambda v: (v[4] is not None, v[4] or 0, v[0]))
    assert [x.k for x in metrics.positions(df, ["by", "k"]).orderBy("position").collect()] == [v[0] for v in order]
    assert metrics.positions(df, ["by", "k"]).agg(F.max("position")).first()[0] == 1233
    total = n = 0
    for at in range(0, 1234, 50):
        pair = [(v[1], v[2]) for v in order[at : at + 50] if v[2] is not None]
        if len(pair) >= 3:
            total, n = total + abs(np.corrcoef(*zip(*pair, strict=True))[0, 1]), n + 1
    got = {x.partner: (x.chunks, x.strength) for x in metrics.chunked_interaction(df, "x", ["p", "flat"], "by", ["k"]).collect()}
    assert got == {"p": (n, round(total, 4)), "flat": (0, 0.0)}
    assert metrics.positions(df.limit(0), ["by", "k"]).count() == 0


def test_readers_see_the_old_or_the_new(spark, tmp_path):
    path = str(tmp_path / "table")
    with pytest.raises(ValueError, match="no table"):
        versions.read(spark, path)
    df = spark.range(10).withColumn("v", F.col("id") * 2)
    assert versions.replace(df, path) == 1
    old = versions.read(spark, path)
    assert versions.replace(df.where("id < 3"), path, after=1) == 2
    assert old.count() == 10 and versions.read(spark, path).count() == 3 and versions.read(spark, path, 1).count() == 10
    with pytest.raises(ValueError, match="at version 2, not 1"):
        versions.replace(df, path, after=1)
    with pytest.raises(ValueError, match="by nothing"):
        versions.replace(df.limit(0), path)
    with pytest.raises(Exception, match="broken"):
        versions.replace(df.withColumn("v", F.when(F.col("id") == 7, F.raise_error(F.lit("broken")).cast("long")).otherwise(F.col("v"))), path)
    assert versions.versions(spark, path) == [1, 2] and versions.read(spark, path).count() == 3
    assert versions.patch(spark, path, spark.createDataFrame([(1, 100), (2, None), (9, 5)], "id long, v long"), ["id"]) == 3
    assert {tuple(x) for x in versions.read(spark, path).collect()} == {(0, 0), (1, 100), (2, None)}
    with pytest.raises(Exception, match="duplicate key"):
        versions.patch(spark, path, spark.createDataFrame([(1, 1), (1, 2)], "id long, v long"), ["id"])
    with pytest.raises(ValueError, match="lacks columns"):
        versions.patch(spark, path, spark.createDataFrame([(1, 1)], "id long, w long"), ["id"])
    assert versions.forget(spark, path, 1) == [1, 2] and versions.versions(spark, path) == [3] and versions.read(spark, path).count() == 3


def test_of_two_writes_one_wins(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "table")
    versions.replace(spark.range(2), path)
    whole, nested = versions._Files.rename, []

    def late(self, one, other):
        if not nested:
            nested.append(1)
            versions.replace(spark.range(5), path)  # another writer is done first
        return whole(self, one, other)

    monkeypatch.setattr(versions._Files, "rename", late)
    with pytest.raises(ValueError, match="another write has made version 2"):
        versions.replace(spark.range(9), path)
    assert versions.read(spark, path).count() == 5 and versions.versions(spark, path) == [1, 2]


def test_perfect_foresight_is_the_least_of_all_sequences(spark):
    r = random.Random(8)
    tank = simulate.Tank(daily=7.0, interval=1)
    prices = {u: [None if r.random() < 0.15 else round(r.uniform(150, 200), 1) for _ in range(11)] for u in range(8)}
    rows = [(u, i, DAY + dt.timedelta(i), p) for u, ps in prices.items() for i, p in enumerate(ps)]
    got = {x.station_code: x.spend for x in simulate.perfect_foresight(spark.createDataFrame(rows, "station_code long, i int, day date, price double"), tank).collect()}

    def least(ps, i, level):
        if i == len(ps):
            return 0.0
        if i:
            level -= tank.depletion
            if level < -1e-9 and ps[i] is not None:
                return math.inf
            level = max(0.0, level)
        if ps[i] is None:
            return least(ps, i + 1, level)
        low = (i != len(ps) - 1 and level < tank.depletion) or level / tank.size < tank.floor
        wait = max(level, tank.size / 2) if low else level
        return min((to - level) * ps[i] + least(ps, i + 1, to) for to in {wait, tank.size})

    for u, ps in prices.items():
        want = least(ps, 0, tank.size / 2)
        assert got[u] is None if want == math.inf else abs(got[u] - want) < 1e-6
