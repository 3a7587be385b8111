"""Refusals and orders: lookups that meet nothing, results without a stamp, tanks that run dry, summaries with unknown values."""

from __future__ import annotations

import pytest

from tidewell.operators import joins, metrics, simulate, trials


def test_a_lookup_that_meets_nothing_is_refused(spark):
    rows = spark.createDataFrame([(1,), (2,)], "k long")
    extra = spark.createDataFrame([(2, 5)], "k long, x long")
    assert tuple(joins.hit_rate(joins.lookup(rows, extra, ["k"], ["x"]), "x").first()) == (1, 1)
    with pytest.raises(Exception, match="no row has a value of 'x'"):
        joins.hit_rate(joins.lookup(rows.where("k = 1"), extra, ["k"], ["x"]), "x").collect()
    assert tuple(joins.hit_rate(joins.lookup(rows.where("k = 9"), extra, ["k"], ["x"]), "x").first()) == (0, 0)


def test_results_without_a_stamp_are_found(spark):
    documents = [(1, '{"a": {"cpl": 1}, "b": {"cadence": "x", "arms": [{"cpl": 2}]}}'), (2, "{"), (3, None), (4, " "), (5, '[{"my_cpl": 1}, 2]')]
    got = trials.unstamped_results(spark.createDataFrame(documents, "id long, document string")).collect()
    assert sorted((r.id, r.path) for r in got) == [(1, "/a"), (2, "unreadable"), (5, "/0")]


def test_tanks_by_their_gaps(spark):
    gaps = spark.createDataFrame([("a", 1), ("b", 7), ("c", 8), ("d", 400), ("e", None), ("f", 8)], "s string, gap int")
    got = {r.s: (r.faults > 0, r.safe) for r in simulate.tank_safety(gaps, simulate.Tank()).collect()}
    assert got == {"a": (False, True), "b": (False, True), "c": (True, False), "d": (True, False), "e": (False, True), "f": (True, False)}


def test_orders_of_a_summary(spark):
    rows = [("a", 1.0, -0.5, None), ("b", 3.0, None, 2), ("c", 2.0, 0.5, None), ("d", 3.0, float("nan"), 1), ("e", None, 0.1, 3)]
    got = metrics.summary_orders(spark.createDataFrame(rows, "feature string, size double, r double, rank int")).orderBy("mode", "place").collect()
    orders = {m: "".join(r.feature for r in got if r.mode == m) for m in ("size", "alpha", "sign", "rank")}
    assert orders == {"size": "bdcae", "alpha": "abcde", "sign": "cebda", "rank": "dbeca"}
