"""Known answers, bounds and refusals of the price-cycle operators."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.functions import stats, text
from tidewell.operators import classify, cycles, joins, models, panel, signals, simulate, storage, trials
from tidewell.sources import files
from tidewell.sources.adapter import Tables

DAY = dt.date(2020, 1, 1)


def days(n: int, start: dt.date = DAY) -> list[dt.date]:
    return [start + dt.timedelta(i) for i in range(n)]


def sawtooth(n: int, period: int = 46, rise: int = 3, base: float = 150.0, amplitude: float = 25.0) -> list[float]:
    out = []
    for i in range(n):
        k = i % period
        out.append(base + amplitude * (k / rise if k < rise else 1 - (k - rise) / (period - rise)))
    return out


def series(spark, values, name="s"):
    return spark.createDataFrame([(name, d, float(v)) for d, v in zip(days(len(values)), values, strict=True)], "series string, price_date date, price double")


def test_gap_of_28_days_is_filled_and_of_29_is_not(spark):
    rows = [(1, DAY, 1500), (1, DAY + dt.timedelta(28), 1600), (1, DAY + dt.timedelta(57), 1700)]
    df = spark.createDataFrame(rows, "station_code long, price_date date, decicents int")
    got = {r.price_date: r.decicents for r in panel.gap_fill(df).collect()}
    assert len(got) == 28 + 1 + 1 and got[DAY + dt.timedelta(27)] == 1500 and DAY + dt.timedelta(29) not in got
    end = spark.createDataFrame([(DAY + dt.timedelta(60),)], "d date")
    assert panel.gap_fill(df, end).count() == 33
    assert panel.gap_fill(df.limit(0)).count() == 0


def test_peaks_of_a_sawtooth_plateaus_and_equal_heights():
    x = np.array(sawtooth(5 * 46))
    assert cycles.peaks(x, 7, 1.0).tolist() == [3 + 46 * k for k in range(5)]
    assert cycles.local_maxima(np.array([0, 1, 1, 1, 0, 2, 2, 0.0])).tolist() == [2, 5]
    assert cycles.peaks(np.array([0, 5, 0, 5, 0.0]), 3).tolist() == [3]
    assert cycles.confirmation(x, 3, 1.0) == 5
    assert len(cycles.local_maxima(np.array([1.0]))) == 0


def test_confirmed_peaks_and_states_do_not_look_ahead(spark):
    rng = np.random.default_rng(0)
    values = np.round(150 + np.cumsum(rng.normal(0, 1, 300)), 2)
    full = series(spark, values)
    cut = DAY + dt.timedelta(200)
    all_ = {(r.peak_date, r.confirmed_on) for r in cycles.confirmed_peaks(full, ["series"]).collect()}
    short = {(r.peak_date, r.confirmed_on) for r in cycles.confirmed_peaks(full.where(F.col("price_date") <= cut), ["series"]).collect()}
    assert short == {x for x in all_ if x[1] <= cut}
    state = cycles.cycle_state(full.select("series", "price_date"), cycles.confirmed_peaks(full, ["series"]), ["series"]).where(F.col("price_date") == cut).first()
    assert state.n_peaks == len(short) and state.last_peak == max(p for p, _ in short)


def test_troughs_lead_the_anchor(spark):
    wave = lambda lag: [150 + 10 * math.cos(2 * math.pi * (i + lag) / 45) for i in range(400)]
    both = series(spark, wave(5), "early").unionByName(series(spark, wave(0), "same"))
    anchor = cycles.trough_events(series(spark, wave(0), "anchor"), ["series"]).select(F.col("event_date").alias("anchor_date"))
    got = {r.series: r.median_lead for r in cycles.leadership(anchor, cycles.trough_events(both, ["series"]), "series", 20).collect()}
    assert got == {"early": 5.0, "same": 0.0}


def test_days_since_trough_depends_on_the_past_alone(spark):
    rng = np.random.default_rng(1)
    full = series(spark, 150 + 8 * np.sin(np.arange(150) / 7) + rng.normal(0, 0.5, 150))
    cut = DAY + dt.timedelta(120)
    f = lambda df: {r.price_date: r.days_since for r in cycles.days_since_trough(df, ["series"]).collect()}
    whole, short = f(full), f(full.where(F.col("price_date") <= cut))
    assert short == {d: v for d, v in whole.items() if d <= cut}


def test_savitzky_golay_reproduces_a_parabola(spark):
    x = np.arange(20.0)
    got = cycles.smooth(series(spark, 3 + 2 * x - 0.1 * x * x), "price", ["series"]).orderBy("price_date").collect()
    assert all(abs(r.smooth - r.price) < 1e-9 for r in got)
    m = cycles.savitzky_golay()
    y = np.random.default_rng(2).normal(size=7)
    fit = np.polyval(np.polyfit(np.arange(7), y, 2), np.arange(7))
    assert np.allclose(m @ y, fit)


def test_asof_takes_the_last_row_at_or_before(spark):
    left = spark.createDataFrame([(1, DAY), (1, DAY + dt.timedelta(5)), (2, DAY)], "k long, at date")
    right = spark.createDataFrame([(1, DAY, 10), (1, DAY + dt.timedelta(3), 13), (1, DAY + dt.timedelta(9), 19)], "k long, day date, v int")
    got = {(r.k, r["at"]): r.v for r in joins.asof(left, right, "k", "at", "day", ["v"]).collect()}
    assert got == {(1, DAY): 10, (1, DAY + dt.timedelta(5)): 13, (2, DAY): None}


def test_many_to_one_join_refuses_repeated_keys_and_clashes(spark):
    rows = spark.createDataFrame([(1,), (2,)], "k long")
    good, bad = spark.createDataFrame([(1, 5)], "k long, x int"), spark.createDataFrame([(1, 5), (1, 6)], "k long, x int")
    assert joins.hit_rate(joins.lookup(rows, good, ["k"], ["x"]), "x").first() == (1, 1)
    with pytest.raises(Exception, match="duplicate key"):
        joins.lookup(rows, bad, ["k"], ["x"]).collect()
    with pytest.raises(ValueError, match="shadow"):
        joins.lookup(rows.withColumn("x", F.lit(1)), good, ["k"], ["x"])


def test_classes_of_constant_prices(spark):
    rows = [(i, "c", d, p) for i, p in enumerate((1500, 1520, 1540, 2000)) for d in days(45)]
    df = spark.createDataFrame(rows, "station_code long, council string, price_date date, decicents int")
    got = {r.station_code: r["class"] for r in classify.classify(df).collect()}
    assert got == {0: "Competitive", 1: "Competitive", 2: "Competitive", 3: "Sticky"}


def test_tank_configurations_that_last_and_that_do_not():
    assert not simulate.never_dry(simulate.Tank(interval=1)) and not simulate.never_dry(simulate.Tank(interval=7))
    assert simulate.never_dry(simulate.Tank(interval=8)) and simulate.never_dry(simulate.Tank(interval=14))


def test_perfect_foresight_is_a_bound_and_litres_are_conserved(spark):
    tank = simulate.Tank()
    rng = np.random.default_rng(3)
    rows = [(s, d, int(p)) for s in (1, 2) for d, p in zip(days(60), 1500 + rng.integers(0, 400, 60), strict=True)]
    daily = spark.createDataFrame(rows, "station_code long, price_date date, decicents int")
    cal = simulate.evaluation_days(daily, "2020-01-01", "2020-02-29", 1)
    best = {r.station_code: r.spend for r in simulate.perfect_foresight(cal, tank).collect()}
    for tau in (0.0, 155.0, 170.0, 999.0):
        d = cal.withColumn("buy", F.coalesce(F.col("price") <= tau, F.lit(False)))
        r = simulate.replay(d, tank, ["station_code"])
        for x in r.collect():
            assert best[x.station_code] <= x.spend + 1e-6
            assert abs(25 + x.litres - 59 * tank.depletion - x.level) < 1e-6
        used = simulate.attribute_fifo(simulate.ledger(r, ["station_code"]), d, tank).groupBy("station_code").agg(F.sum("litres").alias("u")).collect()
        assert all(abs(x.u - 59 * tank.depletion) < 1e-6 for x in used)
        assert all(x.min_level > -1e-6 for x in simulate.audit(d, simulate.ledger(r, ["station_code"]), tank).collect())


def test_running_dry_is_an_error(spark):
    rows = [(1, d, 1700) for d in (DAY, DAY + dt.timedelta(20))]
    cal = simulate.evaluation_days(spark.createDataFrame(rows, "station_code long, price_date date, decicents int"), "2020-01-01", "2020-01-21", 1).withColumn("buy", F.lit(False))
    with pytest.raises(Exception, match="ran dry"):
        simulate.replay(cal, simulate.Tank(), ["station_code"]).collect()
    assert simulate.replay(cal, simulate.Tank(), ["station_code"], strict=False).count() == 1


def test_bootstrap_interval_holds_the_estimate(spark):
    units = spark.createDataFrame([(i, 100.0 + i, 1.0) for i in range(100)], "unit long, spend double, litres double")
    r = simulate.interval(simulate.bootstrap(units, 100)).first()
    assert r.low < 149.5 < r.high and r.high - r.low < 25


def test_correlation_of_a_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, None)], "a double, b double")
    assert df.agg(stats.safe_corr("a", "b").alias("r")).first().r is None


def test_leaks_are_found_and_placebos_keep_the_values(spark):
    s = series(spark, np.random.default_rng(4).normal(size=100))
    past = lambda df: df.select("price_date", panel.calendar_delta(df, "price", 3).alias("x"))
    ahead = lambda df: panel.gradient(df, "price").select("price_date", "gradient")
    assert trials.leaks(past, s, "2020-02-20").count() == 0 and trials.leaks(ahead, s, "2020-02-20").count() > 0
    p = trials.block_placebo(s, "price", 9, 4).collect()
    assert sorted(r.price for r in p) == sorted(r.placebo for r in p) and sum(r.price == r.placebo for r in p) == 1


def test_candidates_are_refused(spark):
    df = spark.createDataFrame([(1.0, 1)], "x double, label int")
    make = lambda **k: trials.Candidate(**({"name": "c", "inputs": ["x"], "columns": ["y"], "add": lambda d: d.withColumn("y", F.col("x"))} | k))
    assert trials.validate(make(), df).first().null_rate == 0
    with pytest.raises(ValueError, match="targets"):
        trials.validate(make(inputs=["label"]), df)
    with pytest.raises(ValueError, match="aren't there"):
        trials.validate(make(inputs=["z"]), df)
    with pytest.raises(ValueError, match="weren't added"):
        trials.validate(make(columns=["q"]), df)
    with pytest.raises(Exception, match="null throughout"):
        trials.validate(make(add=lambda d: d.withColumn("y", F.lit(None).cast("double"))), df).collect()


def test_contracts_stamps_and_family_thresholds():
    with pytest.raises(ValueError, match="cadence"):
        trials.same_contract({"cadence": 1}, {"cadence": 7})
    assert trials.unstamped({"a": {"cpl": 1}, "b": {"cadence": "x", "arms": [{"cpl": 2}]}}) == ["/a"]
    assert abs(trials.t_quantile(0.975, 19) - 2.093) < 1e-3 and abs(trials.t_quantile(0.025, 19) + 2.093) < 1e-3
    assert abs(trials.family_share(0.95, 5) - 0.99) < 1e-12 and trials.family_z(0.95, 5, 20) > trials.family_z(0.95, 1, 20)


def test_storage_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    path = str(tmp_path / "t")
    storage.rewrite(df, path)
    with pytest.raises(ValueError, match="nothing"):
        storage.rewrite(df.limit(0), path)
    log = str(tmp_path / "log")
    storage.append_log(df, log)
    storage.append_log(df, log)
    with pytest.raises(ValueError, match="columns"):
        storage.append_log(df.drop("v"), log)
    assert storage.read(spark, log).count() == 4
    u = storage.upsert(df, spark.createDataFrame([(2, "x"), (9, "a")], "k int, v string"), "k", ["v"], [], unique="v")
    assert {(r.k, r.v) for r in u.collect()} == {(1, "a"), (2, "x")}


def test_models_beat_the_base_rate_and_calibrate(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 2))
    y = (rng.random(600) < 1 / (1 + np.exp(-(1.8 * x[:, 0] - 1.0 * x[:, 1])))).astype(int)
    df = spark.createDataFrame([(float(a), float(b), int(c), i % 3) for i, ((a, b), c) in enumerate(zip(x, y, strict=True))], "f1 double, f2 double, label int, fold int").cache()
    s = models.score(models.out_of_fold(models.logistic(["f1", "f2"]), df, "fold", [0, 1, 2])).first()
    assert s.log_loss < 0.9 * -(s.base_rate * math.log(s.base_rate) + (1 - s.base_rate) * math.log(1 - s.base_rate))
    tree = models.boosted(["f1", "f2"], rounds=5, depth=2).fit(df)
    assert models.importance(tree, ["f1", "f2"])[0][0] == "f1"
    method, out = models.calibrate(models.predict(tree, df).select("label", "proba"))
    assert method in ("sigmoid", "isotonic") and out.where("calibrated < 0 or calibrated > 1").count() == 0
    assert models.r2(df.withColumn("t", F.col("f1") * 2), "t", ["f1", "f2"]) > 0.999
    assert models.clusters(["a", "b", "c"], np.array([[1, 0.9, 0], [0.9, 1, 0], [0, 0, 1]]), 0.5) == [["a", "b"], ["c"]]


def test_text_and_signals(spark):
    df = spark.createDataFrame([("12 Main St., St Marys NSW 2760",), ("5 Old Rd Penrith NSW 2750",)], "a string")
    assert [r[0] for r in df.select(text.normalise_address(F.col("a"))).collect()] == ["12 main street st marys", "5 old road penrith"]
    assert [r[0] for r in df.select(text.suburb_of(F.col("a"))).collect()] == ["St Marys", "Penrith"]
    assert files.resolve(["North", "Northern"], "north") == "North"
    with pytest.raises(ValueError, match="matches"):
        files.resolve(["North", "Northern"], "nort")
    v = spark.createDataFrame([(1, None, 1), (None, None, None), (-1, -1, 0)], "a int, b int, c int")
    assert [r.verdict for r in signals.combine(v, ["a", "b", "c"]).collect()] == ["BUY", "WAIT", "DONT"]


def test_streams_agree_with_batches(spark, sf_dir):
    from tidewell.streaming import ingest

    schema = Tables(spark, sf_dir).table("events").schema
    source = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    got = ingest.run_to_end(spark, ingest.first_wins(source, ["user_id", "event_type"]).select("user_id", "event_type"))
    want = Tables(spark, sf_dir).table("events").select("user_id", "event_type").distinct()
    assert got.count() == want.count()


def test_columns_are_declared_once():
    from tidewell.operators import metrics

    assert metrics.unclassified(["a", "b", "c"], ["a"], ["b"]) == ["c"]
    with pytest.raises(ValueError, match="twice"):
        metrics.unclassified(["a"], ["a"], ["a"])


def test_ablation_keeps_the_feature_that_matters(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 2))
    df = spark.createDataFrame([(float(a), float(b), int(a + 0.3 * e > 0), i % 2) for i, ((a, b), e) in enumerate(zip(x, rng.normal(size=300), strict=True))], "f1 double, f2 double, label int, fold int").cache()
    got = {r[0]: r[3] for r in models.ablation(lambda use, seed: models.logistic(use), df, ["f1", "f2"], "fold = 0", "fold = 1", [0])}
    assert got["none"] == "baseline" and got["f1"] == "keep"


def test_paired_backtest_has_a_row_for_each_fold_and_arm(spark, sf_dir):
    from tidewell import registry

    got = registry.QUERIES["paired_backtest"](spark, sf_dir).orderBy("fold", "arm").collect()
    assert [(r.fold, r.arm) for r in got] == [(0, "base"), (0, "trial"), (1, "base"), (1, "trial")]
    assert all(r.delta_held == r.delta_own == 0 for r in got if r.arm == "base") and all(150 < r.cpl_own < 200 and "interval=1d" in r.cadence for r in got)
    pooled = {r.arm: r for r in registry.QUERIES["cached_backtest"](spark, sf_dir).collect()}
    for arm in ("base", "trial"):
        mine = [r for r in got if r.arm == arm]
        assert abs(pooled[arm].cpl_held - sum(r.spend_held for r in mine) / sum(r.litres_held for r in mine)) < 1e-9


def test_candidates_get_a_status(spark):
    from tidewell.operators import backtest

    rng = np.random.default_rng(12)
    n = 400
    x, z = rng.normal(size=n), rng.normal(size=n)
    rows = [(1, d, float(a), float(b), int(a + b + 0.3 * e > 0)) for d, a, b, e in zip(days(n), x, z, rng.normal(size=n), strict=True)]
    frame = spark.createDataFrame(rows, "station_code long, price_date date, x double, z double, label int").cache()
    make = lambda f, inputs=("z", "price_date", "station_code"): trials.Candidate("c", list(inputs), ["c"], lambda df: df.withColumn("c", f(df)))
    run = lambda c: backtest.try_candidate(c, frame, ["x"], "price_date < '2020-10-01'", "price_date >= '2020-10-01'", "2020-06-30")[0]
    from pyspark.sql import Window

    assert run(make(lambda df: F.col("z") * 2)) == "promising"
    assert run(make(lambda df: F.col("x") * 3, ("x", "price_date", "station_code"))) == "redundant"
    assert run(make(lambda df: F.lead("z").over(Window.partitionBy("station_code").orderBy("price_date")))) == "leaky"
    assert run(make(lambda df: F.col("label"), ("label",))) == "invalid"


def test_noise_floor_of_placebos(spark):
    from tidewell.operators import backtest, metrics

    rng = np.random.default_rng(13)
    cents = 1600 + rng.integers(0, 200, 300)
    daily = spark.createDataFrame([(1, d, int(p)) for d, p in zip(days(300), cents, strict=True)], "station_code long, price_date date, decicents int")
    frame = daily.select("station_code", "price_date", (F.col("decicents") / 10).alias("today"), (F.col("decicents") < 1680).cast("int").alias("label"))
    windows = metrics.folds(spark, "2020-01-01", 1, 200, 60, 60, 7)
    series_ = daily.select("price_date", (F.col("decicents") / 7).alias("v"))
    got = backtest.noise_floor(frame, series_, "v", daily, windows, ["today"], backtest.Setup(simulate.Tank()), [1, 2], 30).collect()
    assert [(r.draw, r.fold) for r in got] == [(1, 0), (2, 0)] and all(abs(r.delta) < 5 for r in got)


def test_a_bump_on_the_way_down_is_no_peak(spark):
    x = [12, 11, 10, 9.5, 9.6, 8, 7, 6, 7, 8, 9, 8, 7]
    true = [(DAY + dt.timedelta(10), DAY + dt.timedelta(11))]
    # over the whole series the distance comes first, and the higher bump is six rows away
    for mode, distance, want in ((True, 7, true), (False, 6, true), (False, 7, [])):
        got = cycles.confirmed_peaks(series(spark, x), ["series"], distance=distance, drop=1.0, point_in_time=mode).collect()
        assert [(r.peak_date, r.confirmed_on) for r in got] == want
    assert cycles.confirmation(np.array([5.0, 4.5, 6.0, 3.0]), 0, 1.0) is None
    saw = series(spark, sawtooth(230))
    both = [sorted(r.peak_date for r in cycles.confirmed_peaks(saw, ["series"], point_in_time=m).collect()) for m in (True, False)]
    assert both[0] == both[1] == [DAY + dt.timedelta(3 + 46 * k) for k in range(5)]


def test_troughs_smooth_as_a_centred_mean():
    rng = np.random.default_rng(7)
    x = 150 + 8 * np.sin(np.arange(300) / 7) + rng.normal(0, 0.5, 300)
    mean = np.array([x[max(0, i - 3) : i + 4].mean() for i in range(300)])
    at = cycles.spaced(-mean, cycles.local_maxima(-mean), 18)
    assert cycles.troughs(x).tolist() == sorted({max(0, t - 5) + int(np.argmin(x[max(0, t - 5) : t + 6])) for t in at})


def test_leave_one_out_keeps_days_without_own_rows(spark):
    rows = [(DAY, "a", 10)] * 3 + [(DAY, "b", 20)] * 3 + [(DAY + dt.timedelta(1), "b", 30)] * 3
    got = {(r.price_date, r.g): r.anchor_price for r in panel.leave_one_out(spark.createDataFrame(rows, "price_date date, g string, decicents int"), "g").collect()}
    assert got == {(DAY, "a"): 2.0, (DAY, "b"): 1.0, (DAY + dt.timedelta(1), "a"): 3.0}


def test_weekly_leads_of_two_waves(spark):
    wave = lambda lag: [150 + 10 * math.cos(2 * math.pi * (i + lag) / 45) for i in range(800)]
    rows = [(d, g, p, a) for g, lag in (("early", 5), ("same", 0)) for d, p, a in zip(days(800), wave(lag), wave(0), strict=True)]
    got = cycles.leadership_snapshots(spark.createDataFrame(rows, "price_date date, g string, price double, anchor_price double"), "g", window=400).collect()
    late = [r for r in got if r.snapshot_date > DAY + dt.timedelta(420)]
    assert {(r.g, r.median_lead) for r in late} == {("early", 5.0), ("same", 0.0)} and min(r.matched for r in late) > 0.8
    assert {r.snapshot_date for r in got if r.g == "early"} == {DAY + dt.timedelta(1 + 7 * k) for k in range(115)}


def test_suburbs_postcodes_and_dates(spark):
    addresses = {
        "123 Main St, Springwood NSW 2777": ("Springwood", "2777"), "Cnr A & B Rd Wagga Wagga NSW 2650": ("Wagga Wagga", "2650"), "1 High Street, Port Augusta WA 6000": ("Port Augusta", "6000"),
        "12 Main St, NSW 2000": (None, "2000"), "Shop 4 2011 Plaza": (None, "2011"), "nowhere": (None, None), "5 Beach Road O'CONNOR ACT 2602": ("O'Connor", "2602"), None: (None, None),
    }
    df = spark.createDataFrame([(a,) for a in addresses], "a string")
    got = {r.a: (r.s, r.p) for r in df.select("a", text.suburb_of(F.col("a")).alias("s"), text.postcode_of(F.col("a")).alias("p")).collect()}
    assert got == addresses
    when = dt.datetime(2024, 3, 5, 14, 30)
    forms = {"2024-03-05T14:30:00": when, "2024-03-05 14:30:00": when, "2024-03-05": dt.datetime(2024, 3, 5), "5/03/2024 02:30:00 PM": when, "5/3/2024 14:30": when, "05/03/2024": dt.datetime(2024, 3, 5), "20240305": None, "5-Mar-2024": None, "": None}
    rows = spark.createDataFrame([(x,) for x in forms], "x string").select("x", text.parse_date(F.col("x")).alias("t")).collect()
    assert {r.x: r.t for r in rows} == forms
    code = spark.createDataFrame([("2056", "x"), ("", "1 Main St 2461"), ("2609", "x"), (None, "a 2777"), ("2777", "x")], "c string, a string")
    assert [r.p for r in code.select(text.clean_postcode(F.col("c"), F.col("a")).alias("p")).collect()] == ["2506", "2460", None, "2777", "2777"]


def test_the_month_of_a_file(spark):
    d = lambda m, day: dt.date(2019, m, day)
    rows = [("sure", 1, d(5, 3)), ("sure", 2, d(3, 17)), ("constant", 1, d(1, 10)), ("constant", 2, d(2, 10)), ("last", 1, d(4, 2)), ("last", 2, d(6, 3)), ("none", 1, None)]
    got = files.file_month(spark.createDataFrame(rows, "file string, line long, at date")).collect()
    assert {r.file: r.month for r in got} == {"sure": 3, "constant": 10, "last": 6}
    c = spark.createDataFrame([(d(3, 17),), (d(17 % 12, 3),), (d(9, 9),)], "at date")
    assert [r.x for r in c.select(text.swap_day_month(F.col("at"), F.lit(3), F.lit(d(12, 31))).alias("x")).collect()] == [d(3, 17), d(3, 5), None]
    assert c.select(text.swap_day_month(F.col("at"), F.lit(3), F.lit(d(1, 1))).alias("x")).dropna().count() == 0


def test_raw_histories_are_cleaned(spark, tmp_path):
    head = ",".join(files.RAW)
    lines = [
        'Shell A,"1 Main St NSW 2777",SPRINGWOOD,2777,Shell,E10,13/05/2001 10:00,150.04', ",,,,,P98,,170", ",,,,,,,", '7,Shell B,"2 Main St 2461",katoomba,,,E10,14/05/2001 09:00,151.26',
        'Shell B,"2 Main St 2461",katoomba,,,E10,14/05/2001 18:00,160', "Nobody,1 X,Y,2000,,E10,14/05/2001,150", "Shell C,1 X,Y,2609,Shell,E10,14/05/2001,150", "Shell C,1 X,Y,2000,Shell,E10,5/13/2001,150", "Shell C,1 X,Y,2000,Shell,E10,5/06/2001,nil", "Shell C,1 X,Y,2000,Shell,E10,2001-07-05,1500",
    ]
    (tmp_path / "raw.csv").write_text("\n".join([head, *lines]) + "\n")
    got = sorted(tuple(r) for r in files.read_raw(spark, str(tmp_path), [("shell", "Shell")]).collect())
    day = dt.date(2001, 5, 13)
    assert got == [
        ("Shell A", "1 Main St NSW 2777", "Springwood", "2777", "Shell", "E10", day, 150.0), ("Shell A", "1 Main St NSW 2777", "Springwood", "2777", "Shell", "P98", day, 170.0),
        ("Shell B", "2 Main St 2461", "Katoomba", "2460", "Shell", "E10", dt.date(2001, 5, 14), 160.0), ("Shell C", "1 X", "Y", "2000", "Shell", "E10", dt.date(2001, 5, 7), 999.0),
    ]


def test_an_unsettled_tank_is_an_error():
    with pytest.raises(ValueError, match="not settled"):
        simulate.never_dry(simulate.Tank(), most=2)


def test_frames_come_from_the_newer_file(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0)], "k int, x double")
    path = str(tmp_path / "f")
    storage.save_frame(df, path)
    assert storage.load_frame(spark, path, "k int, x double").collect() == df.collect()
    import time

    time.sleep(1.1)
    spark.createDataFrame([(7, 3.0)], "k int, x double").write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    assert [r.k for r in storage.load_frame(spark, path, "k int, x double").collect()] == [7]
