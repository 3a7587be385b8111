"""Paired realised backtests: arms of features, fitted fold by fold, and what their decisions would have cost."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.operators import metrics, models, trials
from tidewell.operators import simulate as sim
from tidewell.operators.storage import exists, stored
from tidewell.sources.files import scratch


@dataclass(frozen=True)
class Setup:
    """What results depend on beside the rows and the folds. make builds a pipeline of features and a seed."""

    tank: sim.Tank
    seed: int = 42
    inner: int = 3
    held: float | None = None
    make: Callable[[list[str], int], Pipeline] = lambda features, seed: models.logistic(features)
    method: str = "logistic"


class FoldCache:
    """The baseline's results by fold in a Parquet table, each with the fingerprint of what it depends on."""

    SCHEMA = "fold int, val_start date, val_end date, tau double, spend double, litres double, fills long, always_spend double, always_litres double, fingerprint string"

    def __init__(self, path: str):
        self.path = path

    def known(self, spark: SparkSession, fingerprint: dict) -> dict[int, Row]:
        """Results by fold. A table of other columns, stations, seed, tank, method or data is refused, by what differs."""
        if not exists(spark, self.path):
            return {}
        rows = spark.read.schema(self.SCHEMA).parquet(self.path).collect()  # a row a fold
        for have in {r.fingerprint for r in rows}:
            if differs := {k: (v, fingerprint.get(k)) for k, v in json.loads(have).items() if v != fingerprint.get(k)}:
                raise ValueError(f"cached results are of another setup: {differs}")
        return {r.fold: r for r in rows}

    def add(self, spark: SparkSession, rows: list[dict], fingerprint: dict) -> None:
        if rows:
            said = json.dumps(fingerprint, sort_keys=True)
            names = [c.split()[0] for c in self.SCHEMA.split(", ")]
            spark.createDataFrame([tuple((r | {"fingerprint": said})[c] for c in names) for r in rows], self.SCHEMA).coalesce(1).write.mode("append").parquet(self.path)


def fingerprint(name: str, features: list[str], daily: DataFrame, setup: Setup, data: str | None) -> dict:
    """Which results of a fold may stand for each other; not the folds themselves, so that more of them can be added."""
    code = F.xxhash64("station_code").cast("decimal(20,0)")
    n, total = daily.select("station_code").distinct().agg(F.count(F.lit(1)), F.coalesce(F.sum(code), F.lit(0))).first()
    return {"baseline": name, "features": list(features), "stations": f"{n}:{total}", "seed": setup.seed, "inner": setup.inner, "method": setup.method, "tank": setup.tank.stamp(), "data": data}


def training(setup: Setup, features: list[str], train: DataFrame) -> DataFrame:
    """The training rows as models.cells of label, features and stretch: the days are cut into `inner` stretches."""
    first, last = train.agg(F.min("price_date"), F.max("price_date")).first()
    if first is None or (last - first).days < setup.inner:
        raise ValueError("too few training days to choose a threshold on")
    span = (last - first).days + 1
    stretch = F.floor(F.datediff("price_date", F.lit(first)) * setup.inner / span).cast("int")
    return models.cells(train.withColumn("stretch", stretch), ["stretch", "label", *features])


def calibrated_threshold(setup: Setup, features: list[str], known: DataFrame) -> tuple[PipelineModel, IsotonicRegressionModel, float]:
    """(model of all rows, calibration, threshold) of training rows: the latter two from rows that were scored by models of the days before them.

    The model of all rows before a stretch scores it, and the first has no scores. Equal rows have equal scores, so that
    distinct ones are scored, with their counts.
    """
    scored = models.out_of_fold(setup.make(features, setup.seed), known, "stretch", list(range(setup.inner)))
    scored = models.cells(scored.withColumn("label", F.col("label").cast("double")), ["label", "proba"])
    iso = IsotonicRegression(featuresCol="proba", labelCol="label", predictionCol="calibrated", weightCol=models.COUNT).fit(scored)
    tau = metrics.pick_tau(metrics.threshold_sweep(calibrate_by(iso, scored), weight=models.COUNT)).where("method = 'isotonic'").first()["tau"]
    return setup.make(features, setup.seed).fit(known), iso, float(tau)


def calibrate_by(iso: IsotonicRegressionModel, scored: DataFrame) -> DataFrame:
    return iso.transform(scored).withColumn("proba", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("calibrated")))).drop("calibrated")


def spent(days: DataFrame, buy: Column, tank: sim.Tank) -> Row:
    """(spend, litres, fills) of all stations together, the tank replayed under a rule."""
    done = sim.replay(days.withColumn("buy", buy), tank, ["station_code"], strict=False)
    return done.agg(F.sum("spend").alias("spend"), F.sum("litres").alias("litres"), F.sum(F.size("fills")).alias("fills")).first()


RESULT = "fold int, arm string, val_start date, val_end date, own_tau double, held_tau double, spend_own double, litres_own double, fills_own long, spend_held double, litres_held double, always_spend double, always_litres double, cached boolean"


def paired_backtest(frame: DataFrame, daily: DataFrame, windows: DataFrame, arms: dict[str, list[str]], baseline: str, setup: Setup, cache: FoldCache | None = None, data: str | None = None, shared: dict | None = None) -> DataFrame:
    """A row for each fold and arm: RESULT with cpl, saving and delta at the arm's own threshold and at the held one.

    frame has station_code, price_date, label and the features; windows is a handful of folds (see metrics.folds). In
    each fold an arm is fitted on the rows up to train_end; its own threshold comes from calibrated_threshold, the held one is
    setup.held, or the baseline's own of the fold, so that a difference at it is the features' and not the threshold's. All
    stations' days of the validation window are scored in one pass, days without a score buy, and the tank is replayed. Costs
    are pooled over stations; saving is against always buying, in percent; delta against the baseline in the same fold.

    With a cache the baseline is only fitted for the folds that it lacks, which are added to it. A cache of another setup is
    refused, as is one whose fold has other validation days, and one with a held threshold that isn't the baseline's own. data names the
    rows (see freeze.content), for the cache to tell them from others. shared is a dictionary for runs over the same days and folds, where columns
    of one name are the same: the validation days, what always buying costs, and the training rows of a set of features are made once for all of them.
    """
    if baseline not in arms:
        raise ValueError(f"no arm is called {baseline!r}")
    if bad := sorted(a for a, f in arms.items() if not f):
        raise ValueError(f"arms without features: {bad}")
    if cache and setup.held is not None:
        raise ValueError("cached results are at the baseline's own threshold; a held one can't use them")
    spark = frame.sparkSession
    key = fingerprint(baseline, arms[baseline], daily, setup, data) if cache else {}
    known = cache.known(spark, key) if cache else {}
    folds = windows.orderBy("fold").collect()
    if drifted := [w.fold for w in folds if w.fold in known and (known[w.fold].val_start, known[w.fold].val_end) != (w.val_start, w.val_end)]:
        raise ValueError(f"cached folds have other validation days: {drifted}")
    rows, fresh, shared = [], [], {} if shared is None else shared

    def once(key: tuple, make: Callable):
        if key not in shared:
            shared[key] = make()
        return shared[key]

    for w in folds:
        val = frame.where(F.col("price_date").between(F.lit(w.val_start), F.lit(w.val_end)))
        lasting = F.col("price_date").between(F.lit(w.val_start), F.lit(w.val_end))
        days = once(("days", w.fold), lambda w=w, lasting=lasting: stored(sim.evaluation_days(daily.where(lasting), str(w.val_start), str(w.val_end), setup.tank.interval), "days"))

        def at(decided: DataFrame, tau: float) -> Row:
            return spent(decided, F.coalesce(F.col("proba") >= tau, F.lit(True)), setup.tank)

        def fitted(features: list[str], w=w, val=val, days=days) -> tuple[float, DataFrame]:
            known = once(("train", w.fold, *features), lambda: training(setup, features, frame.where(F.col("price_date") <= F.lit(w.train_end))))
            model, iso, tau = calibrated_threshold(setup, features, known)
            scored = calibrate_by(iso, models.predict(model, val)).select("station_code", F.col("price_date").alias("day"), "proba")
            return tau, stored(days.join(scored, ["station_code", "day"], "left"), "decided")

        if w.fold in known:
            r = known[w.fold]
            base = {c: r[c] for c in ("fold", "val_start", "val_end", "tau", "spend", "litres", "fills", "always_spend", "always_litres")}
        else:
            always = once(("always", w.fold), lambda days=days: spent(days, F.lit(True), setup.tank))
            tau, decided = fitted(arms[baseline])
            own = at(decided, tau)
            base = {"fold": w.fold, "val_start": w.val_start, "val_end": w.val_end, "tau": tau, "spend": own.spend, "litres": own.litres, "fills": own.fills, "always_spend": always.spend, "always_litres": always.litres}
            fresh.append(base)
        held = setup.held if setup.held is not None else base["tau"]
        for arm, features in arms.items():
            if arm == baseline:
                tau, own = base["tau"], (base["spend"], base["litres"], base["fills"])
                other = own if held == tau else tuple(at(decided, held))
            else:
                tau, scored = fitted(features)
                own = tuple(at(scored, tau))
                other = own if held == tau else tuple(at(scored, held))
            rows.append((w.fold, arm, w.val_start, w.val_end, tau, held, *own, *other[:2], base["always_spend"], base["always_litres"], arm == baseline and w.fold in known))
    if cache:
        cache.add(spark, fresh, key)
    return _measured(spark.createDataFrame(rows, RESULT), baseline, ["fold"]).withColumn("cadence", F.lit(setup.tank.stamp()))


def _measured(rows: DataFrame, baseline: str, by: list[str]) -> DataFrame:
    """With cpl, saving and delta at both thresholds, the deltas against the baseline's of the same `by`."""
    always = F.try_divide("always_spend", "always_litres")
    out = rows.withColumn("always_cpl", always)
    for kind in ("own", "held"):
        cpl = F.try_divide(f"spend_{kind}", f"litres_{kind}")
        out = out.withColumns({f"cpl_{kind}": cpl, f"saving_{kind}": F.try_divide(always - cpl, always) * 100})
        base = F.max(F.when(F.col("arm") == baseline, F.col(f"cpl_{kind}"))).over(Window.partitionBy(*by))
        out = out.withColumn(f"delta_{kind}", F.col(f"cpl_{kind}") - base)
    return out


def pooled(results: DataFrame, baseline: str) -> DataFrame:
    """A row for each arm, spend and litres pooled over the folds before they are divided."""
    money = ("spend_own", "litres_own", "spend_held", "litres_held", "always_spend", "always_litres")
    sums = [F.sum(c).alias(c) for c in money]
    rows = results.groupBy("arm").agg(F.count(F.lit(1)).alias("folds"), F.median("own_tau").alias("own_tau"), F.median("held_tau").alias("held_tau"), *sums)
    return _measured(rows, baseline, [])


def noise_floor(frame: DataFrame, series: DataFrame, value: str, daily: DataFrame, windows: DataFrame, features: list[str], setup: Setup, shifts: list[int], block: int = 90) -> DataFrame:
    """(draw, fold, delta): what a market-wide column of no worth changes at the held threshold, for each placebo draw of the series.

    A draw is the series with its blocks moved round, so that it has the series' own distribution and smoothness. The draws
    share the baseline, which is fitted once.
    """
    parts, cache, shared = [], FoldCache(scratch(frame.sparkSession, "baseline")), {}
    series = stored(series.select("price_date", value), "series")
    for k in shifts:
        name = f"placebo_{k}"
        placebo = trials.block_placebo(series, value, block, k, name=name).select("price_date", name)
        arms = {"base": features, "draw": [*features, name]}
        got = paired_backtest(frame.join(F.broadcast(placebo), "price_date", "left"), daily, windows, arms, "base", setup, cache, shared=shared)  # a row a day
        parts.append(got.where("arm = 'draw'").select(F.lit(k).alias("draw"), "fold", F.col("delta_held").alias("delta")))
    return reduce(DataFrame.unionByName, parts)


def fit_stability(frame: DataFrame, daily: DataFrame, windows: DataFrame, features: list[str], setup: Setup, seeds_a: list[int], seeds_b: list[int]) -> DataFrame:
    """(pair, fold, seed_a, seed_b, cpl_a, cpl_b, delta, mean, deviation): what the seed alone changes, columns, rows and folds being the same.

    Seeds pair up one by one; groups of unequal size, with repeats or in common are refused. mean and deviation are of the
    deltas of all pairs, each pooled over its folds.
    """
    if len(seeds_a) != len(seeds_b):
        raise ValueError(f"seeds pair up one by one, but there are {len(seeds_a)} and {len(seeds_b)}")
    if len(set(seeds_a)) < len(seeds_a) or len(set(seeds_b)) < len(seeds_b):
        raise ValueError(f"a group has a seed twice: {seeds_a}, {seeds_b}")
    if both := sorted(set(seeds_a) & set(seeds_b)):
        raise ValueError(f"the groups have seeds in common: {both}")
    shared: dict = {}
    runs = [paired_backtest(frame, daily, windows, {"base": features}, "base", replace(setup, seed=s), shared=shared).withColumn("seed", F.lit(s)) for s in [*seeds_a, *seeds_b]]
    every = stored(reduce(DataFrame.unionByName, runs).select("seed", "fold", "spend_own", "litres_own", "cpl_own"), "seeds")
    pairs = frame.sparkSession.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(seeds_a, seeds_b, strict=True))], "pair int, seed_a int, seed_b int")
    side = lambda x: every.select(F.col("seed").alias(f"seed_{x}"), "fold", F.col("cpl_own").alias(f"cpl_{x}"), F.col("spend_own").alias(f"spend_{x}"), F.col("litres_own").alias(f"litres_{x}"))
    met = pairs.join(side("a"), "seed_a").join(side("b"), ["seed_b", "fold"]).withColumn("delta", F.col("cpl_b") - F.col("cpl_a"))
    sums = met.groupBy("pair").agg((F.sum("spend_b") / F.sum("litres_b") - F.sum("spend_a") / F.sum("litres_a")).alias("d"))
    spread = sums.agg(F.avg("d").alias("mean"), F.stddev_samp("d").alias("deviation"))
    return met.crossJoin(F.broadcast(spread)).select("pair", "fold", "seed_a", "seed_b", "cpl_a", "cpl_b", "delta", "mean", "deviation")


def try_candidate(candidate: trials.Candidate, frame: DataFrame, features: list[str], train: str, test: str, cut: str, gate: float = 0.85) -> tuple[str, str]:
    """(status, reason) of a candidate feature: invalid, leaky, redundant, no_gain or promising, in this order.

    It is computed from its declared inputs; recomputed on rows up to `cut`, where nothing may change; correlated with
    the features that there are, where what can't be computed doesn't pass; and must lower the log loss of the test rows.
    """
    try:
        trials.validate(candidate, frame).collect()
    except Exception as e:  # noqa: BLE001  the reason is the result
        return "invalid", str(e).splitlines()[0]
    keys = ["station_code", "price_date"]
    build = lambda df: candidate.add(df).select(*keys, *candidate.columns)
    rows = frame.select(*dict.fromkeys([*keys, *candidate.inputs]))
    if changed := trials.leaks(build, rows, cut).count():
        return "leaky", f"{changed} rows up to {cut} change with later rows"
    wide = _with_candidate(candidate, frame, keys, [*features, "label"], build, rows)
    part = models.cells(wide.withColumns({"_train": F.expr(train), "_test": F.expr(test)}), ["_train", "_test", "label", *features, *candidate.columns])
    pairs = trials.redundancy(trials.pairwise(part, [*features, *candidate.columns], models.COUNT), gate).where(F.col("b").isin(candidate.columns) & ~F.col("a").isin(candidate.columns))
    if bad := pairs.where("verdict != 'pass'").orderBy("a", "b").first():
        return "redundant", f"{bad.b} with {bad.a}: {bad.verdict}"
    losses = [models.score(models.predict(models.logistic(f).fit(part.where("_train")), part.where("_test"))).first()["log_loss"] for f in (features, [*features, *candidate.columns])]
    return ("promising" if losses[1] < losses[0] else "no_gain"), f"log loss {losses[0]:.5f} without, {losses[1]:.5f} with"


def _with_candidate(candidate: trials.Candidate, frame: DataFrame, keys: list[str], others: list[str], build: Callable[[DataFrame], DataFrame], rows: DataFrame) -> DataFrame:
    """frame with the candidate's columns. Columns that it isn't given go along under other names where it keeps them, else its rows are joined by the keys."""
    hidden = {c: f"_hidden_{c}" for c in frame.columns if c not in rows.columns}
    out = candidate.add(frame.withColumnsRenamed(hidden))
    if set(hidden.values()) | set(keys) | (set(others) & set(rows.columns)) <= set(out.columns) and not set(candidate.columns) & set(frame.columns):
        return out.withColumnsRenamed({v: k for k, v in hidden.items()})
    return frame.join(build(rows), keys)
