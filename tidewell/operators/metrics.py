"""Folds, thresholds, calibration tables and comparisons of arms, over (fold, seed, arm, proba, label, litres, price) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.functions import stats
from tidewell.functions.stats import safe_corr
from tidewell.operators.storage import stored

# Cents a decision earns or costs.
TP, FP, FN = 6.37, 5.80, 11.14


def fixed_split(rows: DataFrame, train_end: str = "1999-01-01", val_end: str = "2000-06-30", buffer: int = 7) -> DataFrame:
    d = F.col("price_date")
    val = d.between(F.date_add(F.lit(train_end), buffer), F.lit(val_end).cast("date"))
    return rows.withColumn("split", F.when(d < train_end, "train").when(val, "val").when(d > F.date_add(F.lit(val_end), buffer), "test").otherwise("buffer"))


def folds(spark: SparkSession, start: str, n: int, train: int, val: int, step: int, buffer: int) -> DataFrame:
    """(fold, val_start, train_end, val_end) of n expanding windows."""
    first = F.date_add(F.lit(start).cast("date"), (F.lit(train) + F.col("id") * step).cast("int"))
    f = spark.range(n).select(F.col("id").cast("int").alias("fold"), first.alias("val_start"))
    return f.select("fold", "val_start", F.date_sub("val_start", buffer + 1).alias("train_end"), F.date_add("val_start", val - 1).alias("val_end"))


def fold_counts(rows: DataFrame, windows: DataFrame) -> DataFrame:
    """Rows to train and to validate on; rows are summed by day before they meet the windows, which are few."""
    days = rows.groupBy("price_date").agg(F.count(F.lit(1)).alias("n"))
    met = days.join(F.broadcast(windows), F.col("price_date") <= F.col("val_end"))
    inside = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return met.groupBy("fold", "val_start", "val_end").agg(inside(F.col("price_date") <= F.col("train_end")).alias("n_train"), inside(F.col("price_date").between(F.col("val_start"), F.col("val_end"))).alias("n_val"))


def threshold_sweep(rows: DataFrame, steps: int = 20, tp: float = TP, fp: float = FP, fn: float = FN, weight: str | None = None) -> DataFrame:
    """Counts and metrics at each k/steps: rows, each so often as its weight says, are counted by the last threshold they reach, then the counts are summed up.

    No row is repeated for each threshold: one pass, then `steps` rows.
    """
    reached = F.element_at(F.filter(F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda k: F.struct(k.alias("k"), (F.col("proba") >= k.cast("decimal(4,0)") * F.lit(1 / steps).cast("decimal(6,4)")).alias("ok"))), lambda s: s["ok"]), -1)["k"]
    by = rows.groupBy(F.coalesce(reached, F.lit(0)).alias("k")).agg(F.sum(F.col("label") if weight is None else F.col("label") * F.col(weight)).alias("yes"), (F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("n"))
    every = rows.sparkSession.range(steps).select(F.col("id").cast("int").alias("k")).join(by, "k", "left").na.fill(0)
    up, all_ = Window.partitionBy().orderBy(F.desc("k")), Window.partitionBy()
    c = every.select("k", F.sum("yes").over(up).alias("tp"), (F.sum("n").over(up) - F.sum("yes").over(up)).alias("fp"), F.sum("yes").over(all_).alias("pos"), F.sum("n").over(all_).alias("n"))
    c = c.where("k > 0").select("k", "tp", "fp", (F.col("pos") - F.col("tp")).alias("fn"), (F.col("n") - F.col("pos") - F.col("fp")).alias("tn"), "n")
    out = stats.precision_recall(c.withColumn("buy_rate", F.round((F.col("tp") + F.col("fp")) / F.col("n"), 4)))
    return out.withColumn("expected_cents", F.round((F.col("tp") * tp - F.col("fp") * fp - F.col("fn") * fn) / F.col("n"), 6)).drop("n")


def regret(rows: DataFrame, by: str, steps: int = 20) -> DataFrame:
    """by, best_k, regret: what each group loses, a row, by the threshold that is best over all groups, against its own best."""
    k = F.explode(F.sequence(F.lit(1), F.lit(steps - 1))).alias("k")
    # a row reaches the thresholds up to its own; counts by that come first, so that they, not the rows, meet the thresholds
    own = F.floor(F.round(F.col("proba") * steps, 6)).cast("int")
    by_reach = rows.groupBy(by, own.alias("reach")).agg(F.sum("label").alias("yes"), F.count(F.lit(1)).alias("n"))
    said = F.col("reach") >= F.col("k")
    value = F.sum(F.when(said, F.col("yes") * TP - (F.col("n") - F.col("yes")) * FP).otherwise(-F.col("yes") * FN))
    cells = by_reach.select("*", k).groupBy(by, "k").agg(value.alias("value"), F.sum("n").alias("n"))
    total = cells.groupBy("k").agg(F.round(F.sum("value"), 4).alias("value"))
    common = total.agg(F.max_by("k", F.struct("value", -F.col("k"))).alias("k")).scalar()
    w = cells.withColumns({"_common": common, "value": F.round("value", 4)})
    best = F.max_by("k", F.struct("value", -F.col("k")))
    lost = F.max("value") - F.max(F.when(F.col("k") == F.col("_common"), F.col("value")))
    return w.groupBy(by).agg(best.alias("best_k"), F.round(lost / F.max("n"), 6).alias("regret"))


def id_like(df: DataFrame, least: int = 20) -> DataFrame:
    """(column, distinct_values, id_like): whole-number columns of more than `least` values look like identifiers."""
    whole = [c for c, t in df.dtypes if t in ("tinyint", "smallint", "int", "bigint")]
    one = df.agg(*[F.count_distinct(c).alias(c) for c in whole])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("distinct_values"), (F.col(c) > least).alias("id_like")) for c in whole])))


def unclassified(columns: list[str], *sets: list[str]) -> list[str]:
    """Columns that none of the declared sets has; a column in two sets is an error."""
    seen: dict[str, int] = {}
    for i, s in enumerate(sets):
        for c in s:
            if seen.setdefault(c, i) != i:
                raise ValueError(f"{c} is declared twice")
    return [c for c in columns if c not in seen]


def attributions(rows: DataFrame, features: list[str], target: str) -> DataFrame:
    """(feature, mean_abs, signed_r, null_share) of each feature's values, by mean absolute value."""
    from tidewell.functions.stats import safe_corr

    aggs = []
    for f in features:
        aggs.append(F.struct(F.lit(f).alias("feature"), F.round(F.avg(F.abs(f)), 4).alias("mean_abs"), F.round(safe_corr(f, target), 4).alias("signed_r"), F.round(F.avg(F.col(f).isNull().cast("int")), 4).alias("null_share")))
    return rows.agg(F.array(*aggs).alias("x")).select(F.inline("x"))


def positions(rows: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """rows with their places, from 0, in the order of the given columns, which together tell all rows apart.

    Rows are dealt to ranges of the order, numbered in their range, and moved by the rows of the ranges before: the sum over the
    ranges is the only window over all, a row for each. The ranges are stored, so that both passes see the same ones.
    """
    ranges = stored(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = F.coalesce(F.sum("_n").over(Window.partitionBy().orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = ranges.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select("_range", before.alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return ranges.withColumn("_place", place).join(F.broadcast(offsets), "_range").withColumn(name, F.col("_before") + F.col("_place")).drop("_range", "_place", "_before")


def chunked_interaction(rows: DataFrame, x: str, partners: list[str], by: str, keys: list[str]) -> DataFrame:
    """(partner, chunks, strength): the sum of |r| between x and each partner over chunks of equal size in the order of `by`.

    High where x works differently along `by`. A chunk has a tenth of the rows, 1 at least and 50 at most; the last may be
    shorter. Rows without the partner are left out, and so are chunks of fewer than three rows or where one of both is constant.
    keys settle the order of equal values; null comes first.
    """
    place = positions(rows.select(*dict.fromkeys([x, *partners, by, *keys])), [by, *keys])
    n = place.agg(F.count(F.lit(1)).alias("n")).scalar()
    size = F.greatest(F.lit(1), F.least(F.lit(50), F.floor(n / 10)))
    chunked = place.withColumn("_c", F.floor(F.col("position") / size))
    r = chunked.groupBy("_c").agg(*[F.when(F.count_if(F.col(p).isNotNull() & F.col(x).isNotNull()) >= 3, safe_corr(x, p)).alias(p) for p in partners])
    return r.unpivot(["_c"], partners, "partner", "r").groupBy("partner").agg(F.count("r").alias("chunks"), F.round(F.coalesce(F.sum(F.abs("r")), F.lit(0.0)), 4).alias("strength"))


def pick_tau(sweep: DataFrame, step: float = 0.05) -> DataFrame:
    """The lowest of the best thresholds for each calibration method."""
    best = sweep.agg(F.min_by("k", F.struct(-F.col("expected_cents"), F.col("k"))).alias("k"))
    methods = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.lit(s).alias("step")) for m, s in (("isotonic", 0.0), ("sigmoid", step), ("raw", step))]))
    tau = F.round(F.least(F.lit(1 - step), F.greatest(F.lit(step), F.col("k") * step + F.col("m.step"))), 4)
    return best.select("k", methods.alias("m")).select("m.method", tau.alias("tau"))


def reliability(rows: DataFrame, proba: str, label: str, bins: int = 10) -> DataFrame:
    """Quantile bins with open upper edges; the edges are one row and attached as a scalar."""
    edges = rows.agg(F.array_distinct(F.percentile(proba, F.array(*[F.lit(i / bins) for i in range(1, bins)]))).alias("e")).scalar()
    p, y = F.avg(proba), F.avg(label)
    binned = rows.withColumn("_e", edges).withColumn("bin", F.size(F.filter("_e", lambda x: x <= F.col(proba))))
    return binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.round(p, 4).alias("mean_pred"), F.round(y, 4).alias("actual"), F.round(y - p, 4).alias("gap"))


def arm_deltas(rows: DataFrame, baseline: str) -> DataFrame:
    a = rows.groupBy("fold", "arm").agg(stats.pooled_ratio(F.col("litres") * F.col("price"), F.col("litres")).alias("cpl"))
    base = F.max(F.when(F.col("arm") == baseline, F.col("cpl"))).over(Window.partitionBy("fold"))
    return a.select("fold", "arm", F.round("cpl", 4).alias("cpl"), F.round(F.col("cpl") - base, 4).alias("delta"))


def seed_gate(rows: DataFrame, factor: float = 5.0) -> DataFrame:
    l = rows.groupBy("fold", "seed", "arm").agg(F.avg(stats.log_loss("label", "proba")).alias("loss"))  # noqa: E741
    s = l.groupBy("fold", "arm").agg(F.avg("loss").alias("mean_loss"), F.median("loss").alias("median_loss"), F.stddev_pop("loss").alias("seed_std"))
    unstable = F.col("seed_std") > factor * F.median("seed_std").over(Window.partitionBy("arm"))
    return s.select("fold", "arm", *[F.round(c, 5).alias(c) for c in ("mean_loss", "median_loss", "seed_std")], unstable.alias("unstable"))


def three_gates(rows: DataFrame, baseline: str) -> DataFrame:
    a = rows.groupBy("fold", "arm").agg(F.avg(stats.log_loss("label", "proba")).alias("loss"))
    base = F.max(F.when(F.col("arm") == baseline, F.col("loss"))).over(Window.partitionBy("fold"))
    d = a.withColumn("delta", F.col("loss") - base).where(F.col("arm") != baseline)
    better, n, mean, median = F.count_if(F.col("delta") < 0), F.count(F.lit(1)), F.avg("delta"), F.median("delta")
    return d.groupBy("arm").agg(better.alias("better"), n.alias("folds"), F.round(mean, 5).alias("mean_delta"), F.round(median, 5).alias("median_delta"), ((mean < 0) & (median < 0) & (better * 2 > n)).alias("passed"))


def week_ahead(daily: DataFrame, days: int = 7) -> DataFrame:
    """x: the price a week on less today's, in cents, for days that have both."""
    later = daily.select("station_code", F.date_sub("price_date", days).alias("price_date"), F.col("decicents").alias("later"))
    return daily.join(later, ["station_code", "price_date"]).select(F.round((F.col("later") - F.col("decicents")) / 10, 4).alias("x"))


def week_benefit(daily: DataFrame, days: int = 7) -> DataFrame:
    w = Window.partitionBy("station_code").orderBy(F.unix_date("price_date")).rangeBetween(1, days)
    rows = daily.withColumns({"_m": F.avg("decicents").over(w), "_k": F.count(F.lit(1)).over(w)}).where(F.col("_k") == days)
    return rows.select("station_code", "price_date", (F.col("_m") - F.col("decicents")).alias("gain"))


def error_deltas(rows: DataFrame, features: list[str], tau: float = 0.5) -> DataFrame:
    said = F.col("proba") >= tau
    long = rows.select("label", said.alias("said"), *features).unpivot(["label", "said"], features, "feature", "x")
    mean = lambda y, s: F.avg(F.when((F.col("label") == y) & (F.col("said") == s), F.col("x")))
    return long.groupBy("feature").agg(F.round(mean(1, False) - mean(1, True), 4).alias("fn_less_tp"), F.round(mean(0, True) - mean(0, False), 4).alias("fp_less_tn"))


def hybrid_cutoff(scores: DataFrame, name: str, score: str, least: int = 6, share: float = 0.5) -> DataFrame:
    w = Window.partitionBy().orderBy(F.desc(score), name)
    ranked = scores.withColumns({"k": F.row_number().over(w), "_top": F.max(score).over(Window.partitionBy())})
    return ranked.where((F.col("k") <= least) | (F.col(score) >= share * F.col("_top"))).drop("_top")


def summary_orders(rows: DataFrame, name: str = "feature", size: str = "size", r: str = "r", rank: str = "rank") -> DataFrame:
    """(mode, name, place) of each row in each order of a summary: by size, by name, by sign (positive, unknown or none, negative), by rank (unranked last).

    Of equal ones the larger comes first, then the first by name. A summary has a row a feature, so that an order is one sort.
    """
    large, sign = -F.coalesce(F.col(size), F.lit(0.0)).cast("double"), F.signum(F.coalesce(F.nanvl(F.col(r).cast("double"), F.lit(0.0)), F.lit(0.0)))
    modes = {"size": large, "alpha": F.lit(0.0), "sign": -sign, "rank": F.coalesce(F.col(rank).cast("double"), F.lit(float("inf")))}
    keys = [F.struct(F.lit(m).alias("mode"), (key + 0.0).alias("a"), (F.lit(0.0) if m == "alpha" else large).alias("b")) for m, key in modes.items()]
    each = rows.select(F.col(name), F.explode(F.array(*keys)).alias("k")).select("k.*", name)
    return each.select("mode", name, F.row_number().over(Window.partitionBy("mode").orderBy("a", "b", name)).alias("place"))
