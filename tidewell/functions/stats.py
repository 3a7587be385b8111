"""Statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def log_loss(label: str, proba: str, clip: float = 1e-15) -> Column:
    p = F.greatest(F.lit(clip), F.least(F.lit(1 - clip), F.col(proba)))
    y = F.col(label)
    return -(y * F.log(p) + (1 - y) * F.log(1 - p))


def pooled_ratio(top: Column, bottom: Column) -> Column:
    """Ratio of sums; null where the lower sum is zero."""
    return F.try_divide(F.sum(top), F.sum(bottom))


def safe_corr(a: str, b: str, weight: str | None = None) -> Column:
    """Pearson correlation over the rows that have both, each so often as its weight says; null if one of them is constant there."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(both, F.col(a).cast("double")), F.when(both, F.col(b).cast("double"))
    sum_ = lambda v: F.sum(v if weight is None else v * F.col(weight))
    n = F.count(x) if weight is None else F.sum(F.when(both, F.col(weight)))
    cov = sum_(x * y) - F.try_divide(sum_(x) * sum_(y), n)
    vx, vy = sum_(x * x) - F.try_divide(sum_(x) * sum_(x), n), sum_(y * y) - F.try_divide(sum_(y) * sum_(y), n)
    spread = (F.max(x) > F.min(x)) & (F.max(y) > F.min(y))
    return F.when(spread, F.try_divide(cov, F.sqrt(F.greatest(vx * vy, F.lit(0.0)))))


def summary(x: str) -> list[Column]:
    q = F.percentile(x, F.array(*[F.lit(p) for p in (0.25, 0.5, 0.75, 0.9)]))
    return [F.count(x).alias("n"), F.round(F.avg(x), 4).alias("mean"), F.round(q[0], 4).alias("p25"), F.round(q[1], 4).alias("median"), F.round(q[2], 4).alias("p75"), F.round(q[3], 4).alias("p90")]


def trimmed_mean(df: DataFrame, x: str, share: float = 0.95) -> DataFrame:
    """Mean of the values up to the given percentile, which is one row and attached as a scalar."""
    limit = df.agg(F.percentile(x, F.lit(share)).alias("q")).scalar()
    return df.withColumn("_q", limit).agg(F.round(F.avg(F.when(F.col(x) <= F.col("_q"), F.col(x))), 4).alias("trimmed_mean"), F.count_if(F.col(x) <= F.col("_q")).alias("kept"))


def standardised_difference(x: str, group: Column, least: int = 50) -> Column:
    """Difference of the means over the pooled deviation; null if a group has fewer than `least` rows or nothing varies."""
    a, b = F.when(group, F.col(x)), F.when(~group, F.col(x))
    pooled = F.sqrt((F.var_pop(a) + F.var_pop(b)) / 2)
    return F.when((F.count(a) >= least) & (F.count(b) >= least), F.try_divide(F.avg(a) - F.avg(b), pooled))


def confusion(label: Column, said: Column) -> list[Column]:
    yes = label == 1
    return [F.count_if(said & yes).alias("tp"), F.count_if(said & ~yes).alias("fp"), F.count_if(~said & yes).alias("fn"), F.count_if(~said & ~yes).alias("tn")]


def precision_recall(df: DataFrame) -> DataFrame:
    """Adds precision, recall and f1 to counts, zero where undefined."""
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a), b), F.lit(0.0))
    p, r = ratio("tp", F.col("tp") + F.col("fp")), ratio("tp", F.col("tp") + F.col("fn"))
    f1 = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    return df.withColumns({"precision": F.round(p, 4), "recall": F.round(r, 4), "f1": F.round(f1, 4)})
