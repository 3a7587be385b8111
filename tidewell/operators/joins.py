"""Joins that Spark has no word for: as-of, exact lag, nearest within a reach, ranges; and guards on keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, key: str, at: str, day: str, columns: list[str]) -> DataFrame:
    """For each left row the last right row of its key at or before `at`; nulls where there is none.

    Both sides meet in one window over the key: no pair of rows is made, so that long histories cost no more than a sort.
    """
    row = F.struct(*[F.col(c) for c in columns])
    a = left.select(*left.columns, F.col(at).alias("_at"), F.lit(1).alias("_probe"), F.lit(None).cast(right.select(row).schema[0].dataType).alias("_row"))
    none = [F.lit(None).cast(left.schema[c].dataType).alias(c) if c != key else F.col(key) for c in left.columns]
    b = right.select(*none, F.col(day).alias("_at"), F.lit(0).alias("_probe"), row.alias("_row"))
    w = Window.partitionBy(key).orderBy("_at", "_probe").rowsBetween(Window.unboundedPreceding, 0)
    seen = a.unionByName(b).withColumn("_seen", F.last("_row", ignorenulls=True).over(w)).where("_probe = 1")
    return seen.select(*left.columns, *[F.col(f"_seen.{c}").alias(c) for c in columns])


def exact_lag(daily: DataFrame, days: int, key: str = "station_code", day: str = "price_date", value: str = "decicents") -> DataFrame:
    """daily with the value of exactly so many days before. By merge: a stored panel is small as a file, and would be broadcast with its millions of rows."""
    past = daily.select(key, F.date_add(day, days).alias(day), F.col(value).alias(f"{value}_lag"))
    return daily.join(past.hint("merge"), [key, day], "left")


def assert_unique(df: DataFrame, *keys: str) -> DataFrame:
    """df, failing at run time if a key occurs twice: for the one side of a many-to-one join."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    checked = df.withColumn("_n", n).withColumn("_ok", F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("duplicate key: "), F.concat_ws(",", *keys)))).otherwise(F.lit(True).cast("string")))
    return checked.where("_ok is not null").drop("_n", "_ok")


def head_to_head(a: DataFrame, b: DataFrame, tolerance: float) -> DataFrame:
    diff = F.round(F.col("price") - F.col("other"), 4)
    d = a.join(b, "price_date").select(diff.alias("diff"))
    x = F.col("diff")
    return d.agg(
        F.count(F.lit(1)).alias("days"), F.count_if(x < -tolerance).alias("cheaper"), F.count_if(F.abs(x) <= tolerance).alias("equal"), F.count_if(x > tolerance).alias("dearer"),
        F.round(F.avg(F.when(x < -tolerance, -x)), 4).alias("mean_saving"), F.round(F.avg(F.when(x > tolerance, x)), 4).alias("mean_loss"),
    )


def nearest_within(anchors: DataFrame, events: DataFrame, key: str, reach: int, anchor_day: str = "anchor_date", event_day: str = "event_date") -> DataFrame:
    """For each anchor day and key the nearest event within `reach` days, the earlier of two as near; lead is positive if the event comes first.

    An event can only meet anchors of its own block of `reach` days or the next ones, so that the join is on equal blocks.
    """
    block = lambda c: F.floor(F.unix_date(F.col(c)) / reach)
    a = anchors.withColumn("_block", block(anchor_day))
    e = events.select("*", F.explode(F.array(*[block(event_day) + d for d in (-1, 0, 1)])).alias("_block"))
    lead = F.datediff(anchor_day, event_day)
    met = a.join(e, "_block").withColumn("lead", lead).where(F.abs("lead") <= reach)
    w = Window.partitionBy(anchor_day, key).orderBy(F.abs("lead"), event_day)
    return met.withColumn("_k", F.row_number().over(w)).where("_k = 1").select(key, anchor_day, event_day, "lead")


def lookup(rows: DataFrame, provider: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Left join of an extra feature table. Refuses columns that rows has already, and keys that the provider has twice."""
    if clash := sorted(set(columns) & set(rows.columns)):
        raise ValueError(f"extra features shadow columns: {clash}")
    if missing := sorted(set(columns) - set(provider.columns)):
        raise ValueError(f"the provider lacks columns: {missing}")
    return rows.join(assert_unique(provider.select(*keys, *columns), *keys), keys, "left")


def hit_rate(joined: DataFrame, column: str) -> DataFrame:
    """(hits, misses) of a lookup's column. Where there are rows and none hits, as when keys of other kinds were met, reading it is an error."""
    counts = joined.agg(F.count_if(F.col(column).isNotNull()).alias("hits"), F.count_if(F.col(column).isNull()).alias("misses"))
    nothing = F.raise_error(F.concat(F.lit(f"no row has a value of {column!r}: rows missed: "), F.col("misses")))
    return counts.select(F.when((F.col("hits") == 0) & (F.col("misses") > 0), nothing).otherwise(F.col("hits")).alias("hits"), "misses")
