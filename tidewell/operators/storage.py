"""Table maintenance on Parquet: insert or ignore, upsert, snapshot replacement, load ledgers, append-only logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def insert_or_ignore(target: DataFrame, new: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The rows of `new` to append: the first of each key by `order`, where the target has none. The first writer wins."""
    first = new.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")
    return first.join(target.select(*keys), keys, "left_anti")


def latest_of_day(rows: DataFrame, keys: list[str], ts: str, tie: str) -> DataFrame:
    """The latest row of each key; of equal times the first by `tie`."""
    w = Window.partitionBy(*keys).orderBy(F.desc(ts), tie)
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def upsert(old: DataFrame, new: DataFrame, key: str, always: list[str], fill: list[str], unique: str | None = None) -> DataFrame:
    """Full outer merge: `always` columns take the new value, `fill` columns too unless it is blank.

    With `unique`, new rows of other keys whose value of it exists already are left out, as are later ones among the new.
    """
    if unique:
        known = old.select(F.col(unique).alias("_u"), F.col(key).alias("_owner"))
        w = Window.partitionBy(unique).orderBy(key)
        new = new.join(known, F.col(unique) == F.col("_u"), "left").where(F.col("_owner").isNull() | (F.col("_owner") == F.col(key))).drop("_u", "_owner")
        new = new.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
    o, n = old.alias("o"), new.alias("n")
    there = F.col(f"n.{key}").isNotNull()
    pick = [F.coalesce(F.col(f"n.{key}"), F.col(f"o.{key}")).alias(key)]
    pick += [F.when(there, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in always]
    pick += [F.coalesce(F.nullif(F.col(f"n.{c}"), F.lit("")), F.col(f"o.{c}")).alias(c) for c in fill]
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer").select(*pick)


def backfill_first(rows: DataFrame, source: DataFrame, key: str, column: str, order: str) -> DataFrame:
    """Blank values of `column` take the first that isn't blank in `source`."""
    seen = source.where(F.trim(F.coalesce(column, F.lit(""))) != "").groupBy(key).agg(F.min_by(column, order).alias("_seen"))
    return rows.join(seen, key, "left").withColumn(column, F.coalesce(F.nullif(F.trim(column), F.lit("")), "_seen")).drop("_seen")


def replace_snapshot(df: DataFrame, path: str, by: str) -> None:
    """Write df over the partitions that it has rows for, leaving the others: running twice changes nothing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def rewrite(df: DataFrame, path: str) -> None:
    """Replace a table as a whole; an empty frame is refused."""
    if df.isEmpty():
        raise ValueError("refusing to replace a table by nothing")
    df.write.mode("overwrite").parquet(path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written below the cluster's shared folder and read back: several readers share it, and lineage ends there."""
    from tidewell.sources.files import scratch

    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder of that path, in whatever store it is."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at))


def append_log(df: DataFrame, path: str, compression: str = "zstd") -> None:
    """Append to a log whose columns must be the same, if it exists."""
    spark = df.sparkSession
    have = spark.read.parquet(path).columns if exists(spark, path) else df.columns
    if have != df.columns:
        raise ValueError(f"the log has columns {have}, not {df.columns}")
    df.write.mode("append").option("compression", compression).parquet(path)


def save_frame(df: DataFrame, path: str) -> None:
    """A feature frame as CSV for others, and as Parquet, which is written last and so is the newer one."""
    df.write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    df.write.mode("overwrite").parquet(f"{path}/parquet")


def load_frame(spark: SparkSession, path: str, schema) -> DataFrame:
    """The frame from Parquet, if that is there and as new as the CSV, else from the CSV under the schema."""
    def newest(kind: str):
        files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/{kind}")
        return files.agg(F.max("modificationTime").alias("t")).first()["t"]

    if exists(spark, f"{path}/parquet") and (not exists(spark, f"{path}/csv") or newest("parquet") >= newest("csv")):
        return spark.read.parquet(f"{path}/parquet")
    return spark.read.schema(schema).option("header", True).csv(f"{path}/csv")


def unloaded(files: DataFrame, ledger: DataFrame, force: bool = False) -> DataFrame:
    return files if force else files.join(ledger, "file", "left_anti")


def patch(df: DataFrame, key: str, values: dict, column: str) -> DataFrame:
    """df with the column changed in the rows of the given keys."""
    c = F.col(column)
    for k, v in values.items():
        c = F.when(F.col(key) == k, F.lit(v)).otherwise(c)
    return df.withColumn(column, c)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
