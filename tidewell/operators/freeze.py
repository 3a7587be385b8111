"""Frozen batches: a feature frame with its columns, folds and tank, fixed once and checked before each use.

A batch is a folder with the frame, the folds and a manifest, which is written last: a folder without one is no batch, and may
be frozen again. The manifest has the columns in their order, the frame's content as sums of hashes over its rows, the folds and
the cadence, so that whatever differs later can be told by name. Sums don't depend on the rows' order or files.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators.metrics import unclassified
from tidewell.operators.storage import exists


def content(df: DataFrame) -> str:
    """Rows, and two sums of hashes over them: equal for equal multisets of rows. Nulls count, and where they stand.

    Values are hashed by column in the order of names, so that the order of columns doesn't matter; their types do.
    """
    names = sorted(df.columns)
    parts = [x for c in names for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]
    sums = [F.coalesce(F.sum(F.xxhash64(F.lit(k), *parts).cast("decimal(20,0)")), F.lit(0)).cast("decimal(38,0)") for k in (1, 2)]
    n, a, b = df.agg(F.count(F.lit(1)), *sums).first()
    kinds = hashlib.sha256(json.dumps([[c, dict(df.dtypes)[c]] for c in names]).encode()).hexdigest()[:12]
    return f"{n}:{kinds}:{a}:{b}"


def ordered(columns: list[str]) -> str:
    """Number and hash of the columns in their order."""
    return f"{len(columns)}:{hashlib.sha256(chr(10).join(columns).encode()).hexdigest()[:12]}"


def _folds(windows: DataFrame) -> list[list]:
    return [[r.fold, str(r.train_end), str(r.val_start), str(r.val_end)] for r in windows.orderBy("fold").collect()]  # a handful


def _manifest(spark: SparkSession, path: str) -> dict:
    if not exists(spark, f"{path}/manifest/_SUCCESS"):
        raise ValueError(f"no frozen batch at {path}")
    return json.loads("".join(r.value for r in spark.read.text(f"{path}/manifest").collect()))


def freeze(frame: DataFrame, path: str, model: list[str], keys: list[str], held_out: list[str], windows: DataFrame, cadence: str) -> dict:
    """Write the batch and return its manifest. A batch that is there already is refused, and so, before anything is written, is
    a frame with columns of no declared role, without a declared model column, or without rows."""
    spark = frame.sparkSession
    if exists(spark, f"{path}/manifest/_SUCCESS"):
        raise ValueError(f"there is a frozen batch at {path}; a batch is frozen once")
    if left := unclassified(frame.columns, keys, model, held_out):
        raise ValueError(f"columns without a role: {left}")
    if missing := [c for c in model if c not in frame.columns]:
        raise ValueError(f"model columns aren't there: {missing}")
    if frame.isEmpty():
        raise ValueError("no rows to freeze")
    frame.write.mode("overwrite").parquet(f"{path}/frame")
    held = spark.read.parquet(f"{path}/frame")
    said = {"columns": list(model), "fingerprint": ordered(model), "content": content(held), "folds": _folds(windows), "cadence": cadence}
    spark.createDataFrame([(json.dumps(said),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return said


def thaw(spark: SparkSession, path: str, model: list[str] | None = None, windows: DataFrame | None = None, cadence: str | None = None) -> tuple[DataFrame, dict]:
    """(frame, manifest) of a batch whose rows are as they were frozen, for use with these columns, folds and cadence.

    What differs is refused by name: rows; columns added, removed or in another order; folds, each that changed; the cadence.
    """
    said = _manifest(spark, path)
    frame = spark.read.parquet(f"{path}/frame")
    if (now := content(frame)) != said["content"]:
        raise ValueError(f"content: the rows have changed since they were frozen ({said['content']}, now {now})")
    if model is not None and list(model) != said["columns"]:
        added, removed = sorted(set(model) - set(said["columns"])), sorted(set(said["columns"]) - set(model))
        raise ValueError(f"columns: added {added}, removed {removed}" if added or removed else "columns: in another order")
    if windows is not None and (folds := _folds(windows)) != said["folds"]:
        then, now = ({f[0]: f[1:] for f in x} for x in (said["folds"], folds))
        raise ValueError(f"folds: {sorted(k for k in then.keys() | now.keys() if then.get(k) != now.get(k))} are others than those frozen")
    if cadence is not None and cadence != said["cadence"]:
        raise ValueError(f"cadence: frozen at {said['cadence']}, not {cadence}")
    return frame, said
