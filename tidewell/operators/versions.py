"""Tables that are replaced as a whole, in one step: each version is a folder of its own, and a pointer says which one counts.

A version's rows are written first; then its number is claimed by renaming a finished pointer file to it, which fails if the number is
taken. A reader takes the highest number there is, and so sees the rows before or the rows after, never both; a write that fails,
or loses to another one, leaves the table as it was. Renaming is one step in a file system; a store without that needs another commit.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators.joins import assert_unique


class _Files:
    """Small files and folders wherever the path's store is."""

    def __init__(self, spark: SparkSession, path: str):
        self.context = spark.sparkContext
        self.hadoop = self.context._jvm.org.apache.hadoop
        self.root = self.hadoop.fs.Path(path)
        conf = self.context._jsc.hadoopConfiguration()
        self.fs = self.root.getFileSystem(conf)
        self.root = self.fs.makeQualified(self.root)
        self.at = self.hadoop.fs.FileContext.getFileContext(self.root.toUri(), conf)

    def path(self, name: str):
        return self.hadoop.fs.Path(self.root, name)

    def names(self, folder: str) -> list[str]:
        at = self.path(folder)
        return [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.context._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, said: str) -> None:
        stream = self.fs.create(self.path(name), False)
        stream.write(bytearray(said.encode()))
        stream.close()

    def rename(self, one: str, other: str) -> bool:
        """Whether it was renamed; not if there is a file of that name."""
        none = self.context._gateway.new_array(getattr(self.hadoop.fs, "Options$Rename"), 0)
        try:
            self.at.rename(self.path(one), self.path(other), none)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception.getClass().getName()):
                return False
            raise
        return True

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


def versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the versions there are, oldest first."""
    return sorted(int(n) for n in _Files(spark, path).names("versions") if n.isdigit())


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table as the given version has it, or the last one. A frame goes on reading its version, whatever is written later."""
    if not (there := versions(spark, path)):
        raise ValueError(f"no table at {path}")
    number = there[-1] if version is None else version
    if number not in there:
        raise ValueError(f"the table has no version {number}: {there}")
    return spark.read.parquet(f"{path}/{_Files(spark, path).read(f'versions/{number:012d}')}")


def replace(df: DataFrame, path: str, after: int | None = None) -> int:
    """Make df's rows the table's next version and return its number. Refused are no rows at all, and a table that isn't at version
    `after` any more, or becomes another one while the rows are written."""
    spark = df.sparkSession
    files, there = _Files(spark, path), versions(spark, path)
    last = there[-1] if there else 0
    if after is not None and after != last:
        raise ValueError(f"the table is at version {last}, not {after}")
    name = uuid.uuid4().hex
    df.write.parquet(f"{path}/data/{name}")
    if spark.read.parquet(f"{path}/data/{name}").isEmpty():
        files.delete(f"data/{name}")
        raise ValueError("refusing to replace a table by nothing")
    files.write(f"versions/.{name}", f"data/{name}")
    if not files.rename(f"versions/.{name}", f"versions/{last + 1:012d}"):
        files.delete(f"versions/.{name}")
        files.delete(f"data/{name}")
        raise ValueError(f"another write has made version {last + 1}")
    return last + 1


def patch(spark: SparkSession, path: str, updates: DataFrame, keys: list[str]) -> int:
    """Set the updates' further columns in the rows of their keys, as a new version. Keys that the updates have twice are an error."""
    there = versions(spark, path)
    table = read(spark, path)
    columns = [c for c in updates.columns if c not in keys]
    if bad := sorted(set(updates.columns) - set(table.columns)):
        raise ValueError(f"the table lacks columns: {bad}")
    of = assert_unique(updates, *keys).withColumnsRenamed({c: f"_new_{c}" for c in columns})
    marked = table.join(of.withColumn("_met", F.lit(True)), keys, "left")
    return replace(marked.select(*[F.when(F.col("_met"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in table.columns]), path, there[-1])


def forget(spark: SparkSession, path: str, keep: int = 2) -> list[int]:
    """Drop all but the last `keep` versions, pointers first, and rows that no pointer is for; return what was dropped.

    Not to be run while something is being written or an old version is being read.
    """
    files, there = _Files(spark, path), versions(spark, path)
    gone = there[: -max(1, keep)]
    for n in gone:
        files.delete(f"versions/{n:012d}")
    held = {files.read(f"versions/{n:012d}") for n in versions(spark, path)}
    for name in files.names("data"):
        if f"data/{name}" not in held:
            files.delete(f"data/{name}")
    return gone
