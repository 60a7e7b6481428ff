"""Durable state: framed records, and snapshots that switch by one rename.

A snapshot is a new versioned directory; `CURRENT` names the version that counts and is
replaced by a rename, so a reader sees the old or the new snapshot and never half of one.
"Never saved" gives an empty table; a damaged record raises CorruptState.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions import frame, frame_fault


class CorruptState(ValueError):
    pass


class SnapshotStore:
    """Versioned Parquet snapshots under one folder, on any file system Spark can reach."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark._jvm
        self.path = jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def save(self, df: DataFrame) -> str:
        version = uuid.uuid4().hex
        df.write.parquet(f"{self.folder}/v-{version}")
        new, current = self.path(f"{self.folder}/CURRENT.{version}"), self.path(f"{self.folder}/CURRENT")
        out = self.fs.create(new, True)
        out.write(bytearray(version.encode()))
        out.close()
        options = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.spark._jsc.hadoopConfiguration())
        renames = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        renames[0] = options
        context.rename(new, current, renames)
        return version

    def current(self) -> str | None:
        current = self.path(f"{self.folder}/CURRENT")
        if not self.fs.exists(current):
            return None
        stream = self.fs.open(current)
        text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return text

    def load(self, schema: T.StructType) -> DataFrame:
        """The current snapshot; an empty table if none was saved. Abandoned versions are never read."""
        version = self.current()
        if version is None:
            return self.spark.createDataFrame([], schema)
        if not self.fs.exists(self.path(f"{self.folder}/v-{version}")):
            raise CorruptState(f"snapshot {version} is gone")
        return self.spark.read.schema(schema).parquet(f"{self.folder}/v-{version}")


class MemoryStore:
    """The same contract in memory: the last saved state, cached; Spark rebuilds lost parts of it."""

    def __init__(self, spark: SparkSession):
        self.spark, self.state = spark, None

    def save(self, df: DataFrame) -> None:
        old, self.state = self.state, df.cache()
        if old is not None:
            old.unpersist()

    def load(self, schema: T.StructType) -> DataFrame:
        return self.spark.createDataFrame([], schema) if self.state is None else self.state


def encode_records(states: DataFrame, key: str) -> DataFrame:
    """(key, blob): the other columns as one framed JSON record."""
    rest = [c for c in states.columns if c != key]
    return states.select(key, frame(F.encode(F.to_json(F.struct(*rest)), "UTF-8")).alias("blob"))


def decode_records(blobs: DataFrame, key: str, schema: T.StructType) -> DataFrame:
    """(key, fault, state): state is null where there is a fault; a payload that is no record is `codec`."""
    fault = frame_fault(F.col("blob"))
    state = F.from_json(F.decode(F.substring("blob", 17, 2147483647), "UTF-8"), schema)
    read = blobs.select(key, fault.alias("fault"), F.when(fault.isNull(), state).alias("state"))
    return read.select(key, F.when(F.col("fault").isNull() & F.col("state").isNull(), "codec").otherwise(F.col("fault")).alias("fault"), "state")


def checked(decoded: DataFrame) -> DataFrame:
    """The states; the first fault found raises when the rows are read."""
    return decoded.where(F.when(F.col("fault").isNull(), True).otherwise(F.raise_error(F.concat(F.lit("corrupt state: "), "fault")).cast("boolean")))


def write_measurements(df: DataFrame, path: str) -> None:
    """CSV with a header; milliseconds with three places."""
    df.select(*[F.format_string("%.3f", c).alias(c) if t == "double" else c for c, t in df.dtypes]).write.mode("overwrite").csv(path, header=True)
