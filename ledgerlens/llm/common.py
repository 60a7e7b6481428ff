"""Helpers that several operators share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one step of a Python operator holds as word lists.
CHUNK_BYTES = 4 << 20

#: A-Z lower-cased, every other byte as it is.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

#: ASCII white space only (TAB to CR, and space); the other bytes that
#: ``bytes.split`` would cut at do not exist outside this set.
WORD_SEPARATORS = b"\t\n\x0b\x0c\r "


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The session's spark.checkpoint.dir is kept; only an unset one, on one machine (tests), gets a folder here."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured is None and sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_table(df: DataFrame) -> DataFrame:
    """df, written to the shared checkpoint folder as Parquet and read again."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished steps now; it does so when the driver collects its garbage, which a long job may not for hours."""
    gc.collect()
    # The thread that tells listeners holds the last event, and by it the last query's plan and shuffles; a job's end replaces it.
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    spark.sparkContext._jsc.parallelize([0], 1).count()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    spark.sparkContext._jvm.System.gc()


def keyed_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text) alone, so that further columns of any name can't clash; null text is empty."""
    return df.select(
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


def by_bytes(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches to slices of about `most` bytes of text, and at least one row."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = np.asarray(pc.binary_length(batch.column(text).cast(pa.large_binary())).fill_null(0))
        ends = np.cumsum(sizes)
        at = 0
        while at < n:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The texts as UTF-8 bytes; null is empty."""
    return [x or b"" for x in batch.column(column).cast(pa.large_binary()).to_pylist()]


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(f, schema)


def strings(column: pa.Array) -> pa.Array:
    """A column of texts as large strings without nulls, in buffers of its own.

    Some string kernels of Arrow misread arrays whose first offset is not zero, as slices have, so the texts are copied.
    """
    return column.cast(pa.large_string()).fill_null("").take(pa.array(np.arange(len(column))))


def ragged(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of each run, and the run that each element belongs to."""
    ends = np.cumsum(lengths)
    return ends - lengths, np.repeat(np.arange(len(lengths)), lengths)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The integers of [start, start + length) of every run, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    first, owner = ragged(lengths)
    return np.arange(total) - first[owner] + np.asarray(starts)[owner]
