"""Balanced contiguous shards by global byte-size prefix sums.

Rows are put in one order (doc_id, then size, checksum), range partitioned, and
written once. Each partition reports its bytes; the running total of those few
numbers gives every partition its global offset, so that each row knows the
bytes before it without a global window. Equal byte targets cut the order into
contiguous shards. A second total of rows per (partition, shard) gives gapless slots.

Defined results: null text has size 1 and checksum 0; a null id sorts first;
equal rows are interchangeable and each gets its own slot; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import cut, read

N_SHARDS = 16
ORDER = ("doc_id", "size", "text_crc32", "tie")


def shard_by_bytes(docs: DataFrame, n_shards: int = N_SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: `n_shards` contiguous runs of the id order, of near-equal bytes.

    A row goes to the shard in which the middle of its bytes falls, so that each
    shard's size is within one row of total / n_shards.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("tie"),  # splits a key that many rows share
    )
    rows = rows.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    rows = cut(rows.drop("tie"))  # from here on the partitions and their order are fixed

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = sum(int(pc.sum(b.column("size")).as_py() or 0) for b in batches)
        yield pa.RecordBatch.from_pydict({"pid": [TaskContext.get().partitionId()], "bytes": [size]})

    # One row a partition.
    per_partition = dict(rows.select("size").mapInArrow(totals, "pid long, bytes long").collect())
    offsets, at = {}, 0
    for pid in sorted(per_partition):
        offsets[pid] = at
        at += per_partition[pid]
    total = at

    def place(sizes: np.ndarray, before: int) -> np.ndarray:
        middle = before + np.cumsum(sizes) - sizes / 2
        return np.minimum(np.floor(middle * n_shards / max(total, 1)), n_shards - 1).astype(np.int64)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, found = TaskContext.get().partitionId(), np.zeros(n_shards, np.int64)
        before = offsets.get(pid, 0)
        for b in batches:
            sizes = b.column("size").to_numpy()
            found += np.bincount(place(sizes, before), minlength=n_shards)
            before += int(sizes.sum())
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array([pid] * len(some), pa.int64()), pa.array(some, pa.int32()), pa.array(found[some], pa.int64())], names=["pid", "shard", "n"])

    first, taken = {}, [0] * n_shards
    for pid, shard, n in sorted(map(tuple, rows.select("size").mapInArrow(counted, "pid long, shard int, n long").collect())):
        first[pid, shard] = taken[shard]
        taken[shard] += n

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        before, slots = offsets.get(pid, 0), np.array([first.get((pid, s), 0) for s in range(n_shards)], np.int64)
        for b in batches:
            sizes = b.column("size").to_numpy()
            shards = place(sizes, before)
            before += int(sizes.sum())
            # A partition is in order, so its shards come in runs.
            starts = np.searchsorted(shards, np.arange(n_shards))
            slot = slots[shards] + np.arange(len(shards)) - starts[shards]
            slots += np.bincount(shards, minlength=n_shards)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shards, pa.int32()), pa.array(slot, pa.int64())], names=["doc_id", "size", "text_crc32", "shard", "slot"])

    return rows.mapInArrow(placed, "doc_id long, size long, text_crc32 long, shard int, slot long")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(read(spark, sf_dir, "documents")).selectExpr(
        "doc_id", "size", "text_crc32", "'bytes' AS law", "shard", "slot", "cast(null AS int) AS grown_shard"
    )
