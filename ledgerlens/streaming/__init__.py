"""Structured Streaming: the apply stream, the key-value fold, and gapless delivery."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ledgerlens.operators.commit import apply_messages, kv_fold
from ledgerlens.sources.adapters import term_of

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder where the cluster keeps checkpoints; a temporary one only on one machine, where none is set."""
    root = spark.sparkContext._jsc.sc().getCheckpointDir()
    base = root.get() if root.isDefined() else spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="stream-")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def log_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int = 1) -> DataFrame:
    """The log as a stream of the events table; the number of files a trigger takes is the back-pressure."""
    events = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{sf_dir}/event[s].parquet")
    return events.select(
        (F.col("event_id") + 1).alias("idx"), term_of(F.col("ts")).alias("term"), F.col("user_id").alias("key"), F.col("event_type").alias("value"), (F.col("event_type") == "error").alias("no_op")
    )


def drain(updates: DataFrame, folder: str, schema: str) -> DataFrame:
    """Runs a streaming aggregate in update mode over what is there. Each trigger writes only the rows that changed, to a version of
    its own, which a repeated trigger replaces; a query that is started again on the folder goes on from its checkpoint."""
    spark = updates.sparkSession

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/v/__version={number}")

    query = updates.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    return spark.read.schema(schema).parquet(f"{folder}/v").drop("__version") if query.lastProgress else spark.createDataFrame([], schema)


def drain_kv(log: DataFrame, folder: str) -> DataFrame:
    """The fold as a streaming aggregate: of all versions of a key the one with the latest index counts."""
    found = drain(kv_fold(log), folder, "key long, value string, idx long")
    last = F.max(F.struct("idx", "value"))
    return found.groupBy("key").agg(last.alias("last")).select("key", "last.value", "last.idx")


def drain_commits(moves: DataFrame, folder: str) -> DataFrame:
    """(key, wanted, last) in any order -> each key's release point, which only moves forward and never past the log."""
    point = F.max(F.when(F.col("wanted") <= F.col("last"), F.col("wanted")))
    gate = moves.groupBy("key").agg(F.coalesce(point, F.lit(0).cast("long")).alias("released"))
    return drain(gate, folder, "key long, released long").groupBy("key").agg(F.max("released").alias("released"))


def drain_violations(committed: DataFrame, folder: str) -> DataFrame:
    """Committed entries as they come (idx, term, key, value, no_op) -> the indexes at which two differ: a monitor over the whole run."""
    entry = F.xxhash64("term", "key", "value", "no_op")
    state = committed.groupBy("idx").agg(F.min(entry).alias("least"), F.max(entry).alias("most"))
    return drain(state.where("least <> most").select("idx"), folder, "idx long").distinct()


def drain_gapless(log: DataFrame, folder: str, by: str) -> DataFrame:
    """`gapless` over what is there, to files."""
    schema = f"{by} long, idx long, term long, value string"
    query = gapless(log, by).writeStream.outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).format("parquet").start(f"{folder}/out")
    query.awaitTermination()
    return log.sparkSession.read.schema(schema).parquet(f"{folder}/out")


def resend_ticks(spark: SparkSession, missing, keep, ticks: int, interval: str = "50 milliseconds") -> int:
    """Every processing-time tick recomputes what is missing from the state and hands it to `keep(tick, rows)`; gives the ticks that ran."""
    done: list[int] = []

    def tick(_: DataFrame, number: int) -> None:
        if len(done) < ticks:
            keep(number, missing())
            done.append(number)

    query = spark.readStream.format("rate").option("rowsPerSecond", 50).load().writeStream.trigger(processingTime=interval).foreachBatch(tick).start()
    while query.isActive and len(done) < ticks:
        query.awaitTermination(1)
    query.stop()
    return len(done)


def drain_apply(log: DataFrame, folder: str) -> DataFrame:
    """Apply messages appended to files, once each however often an entry is delivered. Barriers stay in the stream."""
    spark = log.sparkSession
    once = apply_messages(log).dropDuplicates(["idx", "term"])
    query = once.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).format("parquet").start(f"{folder}/out")
    query.awaitTermination()
    return spark.read.schema("idx long, term long, command_valid boolean, key long, value string").parquet(f"{folder}/out")


def gapless(log: DataFrame, by: str = "node") -> DataFrame:
    """(node, idx, term, value) in any order, repeats and all -> per node each index once, in order, none before its predecessor.

    State per node: the last index delivered, and what waits for a gap to close.
    """

    def deliver(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, waiting = (state.get[0], {int(k): v for k, v in json.loads(state.get[1]).items()}) if state.exists else (0, {})
        for batch in batches:
            for idx, term, value in zip(batch["idx"].tolist(), batch["term"].tolist(), batch["value"].tolist(), strict=True):
                if idx > last:
                    waiting.setdefault(idx, [term, value])
        out = []
        while last + 1 in waiting:
            last += 1
            out.append((key[0], last, *waiting.pop(last)))
        state.update((last, json.dumps(waiting)))
        yield pd.DataFrame(out, columns=[by, "idx", "term", "value"])

    return log.groupBy(by).applyInPandasWithState(deliver, f"{by} long, idx long, term long, value string", "last long, waiting string", "append", GroupStateTimeout.NoTimeout)
