"""Records, snapshots, and streams that are stopped and started again."""

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import frame, frame_fault
from ledgerlens.operators.commit import kv_fold
from ledgerlens.sources import adapters
from ledgerlens.sources.durable import MemoryStore, SnapshotStore, checked, decode_records, encode_records
from ledgerlens.streaming import drain_kv, gapless, log_stream, resend_ticks

SF = "/root/testdata/sf0.001"


def test_frame_faults(spark):
    good = bytes(spark.range(1).select(frame(F.encode(F.lit("payload"), "UTF-8")).alias("b")).first().b)
    cases = {"short": [None, b"", good[:15]], "magic": [b"XXXX" + good[4:]], "version": [good[:4] + b"\0\0\0\2" + good[8:]], "length": [good[:-1], good + b"!"], "checksum": [good[:-1] + b"!"], None: [good]}
    rows = [(want, blob) for want, blobs in cases.items() for blob in blobs]
    got = spark.createDataFrame(rows, "want string, blob binary").select("want", frame_fault(F.col("blob")).alias("fault")).collect()
    assert all(r.want == r.fault for r in got)


def test_records_round_trip(spark):
    states = spark.createDataFrame([(1, 5, None), (2, 6, 3)], "node long, current_term long, voted_for long")
    read = decode_records(encode_records(states, "node"), "node", "current_term long, voted_for long")
    assert sorted((r.node, r.state.current_term, r.state.voted_for) for r in checked(read).collect()) == [(1, 5, None), (2, 6, 3)]
    broken = encode_records(states, "node").withColumn("blob", F.substring("blob", 1, 10))
    with pytest.raises(Exception, match="corrupt state"):
        checked(decode_records(broken, "node", "current_term long")).collect()


def test_snapshots(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"))
    schema = spark.range(0).schema
    assert store.load(schema).count() == 0
    store.save(spark.range(3))
    store.save(spark.range(5))
    spark.range(9).write.parquet(str(tmp_path / "store" / "v-abandoned"))
    assert SnapshotStore(spark, str(tmp_path / "store")).load(schema).count() == 5


def test_stream_equals_batch_and_survives_restart(spark, tmp_path):
    want = sorted(map(tuple, kv_fold(adapters.log(spark, SF)).collect()))
    assert sorted(map(tuple, drain_kv(log_stream(spark, SF), str(tmp_path / "a")).collect())) == want
    # A new start with no checkpoint replays the log from the beginning.
    assert sorted(map(tuple, drain_kv(log_stream(spark, SF), str(tmp_path / "b")).collect())) == want


def test_gapless_delivery(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    schema = "node long, idx long, term long, value string"

    def put(name, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(source / name))

    def drain():
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(source))
        gapless(stream).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).format("parquet").start(out).awaitTermination()
        return sorted((r.node, r.idx) for r in spark.read.parquet(out).collect())

    put("1", [(1, 3, 1, "c"), (1, 1, 1, "a"), (2, 2, 1, "b")])
    assert drain() == [(1, 1)]
    put("2", [(1, 2, 1, "b"), (1, 1, 1, "a"), (2, 1, 1, "a")])  # a late entry, a repeat, and the start of node 2
    assert drain() == [(1, 1), (1, 2), (1, 3), (2, 1), (2, 2)]


def test_restart_goes_on_and_a_replay_rebuilds(spark, tmp_path):
    """A stopped fold starts again on its checkpoint with more of the log there; one whose checkpoint is lost replays all of it."""
    log, source = adapters.log(spark, SF), str(tmp_path / "log")
    part = lambda low, high: log.where((F.col("idx") > low) & (F.col("idx") <= high)).coalesce(1).write.mode("append").parquet(source)
    stream = lambda: spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(source)
    rows = lambda df: sorted(map(tuple, df.collect()))
    part(0, 200)
    part(200, 400)
    assert rows(drain_kv(stream(), str(tmp_path / "a"))) == rows(kv_fold(log.where("idx <= 400")))
    part(400, 10**9)
    assert rows(drain_kv(stream(), str(tmp_path / "a"))) == rows(kv_fold(log))
    versions = spark.read.parquet(str(tmp_path / "a" / "v")).select("__version").distinct().count()
    assert versions == 3  # the second start took the new file alone
    assert rows(drain_kv(stream(), str(tmp_path / "b"))) == rows(kv_fold(log))


def test_ticks_resend_what_is_missing(spark):
    log = adapters.log(spark, SF)
    state, sent = {"match": 0}, []

    def missing():
        return log.where(F.col("idx") > state["match"]).agg(F.count("*")).first()[0]

    def keep(tick, n):
        sent.append(n)
        state["match"] += 100

    assert resend_ticks(spark, missing, keep, 3) == 3 and sent == [missing() + 300, missing() + 200, missing() + 100]


def test_memory_store(spark):
    store = MemoryStore(spark)
    assert store.load("id long").count() == 0
    store.save(spark.range(3))
    store.save(spark.range(5))
    assert store.load("id long").count() == 5
