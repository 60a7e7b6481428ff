"""More queries: leases and reads, network faults, totals, records, sinks and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens import functions as R
from ledgerlens.operators import audit, commit, stats
from ledgerlens.plans.queries import MICROS, W, query
from ledgerlens.sources import adapters as A
from ledgerlens.sources.durable import MemoryStore, write_measurements
from ledgerlens.streaming import drain_commits, drain_gapless, drain_violations, log_stream, shared_folder

NOW = 1706600000000000
DAY = "CAST(date_diff('day', DATE '2024-01-01', ts) + 1 AS BIGINT)"

LEASES = f"""nodes AS (SELECT CAST(n_nationkey AS BIGINT) AS node, CASE n_nationkey % 6 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 5 END AS n_nodes, n_nationkey % 4 <> 3 AS leader,
        CASE n_nationkey % 5 WHEN 1 THEN 0 ELSE 9 END AS commit_index, CASE n_nationkey % 7 WHEN 2 THEN 4 ELSE 5 END AS commit_term FROM nation),
    heard AS (SELECT node, sent_at, row_number() OVER (PARTITION BY node ORDER BY sent_at DESC) AS k
        FROM (SELECT event_id % 25 AS node, user_id % 4 AS peer, max({NOW} - event_id * 7919 % 1000000) AS sent_at FROM events WHERE event_type <> 'error' OR event_id % 25 <> 8 GROUP BY 1, 2)),
    kth AS (SELECT nodes.*, CASE WHEN n_nodes = 1 THEN {NOW} ELSE sent_at END AS contact FROM nodes LEFT JOIN heard ON nodes.node = heard.node AND k = n_nodes // 2),
    ls AS (SELECT node, contact, contact + 122727 AS lease_until, CASE WHEN NOT leader THEN 'not leader' WHEN commit_index = 0 OR commit_term <> 5 THEN 'nothing committed in term'
        WHEN contact IS NULL THEN 'no quorum' WHEN {NOW} >= contact + 122727 THEN 'expired' ELSE 'ok' END AS reason FROM kth)"""


def _leases(spark, sf):
    node = F.col("n_nationkey")
    nodes = A.read(spark, sf, "nation").select(
        node.cast("long").alias("node"), F.when(node % 6 == 0, 1).when(node % 6 == 1, 3).otherwise(5).alias("n_nodes"), (node % 4 != 3).alias("leader"), F.lit(5).alias("term"),
        F.when(node % 5 == 1, 0).otherwise(9).alias("commit_index"), F.when(node % 7 == 2, 4).otherwise(5).alias("commit_term"), F.lit(NOW).cast("long").alias("now"),
    )
    event = F.col("event_id")
    heard = A.read(spark, sf, "events").where((F.col("event_type") != "error") | (event % 25 != 8))
    return commit.leases(nodes, heard.select((event % 25).alias("node"), (F.col("user_id") % 4).alias("peer"), (F.lit(NOW) - event * 7919 % 1000000).cast("long").alias("sent_at")))


@query(f"WITH {LEASES} SELECT node, contact, lease_until, reason = 'ok' AS allowed, reason FROM ls")
def lease_reads(spark, sf):
    return _leases(spark, sf)


READS = """WITH reads AS (SELECT o_orderkey AS read_id, o_orderstatus <> 'P' AS leader, o_custkey % 10 = 0 AS lease, o_orderkey AS idx, o_custkey % 3 AS term, epoch_us(o_orderdate) + 60 * 86400000000 AS deadline FROM orders),
    applied AS (SELECT l_orderkey AS idx, l_suppkey % 3 AS term, epoch_us(l_shipdate) AS applied_at FROM lineitem WHERE l_linenumber = 2 QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey, l_shipdate) = 1)
    SELECT read_id, CASE WHEN NOT leader THEN 'not leader' WHEN lease THEN 'served by lease' WHEN applied_at IS NULL OR applied_at > deadline THEN 'too slow' WHEN applied.term <> reads.term THEN 'deposed' ELSE 'served by barrier' END AS outcome
    FROM reads LEFT JOIN applied ON reads.idx = applied.idx"""


@query(READS)
def read_outcomes(spark, sf):
    micros = lambda c: F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {c})")
    reads = A.read(spark, sf, "orders").select(
        F.col("o_orderkey").alias("read_id"), (F.col("o_orderstatus") != "P").alias("leader"), (F.col("o_custkey") % 10 == 0).alias("lease"), F.col("o_orderkey").alias("idx"),
        (F.col("o_custkey") % 3).alias("term"), (micros("o_orderdate") + 60 * 86_400_000_000).alias("deadline"),
    )
    lines = A.read(spark, sf, "lineitem").where("l_linenumber = 2").groupBy(F.col("l_orderkey").alias("idx")).agg(F.min(F.struct("l_suppkey", "l_shipdate")).alias("first"))
    return commit.read_outcomes(reads, lines.select("idx", (F.col("first.l_suppkey") % 3).alias("term"), micros("first.l_shipdate").alias("applied_at")))


@query(W + """, s AS (SELECT peer, idx, term, key, value FROM M, L WHERE idx > match_index AND idx <= match_index + 40)
    SELECT peer, match_index + 1 AS next_index, (SELECT count(*) FROM s WHERE s.peer = M.peer) AS n_sent,
        coalesce((SELECT string_agg(idx || ':' || term || ':' || key || ':' || value, ',' ORDER BY idx) FROM s WHERE s.peer = M.peer), '') AS entries FROM M""")
def peer_entries(spark, sf):
    found = commit.peer_entries(A.log(spark, sf), A.match(spark, sf), 40)
    text = F.transform("entries", lambda e: F.concat_ws(":", e["idx"].cast("string"), e["term"].cast("string"), e["key"].cast("string"), e["value"]))
    return found.select("peer", "next_index", F.size("entries").cast("long").alias("n_sent"), F.array_join(text, ",").alias("entries"))


@query(f"""WITH m AS (SELECT user_id AS node, CAST(event_id % 3 AS BIGINT) AS role, {DAY} AS cur, {DAY} + CASE WHEN event_id % 11 = 0 THEN 2 ELSE -1 END AS msg, event_id FROM events),
    c AS (SELECT node, max(cur) AS cur, max(msg) AS msg FROM m GROUP BY 1) SELECT node, greatest(cur, msg) AS term, msg > cur AS stepped_down, CASE WHEN msg > cur THEN 0 ELSE 1 END::BIGINT AS role FROM c""")
def step_down(spark, sf):
    term = A.term_of(F.col("ts"))
    messages = A.read(spark, sf, "events").select(F.col("user_id").alias("node"), F.lit(1).alias("role"), term.alias("current_term"), (term + F.when(F.col("event_id") % 11 == 0, 2).otherwise(-1)).alias("msg_term"))
    return commit.step_down(messages)


@query("""SELECT refusal, count(*) AS n, min(commit_index) AS least, max(commit_index) AS most FROM (SELECT CASE WHEN wanted < old THEN 'backwards' WHEN wanted > last THEN 'beyond the log' END AS refusal,
    CASE WHEN wanted <= old OR wanted > last THEN old ELSE wanted END AS commit_index FROM (SELECT user_id AS old, event_id % 97 AS wanted, 60 AS last FROM events)) GROUP BY 1""")
def commit_refusals(spark, sf):
    moves = A.read(spark, sf, "events").select(F.col("user_id").alias("old"), (F.col("event_id") % 97).alias("wanted"), F.lit(60).cast("long").alias("last"))
    return commit.clamp_audit(moves).groupBy("refusal").agg(F.count("*").alias("n"), F.min("commit_index").alias("least"), F.max("commit_index").alias("most"))


ROUTED = """g AS (SELECT CAST(n_nationkey AS BIGINT) AS node, n_regionkey AS grp FROM nation), together AS (SELECT DISTINCT a.node AS src, b.node AS dst FROM g a JOIN g b ON a.grp = b.grp),
    m AS (SELECT event_id AS send_seq, user_id % 25 AS src, event_id % 25 AS dst FROM events),
    r AS (SELECT m.*, together.src IS NOT NULL AND send_seq * 7919 % 100 >= 10 AS request_ok, send_seq * 104729 % 100 >= 5 AS back FROM m LEFT JOIN together ON m.src = together.src AND m.dst = together.dst)"""


def _routed(spark, sf):
    """Draws are fixed functions of the message, so that they don't depend on partitions."""
    messages = A.read(spark, sf, "events").select(F.col("event_id").alias("send_seq"), (F.col("user_id") % 25).alias("src"), (F.col("event_id") % 25).alias("dst"))
    groups = A.read(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("node"), F.col("n_regionkey").alias("group"))
    return audit.deliverable(messages, groups, F.col("send_seq") * 7919 % 100 < 10, F.col("send_seq") * 104729 % 100 < 5)


@query(f"WITH {ROUTED} SELECT send_seq, src, dst, request_ok, request_ok AND back AS reply_ok FROM r")
def deliverable(spark, sf):
    return _routed(spark, sf)


@query(f"WITH {ROUTED} SELECT count(*) AS n_rpcs, count(*) FILTER (WHERE NOT request_ok) AS n_requests_lost, count(*) FILTER (WHERE request_ok AND NOT back) AS n_replies_lost FROM r")
def network_totals(spark, sf):
    return audit.network_totals(_routed(spark, sf))


@query("""WITH t AS (SELECT user_id AS src, event_id % 3 AS dst, event_id AS send_seq, row_number() OVER (PARTITION BY user_id, event_id % 3 ORDER BY epoch_us(ts) + event_id * 7919 % 4000 * 1000000, event_id) AS o FROM events),
    w AS (SELECT src, dst, send_seq < max(send_seq) OVER (PARTITION BY src, dst ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS late FROM t) SELECT src, dst, count(*) AS n_rpcs, count(*) FILTER (WHERE late) AS n_late FROM w GROUP BY 1, 2""")
def delayed_reorders(spark, sf):
    event = F.col("event_id")
    sent = A.read(spark, sf, "events").select(F.col("user_id").alias("src"), (event % 3).alias("dst"), event.alias("send_seq"), F.expr(MICROS).alias("sent_at"))
    return audit.reorders(audit.arrivals(sent, F.col("send_seq") * 7919 % 4000 * 1_000_000))


@query(f"""WITH t AS (SELECT event_type, user_id AS trial, max({DAY}) AS top, sum(event_id % 3) AS retries, count(DISTINCT {DAY}) - 1 AS extra FROM events GROUP BY 1, 2)
    SELECT event_type, max(top) AS max_term, CAST(sum(retries) AS BIGINT) AS retries, round(avg(extra), 6) AS mean_extra, max(extra) AS worst_extra FROM t GROUP BY 1""")
def election_totals(spark, sf):
    terms = A.read(spark, sf, "events").select("event_type", F.col("user_id").alias("trial"), A.term_of(F.col("ts")).alias("term"), (F.col("event_id") % 3).alias("retries"))
    return audit.election_totals(terms, "event_type")


@query("SELECT (idx - 1) // 1000 AS part, string_agg(term, ',' ORDER BY idx) AS terms FROM (SELECT event_id + 1 AS idx, " + DAY + " AS term FROM events) GROUP BY 1")
def log_terms(spark, sf):
    """Terms of a log without the sentinel, in runs of 1,000, so that no array grows with the log."""
    parts = A.log(spark, sf).groupBy(F.expr("(idx - 1) div 1000").alias("part")).agg(F.array_sort(F.collect_list(F.struct("idx", "term"))).alias("e"))
    return parts.select("part", F.array_join(F.transform("e", lambda x: x["term"].cast("string")), ",").alias("terms"))


@query("SELECT event_type, trial, value FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS trial FROM events) WHERE trial <= 50")
def capped_trials(spark, sf):
    return stats.first_trials(A.read(spark, sf, "events").select("event_type", "event_id", "value"), "event_type", "event_id").select("event_type", "trial", "value")


@query("""SELECT user_id, count(*) FILTER (WHERE g > 86400000000) AS n_timeouts, coalesce(max(g), 0) AS longest
    FROM (SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM events WHERE event_id % 7 < 5) GROUP BY 1""")
def inactivity_deadline(spark, sf):
    """Kinds of rows by event_id % 7: start, candidacy, vote granted, leader's message, step-down (also before a refused vote); refusals and stale messages don't reset."""
    at = A.read(spark, sf, "events").select("user_id", "event_id", F.expr(MICROS).alias("at"))
    return audit.missed_deadlines(at, "user_id", "event_id", "at", F.col("event_id") % 7 < 5, 86_400_000_000)


@query(W + "SELECT key, arg_max(value, idx) AS value FROM L WHERE NOT no_op GROUP BY 1")
def expected_union(spark, sf):
    log = A.log(spark, sf)
    return commit.union_maps(*[commit.kv_fold(log.where(F.col("key") % 4 == client)) for client in range(4)])


@query(W + "SELECT t.tick, M.peer, greatest(0, n - least(n, match_index + t.tick * 100)) AS n_missing FROM M, N, (SELECT unnest(range(0, 4)) AS tick) t")
def resend_missing(spark, sf):
    """What each tick would send again, if a hundred entries arrive between ticks."""
    ticks = spark.range(0, 4).toDF("tick")
    later = A.match(spark, sf).join(F.broadcast(ticks)).select("tick", "peer", (F.col("match_index") + F.col("tick") * 100).alias("match_index"))
    sent = commit.peer_messages(A.log(spark, sf), later.select(F.struct("tick", "peer").alias("peer"), "match_index"))
    return sent.select("peer.tick", "peer.peer", F.greatest(F.lit(0), F.col("n_entries")).alias("n_missing"))


@query("""SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'none' WHEN 1 THEN 'short' WHEN 2 THEN 'length' WHEN 3 THEN 'length' WHEN 4 THEN 'magic' WHEN 5 THEN 'version' WHEN 6 THEN 'checksum' ELSE 'short' END AS fault, false AS torn FROM events""")
def record_faults(spark, sf):
    from ledgerlens.plans.queries import record_check

    return record_check(spark, sf)


@query("SELECT event_type, count(*) AS n, true AS within FROM events GROUP BY 1")
def timeout_bounds(spark, sf):
    drawn = A.read(spark, sf, "events").select("event_type", R.timeout_micros(F.col("user_id"), F.col("event_id")).alias("t"))
    return drawn.groupBy("event_type").agg(F.count("*").alias("n"), F.bool_and((F.col("t") >= R.TIMEOUT_LOW_MICROS) & (F.col("t") < R.TIMEOUT_HIGH_MICROS)).alias("within"))


@query("""SELECT event_id, CAST(user_id AS VARCHAR) AS name, lpad(CAST(user_id AS VARCHAR), 6, '0') AS padded, CASE WHEN event_id % 5 = 0 THEN NULL ELSE user_id END AS parsed, repeat('#', user_id % 7) AS marks FROM events""")
def string_kit(spark, sf):
    name = F.concat(F.lit("  client-"), F.col("user_id").cast("string"), F.lit(" "))
    text = F.when(F.col("event_id") % 5 == 0, F.lit("12x")).otherwise(F.concat(F.lit(" "), F.col("user_id").cast("string"), F.lit(" ")))
    return A.read(spark, sf, "events").select(
        "event_id", R.trimmed(name, "client-").alias("name"), R.padded(F.col("user_id"), 6).alias("padded"), R.parsed_int(text).alias("parsed"), F.repeat(F.lit("#"), (F.col("user_id") % 7).cast("int")).alias("marks")
    )


@query("SELECT event_type, count(*) AS n, printf('%.3f', max(value)) AS highest FROM events GROUP BY 1")
def measurements_csv(spark, sf):
    """Measurements to CSV in the shared folder, and back."""
    path = shared_folder(spark, "measurements")
    write_measurements(A.read(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.max("value").alias("highest")), path)
    return spark.read.schema("event_type string, n long, highest string").csv(path, header=True)


@query("""WITH b AS (SELECT event_type, CAST(floor(value / 5) AS BIGINT) AS bin, count(*) AS n FROM events GROUP BY 1, 2), s AS (SELECT event_type, unnest(range(min(bin), max(bin) + 1)) AS bin FROM b GROUP BY 1)
    SELECT s.event_type, s.bin, coalesce(n, 0) AS n, repeat('#', CAST(ceil(coalesce(n, 0) * 50 / (SELECT max(n) FROM b)) AS INTEGER)) AS bar FROM s LEFT JOIN b ON s.event_type = b.event_type AND s.bin = b.bin""")
def histogram_bars(spark, sf):
    return stats.bars(stats.histogram(A.read(spark, sf, "events"), "event_type", "value", 5.0))


@query(W + "SELECT max(idx) AS last_idx, arg_max(term, idx) AS last_term FROM L")
def memory_store(spark, sf):
    store = MemoryStore(spark)
    store.save(spark.range(1).select(F.lit(0).alias("last_idx"), F.lit(0).alias("last_term")))
    store.save(commit.log_tail(A.log(spark, sf)))
    return store.load("last_idx long, last_term long")


@query("SELECT key, coalesce(max(CASE WHEN wanted <= last THEN wanted END), 0) AS released FROM (SELECT user_id AS key, event_id * 31 % 5000 AS wanted, 4000 + user_id % 10 AS last FROM events) GROUP BY 1")
def stream_commit_gate(spark, sf):
    """Release points as a stream: reports come in any order; a point never moves back, nor past the log."""
    log = log_stream(spark, sf)
    moves = log.select("key", ((F.col("idx") - 1) * 31 % 5000).alias("wanted"), (4000 + F.col("key") % 10).alias("last"))
    return drain_commits(moves, shared_folder(spark, "stream-gate"))


@query("SELECT event_id + 1 AS idx FROM events WHERE event_id % 1000 = 7")
def stream_monitor(spark, sf):
    """Two nodes' committed entries as one stream, one of them damaged now and then; the monitor names the indexes."""
    first, second = log_stream(spark, sf), log_stream(spark, sf)
    damaged = second.withColumn("value", F.when((F.col("idx") - 1) % 1000 == 7, F.concat("value", F.lit("!"))).otherwise(F.col("value")))
    return drain_violations(first.union(damaged), shared_folder(spark, "stream-monitor"))


@query("""WITH d AS (SELECT DISTINCT conv_id, turn FROM conversations), r AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS o FROM d WHERE turn >= 0) SELECT conv_id, turn + 1 AS idx FROM r WHERE turn + 1 = o""")
def stream_gapless(spark, sf):
    """Turns of conversations, delivered twice: each goes on once, in order, and none past a gap."""
    schema = "conv_id long, turn long, role string, text string"
    turns = spark.readStream.schema(schema).parquet(f"{sf}/conversation[s].parquet").select("conv_id", (F.col("turn") + 1).alias("idx"), F.lit(0).cast("long").alias("term"), F.lit("").alias("value"))
    return drain_gapless(turns.union(turns), shared_folder(spark, "stream-gapless"), "conv_id").select("conv_id", "idx")
