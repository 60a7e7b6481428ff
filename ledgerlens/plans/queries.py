"""The query catalogue. ``QUERIES[name]`` is (spark, sf_dir) -> DataFrame; ``SQL[name]`` says the same in DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens import functions as R
from ledgerlens.operators import audit, commit, repair, stats
from ledgerlens.sources import adapters as A
from ledgerlens.sources.durable import decode_records, encode_records
from ledgerlens.streaming import drain_apply, drain_kv, log_stream, shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# The model tables in SQL: log L, match M, follower D, its mutated copy X, and n.
L = "L AS (SELECT event_id + 1 AS idx, CAST(date_diff('day', DATE '2024-01-01', ts) + 1 AS BIGINT) AS term, user_id AS key, event_type AS value, event_type = 'error' AS no_op FROM events), N AS (SELECT max(idx) AS n FROM L)"
M = "M AS (SELECT p AS peer, n - p * (n // 200) AS match_index FROM N, (SELECT unnest(range(1, 5)) AS p))"
D = """C AS (SELECT n // 2 AS cut, n // 10 AS extra, (SELECT term FROM L WHERE idx = n // 2) AS cut_term, n // 4 AS spot FROM N),
D AS (SELECT idx, CASE WHEN idx <= cut THEN term ELSE cut_term END AS term, key, CASE WHEN idx <= cut OR term = cut_term THEN value ELSE value || '~' END AS value, no_op FROM L, C WHERE idx <= cut + extra),
X AS (SELECT D.idx, term, key, CASE WHEN idx = spot THEN value || '!' ELSE value END AS value, no_op FROM D, C)"""
W = f"WITH {L}, {M}, {D} "
COMMIT = "(SELECT coalesce(max(idx), 0) FROM L WHERE term = (SELECT max(term) FROM L) AND 1 + (SELECT count(*) FROM M WHERE match_index >= L.idx) >= 3)"
MICROS = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _last_term(log: DataFrame):
    return log.agg(F.max("term")).scalar()


def _commit(spark: SparkSession, sf: str) -> DataFrame:
    log = A.log(spark, sf)
    return commit.commit_index(log, A.match(spark, sf), _last_term(log), A.N_NODES)


def _cut(spark: SparkSession, sf: str):
    return A.n_entries(spark, sf).select(F.expr("n div 2")).scalar()


@query(W + f"SELECT key, arg_max(value, idx) AS value, max(idx) AS idx FROM L WHERE NOT no_op AND idx <= {COMMIT} GROUP BY key")
def kv_at_commit(spark, sf):
    return commit.kv_fold(A.log(spark, sf).where(F.col("idx") <= A.committed(spark, sf)))


@query(W + "SELECT max(idx) AS last_idx, arg_max(term, idx) AS last_term FROM L")
def log_tail(spark, sf):
    return commit.log_tail(A.log(spark, sf))


@query(W + "SELECT idx, term, NOT no_op AS command_valid, key, value FROM L")
def apply_stream(spark, sf):
    return commit.apply_messages(A.log(spark, sf))


@query(W + f"SELECT {COMMIT} AS commit_index")
def commit_index(spark, sf):
    return _commit(spark, sf)


@query(W + "SELECT coalesce(max(idx), 0) AS commit_index FROM L WHERE term = 31")
def commit_index_gated(spark, sf):
    return commit.commit_index(A.log(spark, sf), A.match(spark, sf), F.lit(31), A.N_NODES)


@query(W + """SELECT peer, match_index + 1 AS next_index, (SELECT term FROM L WHERE idx = match_index) AS prev_term,
    (SELECT count(*) FROM L WHERE idx > match_index) AS n_entries, (SELECT coalesce(max(idx), 0) FROM L WHERE idx > match_index) AS last_sent FROM M""")
def peer_messages(spark, sf):
    return commit.peer_messages(A.log(spark, sf), A.match(spark, sf))


@query(W + "SELECT peer, (SELECT n FROM N) + 1 AS next_index, CAST(0 AS BIGINT) AS match_index FROM M")
def init_progress(spark, sf):
    return commit.init_progress(A.log(spark, sf), A.match(spark, sf))


@query("""SELECT user_id AS peer, coalesce(max(CASE WHEN event_type <> 'error' THEN event_id + event_id % 4 END), 0) AS match_index,
    coalesce(max(CASE WHEN event_type <> 'error' THEN event_id + event_id % 4 END), 0) + 1 AS next_index FROM events GROUP BY 1""")
def advance_progress(spark, sf):
    replies = A.read(spark, sf, "events").select(F.col("user_id").alias("peer"), F.col("event_id").alias("prev_log_index"), (F.col("event_id") % 4).alias("n_sent"), (F.col("event_type") != "error").alias("success"))
    return commit.advance_progress(replies)


@query("""WITH e AS (SELECT user_id, event_id, max(event_id) OVER (PARTITION BY user_id) AS next_index FROM events WHERE event_type = 'error')
    SELECT user_id AS peer, count(*) FILTER (WHERE event_id + 1 = next_index OR event_id = next_index) AS n_current, count(*) FILTER (WHERE NOT (event_id + 1 = next_index OR event_id = next_index)) AS n_stale FROM e GROUP BY 1""")
def stale_rejections(spark, sf):
    rejected = A.read(spark, sf, "events").where("event_type = 'error'").select("user_id", "event_id")
    latest = rejected.groupBy("user_id").agg(F.max("event_id").alias("next_index"))
    current = (F.col("event_id") + 1 == F.col("next_index")) | (F.col("event_id") == F.col("next_index"))
    return rejected.join(latest, "user_id").groupBy(F.col("user_id").alias("peer")).agg(F.count_if(current).alias("n_current"), F.count_if(~current).alias("n_stale"))


@query(W + """SELECT l.term, count(*) FILTER (WHERE coalesce(d.term = l.term, false)) AS n_ok, count(*) FILTER (WHERE NOT coalesce(d.term = l.term, false)) AS n_refused FROM L l LEFT JOIN D d ON l.idx = d.idx GROUP BY 1""")
def consistency_check(spark, sf):
    probes = A.log(spark, sf).select(F.col("idx").alias("prev_index"), F.col("term").alias("prev_term"))
    held = repair.matches_at(A.follower(spark, sf), probes)
    return held.groupBy(F.col("prev_term").alias("term")).agg(F.count_if("ok").alias("n_ok"), F.count_if(~F.col("ok")).alias("n_refused"))


LAST = "u AS (SELECT key, arg_max(term, idx) AS term, max(idx) AS idx FROM L GROUP BY key)"


def _last_per_user(spark, sf):
    last = F.max(F.struct("idx", "term"))
    return A.log(spark, sf).groupBy("key").agg(last.alias("last")).select("key", F.col("last.term").alias("term"), F.col("last.idx").alias("idx"))


def _votes(spark, sf):
    c, v = _last_per_user(spark, sf).alias("c"), _last_per_user(spark, sf).alias("v")
    return c.join(v, F.col("c.key") + 1 == F.col("v.key"))


@query(W + f", {LAST} SELECT c.key AS candidate, v.key AS voter, c.term > v.term OR (c.term = v.term AND c.idx >= v.idx) AS up_to_date FROM u c JOIN u v ON c.key + 1 = v.key")
def vote_recency(spark, sf):
    recent = R.up_to_date(F.col("c.term"), F.col("c.idx"), F.col("v.term"), F.col("v.idx"))
    return _votes(spark, sf).select(F.col("c.key").alias("candidate"), F.col("v.key").alias("voter"), recent.alias("up_to_date"))


@query(W + f""", {LAST}, a AS (SELECT c.key AS candidate, v.key AS voter, c.term + c.key % 3 AS term, v.term + 1 AS cur, CASE c.key % 4 WHEN 0 THEN NULL WHEN 1 THEN c.key ELSE c.key + 7 END AS voted,
    c.term > v.term OR (c.term = v.term AND c.idx >= v.idx) AS recent FROM u c JOIN u v ON c.key + 1 = v.key)
    SELECT candidate, voter, greatest(term, cur) AS new_term, term >= cur AND (term > cur OR voted IS NULL OR voted = candidate) AND recent AS granted FROM a""")
def vote_grant(spark, sf):
    key = F.col("c.key")
    recent = R.up_to_date(F.col("c.term"), F.col("c.idx"), F.col("v.term"), F.col("v.idx"))
    term, current = F.col("c.term") + key % 3, F.col("v.term") + 1
    voted = F.when(key % 4 == 0, F.lit(None).cast("long")).when(key % 4 == 1, key).otherwise(key + 7)
    return _votes(spark, sf).select(key.alias("candidate"), F.col("v.key").alias("voter"), F.greatest(term, current).alias("new_term"), F.coalesce(R.vote_granted(term, current, voted, key, recent), F.lit(False)).alias("granted"))


@query(W + """SELECT key % 5 AS node, count(*) FILTER (WHERE term < 15) AS n_stale, count(*) FILTER (WHERE term = 15 AND key % 5 = 0) AS n_at_leader, count(*) FILTER (WHERE term > 15 OR (term = 15 AND key % 5 <> 0)) AS n_accepted FROM L GROUP BY 1""")
def message_refusal(spark, sf):
    node, term = F.pmod("key", F.lit(5)).alias("node"), F.col("term")
    messages = A.log(spark, sf).select(node, term)
    stale, at_leader = term < 15, (term == 15) & (F.col("node") == 0)
    return messages.groupBy("node").agg(F.count_if(stale).alias("n_stale"), F.count_if(at_leader).alias("n_at_leader"), F.count_if(~stale & ~at_leader).alias("n_accepted"))


@query("""WITH v AS (SELECT CAST(date_diff('day', DATE '2024-01-01', ts) + 1 AS BIGINT) AS term, user_id % 7 AS candidate, value >= 20 AS granted, event_type = 'error' AND value > 40 AS void FROM events)
    SELECT term, candidate, count(*) FILTER (WHERE granted) + 1 AS votes, bool_or(void) AS voided, count(*) FILTER (WHERE granted) + 1 >= 21 AND NOT bool_or(void) AS won FROM v GROUP BY 1, 2""")
def election_tally(spark, sf):
    term = A.term_of(F.col("ts"))
    replies = A.read(spark, sf, "events").select(term.alias("term"), F.pmod("user_id", F.lit(7)).alias("candidate"), (F.col("value") >= 20).alias("granted"), (term + F.when((F.col("event_type") == "error") & (F.col("value") > 40), 1).otherwise(0)).alias("reply_term"))
    return commit.election_tally(replies, 41).select("term", "candidate", "votes", "voided", "won")


@query("""WITH c AS (SELECT user_id, max(epoch_us(ts)) AS t FROM events GROUP BY 1), k AS (SELECT min(t) AS contact, count(*) AS n FROM (SELECT t FROM c ORDER BY t DESC LIMIT 2))
    SELECT contact, contact + 122727 AS lease_until, 1706600000000000 < contact + 122727 AS allowed, CASE WHEN 1706600000000000 < contact + 122727 THEN 'ok' ELSE 'expired' END AS reason FROM k""")
def lease_contact(spark, sf):
    contacts = A.read(spark, sf, "events").select(F.col("user_id").alias("peer"), F.expr(MICROS).alias("sent_at"))
    return commit.lease(contacts, A.N_NODES, 1706600000000000)


@query(W + "SELECT min(idx) AS run_start, max(idx) AS run_end, term FROM (SELECT idx, term, idx - row_number() OVER (PARTITION BY term ORDER BY idx) AS island FROM L) GROUP BY term, island")
def term_runs(spark, sf):
    return repair.term_runs(A.log(spark, sf))


@query(W + "SELECT t AS term, coalesce((SELECT max(idx) FROM L WHERE term = t), 0) AS last_idx FROM (SELECT unnest(range(1, 36)) AS t)")
def last_of_term(spark, sf):
    return repair.last_of_term(A.log(spark, sf), spark.range(1, 36).toDF("term"))


HINTS = "r AS (SELECT term, min(idx) AS s FROM D GROUP BY term), h AS (SELECT l.idx AS prev, coalesce(r.s, (SELECT max(idx) FROM D) + 1) AS conflict_index, coalesce(d.term, 0) AS conflict_term FROM L l LEFT JOIN D d ON l.idx = d.idx LEFT JOIN r ON r.term = d.term)"


@query(W + f", {HINTS} SELECT * FROM h")
def conflict_hint(spark, sf):
    return repair.conflict_hints(A.follower(spark, sf), A.log(spark, sf).select(F.col("idx").alias("prev")))


@query(W + f", {HINTS}, o AS (SELECT term, max(idx) AS last FROM L GROUP BY term) SELECT prev, greatest(1, least(prev, coalesce(o.last + 1, conflict_index))) AS next_index FROM h LEFT JOIN o ON o.term = conflict_term")
def next_index(spark, sf):
    hints = repair.conflict_hints(A.follower(spark, sf), A.log(spark, sf).select(F.col("idx").alias("prev")))
    return repair.next_indexes(A.log(spark, sf), hints)


@query(W + """, msg AS (SELECT L.* FROM L, C WHERE idx > cut - 10 AND idx <= (SELECT n FROM N) - (SELECT n FROM N) // 4), k AS (SELECT min(msg.idx) AS c FROM msg JOIN D ON msg.idx = D.idx WHERE msg.term <> D.term)
    SELECT * FROM D WHERE idx < (SELECT coalesce(c, 9223372036854775807) FROM k) UNION ALL SELECT * FROM msg WHERE idx >= (SELECT coalesce(c, 9223372036854775807) FROM k) OR idx > (SELECT max(idx) FROM D)""")
def merge_log(spark, sf):
    n, _ = A.shape(spark, sf)
    low, high = n // 2 - 10, n - n // 4
    return repair.merge(A.follower(spark, sf), A.log(spark, sf).where((F.col("idx") > low) & (F.col("idx") <= high)))


@query(W + f"""SELECT peer, least({COMMIT}, match_index + 100) AS wanted, CASE WHEN least({COMMIT}, match_index + 100) > n THEN match_index // 2 ELSE greatest(match_index // 2, least({COMMIT}, match_index + 100)) END AS commit_index FROM M, N""")
def follower_commit(spark, sf):
    last = A.n_entries(spark, sf).scalar()
    wanted = F.least(_commit(spark, sf).scalar(), F.col("match_index") + 100)
    return A.match(spark, sf).select("peer", wanted.alias("wanted"), F.expr("match_index div 2").alias("old")).select("peer", "wanted", R.commit_clamp(F.col("old"), F.col("wanted"), last).alias("commit_index"))


DIFF = "NOT (a.term IS NOT DISTINCT FROM b.term AND a.key IS NOT DISTINCT FROM b.key AND a.value IS NOT DISTINCT FROM b.value AND a.no_op IS NOT DISTINCT FROM b.no_op)"


@query(W + ", " + ", ".join(f"""f{t} AS (SELECT '{t}' AS copy, a.idx, a.term FROM L a JOIN {t} b USING (idx) WHERE a.term = b.term AND idx >= (SELECT min(a.idx) FROM L a JOIN {t} b ON a.idx = b.idx WHERE {DIFF}))""" for t in ("D", "X")) + """
    SELECT copy, term, count(*) AS n_violations, min(idx) AS first_violation FROM (SELECT * FROM fD UNION ALL SELECT * FROM fX) GROUP BY 1, 2""")
def log_matching_audit(spark, sf):
    found = audit.log_matching_copies(A.log(spark, sf), A.copies(spark, sf))
    return found.groupBy("copy", "term").agg(F.count("*").alias("n_violations"), F.min("idx").alias("first_violation"))


@query(W + """SELECT idx, count(*) AS n_versions FROM (SELECT * FROM L WHERE idx <= (SELECT cut + 50 FROM C) UNION SELECT * FROM X WHERE idx <= (SELECT cut + 50 FROM C)) GROUP BY idx HAVING count(*) > 1""")
def commit_ledger(spark, sf):
    upto = F.col("idx") <= _cut(spark, sf) + 50
    return audit.commit_ledger(A.log(spark, sf).where(upto), A.mutated(spark, sf).where(upto))


def _tickets(spark, sf):
    return A.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("idx"), F.col("l_linenumber").cast("long").alias("term"))


@query("""SELECT CASE WHEN o.o_orderkey IS NULL THEN 'pending' WHEN o.o_orderkey % 4 + 1 = l_linenumber THEN 'landed' ELSE 'overwritten' END AS status, count(*) AS n
    FROM lineitem LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') o ON l_orderkey = o_orderkey GROUP BY 1""")
def claim_tickets(spark, sf):
    applied = A.read(spark, sf, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("idx"), (F.col("o_orderkey") % 4 + 1).alias("term"))
    return audit.ticket_status(_tickets(spark, sf), applied).groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT CAST(l_linenumber AS BIGINT) AS term, l_orderkey AS idx, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_claims(spark, sf):
    return audit.duplicate_claims(_tickets(spark, sf))


@query(W + f"SELECT min(coalesce(a.idx, b.idx)) AS first_diff, count(*) AS n_diff FROM L a FULL JOIN D b ON a.idx = b.idx WHERE {DIFF}")
def sequence_diff(spark, sf):
    return repair.divergence(A.log(spark, sf), A.follower(spark, sf))


@query(W + ", " + ", ".join(f"k{t} AS (SELECT key, arg_max(value, idx) AS value FROM {t} WHERE NOT no_op GROUP BY key)" for t in ("L", "D")) + " SELECT coalesce(a.key, b.key) AS key, a.value AS expected, b.value AS actual FROM kL a FULL JOIN kD b ON a.key = b.key WHERE a.value IS DISTINCT FROM b.value")
def map_diff(spark, sf):
    a, b = commit.kv_fold(A.log(spark, sf)).alias("a"), commit.kv_fold(A.follower(spark, sf)).alias("b")
    both = a.join(b, F.col("a.key") == F.col("b.key"), "full").where(~F.col("a.value").eqNullSafe(F.col("b.value")))
    return both.select(F.coalesce("a.key", "b.key").alias("key"), F.col("a.value").alias("expected"), F.col("b.value").alias("actual"))


@query(W + ", " + ", ".join(f"p{t} AS (SELECT '{t}' AS copy, count(*) AS n_lost FROM (SELECT * FROM L WHERE idx <= (SELECT cut FROM C) EXCEPT ALL SELECT * FROM {t}))" for t in ("D", "X")) + " SELECT copy, n_lost, n_lost = 0 AS intact FROM (SELECT * FROM pD UNION ALL SELECT * FROM pX)")
def prefix_intact(spark, sf):
    prefix = A.log(spark, sf).where(F.col("idx") <= _cut(spark, sf))
    lost = lambda other, name: prefix.exceptAll(other).agg(F.count("*").alias("n_lost")).select(F.lit(name).alias("copy"), "n_lost", (F.col("n_lost") == 0).alias("intact"))
    return lost(A.follower(spark, sf), "D").unionByName(lost(A.mutated(spark, sf), "X"))


@query("""WITH w AS (SELECT conv_id, turn, turn <> coalesce(lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) + 1, 0) AS f FROM conversations WHERE role <> 'assistant')
    SELECT conv_id, min(turn) AS first_fault, count(*) AS n_faults FROM w WHERE f GROUP BY 1""")
def gaps(spark, sf):
    return audit.gaps(A.read(spark, sf, "conversations").where("role <> 'assistant'"), "conv_id", "turn")


@query("SELECT user_id, count(*) FILTER (WHERE p > value) AS n_decreases FROM (SELECT user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) GROUP BY 1")
def monotone_violations(spark, sf):
    return audit.decreases(A.read(spark, sf, "events"), "user_id", "event_id", "value")


@query("""WITH t AS (SELECT user_id AS src, event_id AS send_seq, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS o FROM events),
    w AS (SELECT src, send_seq < max(send_seq) OVER (PARTITION BY src ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS late FROM t)
    SELECT src, CAST(0 AS BIGINT) AS dst, count(*) AS n_rpcs, count(*) FILTER (WHERE late) AS n_late FROM w GROUP BY src""")
def reorders(spark, sf):
    order = F.row_number().over(Window.partitionBy("user_id").orderBy("value", "event_id"))
    trace = A.read(spark, sf, "events").select(F.col("user_id").alias("src"), F.lit(0).cast("long").alias("dst"), F.col("event_id").alias("send_seq"), order.alias("arrive_ord"))
    return audit.reorders(trace)


@query("""SELECT term, count(*) AS n_leaders, min(node) AS least, max(node) AS highest, count(*) > 1 AS violation
    FROM (SELECT DISTINCT CAST(date_diff('day', DATE '2024-01-01', ts) + 1 AS BIGINT) AS term, user_id AS node FROM events WHERE event_type = 'purchase') GROUP BY 1""")
def leaders_by_term(spark, sf):
    leaders = A.read(spark, sf, "events").where("event_type = 'purchase'").select(A.term_of(F.col("ts")).alias("term"), F.col("user_id").alias("node"))
    return audit.leaders_by_term(leaders)


@query("SELECT max(user_id) AS leader, max(term) AS term FROM (SELECT user_id, CAST(date_diff('day', DATE '2024-01-01', ts) + 1 AS BIGINT) AS term FROM events WHERE event_type = 'purchase' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 200)) WHERE term = (SELECT max(CAST(date_diff('day', DATE '2024-01-01', ts) + 1 AS BIGINT)) FROM events WHERE event_type = 'purchase' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 200))")
def live_leader(spark, sf):
    events = A.read(spark, sf, "events")
    dead = events.where("event_type = 'error' AND value > 200").select("user_id").distinct()
    claims = events.where("event_type = 'purchase'").select(A.term_of(F.col("ts")).alias("term"), "user_id").join(dead, "user_id", "left_anti")
    return claims.agg(F.max(F.struct("term", "user_id")).alias("best")).select(F.col("best.user_id").alias("leader"), F.col("best.term").alias("term"))


@query("SELECT count(*) AS n_submitted, (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) AS n_distinct, count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) AS excess FROM lineitem")
def duplicates_excess(spark, sf):
    each = _tickets(spark, sf).groupBy("term", "idx").agg(F.count("*").alias("n"))
    return each.agg(F.sum("n").alias("n_submitted"), F.count("*").alias("n_distinct"), (F.sum("n") - F.count("*")).alias("excess"))


@query("""WITH s AS (SELECT CAST(l_shipdate AS DATE) AS day, 1 AS d FROM lineitem UNION ALL SELECT CAST(l_shipdate AS DATE) + CAST(l_quantity AS INTEGER) AS day, -1 AS d FROM lineitem), net AS (SELECT day, sum(d) AS d FROM s GROUP BY day)
    SELECT CAST(max(o) AS BIGINT) AS peak FROM (SELECT sum(d) OVER (ORDER BY day) AS o FROM net)""")
def peak_concurrency(spark, sf):
    day = F.col("l_shipdate").cast("date")
    return audit.peak(A.read(spark, sf, "lineitem").select(day.alias("start"), F.date_add(day, F.col("l_quantity").cast("int")).alias("stop")))


RANK = "(SELECT e.value FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS c FROM events) e WHERE e.event_type = g.event_type AND e.r = greatest(1, ({p} * e.c + 99) // 100))"


@query("SELECT event_type, n, least, mean, highest, " + ", ".join(RANK.format(p=p) + f" AS p{p}" for p in (50, 90, 95)) + " FROM (SELECT event_type, count(*) AS n, min(value) AS least, round(avg(value), 6) AS mean, max(value) AS highest FROM events GROUP BY 1) g")
def latency_summary(spark, sf):
    return stats.summary(A.read(spark, sf, "events"), "event_type", "value", 1.0)


@query("""WITH b AS (SELECT event_type, CAST(floor(value / 5) AS BIGINT) AS bin, count(*) AS n FROM events GROUP BY 1, 2), s AS (SELECT event_type, unnest(range(min(bin), max(bin) + 1)) AS bin FROM b GROUP BY 1)
    SELECT s.event_type, s.bin, coalesce(n, 0) AS n FROM s LEFT JOIN b ON s.event_type = b.event_type AND s.bin = b.bin""")
def latency_histogram(spark, sf):
    return stats.histogram(A.read(spark, sf, "events"), "event_type", "value", 5.0)


@query("SELECT n, round(150 + 150.0 / (n + 1), 6) AS mean_of_min, round(150 + 150 * (1 - power(2.0, -1.0 / n)), 6) AS median_of_min FROM (SELECT unnest(range(1, 10)) AS n)")
def order_stats_theory(spark, sf):
    n = F.col("n")
    return spark.range(1, 10).toDF("n").select("n", F.round(150 + F.lit(150.0) / (n + 1), 6).alias("mean_of_min"), F.round(150 + 150 * (1 - F.pow(F.lit(2.0), F.lit(-1.0) / n)), 6).alias("median_of_min"))


@query("""WITH c AS (SELECT event_id, CASE event_type WHEN 'error' THEN 'get|' || user_id WHEN 'view' THEN 'put|' || user_id || '|' || event_type || '|x' ELSE 'put|' || user_id || '|' || event_type END AS cmd FROM events),
    s AS (SELECT string_split(cmd, '|') AS p FROM c) SELECT len(p) = 3 AND p[1] = 'put' AS valid, CASE WHEN len(p) = 3 AND p[1] = 'put' THEN p[2] END AS key, CASE WHEN len(p) = 3 AND p[1] = 'put' THEN p[3] END AS value, count(*) AS n FROM s GROUP BY 1, 2, 3""")
def decode_put(spark, sf):
    put = R.encode_put(F.col("user_id"), F.col("event_type"))
    command = F.when(F.col("event_type") == "error", F.concat(F.lit("get|"), F.col("user_id").cast("string"))).when(F.col("event_type") == "view", F.concat(put, F.lit("|x"))).otherwise(put)
    valid, key, value = R.decode_put(command)
    return A.read(spark, sf, "events").select(valid.alias("valid"), key.alias("key"), value.alias("value")).groupBy("valid", "key", "value").agg(F.count("*").alias("n"))


@query("SELECT CAST(a.n_nationkey AS BIGINT) AS node, count(*) - 1 AS n_reachable FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey GROUP BY 1")
def reachability(spark, sf):
    return audit.reachable_pairs(A.read(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("node"), F.col("n_regionkey").alias("group")))


@query("""WITH d AS (SELECT event_type, date_diff('day', DATE '2024-01-01', ts) AS day, count(*) // 10 AS reading FROM events GROUP BY 1, 2)
    SELECT event_type, CAST(day AS BIGINT) AS day, coalesce(reading = lag(reading) OVER (PARTITION BY event_type ORDER BY day), false) AS settled FROM d""")
def settled(spark, sf):
    polls = A.read(spark, sf, "events").groupBy("event_type", (A.term_of(F.col("ts")) - 1).alias("day")).agg(F.expr("count(*) div 10").alias("reading"))
    w = Window.partitionBy("event_type").orderBy("day")
    return polls.select("event_type", "day", F.coalesce(F.col("reading") == F.lag("reading").over(w), F.lit(False)).alias("settled"))


@query(W + f"SELECT peer, {COMMIT} - least(match_index, {COMMIT}) AS lag FROM M")
def apply_lag(spark, sf):
    return A.match(spark, sf).select("peer", _commit(spark, sf).scalar().alias("c"), "match_index").select("peer", (F.col("c") - F.least("match_index", "c")).alias("lag"))


def _records(spark, sf):
    return encode_records(A.read(spark, sf, "events").select("event_id", (F.col("event_id") % 30).alias("current_term"), F.pmod("event_id", F.lit(5)).alias("voted_for"), "props"), "event_id")


@query()
def record_frame(spark, sf):
    return _records(spark, sf).select("event_id", F.hex("blob").alias("blob"))


@query()
def record_check(spark, sf):
    """Every record, damaged in one of eight ways by its id (0: not at all), and what the check says."""
    kind, blob = F.pmod("event_id", F.lit(8)), F.col("blob")
    flipped = F.concat(F.substring(blob, 1, 16), F.unhex(F.lit("00")), F.substring(blob, 18, 2147483647))
    damaged = (
        F.when(kind == 1, F.encode(F.lit(""), "UTF-8")).when(kind == 2, F.substring(blob, 1, 16)).when(kind == 3, F.substring(blob, 1, 20))
        .when(kind == 4, F.concat(F.encode(F.lit("XXXX"), "UTF-8"), F.substring(blob, 5, 2147483647)))
        .when(kind == 5, F.concat(F.substring(blob, 1, 4), F.unhex(F.lit("00000063")), F.substring(blob, 9, 2147483647)))
        .when(kind == 6, flipped).when(kind == 7, F.encode(F.lit("garbage"), "UTF-8")).otherwise(blob)
    )
    found = decode_records(_records(spark, sf).select("event_id", damaged.alias("blob")), "event_id", "current_term long, voted_for long, props string")
    torn = F.col("state.voted_for") != F.col("event_id") % 5
    return found.select("event_id", F.coalesce("fault", F.lit("none")).alias("fault"), F.coalesce(torn, F.lit(False)).alias("torn"))


@query(W + "SELECT key, arg_max(value, idx) AS value, max(idx) AS idx FROM L WHERE NOT no_op GROUP BY key")
def stream_kv(spark, sf):
    return drain_kv(log_stream(spark, sf), shared_folder(spark, "stream-kv"))


@query(W + "SELECT idx, term, NOT no_op AS command_valid, key, value FROM L")
def stream_apply(spark, sf):
    log = log_stream(spark, sf)
    return drain_apply(log.union(log_stream(spark, sf)), shared_folder(spark, "stream-apply"))


@query(W + """SELECT * FROM L UNION ALL SELECT n + s AS idx, (SELECT max(term) FROM L) AS term, CAST(s AS BIGINT) AS key, CASE WHEN s = 3 THEN '' ELSE 'new' END AS value, s = 3 AS no_op FROM N, (SELECT unnest(range(1, 4)) AS s)""")
def append_rows(spark, sf):
    log = A.log(spark, sf)
    n, term = A.n_entries(spark, sf).scalar(), _last_term(log)
    barrier = F.col("key") == 3
    new = spark.range(1, 4).toDF("key").select((n + F.col("key")).alias("idx"), term.alias("term"), "key", F.when(barrier, "").otherwise("new").alias("value"), barrier.alias("no_op"))
    return log.unionByName(new)


@query(W + "SELECT count(DISTINCT key) AS n_keys, max(idx) AS last_idx, arg_max(term, idx) AS last_term, count(*) AS n_applied FROM L WHERE NOT no_op AND idx <= (SELECT cut FROM C)")
def snapshot_as_of(spark, sf):
    part = A.log(spark, sf).where(~F.col("no_op") & (F.col("idx") <= _cut(spark, sf)))
    keys = part.groupBy("key").agg(F.max(F.struct("idx", "term")).alias("last"), F.count("*").alias("n"))
    return keys.agg(F.count("*").alias("n_keys"), F.max("last").alias("last"), F.sum("n").alias("n_applied")).select("n_keys", F.col("last.idx").alias("last_idx"), F.col("last.term").alias("last_term"), "n_applied")


@query("SELECT pos AS idx, CAST(t AS BIGINT) AS term FROM (SELECT unnest(range(1, 11)) AS pos, unnest([1, 1, 1, 4, 4, 5, 5, 6, 6, 6]) AS t)")
def term_list(spark, sf):
    terms = F.array(*[F.lit(t).cast("long") for t in (1, 1, 1, 4, 4, 5, 5, 6, 6, 6)])
    return spark.range(1).select(F.posexplode(terms).alias("pos", "term")).select((F.col("pos") + 1).cast("long").alias("idx"), "term")


ALLOWED = [("user", "assistant"), ("system", "user")]


@query("""SELECT before, after, count(*) AS n FROM (SELECT lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before, role AS after FROM conversations)
    WHERE before IS NOT NULL AND before <> after AND NOT (before = 'user' AND after = 'assistant') AND NOT (before = 'system' AND after = 'user') GROUP BY 1, 2""")
def role_transitions(spark, sf):
    return audit.bad_transitions(A.read(spark, sf, "conversations"), "conv_id", "turn", "role", ALLOWED)


@query("""SELECT user_id, count(*) FILTER (WHERE g > 86400000000) AS n_timeouts, coalesce(max(g), 0) AS longest FROM (SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM events) GROUP BY 1""")
def inactivity_gaps(spark, sf):
    at = A.read(spark, sf, "events").select("user_id", "event_id", F.expr(MICROS).alias("at"))
    gap = F.col("at") - F.lag("at").over(Window.partitionBy("user_id").orderBy("event_id"))
    return at.select("user_id", gap.alias("g")).groupBy("user_id").agg(F.count_if(F.col("g") > 86_400_000_000).alias("n_timeouts"), F.coalesce(F.max("g"), F.lit(0)).alias("longest"))


@query(W + "SELECT key % 20 AS client, key, arg_max(value, idx) AS value FROM L WHERE NOT no_op GROUP BY 1, 2")
def expected_map(spark, sf):
    return commit.kv_fold(A.log(spark, sf)).select(F.pmod("key", F.lit(20)).alias("client"), "key", "value")


@query("SELECT user_id, event_type, CAST(date_diff('day', DATE '2024-01-01', ts) AS BIGINT) AS day, count(*) AS n FROM events GROUP BY 1, 2, 3 HAVING count(*) > 1")
def duplicate_commands(spark, sf):
    return A.read(spark, sf, "events").groupBy("user_id", "event_type", (A.term_of(F.col("ts")) - 1).alias("day")).agg(F.count("*").alias("n")).where("n > 1")


@query(W + f"SELECT a.idx, a.term, a.value AS expected, b.value AS actual FROM L a JOIN X b ON a.idx = b.idx WHERE {DIFF} ORDER BY a.idx LIMIT 1")
def first_violation(spark, sf):
    both = A.log(spark, sf).alias("a").join(A.mutated(spark, sf).alias("b"), F.col("a.idx") == F.col("b.idx")).where(repair.differs())
    return both.select("a.idx", "a.term", F.col("a.value").alias("expected"), F.col("b.value").alias("actual")).orderBy("idx").limit(1)


@query()
def timeout_draws(spark, sf):
    nodes = A.read(spark, sf, "events").select("user_id", "event_id")
    return nodes.select("event_id", R.timeout_micros(F.col("user_id"), F.col("event_id")).alias("timeout_micros"))


@query("""SELECT role, role_name FROM (SELECT CAST(unnest([0, 1, 2, 3]) AS BIGINT) AS role, unnest(['follower', 'candidate', 'leader', 'unknown']) AS role_name)""")
def role_names(spark, sf):
    return spark.range(4).toDF("role").select("role", R.role_name(F.col("role")).alias("role_name"))


@query("SELECT CAST(unnest(range(1, 8)) AS BIGINT) AS n_nodes, unnest([1, 2, 2, 3, 3, 4, 4])::BIGINT AS quorum")
def quorum_sizes(spark, sf):
    return spark.range(1, 8).toDF("n_nodes").select("n_nodes", R.quorum(F.col("n_nodes")).alias("quorum"))


# The leader's log and the six divergent followers, as lists of terms.
LEADER_TERMS = [1, 1, 1, 4, 4, 5, 5, 6, 6, 6]
FOLLOWER_TERMS = {
    "a": [1, 1, 1, 4, 4, 5, 5, 6, 6],
    "b": [1, 1, 1, 4],
    "c": [1, 1, 1, 4, 4, 5, 5, 6, 6, 6, 6],
    "d": [1, 1, 1, 4, 4, 5, 5, 6, 6, 6, 7, 7],
    "e": [1, 1, 1, 4, 4, 4, 4],
    "f": [1, 1, 1, 2, 2, 2, 3, 3, 3, 3, 3],
}


@query("SELECT * FROM (VALUES ('a', 2, 2), ('b', 7, 2), ('c', 1, 1), ('d', 1, 1), ('e', 6, 3), ('f', 8, 3)) AS t(follower, naive, hinted)")
def repair_cost(spark, sf):
    """Each pair of logs is simulated in one task; any number of pairs runs side by side."""
    pairs = spark.createDataFrame([(k, LEADER_TERMS, v) for k, v in FOLLOWER_TERMS.items()], "follower string, leader_log array<int>, follower_log array<int>")

    def run(batches):
        for pdf in batches:
            logs = [(list(a), list(b)) for a, b in zip(pdf["leader_log"], pdf["follower_log"], strict=True)]
            yield pdf[["follower"]].assign(naive=[repair.repair_rounds(a, b, False) for a, b in logs], hinted=[repair.repair_rounds(a, b, True) for a, b in logs])

    return pairs.mapInPandas(run, "follower string, naive int, hinted int")
