"""Safety audits over whole runs: each gives the rows that break a rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.operators.repair import differs
from ledgerlens.operators.stats import range_buckets


def log_matching(a: DataFrame, b: DataFrame) -> DataFrame:
    """idx, term of entries that share index and term though something up to there differs.

    The prefixes up to idx differ exactly if the first difference is at or before it, so one
    join and one minimum decide, without prefix digests.
    """
    both = a.alias("a").join(b.alias("b"), F.col("a.idx") == F.col("b.idx"))
    first = both.where(differs()).agg(F.min(F.col("a.idx")))
    return both.where((F.col("a.term") == F.col("b.term")) & (F.col("a.idx") >= first.scalar())).select(F.col("a.idx").alias("idx"), F.col("a.term").alias("term"))


def log_matching_copies(a: DataFrame, copies: DataFrame) -> DataFrame:
    """The same for several copies in one join: copies has a column `copy`. The first difference of each copy is found in the joined rows."""
    both = a.alias("a").join(copies.alias("b"), F.col("a.idx") == F.col("b.idx")).select("copy", F.col("a.idx").alias("idx"), F.col("a.term").alias("term"), (F.col("a.term") == F.col("b.term")).alias("same"), differs().alias("off"))
    # An entry counts if it comes at or after its copy's first difference.
    first = both.groupBy("copy").agg(F.min(F.when(F.col("off"), F.col("idx"))).alias("first"))  # a row a copy
    return both.where("same").join(F.broadcast(first), "copy").where("idx >= first").select("copy", "idx", "term")


def commit_ledger(*committed: DataFrame) -> DataFrame:
    """Indexes at which committed entries disagree, and in how many versions."""
    every = committed[0]
    for more in committed[1:]:
        every = every.unionByName(more)
    versions = every.select("idx", "term", "key", "value", "no_op").distinct()
    return versions.groupBy("idx").agg(F.count("*").alias("n_versions")).where("n_versions > 1")


def gaps(sequences: DataFrame, by: str, position: str) -> DataFrame:
    """Per sequence: first position that isn't the previous plus one (from 0), and how many aren't."""
    w = Window.partitionBy(by).orderBy(position)
    fault = F.col(position) != F.coalesce(F.lag(position).over(w) + 1, F.lit(0))
    return sequences.select(by, position, fault.alias("fault")).where("fault").groupBy(by).agg(F.min(position).alias("first_fault"), F.count("*").alias("n_faults"))


def decreases(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Per key: how often a value is below the one before."""
    w = Window.partitionBy(by).orderBy(order)
    return rows.select(by, (F.lag(value).over(w) > F.col(value)).alias("down")).groupBy(by).agg(F.count_if("down").alias("n_decreases"))


def reorders(trace: DataFrame) -> DataFrame:
    """Per pair: arrivals whose send number is below the highest that has arrived."""
    w = Window.partitionBy("src", "dst").orderBy("arrive_ord").rowsBetween(Window.unboundedPreceding, -1)
    late = F.col("send_seq") < F.max("send_seq").over(w)
    return trace.select("src", "dst", late.alias("late")).groupBy("src", "dst").agg(F.count("*").alias("n_rpcs"), F.count_if("late").alias("n_late"))


def leaders_by_term(leaders: DataFrame) -> DataFrame:
    """Per term: distinct leaders, the least and the highest; more than one breaks the rule."""
    one = leaders.select("term", "node").distinct()
    return one.groupBy("term").agg(F.count("*").alias("n_leaders"), F.min("node").alias("least"), F.max("node").alias("highest")).withColumn("violation", F.col("n_leaders") > 1)


def ticket_status(tickets: DataFrame, applied: DataFrame) -> DataFrame:
    """Tickets (idx, term) as landed, overwritten or pending against applied (idx, term)."""
    found = tickets.alias("t").join(applied.alias("a"), F.col("t.idx") == F.col("a.idx"), "left")
    status = F.when(F.col("a.term").isNull(), "pending").when(F.col("a.term") == F.col("t.term"), "landed").otherwise("overwritten")
    return found.select("t.*", status.alias("status"))


def duplicate_claims(tickets: DataFrame) -> DataFrame:
    return tickets.groupBy("term", "idx").agg(F.count("*").alias("n")).where("n > 1")


def bad_transitions(states: DataFrame, by: str, order: str, role: str, allowed: list[tuple[str, str]]) -> DataFrame:
    """Role changes that the list doesn't allow, counted per pair. Staying is always allowed."""
    w = Window.partitionBy(by).orderBy(order)
    moves = states.select(F.lag(role).over(w).alias("before"), F.col(role).alias("after")).where("before IS NOT NULL AND before <> after")
    fine = F.lit(False)
    for a, b in allowed:
        fine = fine | ((F.col("before") == a) & (F.col("after") == b))
    return moves.where(~fine).groupBy("before", "after").agg(F.count("*").alias("n"))


def peak(intervals: DataFrame) -> DataFrame:
    """One row: the most intervals [start, stop) open at once.

    Starts and stops are summed by instant; a running sum goes within ranges of instants, and on top of the ranges' totals before it.
    """
    steps = intervals.select(F.col("start").alias("at"), F.lit(1).alias("d")).unionByName(intervals.select(F.col("stop").alias("at"), F.lit(-1).alias("d")))
    order = F.unix_micros(F.col("at").cast("timestamp"))
    net = range_buckets(steps.groupBy(order.alias("at")).agg(F.sum("d").alias("d")), "at")
    totals = net.groupBy("bucket").agg(F.sum("d").alias("d")).agg(F.collect_list(F.struct("bucket", "d")).alias("totals")).scalar()  # a row a range
    running = F.sum("d").over(Window.partitionBy("bucket").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    best = net.select("bucket", running.alias("open")).groupBy("bucket").agg(F.max("open").alias("open"))
    before = F.aggregate(F.filter("totals", lambda t: t["bucket"] < F.col("bucket")), F.lit(0).cast("long"), lambda n, t: n + t["d"])
    return best.withColumn("totals", totals).select((F.col("open") + before).alias("open")).agg(F.max("open").cast("long").alias("peak"))


def deliverable(messages: DataFrame, groups: DataFrame, drop: Column, drop_reply: Column) -> DataFrame:
    """messages (send_seq, src, dst) with request_ok and reply_ok: both ends share a group, and each way has a draw of its own."""
    member = groups.select("node", "group").distinct()
    together = member.alias("a").join(member.alias("b"), F.col("a.group") == F.col("b.group")).select(F.col("a.node").alias("src"), F.col("b.node").alias("dst"), F.lit(True).alias("joined")).distinct()
    request = F.coalesce("joined", F.lit(False)) & ~F.col("drop")
    rolled = messages.withColumns({"drop": drop, "drop_reply": drop_reply}).join(together, ["src", "dst"], "left")
    return rolled.select("send_seq", "src", "dst", request.alias("request_ok"), (request & ~F.col("drop_reply")).alias("reply_ok"))


def network_totals(routed: DataFrame) -> DataFrame:
    """One row: calls, requests and replies lost."""
    return routed.agg(F.count("*").alias("n_rpcs"), F.count_if(~F.col("request_ok")).alias("n_requests_lost"), F.count_if(F.col("request_ok") & ~F.col("reply_ok")).alias("n_replies_lost"))


def arrivals(sent: DataFrame, delay: Column) -> DataFrame:
    """sent (src, dst, send_seq, sent_at) in the order in which delayed messages arrive: a reorder is seen, not configured."""
    order = Window.partitionBy("src", "dst").orderBy("arrives", "send_seq")
    return sent.withColumn("arrives", F.col("sent_at") + delay).withColumn("arrive_ord", F.row_number().over(order)).select("src", "dst", "send_seq", "arrive_ord")


def election_totals(terms: DataFrame, by: str) -> DataFrame:
    """(by, trial, term, retries) -> per group: highest term, retries, and terms beyond a trial's first, on average and at worst."""
    trial = terms.groupBy(by, "trial").agg(F.max("term").alias("top"), F.sum("retries").alias("retries"), (F.count_distinct("term") - 1).alias("extra"))
    return trial.groupBy(by).agg(F.max("top").alias("max_term"), F.sum("retries").alias("retries"), F.round(F.avg("extra"), 6).alias("mean_extra"), F.max("extra").alias("worst_extra"))


def missed_deadlines(rows: DataFrame, by: str, order: str, at: str, resets: Column, micros: int) -> DataFrame:
    """Per key: how often a timer that only some rows reset runs out, and its longest run. Other rows don't touch it."""
    run = F.col(at) - F.lag(at).over(Window.partitionBy(by).orderBy(order))
    return rows.where(resets).select(by, run.alias("run")).groupBy(by).agg(F.count_if(F.col("run") > micros).alias("n_timeouts"), F.coalesce(F.max("run"), F.lit(0)).alias("longest"))


def reachable_pairs(members: DataFrame) -> DataFrame:
    """(node, group) -> how many other nodes each node shares a group with."""
    sizes = members.groupBy("group").agg(F.count("*").alias("n"))
    return members.join(sizes, "group").groupBy("node").agg((F.sum("n") - F.count("*")).cast("long").alias("n_reachable"))
