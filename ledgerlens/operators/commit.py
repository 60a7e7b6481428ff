"""What a majority decides: commit index, progress, elections, leases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import LEASE_MICROS, commit_clamp, quorum


def log_tail(log: DataFrame) -> DataFrame:
    """One row: last_idx and last_term, 0 for an empty log."""
    last = F.max(F.struct("idx", "term"))
    return log.agg(F.coalesce(last["idx"], F.lit(0)).alias("last_idx"), F.coalesce(last["term"], F.lit(0)).alias("last_term"))


def quorum_index(match: DataFrame, last_idx: DataFrame, n_nodes: int) -> DataFrame:
    """One row: the highest index that a quorum holds, the leader (at last_idx) included.

    An order statistic of the few match rows, instead of a count for every entry.
    """
    held = match.select("match_index").unionByName(last_idx.toDF("match_index"))
    ranked = held.agg(F.sort_array(F.collect_list("match_index"), asc=False).alias("held"))
    need = n_nodes // 2 + 1
    return ranked.select(F.when(F.size("held") >= need, F.try_element_at("held", F.lit(need))).otherwise(0).cast("long").alias("quorum_index"))


def commit_index(log: DataFrame, match: DataFrame, leader_term: Column, n_nodes: int, old: int = 0) -> DataFrame:
    """One row: the highest entry of the leader's own term that a quorum holds, or the old value."""
    last = log.agg(F.coalesce(F.max("idx"), F.lit(0)).cast("long"))
    held = quorum_index(match, last, n_nodes)
    found = log.where((F.col("term") == leader_term) & (F.col("idx") <= held.scalar())).agg(F.max("idx").alias("idx"))
    return found.select(F.greatest(F.lit(old).cast("long"), F.coalesce("idx", F.lit(0).cast("long"))).alias("commit_index"))


def kv_fold(log: DataFrame) -> DataFrame:
    """Last write per key in log order; barriers change nothing. Combines map-side on (idx, value)."""
    last = F.max(F.struct("idx", "value"))
    return log.where(~F.col("no_op")).groupBy("key").agg(last.alias("last")).select("key", "last.value", "last.idx")


def apply_messages(log: DataFrame) -> DataFrame:
    return log.select("idx", "term", (~F.col("no_op")).alias("command_valid"), "key", "value")


def next_indexes_of(log: DataFrame, match: DataFrame) -> DataFrame:
    """(peer, next_index, last): where each peer's next message starts, kept within the log, and the log's last index."""
    last = log.agg(F.coalesce(F.max("idx"), F.lit(0)).cast("long")).scalar()
    return match.select("peer", F.greatest(F.lit(1).cast("long"), F.least(F.col("match_index") + 1, last + 1)).alias("next_index"), last.alias("last"))


def peer_messages(log: DataFrame, match: DataFrame) -> DataFrame:
    """Per peer: what a message from its next index on would hold. A log has every index up to its last, so counts need no scan of it."""
    peers = next_indexes_of(log, match).withColumn("prev", F.col("next_index") - 1)
    found = peers.join(log.select(F.col("idx").alias("prev"), F.col("term").alias("prev_term")), "prev", "left")
    sent = F.col("last") >= F.col("next_index")
    return found.select(
        "peer", "next_index", F.coalesce("prev_term", F.lit(0).cast("long")).alias("prev_term"), (F.col("last") - F.col("next_index") + 1).alias("n_entries"), F.when(sent, F.col("last")).otherwise(0).cast("long").alias("last_sent")
    )


def peer_entries(log: DataFrame, match: DataFrame, most: int) -> DataFrame:
    """Per peer: its next index, and the entries of its next message, in order: at most `most`, the bound of a message. The rest follows in later ones."""
    peers = next_indexes_of(log, match)
    wanted = F.when(F.col("last") >= F.col("next_index"), F.sequence("next_index", F.least(F.col("last"), F.col("next_index") + most - 1)))
    asked = peers.select("peer", "next_index", F.explode_outer(wanted).alias("idx"))
    found = asked.join(log, "idx", "left").groupBy("peer", "next_index")
    return found.agg(F.array_sort(F.collect_list(F.when(F.col("term").isNotNull(), F.struct("idx", "term", "key", "value", "no_op")))).alias("entries"))


def clamp_audit(moves: DataFrame) -> DataFrame:
    """(old, wanted, last, ...) -> with the commit index after the move, and why a move is refused."""
    refusal = F.when(F.col("wanted") < F.col("old"), "backwards").when(F.col("wanted") > F.col("last"), "beyond the log")
    return moves.withColumns({"commit_index": commit_clamp(F.col("old"), F.col("wanted"), F.col("last")), "refusal": refusal})


def step_down(messages: DataFrame) -> DataFrame:
    """(node, role, current_term, msg_term) -> term and role of each node after its messages: a newer term makes a follower of it."""
    newest = messages.groupBy("node").agg(F.max("current_term").alias("current_term"), F.max_by("role", "current_term").alias("role"), F.max("msg_term").alias("msg_term"))
    stale = F.col("msg_term") > F.col("current_term")
    return newest.select("node", F.greatest("current_term", "msg_term").alias("term"), F.when(stale, F.lit(0)).otherwise(F.col("role")).cast("long").alias("role"), stale.alias("stepped_down"))


def init_progress(log: DataFrame, peers: DataFrame) -> DataFrame:
    last = log.agg(F.coalesce(F.max("idx"), F.lit(0)).cast("long"))
    return peers.select("peer", (last.scalar() + 1).alias("next_index"), F.lit(0).cast("long").alias("match_index"))


def advance_progress(replies: DataFrame) -> DataFrame:
    """(peer, prev_log_index, n_sent, success) -> match and next of each peer; late or repeated replies can't lower them."""
    matched = F.coalesce(F.max(F.when(F.col("success"), F.col("prev_log_index") + F.col("n_sent"))), F.lit(0))
    return replies.groupBy("peer").agg(matched.alias("match_index")).withColumn("next_index", F.col("match_index") + 1)


def election_tally(replies: DataFrame, n_nodes: int) -> DataFrame:
    """(term, candidate, granted, reply_term) -> votes with the candidate's own, and the outcome."""
    return (
        replies.groupBy("term", "candidate")
        .agg((F.count_if("granted") + 1).alias("votes"), F.bool_or(F.col("reply_term") > F.col("term")).alias("voided"))
        .withColumn("won", (F.col("votes") >= quorum(F.lit(n_nodes))) & ~F.col("voided"))
    )


def lease(contacts: DataFrame, n_nodes: int, now_micros: int, leader: bool = True, committed_in_term: bool = True) -> DataFrame:
    """One leader's lease: one row of contact, lease_until, allowed, reason. contacts: (peer, sent_at) in microseconds."""
    node = contacts.sparkSession.range(1).select(
        F.col("id").alias("node"), F.lit(n_nodes).alias("n_nodes"), F.lit(leader).alias("leader"), F.lit(1).alias("term"), F.lit(1).alias("commit_index"), F.lit(int(committed_in_term)).alias("commit_term"), F.lit(now_micros).cast("long").alias("now")
    )
    return leases(node, contacts.select(F.lit(0).cast("long").alias("node"), "peer", "sent_at")).select("contact", "lease_until", "allowed", "reason")


def leases(nodes: DataFrame, contacts: DataFrame) -> DataFrame:
    """Per node: the contact that completes a quorum, when its lease ends, and whether a read may use it.

    nodes: (node, n_nodes, leader, term, commit_index, commit_term, now); contacts: (node, peer, sent_at), in microseconds. The
    contact is the k-th most recent of the peers' last ones, a list as long as the cluster. A sole node is its own quorum:
    its lease always runs from now.
    """
    last = contacts.groupBy("node", "peer").agg(F.max("sent_at").alias("sent_at")).groupBy("node").agg(F.sort_array(F.collect_list("sent_at"), asc=False).alias("heard"))
    need = quorum(F.col("n_nodes")) - 1
    kth = F.when(need <= 0, F.col("now")).when(F.size("heard") >= need, F.try_element_at("heard", F.greatest(need, F.lit(1)).cast("int")))
    found = nodes.join(last, "node", "left").withColumn("contact", kth).withColumn("lease_until", F.col("contact") + LEASE_MICROS)
    reason = (
        F.when(~F.col("leader"), "not leader").when((F.col("commit_index") == 0) | (F.col("commit_term") != F.col("term")), "nothing committed in term")
        .when(F.col("lease_until").isNull(), "no quorum").when(F.col("now") >= F.col("lease_until"), "expired").otherwise("ok")
    )
    return found.select("node", "contact", "lease_until", (reason == "ok").alias("allowed"), reason.alias("reason"))


def read_outcomes(reads: DataFrame, applied: DataFrame) -> DataFrame:
    """How each read ends: by lease where it is allowed, else through a barrier.

    reads: (read_id, leader, lease, idx, term, deadline); applied: (idx, term, applied_at). A barrier read is refused by a node that
    doesn't lead, too slow if its index isn't applied by the deadline, and deposed if another term's entry is there.
    """
    done = applied.select(F.col("idx").alias("at"), F.col("term").alias("got"), "applied_at")
    outcome = (
        F.when(~F.col("leader"), "not leader").when(F.col("lease"), "served by lease").when(F.col("applied_at").isNull() | (F.col("applied_at") > F.col("deadline")), "too slow")
        .when(F.col("got") != F.col("term"), "deposed").otherwise("served by barrier")
    )
    return reads.join(done, F.col("idx") == F.col("at"), "left").select("read_id", outcome.alias("outcome"))


def union_maps(*maps: DataFrame) -> DataFrame:
    """The union of clients' maps (key, value), whose keys are disjoint; a key of two clients raises when it is read."""
    every = maps[0].select("key", "value")
    for more in maps[1:]:
        every = every.unionByName(more.select("key", "value"))
    found = every.groupBy("key").agg(F.count("*").alias("n"), F.min("value").alias("value"))
    return found.where(F.when(F.col("n") == 1, True).otherwise(F.raise_error(F.concat(F.lit("two clients wrote key "), F.col("key").cast("string"))).cast("boolean"))).select("key", "value")
