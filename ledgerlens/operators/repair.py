"""Where two logs part, what a follower hints, and how logs merge.

Neighbouring entries are found by equi joins on the index, and an order is only
needed among run boundaries, so a log of any length is spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions import next_index_after_conflict
from ledgerlens.operators.stats import range_buckets


def term_runs(log: DataFrame) -> DataFrame:
    """run_start, run_end, term of each run of equal terms. Works for unsorted terms too."""
    before = log.select((F.col("idx") + 1).alias("idx"), F.col("term").alias("before"))
    starts = log.join(before, "idx", "left").where(F.col("before").isNull() | (F.col("before") != F.col("term"))).select("idx", "term")
    last = log.agg(F.max("idx").alias("n"))
    # Neighbours are found within ranges of run starts; a range's last start is followed by the next range's first.
    ranged = range_buckets(starts, "idx")
    firsts = ranged.groupBy("bucket").agg(F.min("idx").alias("idx")).agg(F.collect_list("idx")).scalar()
    inside = F.lead("idx").over(Window.partitionBy("bucket").orderBy("idx"))
    following = F.coalesce("inside", F.array_min(F.filter("firsts", lambda x: x > F.col("idx"))))
    found = ranged.withColumn("inside", inside).withColumn("firsts", firsts).select(F.col("idx").alias("run_start"), "term", following.alias("following"))
    return found.select("run_start", F.coalesce(F.col("following") - 1, last.scalar()).alias("run_end"), "term")


def last_of_term(log: DataFrame, terms: DataFrame) -> DataFrame:
    """Last index of each asked term, 0 where the log has none."""
    return terms.join(log.groupBy("term").agg(F.max("idx").alias("idx")), "term", "left").select("term", F.coalesce("idx", F.lit(0).cast("long")).alias("last_idx"))


def conflict_hints(follower: DataFrame, probes: DataFrame) -> DataFrame:
    """probes (prev) -> (prev, conflict_index, conflict_term): one past the end with term 0, or the run's start.

    Terms never decrease along a log, so a term is one run.
    """
    last = follower.agg(F.coalesce(F.max("idx"), F.lit(0)).cast("long"))
    starts = follower.groupBy("term").agg(F.min("idx").alias("run_start"))
    held = probes.join(follower.select(F.col("idx").alias("prev"), "term"), "prev", "left").join(starts, "term", "left")
    return held.select("prev", F.coalesce("run_start", last.scalar() + 1).alias("conflict_index"), F.coalesce("term", F.lit(0).cast("long")).alias("conflict_term"))


def next_indexes(leader: DataFrame, hints: DataFrame) -> DataFrame:
    """Where the leader tries next after each hint: one row a probe."""
    own = leader.groupBy(F.col("term").alias("conflict_term")).agg(F.max("idx").alias("last_idx"))
    current = F.col("prev") + 1
    return hints.join(own, "conflict_term", "left").select("prev", next_index_after_conflict(current, F.col("conflict_index"), F.coalesce("last_idx", F.lit(0))).alias("next_index"))


def matches_at(follower: DataFrame, probes: DataFrame) -> DataFrame:
    """probes (prev_index, prev_term) with ok: the follower holds that term there; (0, 0) always holds."""
    held = follower.select(F.col("idx").alias("prev_index"), F.col("term").alias("held"))
    ok = F.coalesce(F.col("held") == F.col("prev_term"), (F.col("prev_index") == 0) & (F.col("prev_term") == 0))
    return probes.join(held, "prev_index", "left").select("prev_index", "prev_term", ok.alias("ok"))


def differs(a: str = "a", b: str = "b") -> Column:
    """Entries at one index differ in term, command or kind."""
    return ~(F.col(f"{a}.term").eqNullSafe(F.col(f"{b}.term")) & F.col(f"{a}.key").eqNullSafe(F.col(f"{b}.key")) & F.col(f"{a}.value").eqNullSafe(F.col(f"{b}.value")) & F.col(f"{a}.no_op").eqNullSafe(F.col(f"{b}.no_op")))


def first_conflict(follower: DataFrame, message: DataFrame) -> DataFrame:
    """One row: the first index at which both have an entry, of different terms; null if there is none."""
    both = message.alias("m").join(follower.alias("f"), F.col("m.idx") == F.col("f.idx"))
    return both.agg(F.min(F.when(F.col("m.term") != F.col("f.term"), F.col("m.idx"))).alias("conflict"))


def merge(follower: DataFrame, message: DataFrame) -> DataFrame:
    """The follower's log after the message: its tail goes only from the first conflict on; a tail beyond the message survives.

    Equal index and term are the same entry, so a repeated message changes nothing.
    """
    conflict = first_conflict(follower, message)
    kept = follower.where(F.coalesce(F.col("idx") < conflict.scalar(), F.lit(True)))
    return kept.unionByName(message.join(kept.select("idx"), "idx", "left_anti"))


def divergence(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: first position at which two sequences differ, and at how many they do."""
    both = a.alias("a").join(b.alias("b"), F.col("a.idx") == F.col("b.idx"), "full")
    idx = F.coalesce("a.idx", "b.idx")
    return both.where(differs()).agg(F.min(idx).alias("first_diff"), F.count("*").alias("n_diff"))


def repair_rounds(leader: list[int], follower: list[int], hinted: bool) -> int:
    """Round trips until a follower's log (terms) agrees with the leader's: one entry back at a time, or by hints."""
    following, trips = len(leader) + 1, 0
    while True:
        trips += 1
        prev = following - 1
        if prev == 0 or (prev <= len(follower) and follower[prev - 1] == leader[prev - 1]):
            return trips
        if not hinted:
            following -= 1
            continue
        if prev > len(follower):
            wanted = len(follower) + 1
        else:
            term = follower[prev - 1]
            own = [i + 1 for i, t in enumerate(leader) if t == term]
            wanted = own[-1] + 1 if own else follower.index(term) + 1
        following = max(1, min(following - 1, wanted))
