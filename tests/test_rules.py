"""Truth tables, golden logs, randomised merges, and mutations that audits must find."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerlens import functions as R
from ledgerlens.operators import audit, commit, repair, stats
from ledgerlens.plans.queries import FOLLOWER_TERMS, LEADER_TERMS
from ledgerlens.sources import schemas

LOG = "idx long, term long, key long, value string, no_op boolean"


def log_of(spark, terms, start=1):
    return spark.createDataFrame([(i, t, 1, f"{t}.{i}", False) for i, t in enumerate(terms, start)], LOG)


def test_quorum(spark):
    rows = spark.range(1, 8).select("id", R.quorum(F.col("id")).alias("q")).collect()
    assert [r.q for r in rows] == [1, 2, 2, 3, 3, 4, 4]


@pytest.mark.parametrize("mine, cand, want", [((1, 1), (2, 1), True), ((2, 1), (1, 9), False), ((2, 3), (2, 3), True), ((2, 4), (2, 3), False), ((2, 3), (2, 4), True), ((0, 0), (0, 0), True)])
def test_up_to_date(spark, mine, cand, want):
    assert spark.range(1).select(R.up_to_date(*map(F.lit, (*cand, *mine))).alias("x")).first().x is want


def test_next_index_sweep(spark):
    """At least 1, below the current index (but 1 at 1), for every hint in a box."""
    rows = spark.range(1, 8).toDF("current").join(spark.range(0, 9).toDF("hint")).join(spark.range(0, 9).toDF("last"))
    got = rows.select("current", R.next_index_after_conflict(F.col("current"), F.col("hint"), F.col("last")).alias("n")).collect()
    assert all(r.n == 1 if r.current == 1 else 1 <= r.n <= r.current - 1 for r in got)


def test_commit_needs_own_term(spark):
    log = log_of(spark, [1, 2, 2, 3])
    match = spark.createDataFrame([(1, 3), (2, 3), (3, 0), (4, 0)], "peer long, match_index long")
    index = lambda term: commit.commit_index(log, match, F.lit(term), 5).first().commit_index
    assert index(2) == 3 and index(3) == 0 and index(1) == 1
    # Without the gate, entry 3 of an older term would count: the wrong rule differs.
    assert commit.quorum_index(match, log.agg(F.max("idx")), 5).first().quorum_index == 3


def test_repair_costs():
    costs = {k: (repair.repair_rounds(LEADER_TERMS, v, False), repair.repair_rounds(LEADER_TERMS, v, True)) for k, v in FOLLOWER_TERMS.items()}
    assert costs == {"a": (2, 2), "b": (7, 2), "c": (1, 1), "d": (1, 1), "e": (6, 3), "f": (8, 3)}


def model_merge(follower, start, message):
    out = list(follower)
    for i, entry in enumerate(message):
        at = start - 1 + i
        if at >= len(out):
            out.append(entry)
        elif out[at] != entry:
            out = [*out[:at], entry]
    return out


def test_merge_random(spark):
    rng = random.Random(3)
    for _ in range(6):
        shared = sorted(rng.choices([1, 2, 3], k=rng.randint(1, 8)))
        follower, leader = shared + sorted(rng.choices([3, 4], k=rng.randint(0, 4))), shared + sorted(rng.choices([5, 6], k=rng.randint(0, 4)))
        start = rng.randint(1, len(shared))
        message = leader[start - 1 : rng.randint(start, len(leader))]
        got = repair.merge(log_of(spark, follower), log_of(spark, message, start)).orderBy("idx").collect()
        assert [r.term for r in got] == model_merge(follower, start, message)


def test_stale_message_keeps_tail(spark):
    got = repair.merge(log_of(spark, [1, 1, 2, 2]), log_of(spark, [1], 1))
    assert got.count() == 4


def test_audits_find_mutations(spark):
    log = log_of(spark, [1, 1, 2, 2, 3])
    broken = log.withColumn("value", F.when(F.col("idx") == 2, "x").otherwise(F.col("value")))
    assert audit.log_matching(log, log).count() == 0
    assert [r.idx for r in audit.log_matching(log, broken).orderBy("idx").collect()] == [2, 3, 4, 5]
    assert audit.commit_ledger(log, log).count() == 0 and audit.commit_ledger(log, broken).first().idx == 2
    assert repair.divergence(log, broken).first().first_diff == 2


def test_unsorted_runs(spark):
    rows = repair.term_runs(log_of(spark, [1, 2, 2, 1, 1])).orderBy("run_start").collect()
    assert [(r.run_start, r.run_end, r.term) for r in rows] == [(1, 1, 1), (2, 3, 2), (4, 5, 1)]


def test_nearest_rank_ties(spark):
    rows = spark.createDataFrame([("a", float(v)) for v in [5, 5, 5, 1, 9, 9]] + [("b", 2.0), ("b", None)], "g string, v double")
    got = {(r.g, r.percent): r.value for r in stats.nearest_rank(rows, "g", "v", [1, 50, 100], 2.0).collect()}
    assert got == {("a", 1): 1, ("a", 50): 5, ("a", 100): 9, ("b", 1): 2, ("b", 50): 2, ("b", 100): 2}


def test_empty_log(spark):
    empty = spark.createDataFrame([], LOG)
    assert tuple(commit.log_tail(empty).first()) == (0, 0)
    assert commit.kv_fold(empty).count() == 0 and repair.merge(empty, log_of(spark, [1, 2])).count() == 2


def test_schemas_pinned():
    assert schemas.LOG.simpleString() == "struct<idx:bigint,term:bigint,key:bigint,value:string,no_op:boolean>"
    assert schemas.ENTRY.simpleString() == "struct<term:bigint,command:binary,no_op:boolean>"


def test_sole_node_has_a_lease(spark):
    """No peers are needed, none were heard from: the lease runs from now."""
    nobody = spark.createDataFrame([], "peer long, sent_at long")
    assert tuple(commit.lease(nobody, 1, 1000).first()) == (1000, 1000 + 122727, True, "ok")
    assert commit.lease(nobody, 3, 1000).first().reason == "no quorum"
    assert commit.lease(nobody, 1, 1000, leader=False).first().reason == "not leader"
    assert commit.lease(nobody, 1, 1000, committed_in_term=False).first().reason == "nothing committed in term"


def test_read_outcomes(spark):
    reads = spark.createDataFrame([(1, False, True, 5, 2, 10), (2, True, True, 9, 2, 10), (3, True, False, 5, 2, 10), (4, True, False, 6, 2, 10), (5, True, False, 7, 2, 10), (6, True, False, 8, 2, 10)], "read_id int, leader boolean, lease boolean, idx int, term int, deadline int")
    applied = spark.createDataFrame([(5, 2, 10), (6, 3, 4), (7, 2, 11)], "idx int, term int, applied_at int")
    got = {r.read_id: r.outcome for r in commit.read_outcomes(reads, applied).collect()}
    assert got == {1: "not leader", 2: "served by lease", 3: "served by barrier", 4: "deposed", 5: "too slow", 6: "too slow"}


def test_commit_rule_without_term_gate_is_caught(spark):
    """A leader that counts replicas of an older term's entry commits what another leader overwrites; with the gate it commits nothing."""
    schema = "idx long, term long, key long, value string, no_op boolean"
    old = spark.createDataFrame([(1, 1, 1, "a", False), (2, 2, 1, "b", False)], schema)
    later = spark.createDataFrame([(1, 1, 1, "a", False), (2, 3, 1, "c", False)], schema)
    match = spark.createDataFrame([(1, 2), (2, 2), (3, 1), (4, 1)], "peer long, match_index long")
    gated = commit.commit_index(old, match, F.lit(4), 5).first()[0]
    ungated = commit.quorum_index(match, old.agg(F.max("idx")), 5).first()[0]
    everything = commit.commit_index(later, match, F.lit(3), 5).first()[0]
    assert (gated, ungated, everything) == (0, 2, 2)
    ledger = lambda upto: [r.idx for r in audit.commit_ledger(old.where(F.col("idx") <= upto), later.where(F.col("idx") <= everything)).collect()]
    assert ledger(ungated) == [2] and ledger(gated) == []


def test_union_of_clients_refuses_shared_keys(spark):
    one = spark.createDataFrame([(1, "a")], "key long, value string")
    assert commit.union_maps(one, spark.createDataFrame([(2, "b")], "key long, value string")).count() == 2
    with pytest.raises(Exception, match="two clients wrote key 1"):
        commit.union_maps(one, one).collect()


def test_peak_and_runs_against_plain_loops(spark):
    rng = random.Random(5)
    spans = [(s, s + rng.randrange(1, 40)) for s in (rng.randrange(3000) for _ in range(900))]
    intervals = spark.createDataFrame(spans, "start long, stop long").select(F.timestamp_seconds("start").alias("start"), F.timestamp_seconds("stop").alias("stop"))
    assert audit.peak(intervals).first().peak == max(sum(a <= t < b for a, b in spans) for t in range(3100))
    terms = [rng.randrange(3) for _ in range(2000)]
    log = spark.createDataFrame([(i + 1, t, 0, "", False) for i, t in enumerate(terms)], "idx long, term long, key long, value string, no_op boolean")
    want, start = [], 1
    for i in range(1, 2001):
        if i == 2000 or terms[i] != terms[i - 1]:
            want.append((start, i, terms[i - 1]))
            start = i + 1
    assert sorted(map(tuple, repair.term_runs(log).select("run_start", "run_end", "term").collect())) == want


def test_peer_entries_are_bounded(spark):
    log = spark.createDataFrame([(i, 1, i, "v", False) for i in range(1, 101)], "idx long, term long, key long, value string, no_op boolean")
    match = spark.createDataFrame([(1, 100), (2, 95), (3, 10), (4, 0), (5, 500)], "peer long, match_index long")
    got = {r.peer: (r.next_index, [e.idx for e in r.entries]) for r in commit.peer_entries(log, match, 20).collect()}
    assert got == {1: (101, []), 2: (96, [96, 97, 98, 99, 100]), 3: (11, list(range(11, 31))), 4: (1, list(range(1, 21))), 5: (101, [])}
