"""Model tables from the star schema.

``log``: one entry an event, terms from the day, a barrier for every error event. ``match``: four peers
that lag by multiples of n div 200. ``follower``: the log's first half, then n div 10 rows of
the term at the cut. Scalars (n, the cut, its term) are scalar subqueries, so no join or collect.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

N_NODES = 5
FIRST_DAY = "2024-01-01"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def term_of(ts: Column) -> Column:
    return (F.datediff(ts, F.lit(FIRST_DAY).cast("date")) + 1).cast("long")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(
        (F.col("event_id") + 1).alias("idx"), term_of(F.col("ts")).alias("term"), F.col("user_id").alias("key"), F.col("event_type").alias("value"), (F.col("event_type") == "error").alias("no_op")
    )


def n_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: n."""
    return log(spark, sf_dir).agg(F.coalesce(F.max("idx"), F.lit(0)).cast("long").alias("n"))


def match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return n_entries(spark, sf_dir).select(F.explode(F.sequence(F.lit(1).cast("long"), F.lit(N_NODES - 1).cast("long"))).alias("peer"), "n").select(
        "peer", F.expr("n - peer * (n div 200)").alias("match_index")
    )


def shape(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    """n, and the term at n div 2: two small jobs (one column; one row), so that later filters have constants."""
    events = read(spark, sf_dir, "events")
    n = events.agg(F.max("event_id")).first()[0]
    n = 0 if n is None else n + 1
    at_cut = events.where(F.col("event_id") == n // 2 - 1).agg(F.max(term_of(F.col("ts")))).first()[0]
    return n, at_cut or 0


def follower(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, cut_term = shape(spark, sf_dir)
    inside = F.col("idx") <= n // 2
    same = inside | (F.col("term") == cut_term)
    kept = log(spark, sf_dir).where(F.col("idx") <= n // 2 + n // 10)
    return kept.select("idx", F.when(inside, F.col("term")).otherwise(cut_term).cast("long").alias("term"), "key", F.when(same, F.col("value")).otherwise(F.concat("value", F.lit("~"))).alias("value"), "no_op")


def mutated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The follower with one command changed in its shared half: what an audit must find."""
    n, _ = shape(spark, sf_dir)
    return follower(spark, sf_dir).withColumn("value", F.when(F.col("idx") == n // 4, F.concat("value", F.lit("!"))).otherwise(F.col("value")))


def copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Follower (D) and mutated follower (X) from one pass."""
    n, _ = shape(spark, sf_dir)
    changed = F.when((F.col("copy") == "X") & (F.col("idx") == n // 4), F.concat("value", F.lit("!"))).otherwise(F.col("value"))
    return follower(spark, sf_dir).withColumn("copy", F.explode(F.array(F.lit("D"), F.lit("X")))).withColumn("value", changed)


def committed(spark: SparkSession, sf_dir: str) -> int:
    """The commit index of a cluster of N_NODES, as a constant: the quorum's index from n alone, then one pass over the log up to it."""
    n, _ = shape(spark, sf_dir)
    held = sorted([n, *(n - p * (n // 200) for p in range(1, N_NODES))], reverse=True)[N_NODES // 2]
    entries = log(spark, sf_dir)
    last = entries.groupBy("term").agg(F.max(F.when(F.col("idx") <= held, F.col("idx"))).alias("idx")).agg(F.max(F.struct("term", "idx"))["idx"]).first()[0]
    return last or 0
