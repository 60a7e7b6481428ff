"""Latency statistics that stay exact and spread out at any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nearest_rank(rows: DataFrame, by: str, value: str, percents: list[int], width: float) -> DataFrame:
    """Exact nearest-rank percentiles of each group: by, percent, value.

    Counts of buckets of `width` find the bucket that holds each rank; only its distinct values
    are ordered. A group of any size is thus never sorted as a whole.
    """
    bucketed = rows.where(F.col(value).isNotNull()).select(by, F.col(value).alias("v"), F.floor(F.col(value) / width).alias("bucket"))
    counts = bucketed.groupBy(by, "bucket").agg(F.count("*").alias("n"))
    w = Window.partitionBy(by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    sums = counts.select(by, "bucket", "n", F.sum("n").over(w).alias("up_to"), F.sum("n").over(Window.partitionBy(by)).alias("total"))
    # ceil(p * n / 100) in integers; at least 1.
    ranks = sums.select("*", F.explode(F.array(*[F.lit(p).cast("long") for p in percents])).alias("percent"))
    rank = F.greatest(F.lit(1).cast("long"), F.expr("(percent * total + 99) div 100"))
    hit = ranks.select("*", rank.alias("rank")).where("rank <= up_to AND rank > up_to - n").select(by, "bucket", "percent", (F.col("rank") - F.col("up_to") + F.col("n")).alias("within"))
    # Equal values are counted before they are ordered, so a value that many rows have is one row.
    distinct = bucketed.join(hit.select(by, "bucket").distinct(), [by, "bucket"], "left_semi").groupBy(by, "bucket", "v").agg(F.count("*").alias("times"))
    upto = F.sum("times").over(Window.partitionBy(by, "bucket").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    ordered = distinct.select(by, "bucket", "v", "times", upto.alias("upto"))
    inside = (F.col("within") <= F.col("upto")) & (F.col("within") > F.col("upto") - F.col("times"))
    return ordered.join(hit, [by, "bucket"]).where(inside).select(by, "percent", F.col("v").alias("value"))


def summary(rows: DataFrame, by: str, value: str, width: float, percents=(50, 90, 95)) -> DataFrame:
    """Count, least, mean, highest and percentiles of each group."""
    base = rows.where(F.col(value).isNotNull()).groupBy(by).agg(F.count("*").alias("n"), F.min(value).alias("least"), F.round(F.avg(value), 6).alias("mean"), F.max(value).alias("highest"))
    ranks = nearest_rank(rows, by, value, list(percents), width).groupBy(by).agg(*[F.max(F.when(F.col("percent") == p, F.col("value"))).alias(f"p{p}") for p in percents])
    return base.join(ranks, by)


def histogram(rows: DataFrame, by: str, value: str, width: float) -> DataFrame:
    """by, bin (its lower end as a multiple of width), n; bins between the least and the highest are there even if empty."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(by, F.floor(F.col(value) / width).alias("bin")).agg(F.count("*").alias("n"))
    # In two steps, so that an outlier makes no long array.
    spans = counts.groupBy(by).agg(F.min("bin").alias("lo"), F.max("bin").alias("hi")).select(by, "hi", F.explode(F.sequence("lo", "hi", F.lit(4096).cast("long"))).alias("at"))
    spans = spans.select(by, F.explode(F.sequence("at", F.least(F.col("hi"), F.col("at") + 4095))).alias("bin"))
    return spans.join(counts, [by, "bin"], "left").select(by, "bin", F.coalesce("n", F.lit(0)).alias("n"))


def bars(bins: DataFrame, most: int = 50) -> DataFrame:
    """Text bars for a histogram, the longest of `most` marks."""
    top = bins.agg(F.max("n"))
    return bins.withColumn("bar", F.repeat(F.lit("#"), F.ceil(F.col("n") * most / top.scalar()).cast("int")))


def first_trials(rows: DataFrame, by: str, order: str, most: int = 50) -> DataFrame:
    """The first `most` rows of each group. Spark drops later rows of a group before the shuffle."""
    return rows.withColumn("trial", F.row_number().over(Window.partitionBy(by).orderBy(order)).cast("long")).where(F.col("trial") <= most)


def range_buckets(rows: DataFrame, at: str, most: int = 256) -> DataFrame:
    """rows with `bucket`, by ranges of `at` (a long) of about equal numbers of rows; the ranges' ends are a bounded array."""
    cuts = rows.agg(F.array_distinct(F.percentile_approx(at, F.array(*[F.lit(i / most) for i in range(1, most)]))).alias("cuts")).scalar()
    # A subquery may not stand within a higher-order function.
    return rows.withColumn("cuts", cuts).withColumn("bucket", F.size(F.filter("cuts", lambda x: x < F.col(at)))).drop("cuts")
