"""The corpus pipeline: toxicity, quality, near copies, benchmark leaks, pieces.

Each stage is (spark, docs, sf_dir) -> DataFrame. All but the last return the columns of
documents; the last adds the sampled SentencePiece ids. ``run`` writes each stage to
the checkpoint folder and reads it again as the next one's docs; a stage's folder goes when the next one is written.

Defined results of all stages: null and empty texts are texts without words; very long texts count whole; an empty table stays empty;
further columns stay as they are.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.llm import decontamination, near_dedup, quality, sentencepiece_lattice, toxicity
from ledgerlens.llm.common import ensure_checkpoint_dir, read


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents whose toxicity score reaches its threshold go; the model is fitted on the labels and on docs themselves."""
    return toxicity.keep_clean(docs, read(spark, sf_dir, "labels"))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents that score under its threshold go; the pool of the co-training is docs themselves."""
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4, at a similarity of 0.8 over five words: of each group of linked texts the row with the least doc_id stays."""
    return near_dedup.drop_near_copies(docs)


def remove_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: passages of the benchmark are cut out of the texts; every document stays, and clean texts stay as they are."""
    return decontamination.remove_leaks(docs, read(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: sampled pieces of each text, which decode to it."""
    return sentencepiece_lattice.with_pieces(docs, sentencepiece_lattice.default_model())


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("near_copies", drop_near_copies),
    ("decontamination", remove_leaks),
    ("pieces", encode),
]

#: The classifiers are fitted in numpy and the pieces are sampled, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over documents."""
    ensure_checkpoint_dir(spark)
    path = spark._jvm.org.apache.hadoop.fs.Path
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    files = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            files.delete(path(f"{folder}/{before}"), True)
        before = name
    return docs
