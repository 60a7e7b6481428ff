"""The queries of this package, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.llm import attention_lm, decontamination, media, quality, sentencepiece_lattice, sharding, simhash, token_counts, toxicity, url_rules


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    functions = [
        sentencepiece_lattice.op1_sentencepiece,
        quality.op2_quality,
        attention_lm.op3_lm_score,
        simhash.op4_simhash,
        toxicity.op5_toxicity,
        sharding.op6_sharding,
        media.op7_media_columns,
        decontamination.op8_decontamination,
        url_rules.op9_url_rules,
        token_counts.op10_token_counts,
    ]
    return {f.__name__: f for f in functions}


def oracle_sql() -> dict[str, str]:
    return {"op8_decontamination": decontamination.OP8_SQL}
