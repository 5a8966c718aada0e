"""The queries of the corpus operators and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ctw, decontam, jaccard, mixing, quality, rules, secrets, tokencount, toxicity, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": quality.op1_quality,
        "op2_tokens": tokencount.op2_tokens,
        "op3_mixing": mixing.op3_mixing,
        "op4_secrets": secrets.op4_secrets,
        "op5_ctw": ctw.op5_ctw,
        "op6_jaccard": jaccard.op6_jaccard,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_decontam": decontam.op8_decontam,
        "op9_warc": warc.op9_warc,
        "op10_rules": rules.op10_rules,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_mixing": mixing.ORACLE,
        "op6_jaccard": jaccard.ORACLE,
        "op8_decontam": decontam.ORACLE,
        "op9_warc": warc.ORACLE,
        "op10_rules": rules.ORACLE,
    }
