"""Queries of the subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import contamination, html, lm, packing, passages, privacy, quality, secrets, simhash, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_privacy": privacy.query,
        "op10_html": html.query,
        "op2_contamination": contamination.query,
        "op3_passages": passages.query,
        "op4_packing": packing.query,
        "op5_toxicity": toxicity.query,
        "op6_lm": lm.query,
        "op7_secrets": secrets.query,
        "op8_simhash": simhash.query,
        "op9_quality": quality.query,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    """Shingle hashes, tokenizers, trained models and adaptive thresholds are not SQL: the tests hold those queries against brute force."""
    return {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
