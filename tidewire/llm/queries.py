"""The registered query of each training-data operator, with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import ball_kmeans, bpe, decontamination, fm_dedup, merkle, pii, resampling, simhash, suffix_dedup, toxicity, turns, url_lists, warc
from .common import with_small_batches


def _run(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: query(with_small_batches(spark), sf_dir)


_QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_url_filters": url_lists.op2_url_filters,
    "op3_quality": resampling.op3_quality,
    "op4_pii": pii.op4_pii,
    "op5_fm_dedup": fm_dedup.op5_fm_dedup,
    "op6_bpe": bpe.op6_bpe,
    "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
    "op8_simhash": simhash.op8_simhash,
    "op9_decontamination": decontamination.op9_decontamination,
    "op10_fingerprints": merkle.op10_fingerprints,
    "op11_ball_kmeans": ball_kmeans.op11_ball_kmeans,
    "op12_toxicity": toxicity.op12_toxicity,
    "op13_turns": turns.op13_turns,
    "pipeline": corpus_pipeline.run,
}
QUERIES = {name: _run(query) for name, query in _QUERIES.items()}

ORACLE_SQL = {"op1_warc": warc.OP1_SQL, "op2_url_filters": url_lists.OP2_SQL, "op11_ball_kmeans": ball_kmeans.OP11_SQL}
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
