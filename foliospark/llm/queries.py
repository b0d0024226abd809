"""The queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, byte_bpe, context_tree, exact_dedup, line_crf, minhash_dedup, packing, passages, piece_bpe, pii, quality_rules, runs, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii": pii.query,
        "op2_minhash_dedup": minhash_dedup.query,
        "op3_toxicity": toxicity.query,
        "op4_byte_bpe": byte_bpe.query,
        "op5_line_crf": line_crf.query,
        "op6_passages": passages.query,
        "op7_context_tree": context_tree.query,
        "op8_packing": packing.query,
        "op9_exact_dedup": exact_dedup.query,
        "op10_quality_rules": quality_rules.query,
        "op11_alignment": alignment.query,
        "op12_piece_bpe": piece_bpe.query,
        "op13_runs": runs.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_minhash_dedup": minhash_dedup.SQL, "op9_exact_dedup": exact_dedup.SQL}
