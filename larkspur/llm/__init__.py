"""Operations of a training-data pipeline. Nothing else in the library imports this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from larkspur.llm import byte_bpe, kneser_ney, language_id, line_dedup, metric_join, mixing, order_minhash, quality_rules, secret_scan, sharding

_QUERIES = (
    quality_rules.op1_quality_rules,
    kneser_ney.op2_kneser_ney_quality,
    mixing.op3_poisson_mix,
    metric_join.op4_metric_range_join,
    line_dedup.op5_line_dedup,
    order_minhash.op6_order_minhash,
    byte_bpe.op7_byte_bpe,
    secret_scan.op8_secret_scan,
    language_id.op9_byte_language_id,
    sharding.op10_jump_shards,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    """SQL of the operators that SQL can express; the others are tested against brute force."""
    return {"op1_quality_rules": quality_rules.OP1_SQL, "op3_poisson_mix": mixing.OP3_SQL, "op4_metric_range_join": metric_join.OP4_SQL, "op5_line_dedup": line_dedup.OP5_SQL}
