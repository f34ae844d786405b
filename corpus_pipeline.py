"""A corpus pipeline of five stages over ``documents``. Each stage takes (spark, docs, sf_dir), works on all that the stage
before kept and returns the columns of documents, the last one the encoded documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from larkspur.llm import byte_bpe, kneser_ney, line_dedup, mixing, order_minhash
from larkspur.llm.common import checkpoint_dir, table
from larkspur.store import Store

STAGES = [
    ("quality classifier", kneser_ney.quality_stage),
    ("line dedup", line_dedup.line_stage),
    ("minhash near-dedup", order_minhash.near_stage),
    ("source mix", mixing.mix_stage),
    ("byte-level bpe", byte_bpe.bpe_stage),
]

#: The language model and the alignment of near copies have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what each stage before returns is written as Parquet in the shared folder and read again, and
    removed when the next one is written."""
    docs, place = table(spark, sf_dir, "documents"), f"{checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{k}")
        docs = spark.read.parquet(f"{place}/{k}")
        if k:
            Store(spark).remove(f"{place}/{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
