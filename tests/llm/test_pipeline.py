"""The pipeline: every stage on real and odd rows, and the whole against stages computed plainly."""

import collections
import hashlib

import corpus_pipeline
import pytest
from test_operators import DOCS, brute_classes, rows

from larkspur.llm import byte_bpe, kneser_ney, mixing
from larkspur.llm.common import materialize, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def brute_lines(docs):
    keys = collections.defaultdict(set)
    fold = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s.strip(" \t\n\x0b\x0c\r"))
    for i, t in docs:
        for line in t.split("\n"):
            keys[fold(line)].add(i)
    gone = {k for k, v in keys.items() if k and len(v) >= 10}
    return [(i, "\n".join(x for x in t.split("\n") if fold(x) not in gone)) for i, t in docs]


def test_whole(spark, sf):
    docs = table(spark, sf, "documents")
    kept = materialize(kneser_ney.quality_stage(spark, docs, sf))
    assert kept.columns == docs.columns and docs.count() * 0.6 < kept.count() < docs.count()
    lines = brute_lines([(r["doc_id"], r["text"]) for r in kept.collect()])
    classes = brute_classes(lines)
    left = {i: t for i, t in lines if classes[i] == i}
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    rest = spark.createDataFrame([(i, t, source[i]) for i, t in left.items()], "doc_id long, text string, source string")
    want = collections.Counter((r["doc_id"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in mixing.replicate(rest, mixing.tempered_rates(rest)).collect())
    got = collections.Counter((r["doc_id"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, sf).collect())
    assert got == want


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stage_odd(spark, sf, stage):
    some = rows(None, "", "a b c d e f g", "a b c d e f g", "é " * 3000) + [(None,) * 12] * 2
    docs = spark.createDataFrame(some, DOCS)
    out = materialize(stage[1](spark, docs, sf))
    assert stage[1] is byte_bpe.bpe_stage or out.columns == docs.columns
    assert stage[1](spark, docs.limit(0), sf).count() == 0
