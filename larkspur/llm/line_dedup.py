"""Line dedup: hashes of lines are range-partitioned with a secondary sort by document and position; first occurrences are
streamed in that order; what comes back is a compressed keep bitmap for each document, not text. DataFrame functions only."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.llm.common import BROADCAST_BYTES, byte_count, fresh, materialize, table, with_columns_of

MIN_DOCS = 10
#: Streams that the occurrences of one key are dealt over, by document; a key held by any share of the rows is never one task's.
SALTS = 64
BLANKS = " \t\n\x0b\x0c\r"


def lines_of(text: Column) -> Column:
    """The lines of a text; null and empty texts have one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), string.ascii_uppercase, string.ascii_lowercase)


def occurrences(docs: DataFrame) -> DataFrame:
    """h1, h2 (128 bits of the line's key), salt, doc_id, doc_hash, pos, n_lines of every line whose key is not empty."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("doc_hash"), lines_of(F.col("text")).alias("lines"))
    rows = rows.select("doc_id", "doc_hash", F.size("lines").alias("n_lines"), F.posexplode("lines").alias("pos", "line"))
    rows = rows.withColumn("key", line_key(F.col("line"))).where(F.length("key") >= 1)
    return rows.select(
        F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"),
        F.pmod(F.xxhash64(F.lit(3), "doc_id", "doc_hash"), F.lit(SALTS)).cast("short").alias("salt"), "doc_id", "doc_hash", "pos", "n_lines",
    )


def common_lines(found: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """h1, h2, docs, first (doc_id, doc_hash, pos) of the ``found`` occurrences: keys in ``min_docs`` documents or more, with their first occurrence."""
    keys = ["h1", "h2", "salt"]
    rows = found.drop("n_lines").repartitionByRange(*keys).sortWithinPartitions(*keys, "doc_id", "doc_hash", "pos")
    stream = Window.partitionBy(*keys).orderBy("doc_id", "doc_hash", "pos")
    doc = F.struct("doc_id", "doc_hash")
    rows = rows.withColumn("new", F.when(doc.eqNullSafe(F.lag(doc).over(stream)), 0).otherwise(1)).withColumn("at", F.row_number().over(stream))
    runs = rows.groupBy(*keys).agg(F.sum("new").alias("docs"), F.min(F.when(F.col("at") == 1, F.struct("doc_id", "doc_hash", "pos"))).alias("first"))
    return runs.groupBy("h1", "h2").agg(F.sum("docs").alias("docs"), F.min("first").alias("first")).where(F.col("docs") >= min_docs)


def runs_of(positions: Column, n: Column) -> Column:
    """Sorted dropped positions of ``n`` lines as run lengths: kept, dropped, kept, ..., kept. A bitmap, compressed."""
    starts = F.filter(positions, lambda p, i: (i == 0) | (p != F.coalesce(F.try_element_at(positions, i) + 1, F.lit(-1))))
    ends = F.filter(positions, lambda p, i: (i == F.size(positions) - 1) | (p + 1 != F.coalesce(F.try_element_at(positions, i + 2), F.lit(-1))))
    pairs = F.flatten(F.transform(F.arrays_zip(starts.alias("s"), ends.alias("e")), lambda x, i: F.array(x["s"] - F.when(i == 0, 0).otherwise(F.element_at(ends, F.greatest(i, F.lit(1))) + 1), x["e"] - x["s"] + 1)))
    return F.concat(pairs, F.array(n - F.element_at(ends, -1) - 1))


def keep_bitmaps(docs: DataFrame, min_docs: int = MIN_DOCS, keep_first: bool = False) -> DataFrame:
    """doc_id, doc_hash, n_lines, keep_runs of each document that loses a line.

    A key found in ``min_docs`` documents or more loses all its lines, or all but the first in the order of document and
    position (``keep_first``). A document is a doc_id with its text: equal rows count once and get one bitmap; null ids
    are told apart by text; null and empty texts have one empty line, which has no key. Very long texts are split like
    others, a line being the unit of all that follows. An empty table gives no rows. Only doc_id and text are read.
    """
    found = materialize(occurrences(docs))  # hashes and places only; texts are split once
    common = materialize(common_lines(found, min_docs).select("h1", "h2", *(["first"] if keep_first else [])))
    how = "inner" if keep_first else "left_semi"
    if byte_count(common) <= BROADCAST_BYTES:
        hits = found.join(F.broadcast(common), ["h1", "h2"], how)
    else:  # each key in every stream, so that the commonest line's occurrences stay dealt out
        hits = found.join(common.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("short"), F.lit(SALTS - 1).cast("short"), F.lit(1).cast("short")))), ["h1", "h2", "salt"], how)
    if keep_first:
        hits = hits.where(~F.struct("doc_id", "doc_hash", "pos").eqNullSafe(F.col("first"))).drop("first")
    dropped = hits.groupBy("doc_id", "doc_hash").agg(F.max("n_lines").alias("n_lines"), F.sort_array(F.collect_set("pos")).alias("dropped"))
    return dropped.select("doc_id", "doc_hash", "n_lines", runs_of(F.col("dropped"), F.col("n_lines")).alias("keep_runs"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with its text reduced to the lines kept, plus __n_lines and __n_dropped (with underscores added if ``docs`` has
    such a column). Documents without a bitmap, null texts among them, stay as they are; equal rows lose the same lines;
    columns of any names are carried along; an empty table stays empty."""
    own, other, runs, lines, left, n_lines, n_dropped = (fresh(docs, x) for x in ("__h", "__hash", "__runs", "__lines", "__left", "__n_lines", "__n_dropped"))
    of = fresh(docs, "__id")
    ids = bitmaps.select(F.col("doc_id").alias(of), F.col("doc_hash").alias(other), F.col("keep_runs").alias(runs))
    rows = docs.withColumn(own, F.xxhash64("text")).join(ids, F.col("doc_id").eqNullSafe(F.col(of)) & (F.col(own) == F.col(other)), "left")
    rows = rows.withColumn(lines, lines_of(F.col("text"))).withColumn(n_lines, F.size(lines).cast("long"))
    keep = F.flatten(F.transform(runs, lambda n, i: F.array_repeat(i % 2 == 0, n)))
    rows = rows.withColumn(left, F.when(F.col(runs).isNotNull(), F.transform(F.filter(F.arrays_zip(F.col(lines).alias("line"), keep.alias("keep")), lambda x: x["keep"]), lambda x: x["line"])))
    rows = rows.withColumn(n_dropped, F.when(F.col(runs).isNull(), F.lit(0)).otherwise(F.size(lines) - F.size(left)).cast("long"))
    rows = rows.withColumn("text", F.when(F.col(runs).isNull(), F.col("text")).otherwise(F.concat_ws("\n", left)))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns], n_lines, n_dropped)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = apply_bitmaps(docs, keep_bitmaps(docs))
    return kept.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: lines that ten documents or more share are dropped; every document stays, n_chars follows its text.

    Null and empty texts stay as they are; rows that are equal in doc_id and text are one document and lose the same lines;
    other columns, whatever their names, are carried along; an empty table stays empty.
    """
    kept = apply_bitmaps(docs, keep_bitmaps(docs))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col(fresh(docs, "__n_dropped")) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return with_columns_of(kept, docs)


OP5_SQL = r"""
with d as (select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as lines, md5(coalesce(text, ' ')) as h from documents),
l as (select r, doc_id, h, unnest(lines) as line, unnest(range(len(lines))) as pos from d),
k as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
c as (select key from k where length(key) >= 1 group by key having count(distinct (doc_id, h)) >= 10)
select any_value(doc_id) as doc_id, count(*)::bigint as n_lines, count(c.key)::bigint as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where c.key is null), '')) as kept_sha256
from k left join c using (key) group by r
"""
