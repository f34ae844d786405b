"""Quality classifier: an interpolated modified Kneser-Ney model of character 4-grams (Chen and Goodman 1999) learned from
trusted text. Counts are sharded tables joined by n-gram; perplexities are thresholded by quantiles of each language.

A 4-gram of 16-bit symbols is one bigint, so keys are exact, a context is a shift and a lower order a mask. Code points of
16 bits are symbols as they are; the places of surrogates, which no text has, stand for the start, for the most frequent
of the code points beyond 16 bits, and for the rest of those, which are one unknown symbol. Texts travel once, as
compressed blocks: each block asks for its distinct 4-grams, the count joins answer, and answers meet the block.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import fresh, materialize, row_id, ship, small_side, table, with_columns_of

ship(__name__)

ORDER = 4
#: The start symbol, the unknown one, and the first and the number of those for frequent code points beyond 16 bits.
START, UNKNOWN, BEYOND, PLACES = 0xD800, 0xD801, 0xD802, 2046
#: Bytes that the table of probabilities may take to be broadcast.
ANSWERS = 32_000_000
#: Bytes of text in a block, at least one document whatever its length.
BLOCK_BYTES = 8_000_000
#: Code points worked on at a time, three at least.
CHUNK = 1_000_000
#: A text is rejected if its nats per character lie further above its language's median than so many interquartile ranges
#: (of LEAST_IQR at least, far below those of real text, where it never decides), the excess being shrunk by
#: n / (n + SHRINK) for a text of n characters.
FENCE, LEAST_IQR, SHRINK = 2.5, 0.01, 600.0
#: Languages with fewer documents are held against the quantiles of all.
LEAST_DOCS = 50


def wide_symbols(docs: DataFrame) -> np.ndarray:
    """The PLACES most frequent code points of the corpus beyond 16 bits, sorted: all of them unless there are more."""
    wide = "[\\x{10000}-\\x{10FFFF}]"
    found = docs.where(F.col("text").rlike(wide)).select(F.explode(F.regexp_extract_all("text", F.lit(wide), F.lit(0))).alias("c")).groupBy("c").count()
    top = found.orderBy(F.desc("count"), "c").limit(PLACES).collect()
    return np.array(sorted(ord(r["c"]) for r in top), np.uint32)


def symbols(pieces: list[tuple[str, bool]], wide: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """4-gram keys of the characters of pieces of text, and where each piece's keys begin.

    A piece is (text, first): first ones follow three start symbols, others begin with the three characters before them.
    """
    parts, starts, n = [], [0], 0
    for t, first in pieces:
        raw = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
        lead = (ORDER - 1) * first
        s = np.full(len(raw) + lead, START, np.int64)
        s[lead:] = raw
        for i in np.flatnonzero(raw > 0xFFFF) if not t.isascii() else ():
            at = int(np.searchsorted(wide, raw[i]))
            s[lead + i] = BEYOND + at if at < len(wide) and wide[at] == raw[i] else UNKNOWN
        parts.append(s[:-3] << 48 | s[1:-2] << 32 | s[2:-1] << 16 | s[3:])
        n += len(parts[-1])
        starts.append(n)
    return np.concatenate(parts) if parts else np.zeros(0, np.int64), np.array(starts)


def chunks(texts: pa.Array) -> Iterator[tuple[list[int], list[tuple[str, bool]]]]:
    """(indices, pieces) of about CHUNK characters in all; longer texts come in several pieces."""
    at, some, size = [], [], 0
    for i, t in enumerate(texts):
        text = t.as_py() or ""
        for begin in range(0, max(1, len(text)), CHUNK):
            at.append(i)
            some.append((text[max(0, begin - ORDER + 1) : begin + CHUNK], begin == 0))
            size += len(some[-1][0])
            if size >= CHUNK:
                yield at, some
                at, some, size = [], [], 0
    if some:
        yield at, some


def grams(docs: DataFrame, trusted: DataFrame, wide: np.ndarray) -> DataFrame:
    """g, c: every 4-gram of ``docs`` and its count in the documents whose doc_id is in ``trusted``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in batches:
            for flag in (True, False):
                texts = b.column("text").filter(pc.equal(b.column("__t"), pa.scalar(flag)))
                for _, some in chunks(texts):
                    k, n = np.unique(symbols(some, wide)[0], return_counts=True)
                    merged, at = np.unique(np.concatenate([keys, k]), return_inverse=True)
                    counts = np.bincount(at, np.concatenate([counts, n * flag]), len(merged)).astype(np.int64)
                    keys = merged
                    if len(keys) > 4_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["g", "c"])
                        keys, counts = keys[:0], counts[:0]
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["g", "c"])

    ids = materialize(trusted.select(F.col("doc_id").alias("__id")).where("__id is not null").distinct())
    rows = docs.select(row_id().alias("__row"), "text").join(small_side(ids.withColumn("__t", F.lit(True))), F.col("__row") == F.col("__id"), "left")
    return rows.select("text", F.coalesce("__t", F.lit(False)).alias("__t")).mapInArrow(run, "g long, c long").groupBy("g").agg(F.sum("c").alias("c"))


def discounted(counts: DataFrame) -> tuple[Column, Column]:
    """Discount of a count c, and back-off mass of a context from its n1, n2, n3 (types seen once, twice, more) and total."""
    r = counts.agg(*[F.count(F.when(F.col("c") == i, 1)).alias(f"n{i}") for i in (1, 2, 3, 4)]).first()
    n1, n2, n3, n4 = (max(r[f"n{i}"], 1) for i in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2)
    d = [min(max(i - (i + 1) * y * b / a, 0.05), i - 0.05) for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    take = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).when(F.col("c") > 2, d[2]).otherwise(0.0)
    return take, (d[0] * F.col("n1") + d[1] * F.col("n2") + d[2] * F.col("n3")) / F.col("total")


def probabilities(all_grams: DataFrame) -> DataFrame:
    """g, logp: natural log of the interpolated probability of the last symbol of each 4-gram after the others.

    Orders 3, 2 and 1 count the distinct symbols before them. A context never seen passes its whole mass to the order
    below, and the lowest order to a uniform distribution over the symbols seen and one more.
    """
    counts = {ORDER: all_grams.where("c > 0")}
    wanted = {ORDER: all_grams.select(F.col("g").alias("k"))}
    masks = {3: (1 << 48) - 1, 2: (1 << 32) - 1, 1: (1 << 16) - 1}
    low = lambda c, k: F.col(c).bitwiseAND(F.lit(masks[k]))
    for k in (3, 2, 1):
        above = counts[k + 1]
        counts[k] = materialize(above.groupBy(low("g", k).alias("g")).agg(F.count(F.lit(1)).alias("c")))
        wanted[k] = materialize(wanted[k + 1].select(low("k", k).alias("k")).distinct())
    types = counts[1].count() + 1
    p = None
    for k in range(1, ORDER + 1):
        take, mass = discounted(counts[k])
        seen = counts[k].select(F.col("g").alias("k"), "c")
        sums = [F.sum("c").alias("total"), *[F.count(F.when(x, 1)).alias(f"n{i}") for i, x in ((1, F.col("c") == 1), (2, F.col("c") == 2), (3, F.col("c") > 2))]]
        if k == 1:  # one context, the empty one: its row comes to the driver
            of = seen.agg(*sums).select("total", mass.alias("mass")).first()
            rows = wanted[k].join(seen, "k", "left").select("*", F.lit(of["total"]).alias("total"), F.lit(of["mass"]).alias("mass"))
            below = F.lit(1.0 / types)
        else:
            of = seen.groupBy(F.shiftrightunsigned("k", 16).alias("h")).agg(*sums).select("h", "total", mass.alias("mass"))
            rows = wanted[k].withColumn("h", F.shiftrightunsigned("k", 16)).join(seen, "k", "left").join(of, "h", "left")
            rows = rows.withColumn("s", low("k", k - 1)).join(p.select(F.col("k").alias("s"), F.col("p").alias("below")), "s")
            below = F.col("below")
        own = F.coalesce((F.col("c") - take) / F.col("total"), F.lit(0.0))
        p = materialize(rows.select("k", (own + F.coalesce("mass", F.lit(1.0)) * below).alias("p")))
    return p.select(F.col("k").alias("g"), F.log("p").cast("float").alias("logp"))


def packed(docs: DataFrame) -> DataFrame:
    """block, blob: all columns of ``docs`` in blocks of about BLOCK_BYTES, compressed. ``block`` is a hash of the blob, so a
    block can only be answered what it asked itself."""
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, size = [], 0

        def out() -> pa.RecordBatch:
            sink = io.BytesIO()
            with pa.ipc.new_stream(sink, some[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
                for b in some:
                    to.write_batch(b)
            blob = sink.getvalue()
            return pa.RecordBatch.from_arrays([pa.array([xxhash.xxh64_intdigest(blob) - 2**63], pa.int64()), pa.array([blob], pa.binary())], ["block", "blob"])

        for b in batches:
            sizes = np.cumsum(np.nan_to_num(pc.binary_length(b.column(text)).to_numpy(zero_copy_only=False).astype(float)) + 64)
            at = 0
            while at < b.num_rows:
                upto = int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + BLOCK_BYTES - size)) + 1
                some.append(b.slice(at, upto - at))
                size += int(sizes[min(upto, b.num_rows) - 1] - (sizes[at - 1] if at else 0))
                at = min(upto, b.num_rows)
                if size >= BLOCK_BYTES:
                    yield out()
                    some, size = [], 0
        if some:
            yield out()

    return docs.mapInArrow(run, "block long, blob binary").repartition("block")


def opened(blob: pa.Scalar) -> Iterator[pa.RecordBatch]:
    yield from pa.ipc.open_stream(blob.as_buffer())


def asked(blocks: DataFrame, wide: np.ndarray) -> DataFrame:
    """block, g: the distinct 4-grams of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, blob in zip(b.column("block"), b.column("blob"), strict=True):
                keys = [np.unique(symbols(some, wide)[0]) for rows in opened(blob) for _, some in chunks(rows.column("text"))]
                keys = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
                for at in range(0, len(keys), 100_000):
                    part = keys[at : at + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), block.as_py())), pa.array(part)], ["block", "g"])

    return blocks.mapInArrow(run, "block long, g long")


class Lookup:
    """Values by 4-gram key: two dense levels over pairs of symbols where those fit, else a search."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        pairs = np.unique(np.concatenate([keys >> 32 & 0xFFFFFFFF, keys & 0xFFFFFFFF]))
        letters = np.unique(np.concatenate([pairs >> 16, pairs & 0xFFFF]))
        self.dense = 0 < len(pairs) ** 2 <= 30_000_000
        if self.dense:
            self.letter = np.zeros(1 << 16, np.int32)
            self.letter[letters] = np.arange(len(letters))
            self.width, self.side = len(letters), len(pairs)
            self.pair = np.zeros(self.width**2, np.int32)
            self.pair[self.letter[pairs >> 16] * self.width + self.letter[pairs & 0xFFFF]] = np.arange(len(pairs))
            self.square = np.full(self.side**2, np.nan, np.float32)
            self.square[self.place(self.keys)] = self.values

    def place(self, keys: np.ndarray) -> np.ndarray:
        a, b, c, d = (self.letter[keys >> s & 0xFFFF] for s in (48, 32, 16, 0))
        return self.pair[a * self.width + b] * np.int32(self.side) + self.pair[c * self.width + d]

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            raise ValueError("a block was not answered")
        found = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1) if not self.dense else self.place(keys)
        if self.dense:
            out = self.square[found]
            known = ~np.isnan(out)
        else:
            out, known = self.values[found], self.keys[found] == keys
        if not known.all():
            raise ValueError("a block asked for a 4-gram that it has no answer to")
        return out


def scored(docs: DataFrame, logp: DataFrame, wide: np.ndarray) -> DataFrame:
    """The columns of ``docs`` but its text, __n (characters) and __nats (their mean negative log-probability; null without any)."""
    blocks = packed(docs)
    answers = asked(blocks, wide).join(small_side(logp, ANSWERS), "g").groupBy("block").agg(F.collect_list("g").alias("g"), F.collect_list("logp").alias("logp"))
    kept = [f for f in docs.schema if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                known = Lookup(batch.column("g")[i].values.to_numpy(), batch.column("logp")[i].values.to_numpy()) if batch.column("g")[i].is_valid else Lookup(np.zeros(0, np.int64), np.zeros(0, np.float32))
                for rows in opened(batch.column("blob")[i]):
                    n, nats = np.zeros(rows.num_rows, np.int64), np.zeros(rows.num_rows)
                    for at, some in chunks(rows.column("text")):
                        keys, starts = symbols(some, wide)
                        upto = np.concatenate([[0.0], np.cumsum(known(keys), dtype=np.float64)]) if len(keys) else np.zeros(1)
                        np.add.at(n, at, np.diff(starts))
                        np.add.at(nats, at, upto[starts[:-1]] - upto[starts[1:]])
                    nats = np.round(nats / np.maximum(n, 1), 6)
                    yield pa.RecordBatch.from_arrays([*(rows.column(f.name) for f in kept), pa.array(n), pa.array(nats, mask=n == 0)], [*(f.name for f in kept), "__n", "__nats"])

    names = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept)
    return blocks.join(answers, "block", "left").select("blob", "g", "logp").mapInArrow(run, f"{names}__n long, __nats double")


def classified(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """doc_id, lang, __row and __h (the row's id and a hash of its text and language), __n, __nats and __kept of every row of ``docs``.

    ``trusted`` names the doc_ids to learn from; without any, all texts score alike and stay. Texts that are null or empty
    have no score and are kept, as nothing speaks against them. Null languages are one group; repeated rows score alike; a
    doc_id with several texts has a score for each and is trusted with all; other columns are not read; texts of any
    length are scored whole, in pieces; an empty table stays empty. Texts are scored once: the narrow result is written.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    wide = wide_symbols(docs)
    all_grams = materialize(grams(docs, trusted, wide))
    rows = docs.select("doc_id", "lang", row_id().alias("__row"), F.xxhash64("text", "lang").alias("__h"), "text")
    return fenced(materialize(scored(rows, materialize(probabilities(all_grams)), wide)))


def fenced(rows: DataFrame) -> DataFrame:
    """``rows`` (lang, __n, __nats and others) with __kept."""
    quantiles = F.percentile(F.round("__nats", 3), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    some = rows.where("__n > 0")
    every = some.agg(quantiles.alias("q")).first()["q"] or [0.0, 0.0, 0.0]
    of = materialize(some.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), quantiles.alias("q")))
    of = of.select(F.col("lang").alias("__of"), F.when(F.col("docs") >= LEAST_DOCS, F.col("q")).otherwise(F.array(*map(F.lit, every))).alias("__q"))
    rows = rows.join(small_side(of), F.col("lang").eqNullSafe(F.col("__of")), "left")
    excess = (F.col("__nats") - F.col("__q")[1]) * F.col("__n") / (F.col("__n") + SHRINK)
    limit = FENCE * F.greatest(F.col("__q")[2] - F.col("__q")[0], F.lit(LEAST_IQR))
    return rows.withColumn("__kept", F.coalesce(excess <= limit, F.lit(True))).drop("__of", "__q")


def trusted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").where("quality = 1 and coalesce(toxic, 0) = 0").select("doc_id")


def op2_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = classified(table(spark, sf_dir, "documents"), trusted_ids(spark, sf_dir))
    return rows.select("doc_id", "lang", F.col("__n").alias("n_symbols"), F.exp("__nats").alias("perplexity"), F.col("__kept").alias("kept"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the classifier rejects go.

    Rows are told apart by doc_id, text and language; equal rows stay or go together. Null and empty texts stay; other
    columns, whatever their names, are carried along; an empty table stays empty.
    """
    on = [fresh(docs, "__row"), fresh(docs, "__h")]
    rows = classified(docs, trusted_ids(spark, sf_dir))
    gone = materialize(rows.where("not __kept").select(F.col("__row").alias(on[0]), F.col("__h").alias(on[1])).distinct())
    named = docs.withColumn(on[0], row_id()).withColumn(on[1], F.xxhash64(F.col("text").cast("string"), F.col("lang").cast("string")))
    return with_columns_of(named.join(small_side(gone), on, "left_anti"), docs)
