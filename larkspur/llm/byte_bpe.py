"""Byte-level BPE: ranked merges are folded over the byte arrays of distinct words; decoding joins binary pieces.

``fold_documents`` splits texts once into blocks (distinct words, and texts as indices of them), folds each distinct word of
the corpus once by ``encode_words``, Spark higher-order functions with a literal rank map, and joins the ids back to blocks.
``encode_documents`` gives the same rows without a shuffle, folding the distinct words of each task in Python.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import io
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.llm.common import ship, table

ship(__name__)

#: The vocabulary used unless another path is given.
VOCABULARY = "byte_bpe_50k.tiktoken"
#: The literal rank map is an array of this many small maps, by crc32 of the piece, as Spark searches a map from end to end.
SLOTS = 65_536
#: Distinct words a task remembers; beyond that it begins anew.
REMEMBERED = 400_000
#: Words of more bytes are merged with a heap in Python: a fold over arrays copies them at each merge, so its time grows with the square.
LONG = 256
NONE = 2**31 - 1
#: Bytes of text in a block, at least one document whatever its length; words whose ids are joined at a time; level of compression.
BLOCK_BYTES, CHUNK, ZSTD = 64_000_000, 200_000, 9


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in lines if line.strip())}


def default_vocabulary() -> tuple[dict[bytes, int], str]:
    """Ranks and splitting pattern of the public vocabulary."""
    import public_tokenizers

    return load_ranks(public_tokenizers.path(VOCABULARY)), public_tokenizers.PATTERN


def fold_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a word: the neighbours of least rank, leftmost first, are joined until none are in the vocabulary."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    if len(word) > LONG:
        return fold_long(word, ranks)
    get = ranks.get
    pieces = [word[i : i + 1] for i in range(len(word))]
    joined = [get(word[i : i + 2], NONE) for i in range(len(word) - 1)]
    while joined:
        best = min(joined)
        if best == NONE:
            break
        i = joined.index(best)
        pieces[i : i + 2] = [pieces[i] + pieces[i + 1]]
        del joined[i]
        if i:
            joined[i - 1] = get(pieces[i - 1] + pieces[i], NONE)
        if i < len(joined):
            joined[i] = get(pieces[i] + pieces[i + 1], NONE)
    return [ranks[p] for p in pieces]


def fold_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """As fold_word, in n log n steps: a heap of (rank, place) over linked pieces."""
    n = len(word)
    end, before, alive = [i + 1 for i in range(n)], [i - 1 for i in range(n)], [True] * n
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        if (j := end[i]) < n and (rank := ranks.get(word[i : end[j]])) is not None:
            heapq.heappush(heap, (rank, i, end[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, upto = heapq.heappop(heap)
        if not alive[i] or (j := end[i]) >= n or end[j] != upto:
            continue
        alive[j] = False
        end[i] = upto
        if upto < n:
            before[upto] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


class Folded(dict):
    """Ids of the distinct words met so far, each folded once, as little-endian unsigned 32-bit integers."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks

    def __missing__(self, word: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = ids = b"".join(i.to_bytes(4, "little") for i in fold_word(word.encode(), self.ranks))
        return ids


class Encoder:
    """Encodes texts with a memory of distinct words."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import regex

        self.split, self.known = regex.compile(pattern).findall, Folded(ranks)
        self.pieces = {r: p for p, r in ranks.items()}

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.known.__getitem__, self.split(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, memoryview(ids).cast("I")))


def encode_documents(docs: DataFrame, ranks: dict[bytes, int], pattern: str, full: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row, with ``full`` also ids (array<int>) and decoded (binary).

    Each match of ``pattern`` is encoded separately, without special tokens. Null and empty texts have no ids; repeated
    rows give equal rows; texts of any length are encoded whole; an empty table gives no rows. The vocabulary is sent
    to each task, its size is that of its file.
    """
    if not {bytes([i]) for i in range(256)} <= set(ranks):
        raise ValueError("the vocabulary lacks single bytes")
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * full

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(ranks, pattern)
        digest = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                b = batch.slice(at, 500)
                out: list[list] = [[] for _ in names[1:]]
                for t in b.column("text"):
                    ids = coder.encode(t.as_py() or "")
                    decoded = coder.decode(ids)
                    for o, v in zip(out, (len(ids) // 4, digest(ids), digest(decoded), list(memoryview(ids).cast("I")) if full else None, decoded), strict=False):
                        o.append(v)
                kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.binary()]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(o, k) for o, k in zip(out, kinds, strict=False))], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded binary" * full)


def rank_map(spark: SparkSession, ranks: dict[bytes, int], name: str = "larkspur_ranks") -> Column:
    """The ranks as a literal of type array<map<binary, int>>, held by a session variable."""
    slots: list[list[tuple[bytes, int]]] = [[] for _ in range(SLOTS)]
    for piece, rank in ranks.items():
        slots[crc32(piece) % SLOTS].append((piece, rank))
    rows = pa.table({"m": pa.array([slots], pa.list_(pa.map_(pa.binary(), pa.int32())))})
    spark.createDataFrame(rows).createOrReplaceTempView(name)
    spark.sql(f"declare or replace variable {name} array<map<binary, int>>")
    spark.sql(f"set var {name} = (select m from {name})")
    return F.expr(name)


def encode_words(word: Column, ranks: Column) -> Column:
    """Ids (array<int>) of a binary word by a literal ``rank_map``: an aggregate folds one merge after the other.

    The state is the places where pieces begin and the rank of each two neighbours joined; a null word gives null, an
    empty one no ids.
    """
    none, empty = F.lit(NONE), F.array().cast("array<int>")
    n = F.octet_length(word)

    def rank(piece: Column) -> Column:
        return F.coalesce(F.try_element_at(F.get(ranks, F.crc32(piece) % SLOTS), piece), none)

    def step(x: Column, _: Column) -> Column:
        best = F.array_min(x["joined"])

        def merge(i: Column) -> Column:
            at, joined = x["at"], x["joined"]
            k = F.size(joined)
            left = F.when(i > 1, F.array(rank(F.substring(word, F.get(at, i - 2), F.get(at, i + 1) - F.get(at, i - 2))))).otherwise(empty)
            right = F.when(i < k, F.array(rank(F.substring(word, F.get(at, i - 1), F.get(at, i + 2) - F.get(at, i - 1))))).otherwise(empty)
            rest = F.concat(F.slice(joined, 1, F.greatest(i - 2, F.lit(0))), left, right, F.slice(joined, i + 2, k))
            return F.struct(F.concat(F.slice(at, 1, i), F.slice(at, i + 2, k)).alias("at"), rest.alias("joined"))

        merged = F.get(F.transform(F.array(F.array_position(x["joined"], best).cast("int")), merge), 0)
        return F.when(F.coalesce(best, none) == none, x).otherwise(merged)

    start = F.struct(F.sequence(F.lit(1), n + 1).alias("at"), F.transform(F.sequence(F.lit(1), n - 1), lambda i: rank(F.substring(word, i, 2))).alias("joined"))
    ids = lambda x: F.transform(F.slice(x["at"], 1, F.size(x["at"]) - 1), lambda at, i: rank(F.substring(word, at, F.get(x["at"], i + 1) - at)))
    folded = F.aggregate(F.sequence(F.lit(1), n - 1), start, step, ids)
    return F.when(n == 0, empty).when(n == 1, F.array(rank(word))).when(rank(word) != none, F.array(rank(word))).otherwise(folded)


class Numbered(dict):
    """Numbers of the distinct words met, from 0."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def packed_words(words: list[bytes]) -> bytes:
    sink = io.BytesIO()
    batch = pa.RecordBatch.from_arrays([pa.array(words, pa.binary())], ["word"])
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", ZSTD))) as to:
        to.write_batch(batch)
    return sink.getvalue()


def opened_words(blob: pa.Scalar) -> pa.Array:
    return pa.ipc.open_stream(blob.as_buffer()).read_next_batch().column("word")


def asked(blocks: DataFrame) -> DataFrame:
    """block, i, word: the distinct words of each block, numbered, but those of more than LONG bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, blob in zip(batch.column("block"), batch.column("words"), strict=True):
                words = opened_words(blob)
                i = np.flatnonzero(pc.binary_length(words).to_numpy() <= LONG).astype(np.int32)
                for at in range(0, len(i), 50_000):
                    some = i[at : at + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), block.as_py(), np.int64)), pa.array(some), words.take(pa.array(some))], ["block", "i", "word"])

    return blocks.mapInArrow(run, "block long, i int, word binary")


def answered(rows: DataFrame, ranks: Column, width: int) -> DataFrame:
    """block, i, ids of the words ``asked``: each is folded once, where it comes first, and later rows take over its ids.

    The ids of a word are one binary value, each a big-endian number of ``width`` bytes. A word has a row for each block at most, so what is dealt by word is even, whatever the words' frequencies.
    """
    same = Window.partitionBy("word").orderBy("block", "i")
    digits = F.transform(encode_words(F.col("word"), ranks), lambda i: F.lpad(F.hex(i), 2 * width, "0"))
    rows = rows.withColumn("k", F.row_number().over(same)).withColumn("own", F.when(F.col("k") == 1, F.unhex(F.array_join(digits, ""))))
    return rows.select("block", "i", F.first("own", ignorenulls=True).over(same.rowsBetween(Window.unboundedPreceding, 0)).alias("ids"))


def blocks_of(docs: DataFrame, pattern: str) -> DataFrame:
    """block, doc_id, n, words, at: about BLOCK_BYTES of text each. ``words`` are the block's distinct words, the most frequent
    first; ``at`` holds the numbers, from 1, of all words of its documents, 0 standing for the next of those that come once,
    and ``n`` how many each document has. ``block`` is a hash of ``words``,
    so a task that runs again after a loss can only ask for what it asked before, in whatever order its rows come.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        split = regex.compile(pattern).findall
        known, ids, n, at, size = Numbered(), [], [], [], 0

        def out() -> pa.RecordBatch:
            all_at = np.concatenate(at)
            at.clear()
            counts = np.bincount(all_at, minlength=len(known))
            order = np.argsort(-counts, kind="stable")
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(1, len(order) + 1)
            rank[counts == 1] = 0
            words = [w.encode() for w in known]
            words = [words[i] for i in order]
            all_at = rank[all_at].astype("<u4", copy=False)
            planes = np.ascontiguousarray(all_at.view(np.uint8).reshape(-1, 4).T)
            key = xxhash.xxh64(b"\0".join(words))
            key.update(np.array(list(map(len, words)), "<i8").tobytes())
            columns = [pa.array([np.uint64(key.intdigest()).astype(np.int64)]), pa.array([ids], pa.list_(pa.int64())), pa.array([n], pa.list_(pa.int64())), pa.array([packed_words(words)], pa.binary()), pa.array([pa.Codec("zstd", ZSTD).compress(planes, asbytes=True)], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["block", "doc_id", "n", "words", "at"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                t = text.as_py() or ""
                found = split(t)
                ids.append(doc_id)
                n.append(len(found))
                at.append(np.fromiter(map(known.__getitem__, found), np.uint32, len(found)))
                size += len(t.encode()) + 8
                if size >= BLOCK_BYTES:
                    yield out()
                    known, ids, n, at, size = Numbered(), [], [], [], 0
        if ids:
            yield out()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "block long, doc_id array<long>, n array<long>, words binary, at binary").repartition("block")


def spread(starts: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the items of the runs ``which``, one run after the other, and where each of these begins and the last ends."""
    of = sizes[which]
    ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(of)])
    return np.repeat(starts[which] - ends[:-1], of) + np.arange(ends[-1]), ends


def fold_documents(docs: DataFrame, ranks: dict[bytes, int], pattern: str, full: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row, with ``full`` also ids (array<int>) and decoded (binary).

    Each match of ``pattern`` is encoded separately, without special tokens; ids are decoded by joining their pieces. Null
    and empty texts have no ids; repeated rows give a row each; texts of any length are encoded whole; an empty table
    gives no rows. Words of more than LONG bytes, for which a fold over arrays is quadratic, are merged with a heap when
    their block is put together. Shuffled are the blocks, once, and each block's distinct words and their ids.
    """
    if not {bytes([i]) for i in range(256)} <= set(ranks):
        raise ValueError("the vocabulary lacks single bytes")
    blocks = blocks_of(docs, pattern)
    width = (max(ranks.values()).bit_length() + 7) // 8
    answers = answered(asked(blocks), rank_map(docs.sparkSession, ranks), width).groupBy("block").agg(F.collect_list("i").alias("i"), F.collect_list("ids").alias("ids"))
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * full
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = {r: p for p, r in ranks.items()}
        pieces = [pieces.get(i, b"") for i in range(max(pieces) + 1)]
        piece_sizes = np.array(list(map(len, pieces)), np.int64)
        piece_starts, piece_bytes = np.cumsum(piece_sizes) - piece_sizes, np.frombuffer(b"".join(pieces), np.uint8)
        for batch in batches:
            for b in range(batch.num_rows):
                words, known = opened_words(batch.column("words")[b]), batch.column("ids")[b]
                starts, sizes = np.zeros(len(words), np.int64), np.full(len(words), -1, np.int64)
                flat = np.zeros(0, np.uint32)
                if known.is_valid:
                    i, ids = batch.column("i")[b].values.to_numpy(), known.values
                    lengths = pc.binary_length(ids).to_numpy().astype(np.int64) // width
                    starts[i], sizes[i] = np.cumsum(lengths) - lengths, lengths
                    for byte in np.frombuffer(b"".join(ids.to_pylist()), np.uint8).reshape(-1, width).T:
                        flat = (flat << 8 | byte) if len(flat) else byte.astype(np.uint32)
                rest = np.flatnonzero(sizes < 0)
                if (pc.binary_length(words).to_numpy()[rest] <= LONG).any():
                    raise ValueError("a word of a block has no ids")
                more = [fold_word(w, ranks) for w in words.take(pa.array(rest)).to_pylist()]
                sizes[rest] = list(map(len, more))
                starts[rest] = len(flat) + np.cumsum(sizes[rest]) - sizes[rest]
                flat = np.concatenate([flat, np.array([i for ids in more for i in ids], np.uint32)])
                ends = np.cumsum(batch.column("n")[b].values.to_numpy())
                total = int(ends[-1])
                at = np.frombuffer(pa.decompress(batch.column("at")[b].as_buffer(), total * 4, "zstd"), np.uint8).reshape(4, total) if total else np.zeros((4, 0), np.uint8)
                alone = len(words) - int(np.count_nonzero(~at.any(0)))
                made: list[list] = [[] for _ in names]
                hashes, parts, n_tokens, begin, doc, ids_of = (hashlib.sha256(), hashlib.sha256()), [], 0, 0, 0, batch.column("doc_id")[b].values
                while doc < len(ends):
                    upto = min(begin + CHUNK, total)
                    which = np.ascontiguousarray(at[:, begin:upto].T).view("<u4").ravel().astype(np.int64) - 1
                    once = np.flatnonzero(which < 0)
                    which[once] = alone + np.arange(len(once))
                    alone += len(once)
                    places, word_ends = spread(starts, sizes, which)
                    ids = flat[places]
                    places, piece_ends = spread(piece_starts, piece_sizes, ids)
                    raw, text = ids.astype("<u4").tobytes(), piece_bytes[places].tobytes()
                    low = 0
                    while doc < len(ends):
                        high = int(word_ends[min(int(ends[doc]), upto) - begin])
                        one = raw[low * 4 : high * 4], text[int(piece_ends[low]) : int(piece_ends[high])]
                        hashes[0].update(one[0])
                        hashes[1].update(one[1])
                        n_tokens += high - low
                        if full:
                            parts.append(one)
                        low = high
                        if ends[doc] > upto:
                            break
                        row = [ids_of[doc].as_py(), n_tokens, hashes[0].hexdigest(), hashes[1].hexdigest()]
                        row += [np.frombuffer(b"".join(p[0] for p in parts), "<u4").astype(np.int32), b"".join(p[1] for p in parts)] * full
                        for m, v in zip(made, row, strict=False):
                            m.append(v)
                        hashes, parts, n_tokens, doc = (hashlib.sha256(), hashlib.sha256()), [], 0, doc + 1
                    begin = upto
                yield pa.RecordBatch.from_arrays([pa.array(m, k) for m, k in zip(made, kinds, strict=False)], names)

    kept = blocks.join(answers, "block", "left").select("doc_id", "n", "words", "at", "i", "ids")
    return kept.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded binary" * full)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold_documents(table(spark, sf_dir, "documents"), *default_vocabulary())


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: what op7 returns, of the documents that are left: a row for each, repeated rows included; null
    and empty texts have no ids; other columns are not read; an empty table gives no rows."""
    return fold_documents(docs, *default_vocabulary())
