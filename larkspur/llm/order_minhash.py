"""Near-dedup by Order MinHash (Marcais et al. 2019): each sketch samples several minimum occurrence-labelled k-mers of words
and keeps them in text order; documents that share a sketch are candidates, verified by banded alignment alone."""

from __future__ import annotations

import math
import string
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import fits, fresh, join_hot, materialize, row_id, ship, small_side, table, with_columns_of
from larkspur.llm.components import connected

ship(__name__)

#: The least similarity: 1 - edits / words of the longer text, an edit being a word put in, left out or replaced.
SIMILARITY = 0.8
#: Words of a k-mer, k-mers that a sketch samples, sketches, and words of a text at most that has them. A text edited in
#: every seventh word has few five-word k-mers whole and a short one few triples in order, hence the second and third kind.
KINDS = ((5, 3, 24, 2**31), (3, 3, 32, 2**31), (3, 2, 16, 48))
#: Texts of so many words at most also have exact keys, which no linked pair of them can miss.
EXACT = 14
#: Buckets of more documents are compared in blocks; up to it as single pairs.
BUCKET = 32
#: Documents compared with one leader in one part at most, documents of a block, and words of a part or block, and of a unit that is verified at a time (one group at least).
MEMBERS, BLOCK, GROUP_WORDS, UNIT_WORDS = 64, 2048, 1_000_000, 250_000
#: Times that texts are compared with leaders before what is left is compared in full.
ROUNDS = 2
#: Words that occur more often in a text are found by one long integer, others by their places.
OFTEN = 24

_ODD = np.random.default_rng(41).integers(1, 2**63, max(n for _, _, n, _ in KINDS), np.uint64) * np.uint64(2) + np.uint64(1)
_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_MOST = np.uint64(2**64 - 1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _C2
    x = (x ^ (x >> np.uint64(27))) * _C3
    return x ^ (x >> np.uint64(31))


class Words(dict):
    """32-bit hash of a word in lower case without punctuation at its ends; 0 if nothing is left."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        bare = word.lower().strip(string.punctuation)
        self[word] = h = (xxhash.xxh64_intdigest(bare.encode("utf-8", "surrogatepass")) >> 32 | 1) if bare else 0
        return h


def words_of(text: str | None, known: Words) -> np.ndarray:
    w = (text or "").split()
    w = np.fromiter(map(known.__getitem__, w), np.uint32, len(w))
    return w[w != 0]


def kmers(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-mers in text order; one for the whole text if it is shorter, none without words."""
    if not len(words):
        return np.zeros(0, np.uint64)
    w, k = words.astype(np.uint64), min(k, len(words))
    s = np.zeros(len(w) - k + 1, np.uint64)
    for j in range(k):
        s = s * _C1 + w[j : len(w) - k + 1 + j]
    return mixed(s)


def labelled(s: np.ndarray, of: np.ndarray | None = None) -> np.ndarray:
    """Each hash with its number among its equals, of the same text if ``of`` names the text of each: no two are equal there."""
    n = len(s)
    own = s if of is None else mixed(s ^ mixed(of.astype(np.uint64) * _C3 + _C1))
    order = np.argsort(own, kind="stable")
    run = own[order]
    fresh = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
    nth = np.empty(n, np.uint64)
    nth[order] = (np.arange(n) - np.repeat(fresh, np.diff(np.append(fresh, n)))).astype(np.uint64)
    return mixed(s + nth * _C1)


def sketch(s: np.ndarray, sampled: int, sketches: int) -> np.ndarray:
    """Bucket keys of a text's k-mers: under each of several orders, its ``sampled`` least labelled k-mers as they follow in the text."""
    n, marked = len(s), labelled(s)
    at, some = np.empty((sketches, min(sampled, n)), np.int64), max(1, 1_000_000 // n)  # a few orders at a time for long texts
    for i in range(0, sketches, some):
        v = marked[None] * _ODD[i : min(i + some, sketches), None]
        for j in range(at.shape[1]):
            least = v.argmin(1)
            at[i : i + some, j] = least
            v[np.arange(len(v)), least] = _MOST
    at.sort(1)
    key = np.arange(1, sketches + 1, dtype=np.uint64) * _C3
    for j in range(at.shape[1]):
        key = mixed(key * _C1 + s[at[:, j]])
    return key


def exact_keys(words: np.ndarray) -> np.ndarray:
    """Keys of a short text's words, and of these with as many left out as may differ from a similar one; none of a longer text.

    Of two texts that are linked each has at most 1 - SIMILARITY of its words besides those that both have in order, so
    what they have in order is a key of both.
    """
    n = len(words)
    if n > EXACT:
        return np.zeros(0, np.uint64)
    keys = []
    for gone in range(allowed(n) + 1):
        left = words.astype(np.uint64)[np.array(list(combinations(range(n), n - gone)))]
        key = np.full(len(left), _C2 + np.uint64(n - gone))
        for j in range(n - gone):
            key = mixed(key * _C1 + left[:, j])
        keys.append(key)
    return np.concatenate(keys)


def keys_of(words: np.ndarray) -> np.ndarray:
    """All bucket keys of a text, each once."""
    keys, grams = [exact_keys(words)], {k: kmers(words, k) for k, _, _, _ in KINDS}
    for i, (k, sampled, sketches, longest) in enumerate(KINDS):
        if len(words) <= longest:
            keys.append(mixed(sketch(grams[k], sampled, sketches) + np.uint64(i)))
    return np.unique(np.concatenate(keys))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, rid, h, text: a row is known by rid and h, the hash of its text, as several texts may have one doc_id."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).select("doc_id", row_id().alias("rid"), F.xxhash64("text").alias("h"), "text")


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, rid, h, node, size, sketch: node is a hash of the word sequence (null without words), equal for equal texts; size counts its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                b = batch.slice(start, 1000)
                nodes, sizes, keys = [], [], []
                for t in b.column("text"):
                    w = words_of(t.as_py(), known)
                    nodes.append(xxhash.xxh64_intdigest(w.tobytes()) - 2**63 if len(w) else None)
                    sizes.append(len(w))
                    keys.append(keys_of(w).view(np.int64) if len(w) else None)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "rid", "h")), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "rid", "h", "node", "size", "sketch"])

    return keyed(docs).mapInArrow(run, "doc_id long, rid long, h long, node long, size int, sketch array<long>")


def word_hashes(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, words (array<int>) of the texts whose rid and h are those of a node in ``nodes`` (rid, h)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                b = batch.slice(start, 1000)
                found = [words_of(t.as_py(), known) for t in b.column("text")]
                node = [xxhash.xxh64_intdigest(w.tobytes()) - 2**63 for w in found]
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array([w.view(np.int32) for w in found], pa.list_(pa.int32()))], ["node", "words"])

    found = keyed(docs).join(small_side(nodes.select("rid", "h")), ["rid", "h"], "left_semi").select("text").mapInArrow(run, "node long, words array<int>")
    return found.groupBy("node").agg(F.first("words").alias("words"))


def allowed(words: int) -> int:
    """Edits that a link may have, by the longer text's words."""
    return int((1 - SIMILARITY) * words + 1e-9)


def aligned(a: np.ndarray, b: np.ndarray, most: int) -> bool:
    """Whether the edit distance of two word sequences is ``most`` at most.

    The alignment is banded: only diagonals that a way of ``most`` edits can reach are computed, and a column of the band is
    one long integer of differences between neighbours (Myers 1999, Hyyrö 2003), so a step costs band / 64 machine words.
    """
    if len(a) < len(b):
        a, b = b, a
    gap = len(a) - len(b)
    if gap > most:
        return False
    k = len(b)
    other = np.flatnonzero(a[:k] != b)
    head = int(other[0]) if len(other) else k
    other = np.flatnonzero(a[gap + head :][::-1] != b[head:][::-1])
    tail = int(other[0]) if len(other) else k - head
    a, b = a[head : len(a) - tail].tolist(), b[head : k - tail].tolist()
    if not b:
        return True
    # Bit q of column j stands for row j - reach + q, its last one for the diagonal gap + reach.
    reach = (most - gap) // 2
    width = gap + 2 * reach + 1
    mask, goal, score = (1 << width) - 1, gap + reach, gap
    places: dict[int, list[int]] = {}
    for i, x in enumerate(a):
        places.setdefault(x, []).append(i)
    whole = {x: sum_of_bits(at) for x, at in places.items() if len(at) > OFTEN}
    up, down = mask ^ ((1 << reach) - 1), 0  # where a row is one more, or one less, than the row before
    for j, x in enumerate(b):
        base, same = j - reach, 0
        if x in whole:
            same = (whole[x] >> base if base >= 0 else whole[x] << -base) & mask
        else:
            for i in places.get(x, ()):
                if 0 <= i - base < width:
                    same |= 1 << (i - base)
        free = ((((same & up) + up) ^ up) | same | down) & mask  # no edit from the diagonal's last cell
        if not free >> goal & 1:
            score += 1
            if score > most:
                return False
        right, left = down | (mask & ~(free | up)), free & up
        up, down = left | (mask & ~((free >> 1) | right)), (free >> 1) & right
    return True


def sum_of_bits(at: list[int]) -> int:
    bits = np.zeros(at[-1] + 1, np.uint8)
    bits[at] = 1
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def single_words(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Labelled words of each text, one text after the other, and where each begins (and the last ends)."""
    sizes = np.array([len(w) for w in words], np.int64)
    return labelled(np.concatenate(words).astype(np.uint64), np.repeat(np.arange(len(words)), sizes)), np.concatenate([[0], np.cumsum(sizes)])


def pairs_of_words(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Labelled pairs of neighbouring words of each text, one after the other, and where each text begins (and the last ends).

    A text of one word has its word instead, so none is empty.
    """
    sizes = np.array([len(w) for w in words], np.int64)
    flat, of = np.concatenate(words).astype(np.uint64), np.repeat(np.arange(len(words)), sizes)
    last = np.cumsum(sizes) - 1
    following = np.append(flat[1:], np.uint64(0))
    following[last] = 0
    keep = np.ones(len(flat), bool)
    keep[last[sizes > 1]] = False
    flat, of = mixed(mixed(flat * _C1) + following)[keep], of[keep]
    return labelled(flat, of), np.concatenate([[0], np.cumsum(np.maximum(sizes - 1, 1))])


def unit_links(part: pd.DataFrame) -> pd.DataFrame:
    """Links between leaders (side 0) and others (2) of each ``group``, 1 being both, until all that can are joined.

    An edit takes one word away and breaks two pairs of neighbouring words, so texts that have too few of either in common
    cannot be linked; every other pair of different components is aligned.
    """
    part = part.drop_duplicates(["group", "node", "side"]).sort_values(["group", "side", "node"], kind="stable")
    nodes, side, comp, group = part["node"].tolist(), part["side"].to_numpy(), part["component"].tolist(), part["group"].to_numpy()
    words = [np.asarray(w, np.int32).view(np.uint32) for w in part["words"]]
    size = np.array([len(w) for w in words])
    bags = []  # number of each word, or pair, in its text's place, and where each text begins
    for shared, start in (single_words(words), pairs_of_words(words)):
        vocab, at = np.unique(shared, return_inverse=True)
        bags.append((at, start, np.zeros(len(vocab), np.int64)))
    parent = {c: c for c in comp}

    def find(c: int) -> int:
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    def common(bag: tuple, i: int, low: int, high: int) -> np.ndarray:
        at, start, mark = bag
        mine = at[start[i] : start[i + 1]]
        mark[mine] = 1
        both = np.add.reduceat(mark[at[start[low] : start[high]]], start[low:high] - start[low])
        mark[mine] = 0
        return both

    out = []
    begins = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    for low, high in zip(begins, np.append(begins[1:], len(group)), strict=True):
        others = low + int((side[low:high] == 0).sum())  # sides are sorted
        for i in range(low, others + int((side[low:high] == 1).sum())):
            first = max(others, i + 1)  # two that are both meet once
            if first == high:
                continue
            longer, shorter = np.maximum(size[first:high], size[i]), np.minimum(size[first:high], size[i])
            most = ((1 - SIMILARITY) * longer + 1e-9).astype(np.int64)
            fits = longer - shorter <= most
            if fits.any():
                fits &= common(bags[0], i, first, high) >= longer - most
            if fits.any():
                fits &= common(bags[1], i, first, high) >= longer - 1 - 2 * most
            for j in np.flatnonzero(fits):
                p, q = find(comp[i]), find(comp[first + j])
                if p != q and aligned(words[i], words[first + j], int(most[j])):
                    parent[q] = p
                    out.append((nodes[i], nodes[first + j]))
    return pd.DataFrame(out, columns=["a", "b"]).astype("int64")


def verified(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Links of groups: ``rows`` has group, node, size, side and component. Groups are dealt over units of about UNIT_WORDS."""
    rows = materialize(rows)
    units = max(1, math.ceil((rows.agg(F.sum("size")).first()[0] or 0) / UNIT_WORDS))
    counts = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    rows = join_hot(rows.drop("size"), texts, ["node"], counts=counts).withColumn("unit", F.pmod(F.xxhash64("group"), F.lit(units)))
    return materialize(rows.groupBy("unit").applyInPandas(unit_links, "a long, b long"))


def led(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Links among ``pairs`` (lead, node, lead_size, size, lead_component, component); a leader's members are dealt over several groups."""
    many = pairs.groupBy("lead").agg(F.count(F.lit(1)).alias("n"), F.greatest(F.ceil(F.count(F.lit(1)) / MEMBERS), F.ceil(F.sum("size") / GROUP_WORDS)).cast("int").alias("parts"))
    dealt = join_hot(pairs, materialize(many), ["lead"]).withColumn("group", F.xxhash64("lead", F.pmod(F.xxhash64("node"), F.col("parts"))))
    sides = [F.struct(F.col("lead").alias("node"), F.col("lead_size").alias("size"), F.lit(0).alias("side"), F.col("lead_component").alias("component")), F.struct("node", "size", F.lit(2).alias("side"), "component")]
    rows = dealt.select("group", F.explode(F.array(*sides)).alias("x")).select("group", "x.*")
    return verified(rows.groupBy("group", "node", "side").agg(F.first("size").alias("size"), F.min("component").alias("component")), texts)


def near_in_length(a: Column, b: Column) -> Column:
    return F.greatest(a, b) - F.least(a, b) <= F.floor((1 - SIMILARITY) * F.greatest(a, b) + 1e-9)


def divided(entries: DataFrame, groups: DataFrame) -> DataFrame:
    """bucket, node, size, component of the buckets whose members are of several components, each with their number n,
    their words, and the least component (lo). Of buckets with equal members there is one."""
    rows = entries.select("bucket", "node", "size").join(small_side(groups), "node", "left").withColumn("component", F.coalesce("component", "node"))
    of = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y"))
    of = of.where("lo <> hi").groupBy("x", "y", "n", "words", "lo").agg(F.min("bucket").alias("bucket"))
    of = materialize(of.drop("x", "y").withColumn("size_of", F.col("n")))
    return materialize(join_hot(rows, of, ["bucket"]).withColumnRenamed("size_of", "n"))


def with_leads(rows: DataFrame, seed: int) -> DataFrame:
    """Pairs for ``led``: each of ``rows`` (bucket, n, node, size, component) with a lead of its bucket, drawn by ``seed``, if they
    are of different components and of lengths that can be linked."""
    least = [F.min_by(c, F.xxhash64(F.lit(seed), "node")).alias(f"lead{of}") for c, of in (("node", ""), ("size", "_size"), ("component", "_component"))]
    leads = materialize(rows.groupBy("bucket").agg(F.max("n").alias("n"), *least))
    pairs = join_hot(rows.select("bucket", "node", "size", "component"), leads, ["bucket"]).where((F.col("component") != F.col("lead_component")) & near_in_length(F.col("size"), F.col("lead_size")))
    return materialize(pairs.groupBy("lead", "node").agg(*[F.first(c).alias(c) for c in ("lead_size", "size", "lead_component", "component")]))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, rid, h, class_id, class_text, kept of every row of ``docs`` (doc_id, text; other columns are not read).

    Two texts are linked if they share a bucket key and the words of the longer are kept but for 1 - SIMILARITY of them in
    edits. Classes are the connected texts, named by the smallest doc_id in them (class_id) and, as several texts may have
    that, the hash of its text (class_text); the row of that name is kept. Words are lower-cased and stripped of
    punctuation at their ends; texts with equal words are one node. Null and empty texts, and those of punctuation only,
    are classes of their own. A doc_id with several texts is several rows; rows without doc_id are numbered by their text;
    equal rows share a class and are all kept or none. Very long texts are sketched and aligned whole. An empty table gives no rows.

    Texts are first compared with leaders of their buckets, ROUNDS times, a number of pairs in proportion to the rows: the
    first time with the least leader alone. What that leaves in several components is compared in full, texts of lengths
    that can be linked with each other: single pairs in small buckets; in large ones, blocks of the texts outside the
    bucket's first component against blocks of those in it and against each other.
    """
    rows = materialize(sketched(docs))
    nodes = rows.where("node is not null").groupBy("node").agg(F.min(F.struct("rid", "h")).alias("first"), F.count(F.lit(1)).alias("n"), F.min("size").alias("size"), F.min("sketch").alias("sketch"))
    nodes = materialize(nodes.select("node", "first", "n", "size", "sketch"))
    entries = nodes.select(F.explode("sketch").alias("bucket"), "node", "size")
    shared = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("lead"), F.min_by("size", "node").alias("lead_size")).where("n > 1")
    shared = materialize(shared.select("bucket", "n", "lead", "lead_size", (F.col("n") == 2).alias("pair")))
    entries = materialize(join_hot(entries, shared, ["bucket"]))
    needed = materialize(nodes.join(entries.select("node").distinct(), "node", "left_semi").select("first.*"))
    texts = materialize(word_hashes(docs, needed))

    star = entries.groupBy("node", "size").agg(F.min("lead").alias("lead"), F.min_by("lead_size", "lead").alias("lead_size"))
    star = star.where("node <> lead").where(near_in_length(F.col("size"), F.col("lead_size"))).withColumn("lead_component", F.col("lead")).withColumn("component", F.col("node"))
    links = led(materialize(star), texts)
    groups = materialize(connected(links))
    # Texts that can be linked lie in the same class of lengths or in neighbouring ones.
    length = F.floor(F.log("size") / -math.log(SIMILARITY - 1e-6)).cast("int")
    left = entries.where("not pair").select("bucket", "node", "size", F.explode(F.array(length, length + 1)).alias("length")).select(F.xxhash64("bucket", "length").alias("bucket"), "node", "size")
    left = divided(left.union(entries.where("pair").select("bucket", "node", "size")), groups)
    for k in range(1, ROUNDS):
        links = materialize(links.union(led(with_leads(left, k), texts)))
        groups = materialize(connected(links))
        left = divided(left, groups)

    few = left.where(F.col("n") <= BUCKET).groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("node", "size", "component"))).alias("all"))
    later = F.transform(F.col("all"), lambda x, i: F.struct(x.alias("a"), F.filter(F.slice("all", i + 2, BUCKET), lambda y: (y["component"] != x["component"]) & near_in_length(x["size"], y["size"])).alias("rest")))
    pairs = few.select(F.explode(later).alias("p")).select("p.a", F.explode("p.rest").alias("b"))
    pairs = pairs.select(F.col("a.node").alias("lead"), F.col("a.size").alias("lead_size"), F.col("b.node").alias("node"), F.col("b.size").alias("size"), F.col("a.component").alias("lead_component"), F.col("b.component").alias("component")).distinct()
    more = led(materialize(pairs), texts)

    # Blocks i of the texts outside the bucket's first component meet blocks j of those in it, and each other.
    stray = F.col("component") != F.col("lo")
    many = left.where(F.col("n") > BUCKET)
    outside = [F.sum(F.when(stray, x).otherwise(0)) for x in (F.lit(1), F.col("size"))]
    blocks = many.groupBy("bucket").agg(F.max("n").alias("n"), F.ceil(F.greatest(outside[0] / BLOCK, outside[1] / GROUP_WORDS)).cast("int").alias("is"), F.ceil(F.greatest((F.max("n") - outside[0]) / BLOCK, (F.max("words") - outside[1]) / GROUP_WORDS)).cast("int").alias("js"))
    many = many.select("bucket", "node", "size", "component", stray.alias("stray"))
    many = materialize(join_hot(many, materialize(blocks), ["bucket"]))
    own = lambda of: F.pmod(F.xxhash64(F.lit(2), "node"), F.col(of))
    inside = many.where("not stray").select("bucket", F.explode(F.sequence(F.lit(0), F.col("is") - 1)).alias("i"), own("js").alias("j"), "node", "size", F.lit(2).alias("side"), "component")
    out = many.where("stray").withColumn("own", own("is")).withColumn("to", F.explode(F.sequence(F.lit(0), F.col("js") + F.col("is") - 1))).withColumn("other", F.col("to") - F.col("js"))
    against = out.where("other < 0").select("bucket", F.col("own").alias("i"), F.col("to").alias("j"), "node", "size", F.when(F.col("to") == 0, 1).otherwise(0).alias("side"), "component")
    among = out.where("other >= 0 and other <> own").select("bucket", F.least("own", "other").alias("i"), (-1 - F.greatest("own", "other")).alias("j"), "node", "size", F.when(F.col("own") < F.col("other"), 0).otherwise(2).alias("side"), "component")
    units = inside.union(against).union(among).select(F.xxhash64("bucket", "i", "j").alias("group"), "node", "size", "side", "component")
    most = verified(units, texts)

    groups = materialize(connected(links.union(more).union(most)))
    named = nodes.select("node", "first", F.col("n").alias("rows")).join(small_side(groups), "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = materialize(named.groupBy("component").agg(F.min("first").alias("class"), F.count(F.lit(1)).alias("n")))
    named = materialize(join_hot(named, least, ["component"]).select("node", "rows", "class.*").toDF("node", "n", "class_id", "class_text"))
    out = rows.select("doc_id", "rid", "h", "node")
    out = out.join(F.broadcast(named.drop("n")), "node", "left") if fits(named) else join_hot(out, named, ["node"], "left")
    out = out.withColumn("class_id", F.coalesce("class_id", "rid")).withColumn("class_text", F.coalesce("class_text", "h"))
    return out.select("doc_id", "rid", "h", "class_id", "class_text", ((F.col("rid") == F.col("class_id")) & (F.col("h") == F.col("class_text"))).alias("kept"))


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "kept", "class_text")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each class of near copies one row stays, that with the smallest doc_id.

    Rows are told apart by doc_id and text, so a text stays whatever other text has its doc_id. Of equal rows (doc_id and
    text, nulls included) one stays. Texts without words are near copies of nothing; other columns, whatever their names,
    are carried along; an empty table stays empty.
    """
    on = [fresh(docs, "__rid"), fresh(docs, "__h")]
    found = materialize(near_duplicates(docs).select(F.col("rid").alias(on[0]), F.col("h").alias(on[1]), "kept"))
    gone = materialize(found.where("not kept").select(*on).distinct())
    rows = docs.withColumn(on[0], row_id()).withColumn(on[1], F.xxhash64(F.col("text").cast("string")))
    rows = rows.join(small_side(gone), on, "left_anti")
    twice = materialize(found.where("kept").groupBy(*on).count().where("count > 1").select(*on))
    if twice.limit(1).count():  # repeated rows: one of each stays
        twice = small_side(twice)
        rows = rows.join(twice, on, "left_anti").unionByName(rows.join(twice, on, "left_semi").dropDuplicates(on))
    return with_columns_of(rows, docs)
