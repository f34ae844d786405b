"""Language ID: a bidirectional gated recurrent network over bytes, trained in numpy by backpropagation through time, labels
every position; the probabilities of a document's positions are pooled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.llm.common import ship, table

ship(__name__)

HIDDEN = 8
#: Bytes of a segment, over which a state runs; a text is cut into as many as it takes, whole.
SEGMENT = 96
#: Segments labelled at a time.
AT_ONCE = 1536
#: The fit: distinct texts of a language at most, bytes of each (a window at a hashed place), and languages at most, the
#: most frequent ones; others are not learned. So the driver gets TRAIN_DOCS * TRAIN_BYTES * TRAIN_LANGS bytes at most.
TRAIN_DOCS, TRAIN_BYTES, TRAIN_LANGS = 400, 480, 200
STEPS, BATCH, RATE, SEED = 700, 192, 0.02, 7


def tanh_gates(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class Network:
    """One gated recurrent unit for each direction and a softmax over both states at every position."""

    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
        self.labels, self.hidden, self.w = labels, hidden, {}
        for d in "fb":
            self.w |= {f"in_{d}": draw(256, 3 * hidden), f"gate_{d}": draw(hidden, 2 * hidden), f"new_{d}": draw(hidden, hidden)}
        self.w |= {"out": draw(2 * hidden, len(labels)), "bias": np.zeros(len(labels), np.float32)}

    def states(self, x: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """States (steps, rows, hidden) of byte columns ``x`` (steps, rows) read in direction ``d``."""
        h, w = self.hidden, self.w
        state = np.zeros((x.shape[1], h), np.float32)
        out = np.empty((*x.shape, h), np.float32)
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            a = w[f"in_{d}"][x[t]]
            g = tanh_gates(a[:, : 2 * h] + state @ w[f"gate_{d}"])
            z, r = g[:, :h], g[:, h:]
            rs = r * state
            new = np.tanh(a[:, 2 * h :] + rs @ w[f"new_{d}"])
            if keep is not None:
                keep.append((t, state, z, r, rs, new))
            state = new + z * (state - new)
            out[t] = state
        return out

    def label(self, x: np.ndarray) -> np.ndarray:
        """Probabilities (steps, rows, labels) of each position."""
        s = self.states(x, "f") @ self.w["out"][: self.hidden] + self.states(x, "b") @ self.w["out"][self.hidden :] + self.w["bias"]
        s = np.exp(s - s.max(2, keepdims=True))
        return s / s.sum(2, keepdims=True)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over positions, and its gradient by every weight, by backpropagation through time."""
        h, w, kept = self.hidden, self.w, {"f": [], "b": []}
        s = np.concatenate([self.states(x, d, kept[d]) for d in "fb"], 2)
        p = s @ w["out"] + w["bias"]
        p = np.exp(p - p.max(2, keepdims=True))
        p /= p.sum(2, keepdims=True)
        n = x.size
        loss = -float(np.log(np.maximum(p[:, np.arange(len(y)), y], 1e-12)).mean())
        p[:, np.arange(len(y)), y] -= 1
        p /= n
        g = {k: np.zeros_like(v) for k, v in w.items()}
        g["out"], g["bias"] = np.einsum("tri,trk->ik", s, p), p.sum((0, 1))
        ds = p @ w["out"].T
        for d, part in (("f", slice(0, h)), ("b", slice(h, 2 * h))):
            later = np.zeros((x.shape[1], h), np.float32)
            for t, state, z, r, rs, new in reversed(kept[d]):
                dh = ds[t][:, part] + later
                dn = dh * (1 - z) * (1 - new * new)
                drs = dn @ w[f"new_{d}"].T
                dg = np.concatenate([dh * (state - new) * z * (1 - z), drs * state * r * (1 - r)], 1)
                later = dh * z + drs * r + dg @ w[f"gate_{d}"].T
                g[f"new_{d}"] += rs.T @ dn
                g[f"gate_{d}"] += state.T @ dg
                np.add.at(g[f"in_{d}"], x[t], np.concatenate([dg, dn], 1))
        return loss, g


def train(samples: list[tuple[bytes, str]], steps: int = STEPS, seed: int = SEED) -> Network | None:
    """A network fitted to (bytes, label); None without samples. Adam with a falling rate, languages drawn equally often."""
    labels = sorted({lab for _, lab in samples})
    if not labels:
        return None
    net, rng = Network(labels, seed=seed), np.random.default_rng(seed)
    by = [[np.frombuffer(s, np.uint8) for s, lab in samples if lab == k and s] for k in labels]
    by = [b or [np.zeros(1, np.uint8)] for b in by]
    m, v, span = {k: np.zeros_like(a) for k, a in net.w.items()}, {k: np.zeros_like(a) for k, a in net.w.items()}, SEGMENT // 2
    for step in range(1, steps + 1):
        y = rng.integers(0, len(labels), BATCH)
        x = np.full((span, BATCH), 32, np.uint8)
        for i, k in enumerate(y):
            s = by[k][rng.integers(len(by[k]))]
            at = rng.integers(0, max(1, len(s) - span + 1))
            cut = s[at : at + span]
            x[: len(cut), i] = cut
        _, g = net.gradients(x, y)
        rate = RATE * (1 - step / (steps + 1))
        for k, a in net.w.items():
            m[k], v[k] = 0.9 * m[k] + 0.1 * g[k], 0.99 * v[k] + 0.01 * g[k] ** 2
            a -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return net


def predict(net: Network | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and pooled probability of each text, read whole."""
    k = len(net.labels) if net else 1
    sums, sizes = np.zeros((len(texts), k)), np.zeros(len(texts))
    waiting: list[tuple[int, np.ndarray]] = []

    def flush(all_: bool) -> None:
        while waiting and (all_ or sum(len(a) for _, a in waiting) >= AT_ONCE * SEGMENT):
            rows, owner, length, took = [], [], [], 0
            while waiting and took < AT_ONCE:
                i, a = waiting.pop(0)
                n = min(AT_ONCE - took, -(-len(a) // SEGMENT))
                head, rest = a[: n * SEGMENT], a[n * SEGMENT :]
                if len(rest):
                    waiting.insert(0, (i, rest))
                padded = np.full(n * SEGMENT, 32, np.uint8)
                padded[: len(head)] = head
                rows.append(padded.reshape(n, SEGMENT))
                owner.append(np.full(n, i))
                length.append(np.minimum(SEGMENT, len(head) - SEGMENT * np.arange(n)))
                took += n
            x, own, size = np.concatenate(rows).T, np.concatenate(owner), np.concatenate(length)
            x = np.ascontiguousarray(x)
            p = net.label(x)
            p[np.arange(SEGMENT)[:, None] >= size[None]] = 0
            np.add.at(sums, own, p.sum(0))
            np.add.at(sizes, own, size)

    for i, t in enumerate(texts):
        if net and t and any(map(str.isalpha, t)):
            waiting.append((i, np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8)))
            if i % 64 == 63:
                flush(False)
    if net:
        flush(True)
    p = sums / np.maximum(sizes, 1)[:, None]
    best = p.argmax(1)
    return [net.labels[b] if s else "und" for b, s in zip(best, sizes, strict=True)], [round(float(p[i, b]), 4) if sizes[i] else 0.0 for i, b in enumerate(best)]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_sample(docs: DataFrame, docs_of_each: int = TRAIN_DOCS, size: int = TRAIN_BYTES, langs: int = TRAIN_LANGS) -> list[tuple[bytes, str]]:
    """A bounded hash sample of rows that are not held out and have a language: ``docs_of_each`` distinct texts of each of the
    ``langs`` most frequent languages at most."""
    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & (F.length("text") > 0))
    h = F.xxhash64(F.lit(23), "text")
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(h).alias("texts")).orderBy(F.desc("n"), "lang").limit(langs).collect()
    if not counts:
        return []
    rate = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, 2 * docs_of_each / max(1, r["texts"]))))])
    at = F.pmod(F.xxhash64(F.lit(29), "text"), F.greatest(F.lit(1), F.length("text") - size // 2)).cast("int") + 1
    # Copies of a text are one before they are dealt out; what is numbered is a few times the sample, on average.
    some = rows.where(F.pmod(h, F.lit(1 << 24)) < F.coalesce(F.element_at(rate, F.col("lang")), F.lit(0.0)) * (1 << 24)).select("lang", h.alias("h"), F.substring(F.col("text"), at, F.lit(size)).alias("cut"))
    some = some.groupBy("lang", "h").agg(F.first("cut").alias("cut"))
    first = some.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 24)), "h"))).where(F.col("k") <= docs_of_each)
    return [(r["cut"].encode("utf-8", "surrogatepass")[:size], r["lang"]) for r in sorted(first.collect(), key=lambda r: (r["lang"], r["k"]))]


def identify(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; only the text is read for a prediction.

    Unless ``net`` is given it is fitted here, on rows that are not held out. Null texts and those without a letter are
    ``und`` with score 0, as is everything if no row can be learned from. A null doc_id is not held out and not learned
    from; of the distinct languages the TRAIN_LANGS most frequent are learned. Repeated rows get equal results; texts are read whole at any length; an empty table gives no rows.
    """
    net = net or train(training_sample(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                b = batch.slice(at, 512)
                langs, scores = predict(net, b.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op9_byte_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
