"""Quality rules whose thresholds adapt: mergeable quantile sketches per language and source instead of fixed cutoffs."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.llm.common import materialize, ship, small_side, table

ship(__name__)

BLANKS, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
#: The outer deciles and the median are what a fence is made of: it lies FENCE times their distance beyond a decile.
LOW, MIDDLE, HIGH, FENCE = 1, 5, 9, 4
#: A group's quantiles are drawn to those of its language, and a language's to those of the corpus, with the weight of so many documents.
SHRINK = 50
#: Metrics in thousandths. A rate of counted events is held against its fence by what it is at least if its count was as
#: much too high by chance as NOISE standard deviations allow: few events in a short text say little.
METRICS = ("mean_word", "symbol_rate", "dup_line_rate", "repeat_rate")
NOISE = 2.0
#: Count, base, and counts that one event makes, of each metric that is a rate.
EVENTS = {"symbol_rate": ("n_symbols", "n_words", 1), "dup_line_rate": ("n_dup_lines", "n_lines", 1), "repeat_rate": ("n_repeat_words", "n_words", 6)}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
#: Bytes of a text that are split at a time.
CHUNK = 1 << 20
_BLANK = re.compile(rb"[ \t-\r]")


def word_numbers(text: str) -> np.ndarray:
    """The words of a text as numbers of the distinct ones; the words themselves are only held once each."""
    raw, known, parts, at = text.encode("utf-8", "surrogatepass"), {}, [np.zeros(0, np.int64)], 0
    while at < len(raw):
        end = _BLANK.search(raw, at + CHUNK)
        end = end.start() if end else len(raw)
        some = raw[at:end].split()
        parts.append(np.fromiter((known.setdefault(w, len(known)) for w in some), np.int64, len(some)))
        at = end
    return np.concatenate(parts)


def measure(text: str | None) -> tuple[int, ...]:
    """The values of COUNTS; n_lines counts lines with a word."""
    if not text:
        return (0,) * len(COUNTS)
    words = word_numbers(text)
    seen: set[int] = set()
    full = dup = 0
    for line in text.split("\n"):
        if line.strip(BLANKS):
            full += 1
            h = xxhash.xxh3_128_intdigest(line.encode("utf-8", "surrogatepass")) if len(line) > 32 else line
            dup += h in seen
            seen.add(h)
    repeated, n = 0, len(words)
    if n > 2:
        many = int(words.max()) + 1
        pair = np.unique(words[:-2] * many + words[1:-1], return_inverse=True)[1]
        _, which, times = np.unique(pair * many + words[2:], return_inverse=True, return_counts=True)
        again = np.flatnonzero(times[which] > 1)
        step = np.zeros(n + 1, np.int64)
        np.add.at(step, again, 1)
        np.add.at(step, again + 3, -1)
        repeated = int((np.cumsum(step) > 0).sum())
    return n, len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), dup, repeated, full


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and COUNTS of every row."""
    names = ("doc_id", "lang", "source")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [measure(t.as_py()) for t in b.column("text")]
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * len(COUNTS)
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), *columns], [*names, *COUNTS])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("text"))
    return rows.mapInArrow(run, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS))


def with_metrics(rows: DataFrame) -> DataFrame:
    words, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    ratio = lambda n, of: F.floor(F.col(n) * 1000 / of).cast("long")
    rows = rows.withColumn("mean_word", ratio("word_chars", words)).withColumn("symbol_rate", ratio("n_symbols", words)).withColumn("dup_line_rate", ratio("n_dup_lines", lines)).withColumn("repeat_rate", ratio("n_repeat_words", words))
    return rows.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def sketch(rows: DataFrame) -> DataFrame:
    """lang, source, metric, bucket, n: histograms over the three leading digits, a relative error below 1 % at any size.

    Two sketches merge by adding counts, in any order, so partial results of tasks, sources and days combine exactly.
    """
    long = rows.select("lang", "source", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in METRICS])).alias("x")).select("lang", "source", "x.*")
    unit = F.pow(F.lit(10), F.greatest(F.length(F.col("v").cast("string")) - 3, F.lit(0))).cast("long")
    return long.groupBy("lang", "source", "metric", (F.col("v") - F.col("v") % unit).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def quantiles(merged: DataFrame, by: list[str]) -> DataFrame:
    """One row for each group: docs, and lo_M, mid_M and hi_M, two deciles and the median, of each metric M."""
    merged = merged.groupBy(*by, "metric", "bucket").agg(F.sum("n").alias("n"))
    upto = Window.partitionBy(*by, "metric").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    merged = merged.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(Window.partitionBy(*by, "metric")))
    at = [F.min(F.when(10 * F.col("upto") >= q * F.col("all"), F.col("bucket"))).alias(n) for q, n in ((LOW, "lo"), (MIDDLE, "mid"), (HIGH, "hi"))]
    q = merged.groupBy(*by, "metric").agg(F.max("all").alias("docs"), *at)
    return q.groupBy(*by).agg(F.max("docs").alias("docs"), *[F.max(F.when(F.col("metric") == m, F.col(x))).alias(f"{x}_{m}") for m in METRICS for x in ("lo", "mid", "hi")])


def shrunk(own: DataFrame, wider: DataFrame, on: list[str]) -> DataFrame:
    """The quantiles of ``own`` drawn to those of the ``wider`` groups that hold them; without ``on``, of the one there is."""
    if on:
        w = wider.select(*[F.col(c).alias(f"__{c}") for c in wider.columns])
        rows = own.join(small_side(w), [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in on])
    else:
        one = wider.first() or {c: None for c in wider.columns}
        rows = own.withColumns({f"__{c}": F.lit(one[c]).cast("long") for c in wider.columns})
    names = [c for c in own.columns if c[:3] in ("lo_", "mid", "hi_")]
    return materialize(rows.select(*[F.expr(f"(docs * {c} + {SHRINK} * __{c}) div (docs + {SHRINK})").alias(c) if c in names else F.col(c) for c in own.columns]))


def at_least(metric: str) -> Column:
    """A rate, in thousandths, less the noise of its count."""
    count, base, unit = EVENTS[metric]
    root = F.greatest(F.sqrt(F.col(count) / F.lit(float(unit))) - NOISE, F.lit(0.0))
    return F.floor(root * root * float(1000 * unit) / F.greatest(base, F.lit(1))).cast("long")


def judged(docs: DataFrame) -> DataFrame:
    """COUNTS, metrics, base_failed and kept of every row of ``docs``, whatever its other columns.

    Rows that pass the base rules are sketched by (lang, source). A group's fence for a metric lies FENCE times the distance
    of an outer decile from the median beyond that decile, both taken from the group's sketch, drawn to its language's and
    through that to the corpus' the more the fewer documents it has. A row is kept if its mean word length lies
    within its fences and no rate, less the noise of its count, beyond its upper one. Where nine of ten documents of a group
    have none of something, only documents with more of it than noise are out. Null languages and sources are groups of
    their own; null and empty texts have no words and fail the base; ties and repeated rows count each; a very long text is
    read whole, held as one number a word; an empty table gives no rows.
    """
    rows = materialize(with_metrics(measured(docs)))
    fine = materialize(sketch(rows.where(~F.col("base_failed"))))
    by = ["lang", "source"]
    lang = shrunk(materialize(quantiles(fine, by[:1])), materialize(quantiles(fine, [])), [])
    q = shrunk(materialize(quantiles(fine, by)), lang, by[:1])
    q = materialize(q.select(*[F.col(c).alias(f"__{c}") for c in q.columns]))
    rows = rows.join(small_side(q), F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source")), "left")
    held = F.col("mean_word") >= F.col("__lo_mean_word") - FENCE * (F.col("__mid_mean_word") - F.col("__lo_mean_word"))
    for m in METRICS:
        held &= (at_least(m) if m in EVENTS else F.col(m)) <= F.col(f"__hi_{m}") + FENCE * (F.col(f"__hi_{m}") - F.col(f"__mid_{m}"))
    return rows.withColumn("kept", ~F.col("base_failed") & F.coalesce(held, F.lit(True))).select("doc_id", "lang", "source", *COUNTS, *METRICS, "base_failed", "kept")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents")).select("doc_id", *COUNTS[:5], "base_failed", "kept")


def _sql() -> str:
    long = " union all ".join(f"select lang, source, '{m}' as metric, {m} as v from m where not base_failed" for m in METRICS)
    tables, each = "", [f"{x}_{m}" for m in METRICS for x in ("lo", "mid", "hi")]
    for k, by in enumerate(([], ["lang"], ["lang", "source"])):
        pre = "".join(f"{c}, " for c in by)
        part = f"partition by {pre}metric"
        at = ", ".join(f"min(bucket) filter (where 10 * upto >= {q} * al) as {n}" for q, n in ((LOW, "lo"), (MIDDLE, "mid"), (HIGH, "hi")))
        own = ", ".join(f"max(case when metric = '{m}' then {x} end) as {x}_{m}" for m in METRICS for x in ("lo", "mid", "hi"))
        tables += f""", m{k} as (select {pre}metric, bucket, sum(n) as n from s group by {pre}metric, bucket),
u{k} as (select *, sum(n) over ({part} order by bucket rows unbounded preceding) as upto, sum(n) over ({part}) as al from m{k}),
q{k} as (select {pre}metric, max(al) as docs, {at} from u{k} group by {pre}metric),
t{k} as (select {pre}max(docs) as docs, {own} from q{k} {"group by " + pre[:-2] if by else ""})"""
        wider = "t0" if k == 1 else f"f{k - 1}"
        on = " and ".join(f"t{k}.{c} is not distinct from {wider}.{c}" for c in by[:-1]) or "true"
        if k:
            tables += f""", f{k} as (select {"".join(f"t{k}.{c}, " for c in by)}t{k}.docs, {", ".join(f"(t{k}.docs * t{k}.{c} + {SHRINK} * {wider}.{c}) // (t{k}.docs + {SHRINK}) as {c}" for c in each)} from t{k} join {wider} on {on})"""
    joins = " left join f2 on m.lang is not distinct from f2.lang and m.source is not distinct from f2.source"

    def least(m: str) -> str:
        if m not in EVENTS:
            return f"m.{m}"
        count, base, unit = EVENTS[m]
        root = f"greatest(sqrt({count} / {unit}.0::double) - {NOISE}::double, 0.0::double)"
        return f"floor({root} * {root} * {1000 * unit}.0::double / greatest({base}, 1))"

    held = f"m.mean_word >= lo_mean_word - {FENCE} * (mid_mean_word - lo_mean_word) and " + " and ".join(f"{least(m)} <= hi_{m} + {FENCE} * (hi_{m} - mid_{m})" for m in METRICS)
    return rf"""
with d as (select row_number() over () as r, *, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as words from documents),
w as (select r, unnest(range(1, len(words) - 1)) as i, unnest(list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])) as g from d),
g as (select r, i, count(*) over (partition by r, g) as n from w),
p as (select r, count(distinct i + j) as n_repeat from g, (select unnest([0, 1, 2]) as j) where n > 1 group by r),
l as (select r, line, count(*) as n from (select r, unnest(string_split(text, chr(10))) as line from d) where regexp_matches(line, '[^\x20\x09-\x0D]') group by 1, 2),
u as (select r, sum(n) as n_lines, sum(n - 1) as n_dup from l group by r),
c as (select d.doc_id, d.lang, d.source, len(words)::bigint as n_words, coalesce(length(array_to_string(words, '')), 0)::bigint as word_chars,
      coalesce(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')), 0)::bigint as n_symbols, coalesce(n_dup, 0)::bigint as n_dup_lines,
      coalesce(n_repeat, 0)::bigint as n_repeat_words, coalesce(n_lines, 0)::bigint as n_lines from d left join p using (r) left join u using (r)),
m as (select *, 1000 * word_chars // greatest(n_words, 1) as mean_word, 1000 * n_symbols // greatest(n_words, 1) as symbol_rate,
      1000 * n_dup_lines // greatest(n_lines, 1) as dup_line_rate, 1000 * n_repeat_words // greatest(n_words, 1) as repeat_rate,
      n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from c),
s as (select lang, source, metric, v - v % pow(10, greatest(length(v::varchar) - 3, 0))::bigint as bucket, count(*) as n from ({long}) group by 1, 2, 3, 4){tables}
select m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and coalesce({held}, true) as kept from m{joins}
"""


OP1_SQL = _sql()
