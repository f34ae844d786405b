"""Secret scans: patterns for known forms, and character Markov models of random strings and ordinary identifiers compared
by log-likelihood ratio. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import materialize, table

#: Fixed patterns of the base kinds, in their order, with the group and the least length that a match must have.
BASE = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]+", 0, 16),
}
#: What the search runs by: maximal runs that are too short cannot hold a longer match, so the length is in the pattern.
SEARCH = {"assign": BASE["assign"][0], "access": r"AKIA[A-Z0-9]{14,}", "hex": r"[0-9a-f]{16,}"}
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Strings that the models judge, and ordinary words they learn from.
JUDGED, ORDINARY = "[A-Za-z0-9+/_=-]{20,}", "[A-Za-z0-9+/_=-]{6,}"
#: Strings of so many characters are judged, so unless a base pattern labels them it is not known what they are.
LONG = 20
#: One of so many labelled strings is held out from the counts; the ordinary ones among them set the threshold.
HELD_OUT = 4
#: Ordinary strings that are scored together as one, and what may stand between them.
JOINED, JOINERS = 3, "_-/"
#: Strings that a model's counts stand for at most, random or ordinary. All are counted; beyond it the counts are scaled down to it, as
#: otherwise a step not seen, for which the models have a fixed number of counts, would weigh more the larger the input is.
WEIGHT = {True: 32, False: 10_000}
#: The least threshold: the log of the odds against a run holding a secret before it is read.
LEAST_LLR = 12.0
#: Spans whose places are summed up at a time.
SLICE = 64


def matches(text: str, kind: str) -> Column:
    """array<struct<start, end, hit>> of a kind's searched matches, leftmost and non-overlapping, in code points."""
    pattern = SEARCH.get(kind, JUDGED)
    hits, gaps = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)), F.split(F.col(text), pattern, -1)
    cut = F.zip_with(gaps, hits, lambda g, h: F.struct(F.char_length(g).alias("gap"), h.alias("hit")))
    empty = F.array().cast("array<struct<start:int,end:int,hit:string>>")
    cut = F.filter(cut, lambda x: x["hit"].isNotNull())
    # Places are sums over slices and then over the slices' sums, as an array that grows by one is copied each time.
    slices = F.transform(F.sequence(F.lit(0), F.floor((F.size(cut) - 1) / SLICE).cast("int")), lambda k: F.slice(cut, k * SLICE + 1, SLICE))
    within = F.transform(
        slices,
        lambda some: F.aggregate(
            some, F.struct(F.lit(0).alias("at"), empty.alias("out")),
            lambda s, x: F.struct(
                (s["at"] + x["gap"] + F.char_length(x["hit"])).alias("at"),
                F.concat(s["out"], F.array(F.struct((s["at"] + x["gap"]).alias("start"), (s["at"] + x["gap"] + F.char_length(x["hit"])).alias("end"), x["hit"].alias("hit")))).alias("out"),
            ),
        ),
    )
    begins = F.aggregate(within, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")), lambda s, x: F.struct((s["at"] + x["at"]).alias("at"), F.concat(s["all"], F.array(s["at"])).alias("all")), lambda s: s["all"])
    walked = F.flatten(F.zip_with(within, begins, lambda x, at: F.transform(x["out"], lambda y: F.struct((y["start"] + at).alias("start"), (y["end"] + at).alias("end"), y["hit"].alias("hit")))))
    walked = F.when(F.size(cut) > 0, walked).otherwise(empty)
    may = F.col(text).rlike(pattern)
    if kind == "assign":  # a plain search first, as most texts have none of the words
        low = F.lower(text)
        may = F.lit(False)
        for w in ("passw", "secret", "token", "api"):
            may |= low.contains(w)
    if kind == "access":
        may = F.col(text).contains("AKIA")
    found = F.when(may, walked).otherwise(empty)
    _, group, least = BASE.get(kind, ("", 0, 0))
    if group:
        found = F.filter(found, lambda x: F.char_length(F.regexp_extract(x["hit"], pattern, group)) >= least)
    return found


def base_spans(docs: DataFrame) -> DataFrame:
    """doc_id, __text and __KIND, the spans of each base kind."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("__text"))
    for kind in BASE:
        rows = rows.withColumn(f"__{kind}", matches("__text", kind))
    return rows


def codes(token: Column) -> Column:
    """Places in ALPHABET of a token's characters, from 0."""
    table_ = F.array(*[F.lit(ALPHABET.find(chr(i))) for i in range(128)])
    return F.transform(F.split(token, ""), lambda c: F.element_at(table_, F.ascii(c) + 1))


def labelled_samples(docs: DataFrame, train_docs: int | None = None) -> DataFrame:
    """token, random, n, held_out: values of the base spans, and the other words that are not judged themselves, of every distinct
    text, and how often each is there. Copies of a text are one, whatever their number and ids; a string is held out, or not,
    wherever it stands. ``train_docs``, if a caller gives it, takes only a hash sample of about so many texts; no query does."""
    some = docs.where(F.col("text").isNotNull())
    if train_docs is not None:
        some = some.where(F.pmod(F.xxhash64(F.lit(11), "text"), F.lit(1 << 20)) < int(min(1.0, train_docs / max(1, docs.count())) * (1 << 20)) + 1)
    some = some.groupBy(F.xxhash64("text").alias("doc_id")).agg(F.first("text").alias("text"))
    rows = base_spans(some)
    group = BASE["assign"]
    value = F.transform("__assign", lambda x: F.regexp_extract(x["hit"], group[0], group[1]))
    values = F.concat(value, F.transform("__access", lambda x: x["hit"]), F.transform("__hex", lambda x: x["hit"]))
    rest = F.col("__text")
    for pattern in SEARCH.values():
        rest = F.regexp_replace(rest, pattern, " ")
    words = F.filter(F.regexp_extract_all(rest, F.lit(ORDINARY), F.lit(0)), lambda w: F.char_length(w) < LONG)
    both = F.array(F.struct(values.alias("tokens"), F.lit(True).alias("random")), F.struct(words.alias("tokens"), F.lit(False).alias("random")))
    out = rows.select(F.explode(both).alias("x")).select(F.explode("x.tokens").alias("token"), "x.random").groupBy("token", "random").agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("held_out", F.pmod(F.xxhash64(F.lit(13), "token"), F.lit(HELD_OUT)) == 0)


def fit(samples: DataFrame) -> list[float]:
    """Log-likelihood ratio of each step between two characters of ALPHABET, random against ordinary, as a row-major square.

    Any step is possible in a random string, so its counts begin at 1; an ordinary step falls back on how usual its second
    character is. The driver gets one count for each model and pair of characters, a fixed number. Without samples every
    ratio is 0. A string counts ``n`` times if the samples have such a column.
    """
    n = len(ALPHABET)
    c = samples.select("random", (F.col("n") if "n" in samples.columns else F.lit(1)).alias("times"), codes(F.col("token")).alias("c"))
    steps = c.select("random", "times", F.explode(F.filter(F.zip_with(F.slice("c", 1, F.greatest(F.size("c") - 1, F.lit(0))), F.slice("c", 2, F.greatest(F.size("c") - 1, F.lit(0))), lambda a, b: F.when((a >= 0) & (b >= 0), a * n + b)), lambda x: x.isNotNull())).alias("step"))
    counts = {True: [1.0] * (n * n), False: [0.0] * (n * n)}
    for r in steps.groupBy("random", "step").agg(F.sum("times").alias("times")).collect():
        counts[r["random"]][r["step"]] += r["times"]
    second = [sum(counts[False][b::n]) + 0.5 for b in range(n)]
    usual = [x / sum(second) for x in second]
    out = []
    for a in range(n):
        random, ordinary = counts[True][a * n : a * n + n], counts[False][a * n : a * n + n]
        out += [math.log(random[b] / sum(random)) - math.log((ordinary[b] + 2 * usual[b]) / (sum(ordinary) + 2)) for b in range(n)]
    return out


def best_stretch(token: Column, ratios: list[float]) -> Column:
    """struct<score, start, end>: the stretch of a token whose steps have the greatest sum of log-likelihood ratios, the first if
    several have. One walk: a stretch that falls below nothing is begun anew."""
    n, odds = len(ALPHABET), F.array(*map(F.lit, ratios))
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("from"), F.lit(0).alias("at"), F.lit(0.0).alias("best"), F.lit(0).alias("low"), F.lit(0).alias("high"))

    def step(s: Column, gain: Column) -> Column:
        anew = s["sum"] + gain < 0
        better = s["sum"] + gain > s["best"]
        return F.struct(
            F.when(anew, 0.0).otherwise(s["sum"] + gain).alias("sum"), F.when(anew, s["at"] + 1).otherwise(s["from"]).alias("from"), (s["at"] + 1).alias("at"),
            F.when(better, s["sum"] + gain).otherwise(s["best"]).alias("best"), F.when(better, s["from"]).otherwise(s["low"]).alias("low"), F.when(better, s["at"] + 2).otherwise(s["high"]).alias("high"),
        )

    steps = F.char_length(token) - 1
    gain = lambda a, b: F.when((a >= 0) & (b >= 0), F.element_at(odds, F.greatest(a * n + b, F.lit(0)) + 1)).otherwise(0.0)
    gains = F.zip_with(F.slice(codes(token), 1, steps), F.slice(codes(token), 2, steps), gain)
    return F.aggregate(gains, start, step, lambda s: F.struct(s["best"].alias("score"), s["low"].alias("start"), s["high"].alias("end")))


def threshold(samples: DataFrame, ratios: list[float]) -> float:
    """The score from which a stretch counts as random: above that of every held-out ordinary string, and LEAST_LLR at least.

    What is judged is longer than these strings and may be several in one, as names in code and paths are, so each is also scored
    as JOINED of them, dealt together by hash, with each of JOINERS between.
    """
    held = samples.where("held_out and not random").select("token").distinct()
    groups = max(1, held.count() // JOINED)
    some = held.groupBy(F.pmod(F.xxhash64(F.lit(17), "token"), F.lit(groups))).agg(F.sort_array(F.collect_list("token")).alias("all"))
    some = some.select("all", F.explode(F.sequence(F.lit(1), F.size("all"), F.lit(JOINED))).alias("at")).select(F.slice("all", F.col("at"), F.lit(JOINED)).alias("some"))
    strings = held.unionAll(some.select(F.explode(F.array(*[F.array_join("some", j) for j in JOINERS])).alias("token")))
    return max(LEAST_LLR, (strings.agg(F.max(best_stretch(F.col("token"), ratios)["score"])).first()[0] or 0.0) + 1e-9)


def trained(docs: DataFrame) -> tuple[list[float], float]:
    """Ratios and threshold, learned from strings of all texts labelled by the base patterns."""
    samples = materialize(labelled_samples(docs))
    seen = samples.where("not held_out")
    total = {r["random"]: r["n"] for r in seen.groupBy("random").agg(F.sum("n").alias("n")).collect()}
    scale = {k: min(1.0, WEIGHT[k] / total.get(k, 1)) for k in WEIGHT}
    ratios = fit(seen.withColumn("n", F.col("n") * F.when(F.col("random"), scale[True]).otherwise(scale[False])))
    return ratios, threshold(samples, ratios)


def scan(docs: DataFrame, ratios: list[float], least: float) -> DataFrame:
    """doc_id, __text, the spans of each base kind and __markov: stretches of long strings whose ratio marks them as random,
    clear of base spans."""
    rows = base_spans(docs).withColumn("__long", matches("__text", "markov"))
    all_base = F.concat(*[F.col(f"__{k}") for k in BASE])
    clear = F.filter("__long", lambda x: ~F.exists(all_base, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    scored = F.transform("__clear", lambda x: F.struct(x["start"].alias("start"), best_stretch(x["hit"], ratios).alias("best")))
    found = F.transform(F.filter("__scored", lambda x: x["best"]["score"] >= least), lambda x: F.struct((x["start"] + x["best"]["start"]).alias("start"), (x["start"] + x["best"]["end"]).alias("end")))
    return rows.withColumn("__clear", clear).withColumn("__scored", scored).withColumn("__markov", found).drop("__long", "__clear", "__scored")


def listed(rows: DataFrame, kinds: list[str]) -> Column:
    """kind:start:end of the kinds' spans by start and then kind, comma-joined."""
    def said(k: str, rank: int) -> Column:
        return F.transform(f"__{k}", lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), F.concat_ws(":", F.lit(k), x["start"].cast("string"), x["end"].cast("string")).alias("said")))

    each = [said(k, i) for i, k in enumerate(kinds)]
    return F.concat_ws(",", F.transform(F.array_sort(F.concat(*each)), lambda x: x["said"]))


def secret_spans(docs: DataFrame, ratios: list[float] | None = None, least: float = LEAST_LLR) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_spans, spans of every row.

    The models and the threshold are learned from samples labelled by the base patterns unless ``ratios`` are given. Null
    text is empty and has no spans; repeated rows give equal rows; columns but doc_id and text are not read; a very long
    text is searched whole, in time in proportion to it; an empty table gives no rows. Offsets count code points, ends are exclusive.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    if ratios is None:
        ratios, least = trained(docs)
    rows = scan(docs, ratios, least)
    return rows.select("doc_id", *[F.size(f"__{k}").cast("long").alias(f"n_{k}") for k in BASE], listed(rows, list(BASE)).alias("base_spans"), listed(rows, [*BASE, "markov"]).alias("spans"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")
