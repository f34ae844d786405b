"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import fresh, materialize, small_side, table, with_columns_of

SEED = 20_011
#: A source's target weight is its share of the rows to this power, normalised: hot sources are damped, rare ones repeated.
TEMPER = 0.5
#: A larger rate is dealt over equal parts of this at most, each inverted by itself: the sum of their counts is Poisson again.
PART = 64


def tempered_rates(docs: DataFrame, temper: float = TEMPER, scale: float = 1.0) -> DataFrame:
    """source, rate: mean repetitions that bring the sources to tempered weights, ``scale`` x the input's rows in all."""
    n = docs.groupBy("source").agg(F.count(F.lit(1)).cast("double").alias("n"))
    n = materialize(n)
    rows, mass = n.agg(F.sum("n"), F.sum(F.pow("n", F.lit(temper)))).first()
    return n.select("source", (F.pow("n", F.lit(temper)) / (mass or 1.0) * (rows or 0.0) * scale / F.col("n")).alias("rate"))


def weighted_rates(docs: DataFrame, weights: DataFrame, scale: float = 1.0) -> DataFrame:
    """source, rate for target ``weights`` (source, weight >= 0; not named: 0), ``scale`` x the input's rows in all."""
    n = docs.groupBy("source").agg(F.count(F.lit(1)).cast("double").alias("n"))
    n = materialize(n.join(weights.select(F.col("source").alias("named"), F.col("weight").cast("double").alias("weight")), F.col("source").eqNullSafe(F.col("named")), "left").fillna(0.0, ["weight"]))
    rows, mass = n.agg(F.sum("n"), F.sum("weight")).first()
    return n.select("source", (F.col("weight") / (mass or 1.0) * (rows or 0.0) * scale / F.col("n")).alias("rate"))


def poisson_inverse(rate: Column, u: Column) -> Column:
    """The least k with P(X <= k) > u, X being Poisson with mean ``rate`` (PART at most): 12 standard deviations past the mean
    no number of 52 bits lies beyond it."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 20).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("sum"), F.lit(0).alias("k"))
    step = lambda s, i: F.struct((s["p"] * rate / i).alias("p"), (s["sum"] + s["p"] * rate / i).alias("sum"), (s["k"] + (s["sum"] <= u).cast("int")).alias("k"))
    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda s: s["k"] + (s["sum"] <= u).cast("int"))


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) of 52 bits from the hash of ``seed`` and the parts."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") / float(1 << 52)


def replicate(docs: DataFrame, rates: DataFrame, seed: int = SEED) -> DataFrame:
    """Each row of ``docs`` k times, k Poisson with its source's rate; columns of ``docs`` plus the number of the copy, from 0,
    as ``__copy`` (with underscores added if ``docs`` has that), globally shuffled.

    k is the inverse of the Poisson distribution at a number hashed from ``seed`` and doc_id (null: the text), so a run
    repeats exactly and equal ids get equal counts. Null is a source of its own; a source without a rate gives no rows;
    null and long texts are carried along; repeated rows are repeated each; an empty table stays empty. Rates of any size
    cost what the copies they make cost.
    Rows go to a partition by the hash of their copy and of their place in the input, so that rows that are alike, whatever
    their share, are dealt evenly, and are put in the order of that hash there: two steps that make one uniform
    permutation, without a sampling pass. What is broadcast is one number a source, behind a check of its size.
    """
    names = {x: fresh(docs, x) for x in ("__copy", "__of", "__rate", "__key", "__k", "__at", "__place")}
    copy, of, rate, key, k, at, place = names.values()
    rates = materialize(rates.select(F.col("source").alias(of), F.col("rate").alias(rate)).where(F.col(rate) > 0))
    rows = docs.withColumn(place, F.monotonically_increasing_id()).withColumn(key, F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit("")))))
    rows = rows.join(small_side(rates), F.col("source").eqNullSafe(F.col(of)))
    parts = F.ceil(F.col(rate) / PART).cast("int")
    more = F.aggregate(F.sequence(F.lit(2), parts), F.lit(0), lambda n, i: n + poisson_inverse(F.col(rate) / parts, uniform(seed, F.col(key), i.cast("string"))))
    rows = rows.withColumn(k, poisson_inverse(F.col(rate) / parts, uniform(seed, F.col(key))) + F.when(parts > 1, more).otherwise(0)).where(F.col(k) > 0)
    rows = rows.withColumn(copy, F.explode(F.sequence(F.lit(0), F.col(k) - 1)))
    rows = rows.withColumn(at, F.xxhash64(F.lit(seed), key, copy, place))
    return rows.repartition(at).sortWithinPartitions(at).select(*[F.col(f"`{c}`") for c in docs.columns], copy)


def op3_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return replicate(docs, tempered_rates(docs)).select("doc_id", "source", "n_chars", F.col("__copy").cast("int").alias("copy"), F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents repeated to tempered source weights. Null sources are one source; rows without doc_id are
    drawn by their text; other columns, whatever their names, are carried along; an empty table stays empty."""
    return with_columns_of(replicate(docs, tempered_rates(docs)), docs)


OP3_SQL = f"""
with n as (select source, count(*)::double as n from documents group by 1),
t as (select sum(n) as total_rows, sum(pow(n, {TEMPER})) as mass from n),
w as (select source, pow(n, {TEMPER}) / mass * total_rows * 1.0::double / n as whole from n, t),
r as (select source, ceil(whole / {PART})::int as parts, whole / ceil(whole / {PART}) as rate from w),
p as (select source, k, exp(-rate + k * ln(rate) - lgamma(k + 1)) as pk from r, lateral (select unnest(range(0, ceil(rate + 12 * sqrt(rate) + 20)::bigint + 1)) as k)),
c as (select source, list(cdf) as cdf from (select source, sum(pk) over (partition by source order by k rows unbounded preceding) as cdf from p) group by source),
d as (select d.doc_id, d.source, n_chars, text, coalesce(d.doc_id::varchar, md5(coalesce(text, ''))) as key, parts, cdf from documents d join r on r.source is not distinct from d.source join c on c.source is not distinct from d.source),
u as (select *, list_transform(range(1, parts + 1), lambda i: ('0x' || substr(md5('{SEED}:' || key || case when i > 1 then ':' || i::varchar else '' end), 1, 13))::bigint::double / {1 << 52}::double) as us from d),
k as (select *, list_sum(list_transform(us, lambda u: len(list_filter(cdf, lambda x: x <= u))))::bigint as k from u)
select doc_id, source, n_chars, unnest(range(0, k))::int as copy, md5(coalesce(text, '')) as text_md5 from k where k > 0
"""
