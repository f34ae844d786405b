"""Relational operators. Each returns a lazy DataFrame; Spark's optimizer picks joins, pushes filters and prunes columns."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scan(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_columns(left: DataFrame, right: DataFrame) -> list[str]:
    """Names both sides have, in the left side's order; an error if there are none or one is ambiguous."""
    names = [n.lower() for n in right.columns]
    both = [n for n in left.columns if n.lower() in names]
    if not both:
        raise ValueError("a natural join needs a column that both sides have")
    for n in both:
        if names.count(n.lower()) > 1 or [x.lower() for x in left.columns].count(n.lower()) > 1:
            raise ValueError(f"column {n} is ambiguous")
    return both


def join_using(left: DataFrame, right: DataFrame, columns: Sequence[str], how: str = "inner") -> DataFrame:
    """Shared columns first, then the rest of left and right; FULL coalesces the shared ones."""
    for n in columns:
        for side in (left, right):
            if [x.lower() for x in side.columns].count(n.lower()) != 1:
                raise ValueError(f"column {n} must be on either side once")
    if len({n.lower() for n in columns}) != len(columns):
        raise ValueError("a column is named twice")
    return left.join(right, list(columns), how)


def natural_join(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    return join_using(left, right, shared_columns(left, right), how)


def theta_join(left: DataFrame, right: DataFrame, condition: Column, how: str = "inner") -> DataFrame:
    return left.join(right, condition, how)


def semi_join(left: DataFrame, right: DataFrame, condition: Column | list[str]) -> DataFrame:
    return left.join(right, condition, "left_semi")


def anti_join(left: DataFrame, right: DataFrame, condition: Column | list[str]) -> DataFrame:
    return left.join(right, condition, "left_anti")


def band_join(left: DataFrame, right: DataFrame, at: str, low: str, high: str, width: float) -> DataFrame:
    """Rows of ``left`` whose value ``at`` lies in [low, high) of a row of ``right``, as an equi-join on buckets of ``width``.

    An interval is repeated for each bucket that it touches, so ``width`` should be near the usual interval's length; no
    nested loop over all pairs is run.
    """
    bucket = lambda x: F.floor(x / width).cast("bigint")
    wide = right.withColumn("__b", F.explode(F.sequence(bucket(F.col(low)), bucket(F.col(high)))))
    return left.withColumn("__b", bucket(F.col(at))).join(wide, "__b").where((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))).drop("__b")


#: Character classes of SQL patterns, inside brackets, and Java's names for them.
CLASSES = {"ALPHA": "Alpha", "UPPER": "Upper", "LOWER": "Lower", "DIGIT": "Digit", "ALNUM": "Alnum", "SPACE": "Space", "WHITESPACE": "Space"}


def similar_pattern(pattern: str) -> str:
    """A SQL regular expression as a Java one that matches the whole string.

    % and _ are wildcards, for line ends too; | * + ? ( ) { } and brackets have their usual sense; all else, dots, carets,
    dollars and backslashes among them, stands for itself. Inside brackets only ^ at the start, - and [:CLASS:] are special.
    """
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "[":
            end = i + 1 + pattern[i + 1 : i + 2].count("^")
            while end < len(pattern) and (pattern[end] != "]" or end == i + 1):
                end = pattern.index(":]", end) + 2 if pattern.startswith("[:", end) and ":]" in pattern[end:] else end + 1
            if end >= len(pattern):
                raise ValueError(f"a bracket is not closed in {pattern}")
            inner = re.sub(r"\[:(\w+):\]|([\[\]\\&~#])", lambda m: "\\p{" + CLASSES[m[1].upper()] + "}" if m[1] else "\\" + m[2], pattern[i + 1 : end])
            out.append(f"[{inner}]")
            i = end + 1
            continue
        out.append({"%": ".*", "_": "."}.get(c) or (c if c in "|*+?(){}," or c.isalnum() or c.isspace() else "\\" + c))
        i += 1
    return "(?s)\\A(?:" + "".join(out) + ")\\z"


def similar_to(x: Column, pattern: str) -> Column:
    """SQL regular expression match of the whole string."""
    return x.rlike(similar_pattern(pattern))


def ordered(df: DataFrame, *keys: Column) -> DataFrame:
    """Sort with NULLs first ascending and last descending."""
    return df.orderBy(*keys)
