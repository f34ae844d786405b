"""Scalar functions with standard semantics, and the non-standard ones under explicit ``compat_`` names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

c = F.col


def _double(x: Column) -> Column:
    return x.cast("double")


def compat_and(*terms: Column) -> Column:
    """Two-valued AND: a NULL term is FALSE."""
    out = F.lit(True)
    for t in terms:
        out &= F.coalesce(t, F.lit(False))
    return out


def compat_or(*terms: Column) -> Column:
    """Two-valued OR: a NULL term is FALSE."""
    out = F.lit(False)
    for t in terms:
        out |= F.coalesce(t, F.lit(False))
    return out


def compat_not(x: Column) -> Column:
    """Two-valued NOT: NOT NULL is TRUE."""
    return ~F.coalesce(x, F.lit(False))


def compat_divide(a: Column, b: Column) -> Column:
    """Division that never fails: signed infinity or NaN for a zero divisor, NULL for a NULL operand."""
    a, b = _double(a), _double(b)
    zero = F.when(F.isnan(a) | (a == 0), float("nan")).when(a > 0, float("inf")).when(a < 0, float("-inf"))
    return F.when(b == 0, zero).otherwise(a / F.nullif(b, F.lit(0.0)))


def compat_round(x: Column) -> Column:
    """Half toward positive infinity, as a bigint."""
    return F.floor(_double(x) + 0.5).cast("bigint")


def compat_ceil(x: Column) -> Column:
    return F.ceil(_double(x)).cast("double")


def compat_floor(x: Column) -> Column:
    return F.floor(_double(x)).cast("double")


def compat_nullif(condition: Column, value: Column) -> Column:
    """NULL if the condition holds, else the value."""
    return F.when(~F.coalesce(condition, F.lit(False)), value)


def number_as_predicate(x: Column) -> Column:
    """A number in a predicate: its whole part is not zero."""
    return x.cast("int") != 0


def string_as_number(x: Column) -> Column:
    return x.cast("double")


#: The functions of the engine by name; each takes and gives columns and stays in the JVM.
FUNCTIONS: dict[str, Callable[..., Column]] = {
    "abs": F.abs, "acos": F.acos, "asin": F.asin, "atan": F.atan, "atan2": F.atan2, "ceil": compat_ceil, "coalesce": F.coalesce,
    "concat": F.concat, "cos": F.cos, "floor": compat_floor, "greatest": F.greatest, "least": F.least,
    "if": lambda cond, a, b: F.when(cond, a).otherwise(b), "ifnull": F.ifnull, "nullif": F.nullif, "pow": F.pow,
    "round": compat_round, "sin": F.sin, "sqrt": F.sqrt, "tan": F.tan,
}

#: The compatibility forms for SQL text: inlined by the analyzer, so they cost no function call. COMPAT_NULLIF, whose value
#: may have any type, is put into SQL by the front end.
SQL_FORMS = {
    "compat_round(x double) returns bigint": "cast(floor(x + 0.5D) as bigint)",
    "compat_ceil(x double) returns double": "cast(ceil(x) as double)",
    "compat_floor(x double) returns double": "cast(floor(x) as double)",
    "compat_truth(x double) returns boolean": "cast(x as int) <> 0",
    "compat_divide(a double, b double) returns double": "case when b = 0 then case when isnan(a) or a = 0 then double('NaN') when a > 0 then double('Infinity') when a < 0 then double('-Infinity') end else a / nullif(b, 0D) end",
    "compat_not(x boolean) returns boolean": "not coalesce(x, false)",
    "compat_and(a boolean, b boolean) returns boolean": "coalesce(a, false) and coalesce(b, false)",
    "compat_or(a boolean, b boolean) returns boolean": "coalesce(a, false) or coalesce(b, false)",
}


def register(spark: SparkSession) -> None:
    """Make the SQL forms callable in this session's SQL."""
    for head, body in SQL_FORMS.items():
        spark.sql(f"create or replace temporary function {head} return {body}")


class FunctionRegistry:
    """User functions by name; a name can be given once. Prefer vectorised functions."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.names = spark, set(FUNCTIONS)

    def add(self, name: str, function: object) -> None:
        if name.lower() in self.names:
            raise ValueError(f"there is a function {name} already")
        self.spark.udf.register(name, function)
        self.names.add(name.lower())
