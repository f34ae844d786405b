"""CSV files: loading, and advice on a column encoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV file with a header line that is skipped, comma-separated, values trimmed, no quoting."""
    rows = spark.read.csv(path, schema=T.StructType([T.StructField(f.name, T.StringType()) for f in schema]), header=True, enforceSchema=True, quote="", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema])


def _compared(name: str, numeric: bool) -> Column:
    x = F.col(f"`{name}`")
    return x.cast("double") if numeric else x.cast("string")


def column_profiles(df: DataFrame, kinds: dict[str, bool], order: str, splits: int = 64) -> DataFrame:
    """A row for each column of ``kinds`` (name: whether it is a number): n, runs, distincts, sortedness and encoding in the
    order of ``order``.

    runs counts rows that equal a neighbour; sortedness is 0 constant, 1 ascending, -1 descending, 2 neither. The rows are
    cut into ranges of ``order`` once for all columns, and neighbours are found in each range independently; only each range's
    first and last row are put side by side, so no task sees a whole column. Distinct values are counted column by column.
    """
    names = list(kinds)
    values = F.struct(*[_compared(n, kinds[n]).alias(f"v{i}") for i, n in enumerate(names)])
    rows = df.select(F.col(f"`{order}`").alias("i"), values.alias("v")).repartitionByRange(splits, "i").withColumn("part", F.spark_partition_id())
    inside = Window.partitionBy("part").orderBy("i")
    near = rows.withColumn("p", F.lag("v").over(inside)).withColumn("q", F.lead("v").over(inside))
    near = near.withColumn("first", F.row_number().over(inside) == 1).withColumn("last", F.lead("i").over(inside).isNull())
    edges = near.groupBy("part").agg(F.max_by("v", "first").alias("head"), F.max_by("v", "last").alias("tail"))
    across = Window.partitionBy(F.lit(0)).orderBy("part")  # one row for each of at most ``splits`` ranges
    edges = edges.withColumn("before", F.lag("tail").over(across)).withColumn("after", F.lead("head").over(across))
    near = near.join(F.broadcast(edges.drop("head", "tail")), "part")
    near = near.withColumn("p", F.when(F.col("first"), F.col("before")).otherwise(F.col("p"))).withColumn("q", F.when(F.col("last"), F.col("after")).otherwise(F.col("q")))
    some = lambda x: F.coalesce(F.max(F.when(x, 1)), F.lit(0)) > 0
    each = []
    for i in range(len(names)):
        v, p, q = (F.col(f"{side}.v{i}") for side in "vpq")
        each += [F.coalesce(F.sum(F.when((v == p) | (v == q), 1).otherwise(0)), F.lit(0)).cast("bigint").alias(f"runs{i}"), some(v < p).alias(f"down{i}"), some(v > p).alias(f"up{i}")]
    got = near.agg(F.count(F.lit(1)).alias("n"), *each)
    parts = [F.struct(F.lit(n).alias("column_name"), F.col("n"), F.col(f"runs{i}").alias("runs"), F.col(f"down{i}").alias("down"), F.col(f"up{i}").alias("up")) for i, n in enumerate(names)]
    got = got.select(F.explode(F.array(*parts)).alias("x")).select("x.*")
    state = F.when(~F.col("down") & ~F.col("up"), 0).when(~F.col("down"), 1).when(~F.col("up"), -1).otherwise(2)
    got = got.join(F.broadcast(distinct_counts(df, names)), "column_name")
    return got.select("column_name", "n", "runs", "distincts", state.alias("sortedness")).withColumn("encoding", encoding())


def distinct_counts(df: DataFrame, names: list[str]) -> DataFrame:
    """column_name, distincts: each column is read and counted by itself, so no row is multiplied by the number of columns."""
    out = None
    for n in names:
        one = df.agg(F.countDistinct(F.col(f"`{n}`").cast("string")).alias("distincts")).select(F.lit(n).alias("column_name"), "distincts")
        out = one if out is None else out.unionByName(one)
    return out


def column_profile(df: DataFrame, name: str, order: str, numeric: bool, splits: int = 64) -> DataFrame:
    """The profile of one column."""
    return column_profiles(df, {name: numeric}, order, splits)


def code_width(profile: DataFrame) -> DataFrame:
    """``profile`` with code_bits, the bits of a dictionary code (codes begin at 1, 0 marks an unused place), and
    codes_per_block, how many fit into a block of two bytes: 0 if a code is too wide for one."""
    bits = F.ceil(F.log2((F.col("distincts") + 1).cast("double"))).cast("int")
    return profile.withColumn("code_bits", bits).withColumn("codes_per_block", F.floor(F.lit(16) / F.greatest(bits, F.lit(1))).cast("int"))


def encoding() -> Column:
    """RLE for sorted columns that are mostly runs, DICTIONARY for unsorted ones with few values, else NONE."""
    rle = (F.col("sortedness") != 2) & (F.col("runs") > 0.75 * F.col("n"))
    return F.when(rle, "RLE").when((F.col("sortedness") == 2) & (F.col("distincts") < 0.75 * F.col("n")), "DICTIONARY").otherwise("NONE")


def advise(df: DataFrame, order: str, columns: list[str] | None = None) -> DataFrame:
    """A profile for each column."""
    kinds = {f.name: isinstance(f.dataType, T.NumericType) for f in df.schema}
    return column_profiles(df, {n: kinds[n] for n in columns or [n for n in df.columns if n != order]}, order)
