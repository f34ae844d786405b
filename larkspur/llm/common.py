"""What the operators of this subpackage share: table access, checkpoints, guarded broadcasts."""

from __future__ import annotations

import re
import sys
import tempfile
from functools import reduce

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of values a side may have at most, by its own count, before it is joined by a shuffle instead of a broadcast.
BROADCAST_BYTES = 8_000_000
#: Rows of one key that one task may get of a join by ``join_hot``.
HOT_ROWS = 100_000


def ship(name: str) -> None:
    """Pickle the functions of module ``name`` by value, so executors need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


ship(__name__)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as ``spark.checkpoint.dir`` names it; a temporary one only in local mode, as in tests."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        said = sc.getConf().get("spark.checkpoint.dir")
        if not said and not re.match(r"local(\[(\d+|\*)(,\d+)?\])?$", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(said or tempfile.mkdtemp(prefix="larkspur-"))
    return sc._jsc.sc().getCheckpointDir().get()


def materialize(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: it cuts the lineage and survives lost executors.

    Spark hands the estimated size on to a checkpoint, and that of a join is the product of its sides': over the rounds of a
    loop its digits double with each join, until the number alone fills the driver. So the estimate is dropped here.
    """
    checkpoint_dir(df.sparkSession)
    spark, jdf = df.sparkSession, df.checkpoint()._jdf
    jvm, plan = spark._jvm, jdf.queryExecution().logical()
    none = getattr(getattr(jvm.scala, "None$"), "MODULE$")
    plan = jvm.org.apache.spark.sql.execution.LogicalRDD(
        plan.output(), plan.rdd(), plan.outputPartitioning(), plan.outputOrdering(), plan.isStreaming(), plan.stream(), jdf.sparkSession(), none, jvm.scala.Some(plan.constraints())
    )
    return type(df)(jvm.org.apache.spark.sql.classic.Dataset.ofRows(jdf.sparkSession(), plan), spark)


def byte_count(df: DataFrame) -> int:
    """Bytes of all values, with 8 for each row and for each string, binary, array or struct."""
    fixed, varying = 8, F.lit(0).cast("long")
    for f in df.schema:
        c, kind = F.col(f"`{f.name}`"), f.dataType
        if isinstance(kind, (T.StringType, T.BinaryType)):
            fixed, varying = fixed + 8, varying + F.coalesce(F.octet_length(c), F.lit(0))
        elif isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
            fixed, varying = fixed + 8, varying + F.octet_length(F.to_json(F.struct(c)))
        else:
            fixed += 8
    return df.agg(F.sum(varying + fixed)).first()[0] or 0


def small_side(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its values take ``most`` bytes at most; otherwise as it is, for a shuffled join.

    ``df`` should be materialized: its bytes are counted here.
    """
    return F.broadcast(df) if byte_count(df) <= most else df


def fits(df: DataFrame) -> bool:
    """Whether ``df``, which should be materialized, is small enough for a broadcast."""
    return byte_count(df) <= BROADCAST_BYTES


def join_hot(rows: DataFrame, side: DataFrame, on: list[str], how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """``rows`` joined (inner or left) with ``side``, which has one row for each key. A key of more than HOT_ROWS ``rows`` is
    dealt over several tasks by a hash of the row, its one row of ``side`` being repeated; in a left join rows without a key
    are spread likewise.

    ``counts`` says in ``n`` how many of ``rows`` have a key, or more; without it a column ``n`` of ``side`` does, which is not
    returned. It should be materialized, as the hot keys, at most one for HOT_ROWS rows, are looked up first.
    """
    if counts is None:
        counts, side = side.select(*on, "n"), side.drop("n")
    if how == "inner" and (counts.agg(F.max("n")).first()[0] or 0) <= HOT_ROWS:
        return rows.join(side, on, how)
    one = F.lit(1).cast("long")
    hot = small_side(materialize(counts.where(F.col("n") > HOT_ROWS).select(*on, F.ceil(F.col("n") / HOT_ROWS).cast("long").alias("__parts"))))
    lacking = reduce(Column.__or__, [F.col(k).isNull() for k in on])
    salts = F.when(lacking, F.lit(1024).cast("long")).otherwise(F.coalesce("__parts", one))
    dealt = rows.join(hot, on, "left").withColumn("__salt", F.pmod(F.xxhash64(*rows.columns), salts)).drop("__parts")
    sides = side.join(hot, on, "left").withColumn("__salt", F.explode(F.sequence(one - 1, F.coalesce("__parts", one) - 1))).drop("__parts")
    return dealt.join(sides, [*on, "__salt"], how).drop("__salt")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_id(doc_id: str = "doc_id", text: str = "text") -> Column:
    """doc_id; a row without one gets a number of its text, larger than ids in use, so that such rows are not one key."""
    return F.coalesce(F.col(doc_id).cast("long"), F.shiftrightunsigned(F.xxhash64(F.col(text).cast("string")), 2).bitwiseOR(F.lit(1 << 62)))


def with_columns_of(df: DataFrame, docs: DataFrame) -> DataFrame:
    """Only the columns that ``docs`` has, in its order."""
    return df.select(*[F.col(f"`{c}`") for c in docs.columns])
