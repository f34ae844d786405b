"""SQL types and table schemas."""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass, field

from pyspark.sql import types as T

_SIMPLE = {
    "INTEGER": T.IntegerType(), "INT": T.IntegerType(), "SMALLINT": T.ShortType(), "BIGINT": T.LongType(), "TINYINT": T.ByteType(),
    "FLOAT": T.FloatType(), "DOUBLE": T.DoubleType(), "TEXT": T.StringType(), "STRING": T.StringType(), "BLOB": T.BinaryType(), "BOOLEAN": T.BooleanType(),
    "DATE": T.DateType(), "DATETIME": T.TimestampNTZType(), "TIMESTAMP": T.TimestampType(),
}
LONGEST = 65_535


def spark_type(name: str) -> T.DataType:
    """The Spark type of a SQL type name such as ``INTEGER``, ``CHAR(5)`` or ``CHARACTER VARYING(20)``."""
    said = re.sub(r"\s+", " ", name.strip().upper())
    if said in _SIMPLE:
        return _SIMPLE[said]
    if m := re.fullmatch(r"(?:CHAR|CHARACTER|VARCHAR|CHARACTER VARYING) ?\( ?(\d+) ?\)", said):
        if not 1 <= int(m[1]) <= LONGEST:
            raise ValueError(f"the length in {name} must lie between 1 and {LONGEST}")
        return T.StringType()
    if m := re.fullmatch(r"(?:NUMERIC|DECIMAL)(?: ?\( ?(\d+) ?(?:, ?(\d+) ?)?\))?", said):
        return T.DecimalType(int(m[1] or 10), int(m[2] or 0))
    if said == "TIME":
        return T.TimeType() if hasattr(T, "TimeType") else T.StringType()
    raise ValueError(f"unknown type {name}")


def fixed_length(name: str) -> int | None:
    """n of CHAR(n), whose values may not be longer; VARCHAR(n) is not checked."""
    m = re.fullmatch(r"\s*(?:CHAR|CHARACTER)\s*\(\s*(\d+)\s*\)\s*", name, re.I)
    return int(m[1]) if m else None


@dataclass
class Column:
    name: str
    type: str
    not_null: bool = False


@dataclass
class Key:
    columns: list[str]
    primary: bool = False
    name: str | None = None


@dataclass
class ForeignKey:
    columns: list[str]
    table: str
    to: list[str]
    name: str | None = None


@dataclass
class TableDef:
    """What the catalog keeps of a table; ``parts`` are the Parquet folders whose union is its current version."""

    columns: list[Column]
    keys: list[Key] = field(default_factory=list)
    foreign_keys: list[ForeignKey] = field(default_factory=list)
    kind: str = "heap"
    parts: list[str] = field(default_factory=list)
    indexes: list[dict] = field(default_factory=list)
    stats: dict | None = None

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, spark_type(c.type)) for c in self.columns])

    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    def to_json(self) -> dict:
        return asdict(self)

    @classmethod
    def from_json(cls, x: dict) -> TableDef:
        return cls([Column(**c) for c in x["columns"]], [Key(**k) for k in x["keys"]], [ForeignKey(**f) for f in x["foreign_keys"]], x["kind"], x["parts"], x["indexes"], x["stats"])
