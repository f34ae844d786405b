"""Tables on versioned Parquet: definition, loading, insert, update, delete, transactions, audits and upkeep.

A table's version is a list of Parquet folders that are never changed. INSERT adds a folder, UPDATE and DELETE write a new
one; COMMIT publishes the versions of all tables at once by renaming one catalog file. Readers keep what they began with.
"""

from __future__ import annotations

import copy
import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.functions.scalar import FunctionRegistry, register
from larkspur.sources.csv_store import advise, column_profiles, distinct_counts, read_csv
from larkspur.store import Store
from larkspur.types import ForeignKey, TableDef, fixed_length


class DatabaseError(Exception):
    pass


class Database:
    """One writer at a time; any number of readers."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.store = spark, path.rstrip("/"), Store(spark)
        self.tables: dict[str, TableDef] = {}
        self.views: dict[str, str] = {}
        self._saved: tuple[dict, dict] | None = None
        self.row_listeners: list[Callable[[str, str, str, DataFrame], None]] = []
        self.command_listeners: list[Callable[[str, str], None]] = []
        #: Whether writes look for repeated keys and orphans; NOT NULL and CHAR lengths are always looked at.
        self.check_keys = False
        self.functions = FunctionRegistry(spark)
        register(spark)
        if self.store.exists(f"{self.path}/catalog.json"):
            said = json.loads(self.store.read(f"{self.path}/catalog.json"))
            self.tables = {k: TableDef.from_json(v) for k, v in said["tables"].items()}
            self.views = said["views"]

    # Transactions

    @property
    def in_transaction(self) -> bool:
        return self._saved is not None

    def begin(self) -> None:
        if self.in_transaction:
            raise DatabaseError("a transaction is open already")
        self._saved = (copy.deepcopy(self.tables), dict(self.views))

    def commit(self) -> bool:
        """False if none was open."""
        if not self.in_transaction:
            return False
        self._saved = None
        self._publish()
        return True

    def rollback(self) -> bool:
        """False if none was open. Folders written meanwhile are left to ``vacuum``."""
        if self._saved is None:
            return False
        (self.tables, self.views), self._saved = self._saved, None
        return True

    def _publish(self) -> None:
        said = {"tables": {k: v.to_json() for k, v in self.tables.items()}, "views": self.views}
        self.store.replace(f"{self.path}/catalog.json", json.dumps(said, indent=1))

    def _changed(self) -> None:
        if not self.in_transaction:
            self._publish()

    # Definition

    def definition(self, name: str) -> TableDef:
        if name.lower() not in self.tables:
            raise DatabaseError(f"there is no table {name}")
        return self.tables[name.lower()]

    def create_table(self, name: str, definition: TableDef, if_not_exists: bool = False) -> None:
        if name.lower() in self.tables or name.lower() in self.views:
            if if_not_exists:
                return
            raise DatabaseError(f"there is a table {name} already")
        names = [n.lower() for n in definition.names()]
        if len(set(names)) < len(names):
            raise DatabaseError("a column is named twice")
        said = [x.name for x in [*definition.keys, *definition.foreign_keys] if x.name]
        if len(set(said)) < len(said):
            raise DatabaseError("a constraint is named twice")
        for key in definition.keys:
            if unknown := [x for x in key.columns if x.lower() not in names]:
                raise DatabaseError(f"unknown column {unknown[0]}")
            for col in definition.columns:
                col.not_null |= key.primary and col.name.lower() in [x.lower() for x in key.columns]
        for fk in definition.foreign_keys:
            self._resolve(fk)
        definition.schema  # noqa: B018  an unknown type is an error now
        self.tables[name.lower()] = definition
        self._changed()

    def _resolve(self, fk: ForeignKey) -> None:
        to = self.definition(fk.table)
        if not fk.to:  # the table's primary key
            fk.to = next((k.columns for k in to.keys if k.primary), [])
        if len(fk.to) != len(fk.columns):
            raise DatabaseError(f"the foreign key to {fk.table} has another number of columns")

    def drop_table(self, name: str, if_exists: bool = False) -> None:
        if name.lower() not in self.tables and if_exists:
            return
        if name.lower() in self.views:
            raise DatabaseError(f"{name} is a view")
        self.definition(name)
        del self.tables[name.lower()]
        self.spark.catalog.dropTempView(name.lower())
        self._changed()

    def create_view(self, name: str, query: str) -> None:
        if name.lower() in self.tables or name.lower() in self.views:
            raise DatabaseError(f"there is a table {name} already")
        self.views[name.lower()] = query
        self._changed()

    def drop_view(self, name: str, if_exists: bool = False) -> None:
        if name.lower() not in self.views:
            if if_exists and name.lower() not in self.tables:
                return
            raise DatabaseError(f"there is no view {name}")
        del self.views[name.lower()]
        self.spark.catalog.dropTempView(name.lower())
        self._changed()

    def drop_index(self, name: str, table: str | None = None, if_exists: bool = False) -> None:
        """Drop the index of that name, of ``table`` if given; an error if several tables have one."""
        at = [(d, x) for k, d in self.tables.items() for x in d.indexes if (x["name"] or "").lower() == name.lower() and table in (None, k)]
        if len(at) != 1:
            if if_exists and not at:
                return
            raise DatabaseError(f"there is no index {name}" if not at else f"several tables have an index {name}")
        at[0][0].indexes.remove(at[0][1])
        self._changed()

    def create_index(self, name: str | None, table: str, columns: list[str], unique: bool = False, kind: str | None = None) -> None:
        """Kept as metadata; OPTIMIZE then orders the table by its first index, so that Parquet statistics skip what a lookup
        or range does not need."""
        d = self.definition(table)
        if unknown := [x for x in columns if x.lower() not in [n.lower() for n in d.names()]]:
            raise DatabaseError(f"unknown column {unknown[0]}")
        d.indexes.append({"name": name, "columns": columns, "unique": unique, "kind": kind})
        self._changed()

    # Reading

    def table(self, name: str) -> DataFrame:
        d = self.definition(name)
        if not d.parts:
            return self.spark.createDataFrame([], d.schema)
        return self.spark.read.schema(d.schema).parquet(*d.parts)

    # Writing

    def _write(self, name: str, rows: DataFrame, options: dict[str, str] | None = None) -> str:
        d = self.definition(name)
        for c in d.columns:
            x, n = F.col(f"`{c.name}`"), fixed_length(c.type)
            if n:
                rows = rows.withColumn(c.name, F.when(F.length(x) > n, F.raise_error(F.lit(f"a value of {c.name} is longer than {n}")).cast("string")).otherwise(x))
            if c.not_null:
                rows = rows.withColumn(c.name, F.when(x.isNull(), F.raise_error(F.lit(f"{c.name} may not be null")).cast(rows.schema[c.name].dataType)).otherwise(x))
        part = f"{self.path}/{name.lower()}/{uuid.uuid4().hex}"
        rows.write.options(**(options or {})).parquet(part)
        return part

    def _replace(self, name: str, parts: list[str]) -> None:
        """The table's new version, refused if ``check_keys`` is set and it breaks a constraint that the old one kept."""
        d, old = self.definition(name), self.definition(name).parts
        d.parts = parts
        if self.check_keys and (d.keys or d.foreign_keys):
            broken = self.verify(name).where("violations > 0").limit(1).collect()
            if broken:
                d.parts = old
                raise DatabaseError(f"{broken[0]['constraint']} does not hold")
        self._changed()

    def _with_hits(self, name: str, hit: SparkColumn) -> list[str]:
        """The parts that hold a row for which ``hit`` is true."""
        found = self.table(name).where(hit).select(F.regexp_extract(F.col("_metadata.file_path"), "([0-9a-f]{32})/[^/]*$", 1).alias("part")).distinct().collect()
        ids = {r["part"] for r in found}
        return [p for p in self.definition(name).parts if p.rsplit("/", 1)[-1] in ids]

    def _fire(self, when: str, what: str, table: str, rows: DataFrame) -> None:
        for listen in self.row_listeners:
            listen(when, what, table, rows)

    def insert(self, name: str, rows: DataFrame | Iterable[tuple], columns: list[str] | None = None) -> None:
        """Append; values are cast to the columns' types and columns not named become NULL."""
        d = self.definition(name)
        if d.kind == "column":
            raise DatabaseError(f"{name} is a column store, which is read-only")
        columns = columns or d.names()
        by = {f.name.lower(): f for f in d.schema}
        if unknown := [x for x in columns if x.lower() not in by]:
            raise DatabaseError(f"unknown column {unknown[0]}")
        if not isinstance(rows, DataFrame):
            rows = list(rows)
            if any(len(r) != len(columns) for r in rows):
                raise DatabaseError("a row has another number of values than columns")
            rows = self.spark.createDataFrame(rows, T.StructType([by[x.lower()] for x in columns]))
        if len(rows.columns) != len(columns):
            raise DatabaseError("the query has another number of columns")
        rows = rows.toDF(*[f"__{i}" for i in range(len(columns))])
        at = {x.lower(): i for i, x in enumerate(columns)}
        rows = rows.select(*[(F.col(f"__{at[n]}") if n in at else F.lit(None)).cast(f.dataType).alias(f.name) for n, f in by.items()])
        self._fire("before", "insert", name, rows)
        part = self._write(name, rows)
        self._replace(name, [*d.parts, part])
        self._fire("after", "insert", name, self.spark.read.schema(d.schema).parquet(part))

    def update(self, name: str, values: dict[str, SparkColumn], where: SparkColumn | None = None) -> None:
        """All values are computed from the old row; rows for which ``where`` is not true stay, and folders without a row that
        changes are kept as they are. Listeners get the structs old and new of each row that changes."""
        d = self.definition(name)
        if d.kind == "column":
            raise DatabaseError(f"{name} is a column store, which is read-only")
        hit = F.coalesce(where, F.lit(False)) if where is not None else F.lit(True)
        by = {k.lower(): v for k, v in values.items()}
        if unknown := set(by) - {n.lower() for n in d.names()}:
            raise DatabaseError(f"unknown column {min(unknown)}")
        set_to = [by[f.name.lower()].cast(f.dataType).alias(f.name) if f.name.lower() in by else F.col(f"`{f.name}`") for f in d.schema]
        old = self.table(name)
        changes = old.where(hit).select(F.struct(*[F.col(f"`{n}`") for n in d.names()]).alias("old"), F.struct(*set_to).alias("new"))
        self._fire("before", "update", name, changes)
        if touched := self._with_hits(name, hit) if d.parts else []:
            rows = self.spark.read.schema(d.schema).parquet(*touched)
            new = rows.select(*[F.when(hit, x).otherwise(F.col(f"`{f.name}`")).alias(f.name) if f.name.lower() in by else x for f, x in zip(d.schema, set_to, strict=True)])
            self._replace(name, [*(p for p in d.parts if p not in touched), self._write(name, new)])
        self._fire("after", "update", name, changes)

    def delete(self, name: str, where: SparkColumn | None = None) -> None:
        """Folders without a row that goes are kept as they are."""
        d = self.definition(name)
        if d.kind == "column":
            raise DatabaseError(f"{name} is a column store, which is read-only")
        hit = F.coalesce(where, F.lit(False)) if where is not None else F.lit(True)
        gone = self.table(name).where(hit)
        self._fire("before", "delete", name, gone)
        if where is None:
            self._replace(name, [])
        elif touched := self._with_hits(name, hit) if d.parts else []:
            left = self.spark.read.schema(d.schema).parquet(*touched).where(~hit)
            self._replace(name, [*(p for p in d.parts if p not in touched), self._write(name, left)])
        self._fire("after", "delete", name, gone)

    def load_csv(self, name: str, path: str, definition: TableDef, column_store: bool = True, encode: bool = False) -> None:
        """A table from a CSV file; a column store cannot be changed afterwards. With ``encode`` the advice for each column is
        applied: those advised as RLE or DICTIONARY are written with dictionaries, whose codes Parquet packs in runs, others plain."""
        definition.kind = "column" if column_store else "heap"
        self.begin() if (own := not self.in_transaction) else None
        try:
            self.create_table(name, definition)
            options = {}
            if encode:
                advice = {r["column_name"]: r["encoding"] for r in self.encoding_advice(path, definition).collect()}
                options = {f"parquet.enable.dictionary#{n}": str(a != "NONE").lower() for n, a in advice.items()}
            definition.parts = [self._write(name, read_csv(self.spark, path, definition.schema), options)]
        except Exception:
            self.rollback() if own else None
            raise
        self.commit() if own else None

    def encoding_advice(self, path: str, definition: TableDef) -> DataFrame:
        """The advisor's report over a CSV file's columns, in file order."""
        raw = self.spark.read.csv(path, header=True, quote="", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, schema=", ".join(f"`{n}` string" for n in definition.names()), enforceSchema=True)
        return column_profiles(raw.withColumn("__at", F.monotonically_increasing_id()), {f.name: isinstance(f.dataType, T.NumericType) for f in definition.schema}, "__at")

    # Statistics, audits, upkeep

    def analyze(self, name: str) -> DataFrame:
        """One row for each column: rows, distinct values, nulls, and least and greatest number; kept in the catalog."""
        d = self.definition(name)
        report = statistics(self.table(name))
        d.stats = {r["column_name"]: r.asDict() for r in report.collect()}
        self._changed()
        return report

    def verify(self, name: str) -> DataFrame:
        """constraint, violations: nulls, repeated keys and orphans of the table's declared constraints."""
        d, rows = self.definition(name), self.table(name)
        checks = [rows.where(F.col(f"`{c.name}`").isNull()).agg(F.count(F.lit(1)).alias("violations")).withColumn("rule", F.lit(f"not null {c.name}")) for c in d.columns if c.not_null]
        for k in d.keys:
            checks.append(duplicate_keys(rows, k.columns).agg(F.count(F.lit(1)).alias("violations")).withColumn("rule", F.lit(f"{'primary key' if k.primary else 'unique'} {', '.join(k.columns)}")))
        for fk in d.foreign_keys:
            checks.append(orphans(rows, fk.columns, self.table(fk.table), fk.to).agg(F.count(F.lit(1)).alias("violations")).withColumn("rule", F.lit(f"foreign key {', '.join(fk.columns)} to {fk.table}")))
        out = self.spark.createDataFrame([], "constraint string, violations bigint")
        for c in checks:
            out = out.unionByName(c.select(F.col("rule").alias("constraint"), "violations"))
        return out

    def optimize(self, name: str, rows_per_file: int = 5_000_000) -> None:
        """Rewrite the table's folders as one, in files of about ``rows_per_file``, ordered by its first index if it has one."""
        d = self.definition(name)
        if d.parts:
            rows = self.table(name)
            files = max(1, -(-rows.count() // rows_per_file))
            if d.indexes:
                by = [F.col(f"`{c}`") for c in d.indexes[0]["columns"]]
                rows = rows.repartitionByRange(files, *by).sortWithinPartitions(*by)
            else:
                rows = rows.repartition(files)
            d.parts = [self._write(name, rows)]
            self._changed()

    def vacuum(self) -> list[str]:
        """Remove folders that no table's current version has: those of dropped tables, of earlier versions and of rolled back
        writes. Not in a transaction, nor while others still read an earlier version. The removed folders."""
        if self.in_transaction:
            raise DatabaseError("vacuum cannot run in a transaction")
        live, gone = {p for d in self.tables.values() for p in d.parts}, []
        for table in self.store.folders(self.path):
            parts = [f"{self.path}/{table}/{part}" for part in self.store.folders(f"{self.path}/{table}")]
            gone += [p for p in parts if p not in live]
        for p in gone:
            self.store.remove(p)
        return gone

    def advise_encodings(self, name: str, order: str) -> DataFrame:
        return advise(self.table(name), order)


def statistics(df: DataFrame) -> DataFrame:
    """column_name, rows, distincts, nulls, low, high of each column; low and high of numbers only. One pass over the data, and
    one over each column alone for its distinct values."""
    numeric = {f.name for f in df.schema if isinstance(f.dataType, T.NumericType)}
    each = []
    for i, n in enumerate(df.columns):
        x = F.col(f"`{n}`")
        each += [F.sum(x.isNull().cast("long")).alias(f"z{i}")]
        each += [(F.min(x.cast("double")) if n in numeric else F.lit(None).cast("double")).alias(f"l{i}"), (F.max(x.cast("double")) if n in numeric else F.lit(None).cast("double")).alias(f"h{i}")]
    one = df.agg(F.count(F.lit(1)).alias("rows"), *each)
    rows = [F.struct(F.lit(n).alias("column_name"), F.col("rows"), F.coalesce(f"z{i}", F.lit(0)).alias("nulls"), F.col(f"l{i}").alias("low"), F.col(f"h{i}").alias("high")) for i, n in enumerate(df.columns)]
    rows = one.select(F.explode(F.array(*rows)).alias("x")).select("x.*")
    return rows.join(F.broadcast(distinct_counts(df, df.columns)), "column_name").select("column_name", "rows", "distincts", "nulls", "low", "high")


def duplicate_keys(df: DataFrame, columns: list[str]) -> DataFrame:
    """The keys that more than one row has, with their number; keys with a NULL are never equal."""
    full = df
    for c in columns:
        full = full.where(F.col(f"`{c}`").isNotNull())
    return full.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def orphans(df: DataFrame, columns: list[str], parent: DataFrame, to: list[str]) -> DataFrame:
    """Rows whose foreign key is not null and not in ``parent``."""
    right = parent.select(*[F.col(f"`{t}`").alias(f"__{i}") for i, t in enumerate(to)])
    full = df
    for c in columns:
        full = full.where(F.col(f"`{c}`").isNotNull())
    on = [F.col(f"`{c}`") == F.col(f"__{i}") for i, c in enumerate(columns)]
    cond = on[0]
    for x in on[1:]:
        cond &= x
    return full.join(right, cond, "left_anti")
