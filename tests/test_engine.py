"""Tables, SQL statements, transactions, constraints, column stores and functions."""

import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from larkspur.database import Database, DatabaseError
from larkspur.functions import scalar as S
from larkspur.operators import relational as R
from larkspur.plans.frontend import Engine, spark_sql, statements, table_definition, tokens
from larkspur.plans.selectivity import Cost, estimate, scan
from larkspur.sources.csv_store import column_profile
from larkspur.types import fixed_length, spark_type


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(Database(spark, str(tmp_path / "db")))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def sample(engine):
    engine.script("""
        create table simple (a integer, b integer);  -- a comment; with a semicolon
        insert into simple values (0, null), (1, 10), (2, 20), (3, 30), (4, null);
        create table project (a integer, b varchar(20), c integer);
        insert into project values (1, 'red', 10), (2, 'orange', 20), (3, null, 30), (4, 'green', null), (5, 'yellow', 40), (6, 'blue', 50);
        create table t1 (a int, b int, c int); insert into t1 values (1, 10, 100), (2, 20, 200), (3, 30, 300);
        create table t2 (a int, c int, d int); insert into t2 values (2, 250, 2500), (3, 350, 3500), (4, 450, 4500);
    """)
    return engine


@pytest.mark.parametrize("where,want", [("", 5), (" where b < 25", [(1, 10), (2, 20)]), (" where b > 15", [(2, 20), (3, 30)]), (" where b > 15 and b < 25", [(2, 20)])])
def test_simple_selects(sample, where, want):
    got = rows(sample.execute("select * from simple" + where))
    assert len(got) == want if isinstance(want, int) else got == want


@pytest.mark.parametrize("sql,want", [
    ("select c, a from project", [(10, 1), (20, 2), (30, 3), (None, 4), (40, 5), (50, 6)]),
    ("select c, b from project", [(10, "red"), (20, "orange"), (30, None), (None, "green"), (40, "yellow"), (50, "blue")]),
    ("select a - 10 as am, c * 3 as cm from project", [(-9, 30), (-8, 60), (-7, 90), (-6, None), (-5, 120), (-4, 150)]),
    ("select b, a - 10 as am, c * 3 as cm from project where a > 2 and c < 45", [(None, -7, 90), ("yellow", -5, 120)]),
    ("select 1 + 1 as x", [(2,)]),
    ('select "B" from project where b similar to \'(red|b%)\'', [("red",), ("blue",)]),
    ("select a from project where b like '%e%' and not (a between 2 and 4) and a in (1, 5)", [(1,), (5,)]),
    ("select x.a from (select a, b from t1) as x where exists (select 1 from t2 where t2.a == x.a)", [(2,), (3,)]),
    ("select a from t1 union select a from t2", [(1,), (2,), (3,), (4,)]),
    ("select count(*) as n, count(distinct b) as d, sum(b) as s from simple", [(5, 3, 60)]),
    ("select compat_divide(1, 0) as x, compat_round(-2.5) as y, compat_not(null) as z, compat_nullif(a = 1, 'v') as w from t1 where a = 1", [(math.inf, -2, True, None)]),
])
def test_select(sample, sql, want):
    assert rows(sample.execute(sql)) == sorted(want, key=repr)


@pytest.mark.parametrize("join,want", [
    ("natural join t2", []),
    ("join t2 using (a)", [(2, 20, 200, 250, 2500), (3, 30, 300, 350, 3500)]),
    ("left join t2 using (a)", [(1, 10, 100, None, None), (2, 20, 200, 250, 2500), (3, 30, 300, 350, 3500)]),
    ("right join t2 using (a)", [(2, 20, 200, 250, 2500), (3, 30, 300, 350, 3500), (4, None, None, 450, 4500)]),
    ("full join t2 using (a)", [(1, 10, 100, None, None), (2, 20, 200, 250, 2500), (3, 30, 300, 350, 3500), (4, None, None, 450, 4500)]),
])
def test_named_joins(sample, join, want):
    got = sample.execute(f"select * from t1 {join}")
    assert rows(got) == sorted(want, key=repr)
    if join == "natural join t2":
        assert got.columns == ["a", "c", "b", "d"]


def test_other_joins(sample):
    assert sample.execute("select * from t1 cross join t2").count() == 9
    assert sample.execute("select * from t1 join t2 on t1.a < t2.a").count() == 6
    with pytest.raises(PySparkException):
        sample.execute("select a from t1, t2")
    sample.execute("create table other (z integer)")
    with pytest.raises(ValueError):
        sample.execute("select * from t1 natural join other")
    with pytest.raises(ValueError):
        R.natural_join(sample.db.table("t1"), sample.db.table("other"))


def test_dml(sample):
    sample.execute("insert into simple (b, a) values (60, 6)")
    sample.execute("update simple set a = b, b = a where b >= 20")
    assert rows(sample.execute("select * from simple where b is not null")) == [(1, 10), (20, 2), (30, 3), (60, 6)]
    sample.execute("delete from simple where not (b < 5)")
    assert rows(sample.execute("select * from simple")) == sorted([(0, None), (4, None), (20, 2), (30, 3)], key=repr)
    sample.execute("insert into simple select a + 100, c from t1 where c > 100")
    assert sample.execute("select * from simple").count() == 6
    sample.execute("optimize simple")
    assert sample.execute("select * from simple").count() == 6 and len(sample.db.definition("simple").parts) == 1
    sample.execute("delete from simple")
    assert sample.execute("select * from simple").count() == 0
    for bad in ("insert into simple values (1)", "insert into simple (q) values (1)", "update simple set q = 1", "insert into nowhere values (1)", "frobnicate"):
        with pytest.raises((DatabaseError, PySparkException)):
            sample.execute(bad)


def test_transactions(sample, spark):
    db = sample.db
    sample.script("begin work; delete from t1; insert into t2 values (9, 9, 9); create table gone (x integer)")
    assert db.table("t1").count() == 0
    assert Database(spark, db.path).table("t1").count() == 3  # not published yet
    with pytest.raises(DatabaseError):
        sample.execute("begin")
    sample.execute("rollback work")
    assert (db.table("t1").count(), db.table("t2").count(), "gone" in db.tables) == (3, 3, False)
    sample.script("start transaction; delete from t1 where a = 1; commit")
    again = Database(spark, db.path)
    assert again.table("t1").count() == 2 and again.table("project").schema == db.table("project").schema
    assert not db.commit() and not db.rollback()


def test_readers_keep_their_version(sample):
    before = sample.execute("select * from t1")
    sample.execute("update t1 set a = 0")
    assert rows(before)[0][0] == 1 and rows(sample.execute("select * from t1"))[0][0] == 0


def test_definition(engine):
    engine.script("""
        create temporary table if not exists cars (car_id integer, vin char(4) not null unique, make varchar(20), primary key (car_id));
        create table owned (car_id integer references cars, who character varying(9), constraint pk primary key (car_id, who), foreign key (car_id) references cars (car_id));
        create unique index makes using btree on cars (make); create index on cars (vin);
    """)
    d = engine.db.definition("OWNED")
    assert [f.to for f in d.foreign_keys] == [["car_id"], ["car_id"]] and d.keys[0].name == "pk"
    assert [i["columns"] for i in engine.db.definition("cars").indexes] == [["make"], ["vin"]]
    engine.script("insert into cars values (1, 'ab', 'x'), (1, 'ab', 'y'); insert into owned values (1, 'me'), (2, 'you')")
    found = {(r["table_name"], r["constraint"]): r["violations"] for r in engine.execute("verify cars, owned").collect()}
    assert found["cars", "primary key car_id"] == 1 and found["cars", "unique vin"] == 1 and found["cars", "not null vin"] == 0
    assert found["owned", "foreign key car_id to cars"] == 1
    with pytest.raises(PySparkException):
        engine.execute("insert into cars values (3, 'toolong', 'z')")
    with pytest.raises(PySparkException):
        engine.execute("insert into cars values (3, null, 'z')")
    for bad in ("create table cars (a int)", "create table b (a int, A int)", "create table c (a blah)", "create table e (a int references nowhere)", "create table f (a varchar(0))"):
        with pytest.raises((DatabaseError, ValueError)):
            engine.execute(bad)
    engine.script("drop table owned; drop table if exists owned")
    with pytest.raises(DatabaseError):
        engine.execute("drop table owned")


def test_views_events_explain_analyze(sample):
    seen, commands = [], []
    sample.db.row_listeners.append(lambda when, what, table, df: seen.append((when, what, table, df.count())))
    sample.db.command_listeners.append(lambda when, text: commands.append(when))
    sample.execute("create view big as select a from t1 where a > 1")
    assert rows(sample.execute("select a + 1 as b from big")) == [(3,), (4,)]
    sample.execute("delete from t1 where a = 3")
    assert seen == [("before", "delete", "t1", 1), ("after", "delete", "t1", 1)] and commands == ["before", "after"] * 3
    assert "Filter" in sample.execute("explain select * from t1 where a > 1").first()[0]
    got = {r["column_name"]: r for r in sample.execute("analyze verbose simple").collect()}
    assert (got["b"]["rows"], got["b"]["distincts"], got["b"]["nulls"], got["b"]["low"], got["b"]["high"]) == (5, 3, 2, 10.0, 30.0)
    assert sample.db.definition("simple").stats["a"]["distincts"] == 5


def test_column_store(engine, tmp_path):
    path = tmp_path / "x.csv"
    cols = ([1, 1, 1, 1, 2, 2, 2, 2], [1, 2, 3, 4, 5, 6, 7, 8], [5, 1, 5, 1, 5, 1, 5, 1], [3, 1, 4, 8, 5, 9, 2, 6], [7] * 8)
    path.write_text("h,h,h,h,h\n" + "".join(", ".join(map(str, r)) + "\n" for r in zip(*cols, strict=True)))
    engine.execute(f"create colstore cs from '{path}' (a integer, b integer, c varchar(5), d integer, e double)")
    assert rows(engine.execute("select a, c from cs where b > 2 and b < 5 order by b")) == [(1, "1"), (1, "5")]
    advice = {r["column_name"]: (r["runs"], r["distincts"], r["sortedness"], r["encoding"]) for r in engine.db.encoding_advice(str(path), engine.db.definition("cs")).collect()}
    assert advice == {"a": (8, 2, 1, "RLE"), "b": (0, 8, 1, "NONE"), "c": (0, 2, 2, "DICTIONARY"), "d": (0, 8, 2, "NONE"), "e": (8, 1, 0, "RLE")}
    for bad in ("insert into cs values (1, 1, '1', 1, 1.0)", "delete from cs", "update cs set a = 1"):
        with pytest.raises(DatabaseError):
            engine.execute(bad)
    engine.execute(f"create store hs from '{path}' (a integer, b integer, c varchar(5), d integer, e double)")
    engine.execute("delete from hs where b > 2")
    assert engine.execute("select * from hs").count() == 2
    with pytest.raises(PySparkException):
        engine.execute(f"create colstore broken from '{tmp_path}/none.csv' (a integer)")
    assert "broken" not in engine.db.tables


def test_profile_across_ranges(spark):
    values = [3, 3, 3, 5, 5, 9, 9, 9, 9, 12]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v int")
    for splits in (1, 3, 10, 40):
        r = column_profile(df, "v", "i", True, splits).first()
        assert (r["n"], r["runs"], r["distincts"], r["sortedness"]) == (10, 9, 4, 1)
    assert column_profile(df.limit(0), "v", "i", True).first()["n"] == 0


@pytest.mark.parametrize("a,b", [(3, 4), (14, 38), (2.5, 3.25), (-3.5, 9.0), (3, 4.5), (0, -7)])
@pytest.mark.parametrize("ta,tb", [("int", "int"), ("bigint", "bigint"), ("float", "float"), ("double", "double"), ("int", "float"), ("bigint", "float"), ("int", "bigint"), ("int", "double"), ("bigint", "double"), ("float", "double")])
def test_arithmetic(spark, a, b, ta, tb):
    x, y = (int(v) if t in ("int", "bigint") else v for v, t in ((a, ta), (b, tb)))
    r = spark.range(1).select(*[f.alias(n) for n, f in (("p", F.lit(x).cast(ta) + F.lit(y).cast(tb)), ("m", F.lit(x).cast(ta) - F.lit(y).cast(tb)), ("t", F.lit(x).cast(ta) * F.lit(y).cast(tb)))]).first()
    assert (r["p"], r["m"], r["t"]) == (x + y, x - y, x * y)


def test_compat(spark):
    cases = [(1.0, 0.0, math.inf), (-1.0, 0.0, -math.inf), (0.0, 0.0, math.nan), (math.nan, 0.0, math.nan), (6.0, 4.0, 1.5), (None, 0.0, None), (1.0, None, None)]
    df = spark.createDataFrame(cases, "a double, b double, want double").select(S.compat_divide(F.col("a"), F.col("b")).alias("got"), "want")
    for r in df.collect():
        assert r["got"] == r["want"] or (r["got"] is not None and math.isnan(r["got"]) and math.isnan(r["want"]))
    bools = spark.createDataFrame([(True, None), (False, None), (None, None), (True, False)], "a boolean, b boolean")
    got = [tuple(r) for r in bools.select(S.compat_and(F.col("a"), F.col("b")), S.compat_or(F.col("a"), F.col("b")), S.compat_not(F.col("b"))).collect()]
    assert got == [(False, True, True), (False, False, True), (False, False, True), (False, True, True)]
    nums = spark.createDataFrame([(-2.5, -2), (2.5, 3), (0.49, 0), (-0.5, 0)], "x double, want long")
    assert all(r[0] == r[1] for r in nums.select(S.compat_round(F.col("x")), "want").collect())


def test_functions_registry(engine):
    engine.db.functions.add("twice", lambda x: 2 * x)
    with pytest.raises(ValueError):
        engine.db.functions.add("ABS", lambda x: x)


def test_tokens_and_dialect():
    assert [t.kind for t in tokens('a "b c" \'x\' 5 5L 5.0 5.0f <> -- gone\n ;')] == ["word", "quoted", "string", "number", "number", "number", "number", "op", "op"]
    assert len(statements("select ';' ; ; select 2")) == 2
    assert spark_sql(tokens('select "x".y, 5.0, 5.0f, 5l from t where a == 1')) == "select `x`.y , 5.0D , 5.0F , 5L from t where a == 1"
    with pytest.raises(DatabaseError):
        table_definition(tokens("a int frob"))
    assert fixed_length("CHAR(5)") == 5 and fixed_length("VARCHAR(5)") is None and spark_type("numeric(5, 2)").simpleString() == "decimal(5,2)"


def test_strings_are_not_touched(engine):
    got = engine.execute(r"select 'a . b' as a, 'it''s' as b, '' as c, 'x;--y' as d, 'back\slash \n' as e, 'two\nlines' as f".replace("two\\nlines", "two\nlines")).first()
    assert tuple(got) == ("a . b", "it's", "", "x;--y", r"back\slash \n", "two\nlines")
    engine.script("create table s (v varchar(20)); insert into s values ('a . b'), ('it''s'); create view w as select v from s where v = 'it''s'")
    assert rows(engine.execute("select * from w")) == [("it's",)] and engine.execute("select * from s where v = 'a . b'").count() == 1


@pytest.mark.parametrize("pattern,yes,no", [
    ("a.c", ["a.c"], ["abc"]), ("a_c", ["abc", "a\nc", "a.c"], ["ac", "abbc"]), ("%b", ["b", "a\nb"], ["b\n", "ba"]), ("a$", ["a$"], ["a", "a\n"]), ("^a", ["^a"], ["a"]),
    ("(ab|c)+", ["abc", "cc"], ["", "a"]), ("[%_]x", ["%x", "_x"], ["ax"]), ("[^a-c]", ["d", "^"], ["a", "dd"]), ("[[:digit:]x]{2,3}", ["1x", "x23"], ["1", "ab"]), ("a\\b", ["a\\b"], ["ab"]),
    ("[]a]", ["]", "a"], ["b"]), ("a&&b[&&a]", ["a&&b&", "a&&ba"], ["a&&b"]), ("", [""], ["a"]), ("a*b?", ["", "aab"], ["abb"]),
])
def test_similar_to(spark, pattern, yes, no):
    df = spark.createDataFrame([(x, True) for x in yes] + [(x, False) for x in no], "s string, want boolean")
    assert [r for r in df.where(R.similar_to(F.col("s"), pattern) != F.col("want")).collect()] == []


def test_similar_to_errors():
    with pytest.raises(ValueError):
        R.similar_pattern("a[b")


def test_drop_by_kind(sample):
    sample.script("create view v as select a from t1; create index t1 on t1 (a); create index i on t2 (a)")
    sample.execute("drop index t1")
    assert "t1" in sample.db.tables and not sample.db.definition("t1").indexes
    sample.script("drop index i on t2; drop index if exists i; drop view if exists nowhere; drop view v")
    for bad in ("drop index nowhere", "drop view t1", "drop table v", "drop t1", "drop function f", "drop table t1 t2"):
        with pytest.raises(DatabaseError):
            sample.execute(bad)
    assert set(sample.db.tables) == {"simple", "project", "t1", "t2"}


def test_only_touched_parts_are_rewritten(sample):
    db = sample.db
    sample.script("insert into t1 values (100, 1, 1); insert into t1 values (200, 2, 2)")
    before = list(db.definition("t1").parts)
    sample.execute("update t1 set b = 7 where a = 100")
    after = list(db.definition("t1").parts)
    assert len(after) == 3 and set(before) - set(after) == {before[1]}
    sample.execute("delete from t1 where a = 200")
    assert before[0] in db.definition("t1").parts and db.table("t1").count() == 4
    sample.execute("update t1 set b = 0 where a = -1")
    sample.execute("begin; insert into t1 values (5, 5, 5); rollback")
    gone = db.vacuum()
    assert before[1] in gone and db.table("t1").count() == 4 and db.vacuum() == []
    sample.execute("begin")
    with pytest.raises(DatabaseError):
        db.vacuum()


def test_update_listeners_get_old_and_new(sample):
    seen = []
    sample.db.row_listeners.append(lambda when, what, table, df: seen.append((when, what, [(r["old"]["b"], r["new"]["b"]) for r in df.collect()] if what == "update" else df.count())))
    sample.script("update t1 set b = b + 1 where a = 2; insert into t1 values (9, 9, 9)")
    assert seen == [("before", "update", [(20, 21)]), ("after", "update", [(20, 21)]), ("before", "insert", 1), ("after", "insert", 1)]


def test_keys_checked_on_write(engine):
    engine.db.check_keys = True
    engine.script("create table p (k integer primary key, u integer unique); create table f (k integer references p); insert into p values (1, 10), (2, null), (3, null); insert into f values (1), (null)")
    for bad in ("insert into p values (1, 11)", "insert into p values (4, 10)", "insert into f values (9)", "update p set k = 1 where k = 2"):
        with pytest.raises(DatabaseError):
            engine.execute(bad)
    assert engine.db.table("p").count() == 3 and engine.db.table("f").count() == 2


def test_optimize_orders_by_the_index(engine, spark):
    engine.execute("create table t (a integer, b integer)")
    engine.db.insert("t", spark.range(4000).select((F.col("id") * 7 % 4000).cast("int").alias("a"), F.col("id").cast("int").alias("b")))
    engine.execute("create index on t (a)")
    engine.db.optimize("t", 1000)
    spans = engine.db.table("t").groupBy(F.input_file_name().alias("f")).agg(F.min("a").alias("lo"), F.max("a").alias("hi")).orderBy("lo").collect()
    assert len(spans) == 4 and all(x["hi"] < y["lo"] for x, y in zip(spans, spans[1:], strict=False))


def test_advice_is_applied(engine, tmp_path):
    import pyarrow.parquet as pq

    path = tmp_path / "x.csv"
    path.write_text("a,b\n" + "".join(f"{i % 3}, {i * 37 % 1000}\n" for i in range(1000)))
    engine.db.load_csv("t", str(path), table_definition(tokens("a integer, b integer")), encode=True)
    (part,) = engine.db.definition("t").parts
    from pathlib import Path

    meta = pq.ParquetFile(next(Path(part).glob("*.parquet"))).metadata.row_group(0)
    assert ["PLAIN_DICTIONARY" in meta.column(i).encodings for i in (0, 1)] == [True, False]


def test_profiles_in_one_exchange(spark, capsys):
    from larkspur.sources.csv_store import column_profiles, distinct_counts

    df = spark.range(100).select("id", *[(F.col("id") % k).alias(f"c{k}") for k in range(2, 8)])
    column_profiles(df, {f"c{k}": True for k in range(2, 8)}, "id").explain()
    plan = capsys.readouterr().out
    assert plan.count("rangepartitioning") == 1 + plan.count("ReusedExchange [i#") or plan.count("rangepartitioning") <= 2
    distinct_counts(df, df.columns).explain()
    assert "Expand" not in capsys.readouterr().out


def test_selectivity():
    stats = {"a": {"distincts": 10, "low": 0.0, "high": 100.0}, "b": {"distincts": 4}}
    for p, want in [(("=", "a", 5), 0.1), (("<>", "a", 5), 0.9), ((">=", "a", 75), 0.25), (("<", "a", 75), 0.75), (("<=", "a", 20), 0.2), ((">", "a", 20), 0.8), (("<", "a", 1000), 1.0), (("=", "a", ("col", "b")), 0.1), (("=", "c", 1), 0.25), ((">", "b", 1), 0.25), (("and", ("=", "a", 1), ("=", "b", 1)), 0.025), (("or", ("=", "a", 1), ("=", "b", 1)), 0.325), (("not", ("=", "a", 1)), 0.9)]:
        assert abs(estimate(stats, p) - want) < 1e-12
    a = scan(1000, 80)
    assert a.blocks == 10 and a.filtered(0.1) == Cost(100, 80, 2000, 10) and a.nested_loop(Cost(10, 8, 10, 1), 0.5) == Cost(5000, 88, 11000, 1010)
    assert a.sorted().cpu > a.cpu and a.projected(8).width == 8
