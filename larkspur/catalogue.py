"""Queries of the relational engine over the sample tables, each with its DuckDB counterpart."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.database import Database, duplicate_keys, orphans, statistics
from larkspur.functions import scalar as S
from larkspur.operators import relational as R
from larkspur.plans.frontend import Engine
from larkspur.plans.selectivity import estimate
from larkspur.sources.csv_store import advise, code_width
from larkspur.store import scratch
from larkspur.types import Column, Key, TableDef

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = (f, sql)
        return f

    return add


def queries() -> dict[str, Query]:
    return {k: f for k, (f, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _QUERIES.items() if s}


t = R.scan


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, o = t(spark, sf_dir, "customer"), t(spark, sf_dir, "nation"), t(spark, sf_dir, "orders")
    rows = R.theta_join(c, n, F.col("c_nationkey") == F.col("n_nationkey"))
    rows = R.theta_join(rows, o, F.col("o_custkey") == F.col("c_custkey")).where("o_totalprice > 1000 and c_acctbal > 0")
    return R.ordered(rows.select("c_name", "n_name", (F.col("o_totalprice") * 0.9).alias("net")), F.desc("net"))


@query("select c_name, n_name, o_totalprice * 0.9::double as net from customer join nation on c_nationkey = n_nationkey join orders on o_custkey = c_custkey where o_totalprice > 1000 and c_acctbal > 0")
def flagship_net(spark, d):
    return flagship(spark, d)


# Scans, filters, projections


@query("select * from nation")
def scan_all(spark, d):
    return t(spark, d, "nation")


@query("select o_orderkey, o_totalprice from orders where (o_totalprice > 100000 and o_orderstatus = 'F') or o_orderpriority = '1-URGENT'")
def filter_and_or(spark, d):
    return t(spark, d, "orders").where(((F.col("o_totalprice") > 100000) & (F.col("o_orderstatus") == "F")) | (F.col("o_orderpriority") == "1-URGENT")).select("o_orderkey", "o_totalprice")


@query("select event_id, value from events where value between 10 and 50")
def filter_between(spark, d):
    return t(spark, d, "events").where(F.col("value").between(10, 50)).select("event_id", "value")


@query("select n_nationkey, not coalesce(nullif(n_regionkey, 0) > 2, false) as kept from nation where not coalesce(nullif(n_regionkey, 0) > 2, false)")
def filter_not_null2v(spark, d):
    hit = S.compat_not(F.nullif("n_regionkey", F.lit(0)) > 2)
    return t(spark, d, "nation").where(hit).select("n_nationkey", hit.alias("kept"))


@query("select n_nationkey, coalesce(nullif(n_regionkey, 0) > 1, false) and true as both_hold, coalesce(nullif(n_regionkey, 0) > 1, false) or coalesce(n_nationkey > 20, false) as one_holds from nation")
def boolean_two_valued(spark, d):
    x = F.nullif("n_regionkey", F.lit(0)) > 1
    return t(spark, d, "nation").select("n_nationkey", S.compat_and(x, F.lit(True)).alias("both_hold"), S.compat_or(x, F.col("n_nationkey") > 20).alias("one_holds"))


@query("select n_nationkey from nation where trunc(n_regionkey / 2.0::double)::int <> 0")
def number_predicate(spark, d):
    return t(spark, d, "nation").where(S.number_as_predicate(F.col("n_regionkey") / 2.0)).select("n_nationkey")


@query("select n_nationkey from nation where cast(n_nationkey::varchar as double) >= 10")
def string_number_compare(spark, d):
    return t(spark, d, "nation").where(S.string_as_number(F.col("n_nationkey").cast("string")) >= 10).select("n_nationkey")


@query("select l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) * (1 + l_tax) as charge, -l_quantity as neg from lineitem")
def project_arith(spark, d):
    c = F.col
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (c("l_extendedprice") * (1 - c("l_discount")) * (1 + c("l_tax"))).alias("charge"), (-c("l_quantity")).alias("neg"))


@query("select o_totalprice, o_orderkey, o_orderkey - 10 as am from orders")
def project_reorder(spark, d):
    return t(spark, d, "orders").select("o_totalprice", "o_orderkey", (F.col("o_orderkey") - 10).alias("am"))


@query("select x.n_name as country from nation as x where x.n_regionkey = 1")
def rename_alias(spark, d):
    return t(spark, d, "nation").alias("x").where(F.col("x.n_regionkey") == 1).select(F.col("x.n_name").alias("country"))


@query("select k, p from (select o_orderkey as k, o_totalprice * 2 as p from orders where o_orderstatus = 'O') as s where p > 300000")
def derived_table(spark, d):
    s = t(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("k"), (F.col("o_totalprice") * 2).alias("p"))
    return s.where("p > 300000")


@query("select 1 + 1 as two, 'a' || 'b' as ab")
def select_without_table(spark, d):
    return spark.range(1).select((F.lit(1) + 1).alias("two"), F.concat(F.lit("a"), F.lit("b")).alias("ab"))


@query("select p_partkey, p_type from part where p_type like '%O%' and p_name not like 'z%'")
def like_filter(spark, d):
    return t(spark, d, "part").where(F.col("p_type").like("%O%") & ~F.col("p_name").like("z%")).select("p_partkey", "p_type")


@query("select p_partkey, p_brand from part where regexp_full_match(p_brand, 'Brand#(1|2).*')")
def similar_to(spark, d):
    return t(spark, d, "part").where(R.similar_to(F.col("p_brand"), "Brand#(1|2)%")).select("p_partkey", "p_brand")


@query("select n_name from nation where n_regionkey in (1, 3) and n_nationkey not in (5, 6)")
def in_list(spark, d):
    return t(spark, d, "nation").where(F.col("n_regionkey").isin(1, 3) & ~F.col("n_nationkey").isin(5, 6)).select("n_name")


@query("select c_custkey from customer where c_custkey in (select o_custkey from orders where o_totalprice > 200000)")
def in_subquery(spark, d):
    big = t(spark, d, "orders").where("o_totalprice > 200000")
    return R.semi_join(t(spark, d, "customer"), big, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey")


@query("select c_custkey from customer c where exists (select 1 from orders o where o.o_custkey = c.c_custkey and o.o_totalprice > c.c_acctbal * 20)")
def exists_corr(spark, d):
    return R.semi_join(t(spark, d, "customer"), t(spark, d, "orders"), (F.col("o_custkey") == F.col("c_custkey")) & (F.col("o_totalprice") > F.col("c_acctbal") * 20)).select("c_custkey")


@query("select c_custkey from customer c where not exists (select 1 from orders o where o.o_custkey = c.c_custkey)")
def not_exists(spark, d):
    return R.anti_join(t(spark, d, "customer"), t(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey")).select("c_custkey")


@query("select o_orderkey from orders where o_totalprice > (select avg(o_totalprice) * 1.5 from orders)")
def scalar_subquery(spark, d):
    t(spark, d, "orders").createOrReplaceTempView("larkspur_orders")
    return spark.sql("select o_orderkey from larkspur_orders where o_totalprice > (select avg(o_totalprice) * 1.5D from larkspur_orders)")


@query("select n_nationkey, nullif(n_regionkey, 0) is null as missing from nation where nullif(n_regionkey, 0) is null or n_nationkey > 15")
def is_null(spark, d):
    x = F.nullif("n_regionkey", F.lit(0))
    return t(spark, d, "nation").where(x.isNull() | (F.col("n_nationkey") > 15)).select("n_nationkey", x.isNull().alias("missing"))


# Joins


def _regions(spark, d):
    """Nations with the even region keys taken away, so outer joins have something to fill."""
    return t(spark, d, "nation").select("n_name", F.when(F.col("n_regionkey") % 2 == 1, F.col("n_regionkey")).alias("r_regionkey"))


_N = "(select n_name, case when n_regionkey % 2 = 1 then n_regionkey end as r_regionkey from nation) as n"


@query("select c_custkey, n_name from customer join nation on c_nationkey = n_nationkey where c_acctbal > 0")
def join_inner_on(spark, d):
    return R.theta_join(t(spark, d, "customer").where("c_acctbal > 0"), t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")


@query(f"select r_regionkey, n_name, r_name from {_N} join region using (r_regionkey)")
def join_using(spark, d):
    return R.join_using(_regions(spark, d), t(spark, d, "region"), ["r_regionkey"])


@query(f"select r_regionkey, n_name, r_name from {_N} natural join region")
def join_natural(spark, d):
    return R.natural_join(_regions(spark, d), t(spark, d, "region"))


@query("select a.r_name as left_name, b.n_name as right_name from region a cross join nation b")
def join_cross(spark, d):
    return t(spark, d, "region").crossJoin(t(spark, d, "nation")).select(F.col("r_name").alias("left_name"), F.col("n_name").alias("right_name"))


@query("select s_suppkey, n_nationkey from supplier join nation on s_nationkey < n_nationkey and s_acctbal > n_nationkey * 100")
def join_theta(spark, d):
    return R.theta_join(t(spark, d, "supplier"), t(spark, d, "nation"), (F.col("s_nationkey") < F.col("n_nationkey")) & (F.col("s_acctbal") > F.col("n_nationkey") * 100)).select("s_suppkey", "n_nationkey")


@query("select a.n_name as a_name, b.n_name as b_name from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey")
def join_self(spark, d):
    a, b = t(spark, d, "nation").alias("a"), t(spark, d, "nation").alias("b")
    return a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))).select(F.col("a.n_name").alias("a_name"), F.col("b.n_name").alias("b_name"))


@query(f"select n.r_regionkey, n_name, r_name from {_N} left join region r on n.r_regionkey = r.r_regionkey")
def join_left(spark, d):
    return R.join_using(_regions(spark, d), t(spark, d, "region"), ["r_regionkey"], "left")


@query(f"select r.r_regionkey, n_name, r_name from {_N} right join region r on n.r_regionkey = r.r_regionkey")
def join_right(spark, d):
    return R.join_using(_regions(spark, d), t(spark, d, "region"), ["r_regionkey"], "right")


@query(f"select coalesce(n.r_regionkey, r.r_regionkey) as r_regionkey, n_name, r_name from {_N} full join region r on n.r_regionkey = r.r_regionkey")
def join_full(spark, d):
    return R.join_using(_regions(spark, d), t(spark, d, "region"), ["r_regionkey"], "full")


@query("select r_name, c_mktsegment, count(*)::bigint as n, round(sum(o_totalprice), 2) as total from region join nation on n_regionkey = r_regionkey join customer on c_nationkey = n_nationkey join orders on o_custkey = c_custkey group by 1, 2")
def join_multiway(spark, d):
    rows = t(spark, d, "orders").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("r_name", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("select p_partkey, low from part join (select unnest(range(900, 2200, 100))::double as low) on p_retailprice >= low and p_retailprice < low + 100")
def join_band(spark, d):
    bands = spark.range(900, 2200, 100).select(F.col("id").cast("double").alias("low"), (F.col("id") + 100).cast("double").alias("high"))
    return R.band_join(t(spark, d, "part"), bands, "p_retailprice", "low", "high", 100.0).select("p_partkey", "low")


# Aggregation


@query("select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(avg(l_extendedprice), 4) as avg_price, count(*)::bigint as n from lineitem group by 1, 2")
def agg_group(spark, d):
    return t(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.avg("l_extendedprice"), 4).alias("avg_price"), F.count(F.lit(1)).alias("n"))


@query("select o_custkey, count(*)::bigint as n from orders group by 1 having count(*) > 12")
def agg_having(spark, d):
    return t(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).where("n > 12")


@query("select count(*)::bigint as n, sum(l_linenumber)::bigint as lines, round(avg(l_discount), 6) as disc, count(nullif(l_linenumber, 1))::bigint as later from lineitem")
def agg_global(spark, d):
    return t(spark, d, "lineitem").agg(F.count(F.lit(1)).alias("n"), F.sum("l_linenumber").alias("lines"), F.round(F.avg("l_discount"), 6).alias("disc"), F.count(F.nullif("l_linenumber", F.lit(1))).alias("later"))


@query("select count(*)::bigint as n, sum(l_linenumber)::bigint as lines, max(l_tax) as tax from lineitem where l_quantity < 0")
def agg_empty(spark, d):
    return t(spark, d, "lineitem").where("l_quantity < 0").agg(F.count(F.lit(1)).alias("n"), F.sum("l_linenumber").alias("lines"), F.max("l_tax").alias("tax"))


@query("select l_returnflag, count(distinct l_suppkey)::bigint as suppliers from lineitem group by 1")
def agg_count_distinct(spark, d):
    return t(spark, d, "lineitem").groupBy("l_returnflag").agg(F.countDistinct("l_suppkey").alias("suppliers"))


@query("select p_brand, min(p_name) as first_name, max(p_name) as last_name, min(p_size) as least, max(p_size) as most from part group by 1")
def agg_min_max_str(spark, d):
    return t(spark, d, "part").groupBy("p_brand").agg(F.min("p_name").alias("first_name"), F.max("p_name").alias("last_name"), F.min("p_size").alias("least"), F.max("p_size").alias("most"))


@query("select c_mktsegment, round(stddev_samp(c_acctbal), 4) as sd, round(var_samp(c_acctbal), 2) as var from customer group by 1")
def agg_stddev_var(spark, d):
    return t(spark, d, "customer").groupBy("c_mktsegment").agg(F.round(F.stddev_samp("c_acctbal"), 4).alias("sd"), F.round(F.var_samp("c_acctbal"), 2).alias("var"))


@query("select distinct o_orderstatus, o_orderpriority from orders")
def select_distinct(spark, d):
    return t(spark, d, "orders").select("o_orderstatus", "o_orderpriority").distinct()


@query("select l_linenumber % 3 as k, floor(l_quantity / 10) as q, count(*)::bigint as n from lineitem group by 1, 2")
def agg_expr_key(spark, d):
    return t(spark, d, "lineitem").groupBy((F.col("l_linenumber") % 3).alias("k"), S.compat_floor(F.col("l_quantity") / 10).alias("q")).agg(F.count(F.lit(1)).alias("n"))


# Sorting and set operations


@query("select c_custkey, nullif(c_nationkey, 3) as k from customer order by k nulls first, c_custkey desc")
def sort_multi_nulls(spark, d):
    return R.ordered(t(spark, d, "customer").select("c_custkey", F.nullif("c_nationkey", F.lit(3)).alias("k")), F.asc("k"), F.desc("c_custkey"))


@query("select c_custkey, c_acctbal from customer order by abs(c_acctbal) desc")
def sort_expr_desc(spark, d):
    return R.ordered(t(spark, d, "customer").select("c_custkey", "c_acctbal"), F.desc(F.abs("c_acctbal")))


@query("select c_nationkey as k from customer union all select s_nationkey from supplier")
def union_all(spark, d):
    return t(spark, d, "customer").select(F.col("c_nationkey").alias("k")).union(t(spark, d, "supplier").select("s_nationkey"))


@query("select c_nationkey as k from customer union select s_nationkey from supplier")
def union_distinct(spark, d):
    return union_all(spark, d).distinct()


@query("select c_nationkey as k from customer where c_nationkey < 15 intersect select s_nationkey from supplier where s_nationkey > 5")
def intersect(spark, d):
    return t(spark, d, "customer").where("c_nationkey < 15").select(F.col("c_nationkey").alias("k")).intersect(t(spark, d, "supplier").where("s_nationkey > 5").select("s_nationkey"))


@query("select n_nationkey as k from nation except select s_nationkey from supplier where s_acctbal > 8000")
def except_distinct(spark, d):
    return t(spark, d, "nation").select(F.col("n_nationkey").alias("k")).subtract(t(spark, d, "supplier").where("s_acctbal > 8000").select("s_nationkey"))


@query("select c_nationkey as k from customer intersect all select s_nationkey from supplier")
def intersect_all(spark, d):
    return t(spark, d, "customer").select(F.col("c_nationkey").alias("k")).intersectAll(t(spark, d, "supplier").select("s_nationkey"))


@query("select c_nationkey as k from customer except all select s_nationkey from supplier")
def except_all(spark, d):
    return t(spark, d, "customer").select(F.col("c_nationkey").alias("k")).exceptAll(t(spark, d, "supplier").select("s_nationkey"))


# Functions and operators


def _line(spark, d, *columns):
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *columns)


@query("select c_custkey, abs(c_acctbal) as x, abs(c_nationkey - 10) as y from customer")
def fn_abs(spark, d):
    return t(spark, d, "customer").select("c_custkey", S.FUNCTIONS["abs"]("c_acctbal").alias("x"), F.abs(F.col("c_nationkey") - 10).alias("y"))


@query("select l_orderkey, l_linenumber, round(sin(l_quantity), 9) as s, round(cos(l_quantity), 9) as c, round(tan(l_discount), 9) as t, round(asin(l_discount), 9) as a, round(acos(l_discount), 9) as b, round(atan(l_quantity), 9) as e, round(atan2(l_tax, l_quantity), 9) as f from lineitem")
def fn_trig(spark, d):
    q, x = F.col("l_quantity"), F.col("l_discount")
    f = S.FUNCTIONS
    each = {"s": f["sin"](q), "c": f["cos"](q), "t": f["tan"](x), "a": f["asin"](x), "b": f["acos"](x), "e": f["atan"](q), "f": f["atan2"](F.col("l_tax"), q)}
    return _line(spark, d, *[F.round(v, 9).alias(k) for k, v in each.items()])


@query("select c_custkey, ceil(c_acctbal)::double as up, floor(c_acctbal)::double as down from customer")
def fn_ceil_floor(spark, d):
    return t(spark, d, "customer").select("c_custkey", S.compat_ceil(F.col("c_acctbal")).alias("up"), S.compat_floor(F.col("c_acctbal")).alias("down"))


@query("select n_nationkey, cast(floor((n_nationkey - 12) / 2.0::double + 0.5) as bigint) as x from nation")
def fn_round_half_up(spark, d):
    return t(spark, d, "nation").select("n_nationkey", S.compat_round((F.col("n_nationkey") - 12) / 2.0).alias("x"))


@query("select l_orderkey, l_linenumber, round(pow(l_discount, 2), 9) as p, round(sqrt(l_quantity), 9) as r from lineitem")
def fn_pow_sqrt(spark, d):
    return _line(spark, d, F.round(S.FUNCTIONS["pow"]("l_discount", F.lit(2)), 9).alias("p"), F.round(S.FUNCTIONS["sqrt"]("l_quantity"), 9).alias("r"))


@query("select n_nationkey, greatest(nullif(n_regionkey, 0), n_nationkey - 5) as g, least(nullif(n_regionkey, 0), n_nationkey - 5) as l from nation")
def fn_greatest_least(spark, d):
    a, b = F.nullif("n_regionkey", F.lit(0)), F.col("n_nationkey") - 5
    return t(spark, d, "nation").select("n_nationkey", F.greatest(a, b).alias("g"), F.least(a, b).alias("l"))


@query("select n_nationkey, coalesce(nullif(n_regionkey, 0), nullif(n_nationkey, 0), -1) as c, ifnull(nullif(n_regionkey, 1), 9) as i from nation")
def fn_coalesce_ifnull(spark, d):
    return t(spark, d, "nation").select("n_nationkey", F.coalesce(F.nullif("n_regionkey", F.lit(0)), F.nullif("n_nationkey", F.lit(0)), F.lit(-1)).alias("c"), F.ifnull(F.nullif("n_regionkey", F.lit(1)), F.lit(9)).alias("i"))


@query("select n_nationkey, case when nullif(n_regionkey, 0) > 2 then n_name else 'other' end as x from nation")
def fn_if(spark, d):
    return t(spark, d, "nation").select("n_nationkey", S.FUNCTIONS["if"](F.nullif("n_regionkey", F.lit(0)) > 2, F.col("n_name"), F.lit("other")).alias("x"))


@query("select n_nationkey, case when n_regionkey = 2 then null else n_name end as x, nullif(n_regionkey, 2) as y from nation")
def fn_nullif_cond(spark, d):
    return t(spark, d, "nation").select("n_nationkey", S.compat_nullif(F.col("n_regionkey") == 2, F.col("n_name")).alias("x"), F.nullif("n_regionkey", F.lit(2)).alias("y"))


@query("select n_nationkey, n_name || '-' || nullif(n_regionkey, 1)::varchar as x from nation")
def fn_concat(spark, d):
    return t(spark, d, "nation").select("n_nationkey", F.concat("n_name", F.lit("-"), F.nullif("n_regionkey", F.lit(1)).cast("string")).alias("x"))


@query("select n_nationkey, (n_regionkey - 2)::double / (n_nationkey - 10)::double as x from nation")
def op_divide(spark, d):
    return t(spark, d, "nation").select("n_nationkey", S.compat_divide(F.col("n_regionkey") - 2, F.col("n_nationkey") - 10).alias("x"))


@query("select n_nationkey, (n_nationkey - 12) % 5 as i, (n_nationkey - 12)::double % 2.5::double as f from nation")
def op_remainder(spark, d):
    return t(spark, d, "nation").select("n_nationkey", ((F.col("n_nationkey") - 12) % 5).alias("i"), ((F.col("n_nationkey") - 12).cast("double") % 2.5).alias("f"))


# Tables, transactions, statistics, audits


def _database(spark: SparkSession) -> Engine:
    return Engine(Database(spark, f"{scratch(spark)}/db-{uuid.uuid4().hex}"))


def _with_nation(spark: SparkSession, d: str) -> Engine:
    e = _database(spark)
    e.execute("create table nat (n_nationkey integer primary key, n_name varchar(30) not null, n_regionkey integer)")
    e.db.insert("nat", t(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"))
    return e


@query("select n_nationkey, n_name, n_regionkey from nation union all select n_nationkey + 100, n_name, null from nation where n_regionkey = 1")
def dml_insert_select(spark, d):
    e = _with_nation(spark, d)
    e.execute("insert into nat (n_name, n_nationkey) select n_name, n_nationkey + 100 from nat where n_regionkey = 1")
    return e.execute("select * from nat")


@query("select n_nationkey, case when n_regionkey > 2 then n_name || '!' else n_name end as n_name, case when n_regionkey > 2 then n_nationkey else n_regionkey end as n_regionkey from nation")
def dml_update(spark, d):
    e = _with_nation(spark, d)
    e.execute("update nat set n_name = concat(n_name, '!'), n_regionkey = n_nationkey where n_regionkey > 2")
    return e.execute("select * from nat")


@query("select n_nationkey, n_name, n_regionkey from nation where not coalesce(nullif(n_regionkey, 0) < 3, false)")
def dml_delete(spark, d):
    e = _with_nation(spark, d)
    e.execute("delete from nat where nullif(n_regionkey, 0) < 3")
    return e.execute("select * from nat")


@query("select n_nationkey, n_name, n_regionkey from nation where n_nationkey <> 3")
def txn_rollback(spark, d):
    e = _with_nation(spark, d)
    e.script("begin; delete from nat where n_nationkey = 3; commit; start transaction; delete from nat; rollback")
    return e.execute("select * from nat")


@query("select s.n_name, r_name from (select n_name, n_regionkey from nation where n_regionkey = 1) s join region on r_regionkey = n_regionkey")
def view_query(spark, d):
    e = _with_nation(spark, d)
    t(spark, d, "region").createOrReplaceTempView("larkspur_region")
    e.execute("create view americas as select n_name, n_regionkey from nat where n_regionkey = 1")
    return e.execute("select s.n_name, r_name from americas as s join larkspur_region on r_regionkey == n_regionkey")


_STATS = "select '{0}' as column_name, count(*)::bigint as rows, count(distinct {0})::bigint as distincts, (count(*) - count({0}))::bigint as nulls, {1} as low, {2} as high from supplier"


@query(" union all ".join(_STATS.format(c, *((f"min({c})::double", f"max({c})::double") if n else ("null::double", "null::double"))) for c, n in (("s_suppkey", 1), ("s_name", 0), ("s_nationkey", 1), ("s_acctbal", 1))))
def analyze_stats(spark, d):
    return statistics(t(spark, d, "supplier"))


@query("""with s as (select count(distinct l_returnflag) as f, min(l_quantity) as lo, max(l_quantity) as hi from lineitem)
select round(1.0::double / f, 9) as equal_flag, round(1 - 1.0::double / f, 9) as other_flag, round((hi - 30) / (hi - lo), 9) as at_least_30, round((1.0::double / f) * (1 - (hi - 30) / (hi - lo)), 9) as both_hold from s""")
def selectivity_report(spark, d):
    stats = {r["column_name"]: r.asDict() for r in statistics(t(spark, d, "lineitem").select("l_returnflag", "l_quantity")).collect()}
    flag, large = ("=", "l_returnflag", "R"), (">=", "l_quantity", 30)
    found = {"equal_flag": flag, "other_flag": ("<>", *flag[1:]), "at_least_30": large, "both_hold": ("and", flag, ("<", *large[1:]))}
    return spark.createDataFrame([tuple(round(estimate(stats, p), 9) for p in found.values())], ", ".join(f"{k} double" for k in found))


def _advice(column: str, kind: str) -> str:
    return f"""select '{column}' as column_name, n, runs, distincts, sortedness,
case when sortedness <> 2 and runs > 0.75 * n then 'RLE' when sortedness = 2 and distincts < 0.75 * n then 'DICTIONARY' else 'NONE' end as encoding from (
select count(*)::bigint as n, coalesce(sum(case when v = p or v = q then 1 else 0 end), 0)::bigint as runs, count(distinct raw)::bigint as distincts,
case when not coalesce(bool_or(v < p), false) and not coalesce(bool_or(v > p), false) then 0 when not coalesce(bool_or(v < p), false) then 1 when not coalesce(bool_or(v > p), false) then -1 else 2 end::int as sortedness
from (select {column}::{kind} as v, {column}::varchar as raw, lag({column}::{kind}) over (order by o_orderkey) as p, lead({column}::{kind}) over (order by o_orderkey) as q from orders))"""


@query(_advice("o_custkey", "double") + " union all " + _advice("o_orderstatus", "varchar") + " union all " + _advice("o_orderpriority", "varchar"))
def colstore_encoding_advisor(spark, d):
    return advise(t(spark, d, "orders"), "o_orderkey", ["o_custkey", "o_orderstatus", "o_orderpriority"])


@query("select o_orderkey, o_custkey from orders where o_custkey not in (select c_custkey from customer where c_nationkey > 5)")
def verify_fk_orphans(spark, d):
    return orphans(t(spark, d, "orders"), ["o_custkey"], t(spark, d, "customer").where("c_nationkey > 5"), ["c_custkey"]).select("o_orderkey", "o_custkey")


@query("select l_orderkey, l_suppkey, count(*)::bigint as n from lineitem group by 1, 2 having count(*) > 1")
def verify_pk_dups(spark, d):
    return duplicate_keys(t(spark, d, "lineitem").select("l_orderkey", "l_suppkey"), ["l_orderkey", "l_suppkey"])


@query("select 'primary key n_regionkey' as constraint, count(*)::bigint as violations from (select n_regionkey from nation group by 1 having count(*) > 1)")
def verify_constraints(spark, d):
    e = _database(spark)
    e.db.create_table("nat", TableDef([Column("n_nationkey", "INTEGER"), Column("n_regionkey", "INTEGER")], [Key(["n_regionkey"], True)]))
    e.db.insert("nat", t(spark, d, "nation").select("n_nationkey", "n_regionkey"))
    return e.execute("verify nat").where("constraint like 'primary%'").select("constraint", "violations")


# What the rest of the engine does, as rows


def _csv(spark: SparkSession, df: DataFrame) -> str:
    """``df`` as CSV files in the shared folder."""
    path = f"{scratch(spark)}/csv-{uuid.uuid4().hex}"
    df.write.csv(path, header=True)
    return path


_SUPPLIERS = "(s_suppkey integer, s_name varchar(30), s_nationkey integer, s_acctbal double)"


@query("select s_suppkey::int as s_suppkey, s_name, s_nationkey::int as s_nationkey, s_acctbal::double as s_acctbal from supplier")
def csv_load(spark, d):
    e = _database(spark)
    e.execute(f"create store sup from '{_csv(spark, t(spark, d, 'supplier').select('s_suppkey', 's_name', 's_nationkey', 's_acctbal'))}' {_SUPPLIERS}")
    e.execute("insert into sup select s_suppkey, s_name, s_nationkey, s_acctbal from sup where s_suppkey < 0")
    return e.execute("select * from sup")


def _column_store(spark: SparkSession, d: str) -> Engine:
    e = _database(spark)
    e.execute(f"create colstore sup from '{_csv(spark, t(spark, d, 'supplier').select('s_suppkey', 's_name', 's_nationkey', 's_acctbal'))}' {_SUPPLIERS}")
    return e


@query("select s_suppkey::int as s_suppkey, s_acctbal * 2 as twice from supplier where s_acctbal > 1000 and s_nationkey between 3 and 12")
def colstore_scan(spark, d):
    return _column_store(spark, d).execute("select s_suppkey, s_acctbal * 2 as twice from sup where s_acctbal > 1000 and s_nationkey between 3 and 12")


@query("select n_name, count(*) as n, max(s_name) as last from supplier join nation on s_nationkey = n_nationkey group by n_name")
def colstore_join(spark, d):
    e = _column_store(spark, d)
    t(spark, d, "nation").createOrReplaceTempView("larkspur_nation")
    return e.execute("select n_name, count(*) as n, max(s_name) as last from sup join larkspur_nation on s_nationkey == n_nationkey group by n_name")


@query("select o_orderpriority as value, 'o_orderpriority' as column_name, ceil(log2(n + 1))::int as code_bits, floor(16 / ceil(log2(n + 1)))::int as codes_per_block from (select min(o_orderpriority) as o_orderpriority, count(distinct o_orderpriority) as n from orders)")
def colstore_code_width(spark, d):
    rows = t(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    got = code_width(advise(rows, "o_orderkey")).select("column_name", "code_bits", "codes_per_block")
    return got.join(rows.agg(F.min("o_orderpriority").alias("value")))


@query("select * from (values (1::int, 'it''s . a; b', 2.5::double, null::int), (2, 'x', 3.0, 7), (12, null, 0.5, 8)) v(a, b, c, e)")
def insert_values_coercion(spark, d):
    e = _database(spark)
    e.script("create table v (a integer, b varchar(20), c double, e integer); insert into v values (1, 'it''s . a; b', 2.5, null), ('2', 'x', 3, 7.9)")
    e.execute("insert into v (c, a, e) values (0.5f, 12, '8')")
    return e.execute("select * from v")


@query("select n_nationkey, n_name, n_regionkey from nation where n_nationkey > 20 union all select n_nationkey, n_name, n_regionkey from nation where n_nationkey > 20")
def optimize_keeps_rows(spark, d):
    e = _with_nation(spark, d)
    e.script("insert into nat select * from nat; create index by_key on nat (n_nationkey); optimize nat; vacuum")
    return e.execute("select * from nat where n_nationkey > 20")


@query("select c_custkey, c_acctbal from customer order by c_acctbal desc, c_custkey limit 10 offset 5")
def limit_topk(spark, d):
    t(spark, d, "customer").createOrReplaceTempView("larkspur_customer")
    return _database(spark).execute("select c_custkey, c_acctbal from larkspur_customer order by c_acctbal desc, c_custkey limit 10 offset 5")


@query("select n_nationkey, n_name from nation where n_regionkey = 2")
def drop_and_recreate(spark, d):
    e = _with_nation(spark, d)
    e.script("create view few as select n_nationkey, n_name from nat where n_regionkey = 1; create index nat_index on nat (n_name); drop index nat_index; drop view few; drop table if exists nothing")
    e.script("create view few as select n_nationkey, n_name from nat where n_regionkey = 2")
    return e.execute("select * from few")


@query(r"""select * from (values ('a.c', true, true, false, false), ('abc', false, true, false, false), ('a%c', false, true, true, false), ('a^$\', false, false, false, true)) v(s, dot, anything, listed, signs)""")
def similar_to_escapes(spark, d):
    df = spark.createDataFrame([("a.c",), ("abc",), ("a%c",), ("a^$\\",)], "s string")
    each = {"dot": "a.c", "anything": "a_c", "listed": "a[%]c", "signs": "a^$\\"}
    return df.select("s", *[R.similar_to(F.col("s"), p).alias(n) for n, p in each.items()])


@query("select n_nationkey, case when n_regionkey = 2 then null else n_nationkey + 0.5::double end as x, n_regionkey::int <> 0 as y from nation")
def compat_in_sql(spark, d):
    t(spark, d, "nation").createOrReplaceTempView("larkspur_nation")
    return _database(spark).execute("select n_nationkey, compat_nullif(n_regionkey = 2, n_nationkey + 0.5) as x, compat_truth(n_regionkey) as y from larkspur_nation")


@query("select n_regionkey, sum(n_nationkey * 2)::bigint as twice, max(n_nationkey) - min(n_nationkey) as width from nation group by 1")
def plugin_functions(spark, d):
    """A scalar and a grouped aggregate function of the user's, both vectorised."""
    e = _database(spark)
    twice = F.pandas_udf(lambda x: x * 2, "long")
    width = F.pandas_udf(_width, "long")
    e.db.functions.add(f"twice_{uuid.uuid4().hex[:8]}", twice)
    rows = t(spark, d, "nation")
    sums = rows.select("n_regionkey", twice(F.col("n_nationkey").cast("long")).alias("x")).groupBy("n_regionkey").agg(F.sum("x").alias("twice"))
    return sums.join(rows.groupBy("n_regionkey").agg(width(F.col("n_nationkey").cast("long")).alias("width")), "n_regionkey")


def _width(x: pd.Series) -> int:
    return int(x.max() - x.min())


@query("select r.k, r.what, r.n from (values ('insert', 'after', 25::bigint), ('update', 'after', 5::bigint), ('delete', 'after', 5::bigint)) r(what, k, n)")
def row_listeners(spark, d):
    """What listeners are told: the new rows of an update, the old ones of a delete."""
    e, seen = _database(spark), []
    e.execute("create table nat (n_nationkey integer, n_name varchar(30), n_regionkey integer)")
    e.db.row_listeners.append(lambda when, what, table, rows: seen.append((when, what, rows.where("new.n_regionkey = 9 and old.n_regionkey = 1").count() if what == "update" else rows.count())))
    e.db.insert("nat", t(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"))
    e.script("update nat set n_regionkey = 9 where n_regionkey = 1; delete from nat where n_regionkey = 9")
    return spark.createDataFrame([(k, what, n) for k, what, n in seen if k == "after"], "k string, what string, n long")
