"""The catalogue against DuckDB, and the driver's entry points."""

import __spark_entry__
import pytest

from larkspur import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, sf, same, name):
    same(catalogue.queries()[name](spark, sf), catalogue.oracle_sql()[name])


def test_entry(spark):
    rows = __spark_entry__.entry(spark)
    assert rows.columns == ["c_name", "n_name", "net"] and rows.count() == 1394
    net = [r["net"] for r in rows.collect()]
    assert net == sorted(net, reverse=True)


def test_names():
    found = __spark_entry__.queries()
    assert set(catalogue.queries()) <= set(found) and set(__spark_entry__.oracle_sql()) <= set(found)


def test_sorted_nulls_first(spark, sf):
    got = [(r["k"], r["c_custkey"]) for r in catalogue.sort_multi_nulls(spark, sf).collect()]
    assert got == sorted(got, key=lambda x: (x[0] is not None, x[0] or 0, -x[1])) and got[0][0] is None


def test_scan_is_pruned_and_filtered(spark, sf, capsys):
    catalogue.filter_between(spark, sf).explain("formatted")
    plan = capsys.readouterr().out
    assert "PushedFilters: [IsNotNull(value)" in plan and "props" not in plan


def test_band_join_is_an_equi_join(spark, sf, capsys):
    catalogue.join_band(spark, sf).explain()
    plan = capsys.readouterr().out
    assert "NestedLoop" not in plan and "Cartesian" not in plan
