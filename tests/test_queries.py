"""Every registered query of the reference's operators against its DuckDB twin."""

import datetime
import decimal
import hashlib
import math
import os

import duckdb
import pytest

from tessera.operators import sequential
from tessera.plans import catalog

SF = os.environ.get("TESSERA_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in sorted(os.listdir(SF)):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def plain(value):
    """A value in a form that both engines share."""
    if isinstance(value, dict):
        return tuple(plain(v) for v in value.values())
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, datetime.date):
        return datetime.datetime(value.year, value.month, value.day).isoformat()
    return float(value) if isinstance(value, int) and not isinstance(value, bool) else value


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in found)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = rows(df.columns, df.collect())
    assert len(set(df.columns)) == len(df.columns)
    if name not in catalog.ORACLES:
        return
    found = duck.execute(catalog.ORACLES[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == rows(columns, found.fetchall())


def test_oracles_belong_to_queries():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)


def test_lineage_goes_no_second_way_by_hash(spark):
    plan = catalog.QUERIES["lineage_check"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.split("hashpartitioning(")[1:] if not x.startswith("l_orderkey#") or "," in x.split(")")[0].rsplit(",", 1)[0]]


def test_words_of_a_text_stay_in_its_row(spark):
    plan = catalog.QUERIES["task_vocabulary"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan


def test_the_plan_of_tied_lines_is_the_same_on_every_run(spark, tmp_path):
    rows = [(9, p, 1, p, "A") for p in range(1, 12)] + [(99, p, 1, 1, "A") for p in (40, 30, 20)]
    for n, order in enumerate((rows, rows[::-1])):
        spark.createDataFrame(order, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string").coalesce(1).write.parquet(str(tmp_path / f"{n}/lineitem.parquet"))
        found = catalog.QUERIES["resolution_plan"](spark, str(tmp_path / str(n))).collect()
        assert [(r.items, r.ids) for r in found] == [(12, hashlib.md5(",".join(sorted(map(str, [*range(1, 12), 20]))).encode()).hexdigest())]


def test_gaps_of_keys_small_and_large(spark):
    day = datetime.datetime(2024, 1, 1)
    at = lambda hours: day + datetime.timedelta(hours=hours)
    rows = [(u, "a", at(h), u * 100 + h) for u in range(50) for h in (0, 24, 25, 40)] + [(7, "a", None, 1), (90, "b", None, 2), (90, "b", None, 3), (None, "a", at(0), 4), (None, "a", at(1), 5)]
    frame = spark.createDataFrame(rows, "u long, k string, ts timestamp, id long").repartition(3)
    got = {r.id: r.accepted for r in sequential.accept_after_gap(frame, ["u", "k"], "ts", "id", 86_400).filter("id BETWEEN 1 AND 5 OR u = 3").collect()}
    assert got == {300: True, 324: False, 325: True, 340: False, 1: None, 2: True, 3: None, 4: True, 5: False}
