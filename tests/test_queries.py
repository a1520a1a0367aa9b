"""Every query against another SQL engine on the same tables."""

import datetime
import decimal
import math
from pathlib import Path

import duckdb
import pytest

from tidemill.plans import registry
from tidemill.sources.tables import TABLES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def cell(v):
    if v is None:
        return "~"
    if isinstance(v, (float, decimal.Decimal)) and not isinstance(v, bool):
        return "nan" if math.isnan(v) else f"{float(v):.7g}"
    if isinstance(v, (datetime.date, datetime.datetime)):
        return str(v)
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    rows = df.collect()
    if name not in registry.ORACLE:
        assert rows
        return
    result = duck.execute(registry.ORACLE[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    line = lambda row, names: tuple(cell(row[names.index(c)]) for c in sorted(names))
    assert sorted(line(r, df.columns) for r in rows) == sorted(line(r, columns) for r in result.fetchall())


def test_filters_reach_the_scan(spark):
    plan = registry.QUERIES["scan_filtered"](spark, DATA)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(l_quantity)" in plan
    assert "l_comment" not in plan and "l_tax" not in plan.split("ReadSchema")[1]


def plan_of(spark, name):
    return registry.QUERIES[name](spark, DATA)._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["zset_popmin", "zset_popmax", "set_take_n", "hash_take_n", "list_pop", "list_index", "zset_revrange"])
def test_first_rows_are_limited_before_they_meet(spark, name):
    assert "WindowGroupLimit" in plan_of(spark, name)


def test_not_in_broadcasts_nothing_by_force(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(spark, "not_in_subquery").split("== Physical Plan ==")[1]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "LeftAnti" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("name", ["bit_count", "bit_pos"])
def test_bits_need_no_text_search(spark, name):
    plan = plan_of(spark, name).lower()
    assert "regexp" not in plan and "transform(" not in plan and ("conv(" not in plan)


def test_ranks_are_counted_by_cell(spark):
    assert "__cell" in plan_of(spark, "zset_rank")


def test_exports(spark, tmp_path):
    from tidemill.sources import tables

    nation = tables.load(spark, DATA, "nation").select("n_nationkey", "n_name")
    tables.export_json(nation, f"{tmp_path}/json")
    with open(f"{tmp_path}/json/broken.txt", "w") as f:
        f.write('{"n_nationkey": 1, "n_na\n')
    good, bad = tables.rescue_json(spark, f"{tmp_path}/json", "n_nationkey int, n_name string")
    assert sorted(map(tuple, good.collect())) == sorted(map(tuple, nation.collect())) and [r[0] for r in bad.collect()] == ['{"n_nationkey": 1, "n_na']
    tables.export_kv_text(tables.kv(nation, "n_nationkey", "n_name"), f"{tmp_path}/text")
    assert sorted(r[0] for r in spark.read.text(f"{tmp_path}/text").collect()) == sorted(f"{r[0]}\t{r[1]}" for r in nation.collect())


def test_running_counts(spark):
    from tidemill.streaming import changes
    from tidemill.sources import tables

    events = tables.load(spark, DATA, "events")
    got = changes.running_counts(events, "ts", "event_type", "1 day", "1 hour")
    assert got.agg({"n": "sum"}).first()[0] == events.count()
