"""Every registered DAX query against DuckDB, and semantics on small hand-made tables."""

import datetime
import glob
import os
from concurrent.futures import ThreadPoolExecutor

import duckdb
import pytest

from prismata.model import ColumnDef, Measure, Model, ModelError, Relationship, Table
from prismata.operators.queries import CASES, ORACLES, QUERIES
from prismata.plans import compiler
from prismata.plans.compiler import Engine
from prismata.plans.parser import DaxError
from prismata.sources import co_locate
from prismata.sources.demo import demo_model


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return float(f"{float(v):.9g}")


@pytest.fixture(scope="session")
def duck(sf):
    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", ORACLES)
def test_against_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    want = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = [want.columns.index(c) for c in df.columns]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    got = sorted((tuple(plain(v) for v in r) for r in df.collect()), key=key)
    assert got == sorted((tuple(plain(r[k]) for k in order) for r in want.fetchall()), key=key)


@pytest.mark.parametrize("name, table", [("generate_all", "customer"), ("date_functions", "orders")])
def test_whole_tables(spark, name, table):
    """Every row of the table comes out."""
    sf = "/root/testdata/sf0.01"
    df = QUERIES[name](spark, sf)
    want = duckdb.sql(CASES[name][2].replace("FROM customer LEFT JOIN events", f"FROM '{sf}/customer.parquet' LEFT JOIN '{sf}/events.parquet'").replace("FROM orders", f"FROM '{sf}/orders.parquet'"))
    order = [want.columns.index(c) for c in df.columns]
    got = {tuple(plain(v) for v in r) for r in df.collect()}
    assert got == {tuple(plain(r[k]) for k in order) for r in want.fetchall()}
    assert len(got) == spark.read.parquet(f"{sf}/{table}.parquet").count()


def test_matrix_scans_the_fact_once(spark, sf):
    df = Engine(spark, demo_model(), sf).query('EVALUATE SUMMARIZECOLUMNS(region[r_name], lineitem[l_returnflag], "a", [Revenue], "b", [Returned Revenue], "c", [Quantity], "d", AVERAGE(lineitem[l_tax]))')[0]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_extendedprice") and sum("lineitem__l_returnflag" in x and "Relation [" in x for x in plan.split("\n")) <= 2
    assert sum("Relation [" in x and "l_extendedprice" in x for x in plan.split("\n")) <= 2


@pytest.mark.parametrize("name, most", [("matrix_quantity", 1), ("matrix_measure", 2), ("matrix_heads", 1), ("matrix_body", 2), ("var_measures", 1), ("rollup_one_axis", 2)])
def test_rollups_scan_the_fact_once(spark, sf, name, most):
    df = QUERIES[name](spark, sf)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert sum("FileScan parquet" in x and "l_orderkey" in x for x in plan.split("\n")) <= most


@pytest.fixture(scope="session")
def small(spark, tmp_path_factory):
    """Sales whose products are missing or null, an empty table, an all-null column, ties, a repeated key, two facts on one dimension."""
    d = f"file://{tmp_path_factory.mktemp('small')}"
    put = lambda rows, schema, name: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{d}/{name}.parquet")
    put([(1, 10, 1.0, None), (2, 10, 2.0, None), (3, 20, 4.0, None), (4, 99, 8.0, None), (5, None, 16.0, None)], "id long, product long, amount double, empty double", "sales")
    put([(10, "red"), (20, None), (30, "blue")], "product long, color string", "product")
    put([], "id long, product long, amount double", "none")
    put([(1, 10, 5), (2, 30, 7)], "id long, product long, n long", "stock")
    m = Model("small")
    kinds = {"sales": "id:int64 product:int64 amount:double empty:double", "product": "product:int64 color:string", "none": "id:int64 product:int64 amount:double", "stock": "id:int64 product:int64 n:int64"}
    for t, cols in kinds.items():
        m.tables[t] = Table(t, f"{t}.parquet", tuple(ColumnDef(*c.split(":")) for c in cols.split()))
    m.relationships = [Relationship("a", "sales", "product", "product", "product"), Relationship("b", "stock", "product", "product", "product")]
    m.measures = {"total": Measure("sales", "Total", "SUM(sales[amount])")}
    return Engine(spark, m, d)


def rows(e, text):
    return sorted((tuple(r) for r in e.query(text)[0].collect()), key=lambda r: tuple((x is None, str(x)) for x in r))


def test_orphans_fall_into_the_blank_group(small):
    assert rows(small, 'EVALUATE SUMMARIZECOLUMNS(product[color], "t", [Total])') == [("red", 3.0), (None, 28.0)]
    assert rows(small, 'EVALUATE ROW("n", COUNTROWS(VALUES(product[color])), "d", DISTINCTCOUNT(sales[product]))') == [(3, 4)]


def test_rollups_on_odd_tables(small):
    """Orphans count in each level; a total is there if a measure isn't blank, and in SUMMARIZE always."""
    q = 'EVALUATE SUMMARIZECOLUMNS(ROLLUPADDISSUBTOTAL(product[color], "all"), {})'
    assert rows(small, q.format('"t", [Total]')) == [("red", False, 3.0), (None, False, 28.0), (None, True, 31.0)]
    assert rows(small, q.format('"t", IF(ISBLANK([Total]), 0, [Total])')) == [("blue", False, 0.0), ("red", False, 3.0), (None, False, 28.0), (None, True, 31.0)]
    assert rows(small, q.format('"t", [Total], "n", SUM(stock[n])')) == [("blue", False, None, 7), ("red", False, 3.0, 5), (None, False, 28.0, None), (None, True, 31.0, 12)]
    assert rows(small, 'EVALUATE SUMMARIZECOLUMNS(ROLLUPADDISSUBTOTAL(none[id], "all"), "t", SUM(none[amount]))') == []
    assert rows(small, 'EVALUATE SUMMARIZECOLUMNS(ROLLUPADDISSUBTOTAL(none[id], "all"), "t", COUNTROWS(none) + 0)') == [(None, True, 0)]
    assert rows(small, 'EVALUATE SUMMARIZE(none, ROLLUP(none[id]), "t", SUM(none[amount]))') == [(None, None)]
    assert rows(small, 'EVALUATE SUMMARIZECOLUMNS(ROLLUPADDISSUBTOTAL(sales[id], "all"), "t", IF(ISBLANK([Total]), ERROR("no sales"), [Total]))')[-1] == (None, True, 31.0)
    assert rows(small, 'EVALUATE SUMMARIZE(sales, ROLLUP(sales[product]), "t", [Total], "v", VAR x = [Total] RETURN x * 2)') == [(10, 3.0, 6.0), (20, 4.0, 8.0), (99, 8.0, 16.0), (None, 31.0, 62.0)]


def test_empty_and_null_columns(small):
    assert rows(small, 'EVALUATE ROW("s", SUM(none[amount]), "n", COUNTROWS(none), "m", MIN(none[amount]), "e", ISEMPTY(none))') == [(None, None, None, True)]
    assert rows(small, 'EVALUATE ROW("s", SUM(sales[empty]), "n", COUNT(sales[empty]), "a", AVERAGE(sales[empty]), "d", DISTINCTCOUNT(sales[empty]))') == [(0.0, None, None, 1)]
    assert rows(small, "EVALUATE TOPN(3, none, none[amount])") == []


def test_blank_rules(small):
    assert rows(small, 'EVALUATE ROW("a", BLANK() + 1, "b", BLANK() * 2, "c", BLANK() = 0, "d", BLANK() = "", "e", BLANK() = BLANK(), "f", BLANK() < BLANK(), "g", 1 / 0, "h", NOT(BLANK()), "i", BLANK() IN {1}, "j", "x" & BLANK())') == [(1, None, True, True, True, False, None, True, False, "x")]


def test_table_functions_keep_duplicates_and_nulls(small):
    assert rows(small, "EVALUATE INTERSECT(SELECTCOLUMNS(sales, \"p\", sales[product]), VALUES(product[product]))") == [(10,), (10,), (20,), (None,)]
    assert rows(small, "EVALUATE EXCEPT(SELECTCOLUMNS(sales, \"p\", sales[product]), DISTINCT(product[product]))") == [(99,), (None,)]
    assert rows(small, "EVALUATE DISTINCT(product[color])") == [("blue",), ("red",)]


def test_unrelated_groups_are_crossed_up_to_a_bound(spark, sf, monkeypatch):
    text = 'EVALUATE SUMMARIZECOLUMNS(events[event_type], part[p_type], "v", SUM(events[value]))'
    e = Engine(spark, demo_model(), sf)
    assert e.query(text)[0].count() == 30
    monkeypatch.setattr(compiler, "CROSSED", 29)
    with pytest.raises(DaxError):
        e.query(text)


def test_two_queries_keep_their_measures_apart(spark, sf):
    """Queries compile in threads of their own, each with the measures that it defines."""
    e = Engine(spark, demo_model(), sf)
    ask = lambda k: e.query(f'DEFINE MEASURE region[M] = {k} EVALUATE ROW("m", [M])')[0].first()[0]
    with ThreadPoolExecutor(8) as pool:
        assert list(pool.map(ask, range(24))) == list(range(24))


def test_co_located_tables_are_not_shuffled(spark, sf, tmp_path):
    m = demo_model()
    r = m.find_relationship(("lineitem", "l_orderkey"), ("orders", "o_orderkey"))
    near = co_locate(spark, m, sf, r, f"file://{tmp_path}", 4)
    text = 'EVALUATE SUMMARIZECOLUMNS(orders[o_orderpriority], "q", [Quantity])'
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans = {}
        for name, model in (("far", m), ("near", near)):
            df = Engine(spark, model, sf).query(text)[0]
            plans[name] = (sorted(map(tuple, df.collect())), df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("hashpartitioning(orders__o_orderkey") + df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("hashpartitioning(lineitem__l_orderkey"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plans["near"][0] == plans["far"][0] and plans["near"][1] == 0 < plans["far"][1]


def test_one_rule_for_blanks_in_orders(small):
    """Blanks come first in both directions, in ORDER BY, TOPN, SAMPLE and places; START AT starts after them."""
    got = lambda text: [tuple(r) for r in small.query(text)[0].collect()]
    p = 'SELECTCOLUMNS(sales, "i", sales[id], "p", sales[product])'
    assert [r[1] for r in got(f"EVALUATE {p} ORDER BY [p], [i]")] == [None, 10, 10, 20, 99]
    assert [r[1] for r in got(f"EVALUATE {p} ORDER BY [p] DESC, [i]")] == [None, 99, 20, 10, 10]
    assert [r[1] for r in got(f"EVALUATE {p} ORDER BY [p] DESC, [i] START AT 20")] == [20, 10, 10]
    assert rows(small, f"EVALUATE TOPN(2, {p}, [p], 0)") == [(4, 99), (5, None)] and rows(small, f"EVALUATE TOPN(1, {p}, [p], 1)") == [(5, None)]
    assert rows(small, f"EVALUATE SAMPLE(2, {p}, [p], 0, [i], 1)") == [(2, 10), (5, None)]
    assert rows(small, f'EVALUATE SUBSTITUTEWITHINDEX({p}, "at", SELECTCOLUMNS(VALUES(sales[product]), "p", sales[product]), [p], DESC)') == [(1, 3), (2, 3), (3, 2), (4, 1), (5, 0)]
    with pytest.raises(DaxError):
        small.query("EVALUATE TOPN(-1, sales, sales[id])")


def test_bidirectional_filters(small):
    q = 'EVALUATE SUMMARIZECOLUMNS(stock[id], "one", [Total], "both", CALCULATE([Total], CROSSFILTER(stock[product], product[product], BOTH)))'
    assert rows(small, q) == [(1, 31.0, 3.0), (2, 31.0, None)]


def test_lookup_conflict_is_an_error(small):
    with pytest.raises(Exception, match="several values"):
        small.query('EVALUATE ROW("x", LOOKUPVALUE(sales[amount], sales[product], 10))')[0].collect()


def test_errors(small):
    for bad in ('EVALUATE ROW("x", 1 = "a")', "EVALUATE unknown", 'EVALUATE ROW("x", SUM(product[color]))', 'EVALUATE ROW("x", [absent])', "EVALUATE REMOVEFILTERS(sales)", 'EVALUATE ROW("x", CALCULATE([Total], sales[id] = stock[id]))', "EVALUATE sales ORDER BY [nothing]"):
        with pytest.raises(DaxError):
            small.query(bad)


def test_missing_column_and_refresh(spark, small):
    m = small.model
    broken = Model("x", {**m.tables, "none": Table("none", "none.parquet", (ColumnDef("absent", "int64"),))}, {}, [])
    with pytest.raises(ModelError):
        Engine(spark, broken, small.folder).query("EVALUATE none")
    small.refresh()
    assert len(rows(small, "EVALUATE sales")) == 5
