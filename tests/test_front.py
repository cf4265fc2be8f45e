"""Parser, model, lineage, commands, MDX and metadata."""

import json
from xml.etree import ElementTree

import pytest

from prismata.model import Model, ModelError
from prismata.plans.compiler import Engine
from prismata.plans.mdx import parse_mdx, run_mdx, translate
from prismata.plans.parser import DaxError, parse_expression, parse_query
from prismata.sources.demo import demo_model
from prismata.sources.metadata import function_names, rowset, rowsets, system_query
from prismata.sources.results import csdl, evaluate_json, evaluate_rowsets, xml_metadata


def test_precedence_and_literals():
    assert parse_expression("1 + 2 * 3") == ("bin", "+", ("lit", 1), ("bin", "*", ("lit", 2), ("lit", 3)))
    assert parse_expression('"a""b"') == ("lit", 'a"b')
    assert parse_expression("NOT a = b")[1] == "="
    assert parse_expression("x NOT IN {1}")[1] == "NOT"
    assert parse_expression("'My T'[c]") == ("col", "My T", "c")


def test_query_parts():
    q = parse_query("DEFINE VAR x = 1 MEASURE t[m] = 2 /* c */ EVALUATE t ORDER BY t[a] DESC, [b] START AT 1, 2 -- end\n EVALUATE u")
    assert len(q.evaluates) == 2 and [a for _, a in q.evaluates[0].order] == [False, True] and len(q.evaluates[0].start) == 2
    for bad in ("EVALUATE", "SELECT 1", "EVALUATE t ORDER", "EVALUATE FILTER(t,"):
        with pytest.raises(DaxError):
            parse_query(bad)


def test_model_round_trip_and_checks():
    m = demo_model()
    again = Model.from_json(m.to_json())
    assert again.tables == m.tables and again.measures == m.measures and again.relationships == m.relationships
    bad = m.to_json().replace('"int64"', '"variant"', 1)
    with pytest.raises(ModelError):
        Model.from_json(bad)


def test_lineage():
    m = demo_model()
    assert m.upstream("Return Rate")[:2] == ["Returned Revenue", "Revenue"]
    assert "lineitem[l_discount]" in m.upstream("Return Rate")
    assert m.downstream("Revenue") == ["Returned Revenue", "Return Rate", "All Region Revenue"]
    assert "Quantity" in m.downstream("lineitem[l_quantity]")


def test_commands_take_effect_or_none():
    m = demo_model()
    new = m.apply([{"command": "renameMeasure", "name": "Revenue", "newName": "Net"}, {"command": "deleteRelationship", "name": "labels.doc_id-documents.doc_id"}])
    assert new.measure("Net") and not m.measure("Net") and "[Net]" in new.measure("Return Rate").expression
    with pytest.raises(ModelError):
        m.apply([{"command": "createMeasure", "table": "orders", "name": "x", "expression": "1"}, {"command": "deleteMeasure", "name": "absent"}])
    assert m.apply([{"command": "deleteTable", "name": "labels"}], dry_run=True) is m
    with pytest.raises(ModelError):
        m.apply([{"command": "createMeasure", "table": "orders", "name": "a", "expression": "[a]"}])


def test_mdx_shapes():
    one = translate('SELECT NON EMPTY Hierarchize({DrilldownLevel({[part].[p_type].[All]},,,INCLUDE_CALC_MEMBERS)}) DIMENSION PROPERTIES PARENT_UNIQUE_NAME ON COLUMNS FROM [Model] WHERE ([Measures].[Quantity]) CELL PROPERTIES VALUE')
    assert one.shape == "SingleDim" and one.non_empty
    assert one.cells == "EVALUATE SUMMARIZECOLUMNS('part'[p_type], \"Value\", [Quantity])" and one.total == "EVALUATE { CALCULATE([Quantity]) }"
    assert translate("SELECT {[Product].[Color].[Color].AllMembers} ON COLUMNS FROM [Model]").cells == "EVALUATE VALUES('Product'[Color])"
    two = translate("SELECT {[region].[r_name].Members} ON COLUMNS, {[part].[p_type].Members} ON ROWS FROM (SELECT ({[region].[r_name].&[ASIA], [region].[r_name].&[EUROPE]}) ON COLUMNS FROM [Model]) WHERE ([Measures].[Quantity])")
    assert two.shape == "TwoDimAxes" and 'IN {"ASIA", "EUROPE"}' in two.cells and 'IN {"ASIA", "EUROPE"}' in two.total
    assert translate("SELECT FROM [Model] WHERE ([Measures].[Quantity], [region].[r_name].&[ASIA])").cells == "EVALUATE { CALCULATE([Quantity], 'region'[r_name] = \"ASIA\") }"
    assert translate("SELECT {[Measures].[a],[Measures].[b]} ON COLUMNS FROM [Model]").cells == 'EVALUATE ROW("a", [a], "b", [b])'
    cross = "SELECT NON EMPTY CrossJoin(Hierarchize({[r].[a].Members}), {[Measures].[m],[Measures].[n]}) ON COLUMNS"
    assert translate(f"{cross} FROM [Model]").shape == "SingleAxisCrossJoin"
    assert translate(f"{cross}, {{[s].[b].Members}} ON ROWS FROM [Model]").shape == "CrossJoinMatrix"
    assert translate("WITH MEMBER [Measures].[x] AS '[Quantity] * 2' SELECT {[Measures].[x]} ON COLUMNS FROM [Model]").cells == 'EVALUATE ROW("x", [Quantity] * 2)'


def test_mdx_runs(spark, sf):
    t = translate("SELECT {[region].[r_name].Members} ON COLUMNS FROM [Model] WHERE ([Measures].[Quantity])")
    e = Engine(spark, demo_model(), sf)
    cells, total = e.query(t.cells)[0].collect(), e.query(t.total)[0].collect()
    assert sum(r[1] for r in cells) == total[0][0]


def test_metadata(spark):
    m = demo_model()
    for name in rowsets():
        rowset(spark, m, name).collect()
    got = system_query(spark, m, "SELECT [Name], [DataType] FROM $system.TMSCHEMA_COLUMNS WHERE [TableName] = 'region' AND [IsHidden] <> 'true'").collect()
    assert [tuple(r) for r in got] == [("r_regionkey", "int64"), ("r_name", "string")]
    assert system_query(spark, m, "SELECT * FROM $system.MDSCHEMA_CUBES WHERE CATALOG_NAME = @c", {"c": "other"}).count() == 0
    assert parse_mdx("SELECT * FROM $system.TMSCHEMA_MODEL").cube == "$system.TMSCHEMA_MODEL"


def test_every_function_is_registered():
    assert len(function_names()) >= 128


def test_named_sets_and_children():
    t = translate("WITH SET [S] AS '{[region].[r_name].&[ASIA]}' SELECT {[S]} ON COLUMNS FROM [Model] WHERE ([Measures].[Quantity])")
    assert t.dims == [("region", "r_name")] and "= \"ASIA\"" in t.cells and t.total == "EVALUATE { CALCULATE([Quantity]) }"
    up = translate("WITH SET [S] AS {[region].[r_name].&[ASIA],[region].[r_name].&[AFRICA]} SELECT Hierarchize(Generate([S], Ascendants([region].[r_name].currentMember))) ON COLUMNS FROM [Model] WHERE ([Measures].[Quantity], [lineitem].[l_returnflag].&[R])")
    assert up.shape == "SingleDim" and 'IN {"ASIA", "AFRICA"}' in up.cells and up.total == "EVALUATE { CALCULATE([Quantity], 'lineitem'[l_returnflag] = \"R\") }"
    below = translate("WITH MEMBER [Measures].[n] AS '[nation].[n_name].currentmember.children.count' SELECT {[Measures].[n]} ON COLUMNS FROM [Model]")
    assert below.cells == "EVALUATE ROW(\"n\", IF(ISINSCOPE('nation'[n_name]), 0, COUNTROWS(VALUES('nation'[n_name]))))"
    with pytest.raises(DaxError):
        translate("WITH SET [A] AS {[B]} SET [B] AS {[A]} SELECT [A] ON COLUMNS FROM [Model]")


def test_non_empty_drops_blank_rows(spark, sf):
    """A hierarchy beside a constant keeps every member; NON EMPTY keeps those with a value."""
    text = "WITH MEMBER [Measures].[z] AS 'IF([Orders] > 100000, [Orders])' SELECT NON EMPTY {[region].[r_name].Members} ON COLUMNS, {[Measures].[z]} ON ROWS FROM [Model]"
    t, cells, total = run_mdx(Engine(spark, demo_model(), sf), text)
    assert t.non_empty and cells.count() == 0 and total is None


def test_commands_rename_everywhere():
    m = demo_model()
    new = m.apply([
        {"type": "RenameModel", "newName": "Shop"}, {"type": "SetModelProperty", "property": {"culture": "de-DE"}}, {"type": "RenameTable", "table": "lineitem", "newName": "Sales Lines"}, {"type": "RenameColumn", "table": "Sales Lines", "column": "l_quantity", "newName": "Pieces"},
        {"type": "ChangeColumnType", "table": "part", "column": "p_size", "dataType": "Double"}, {"type": "SetTableProperty", "table": "part", "property": {"isHidden": True, "description": None}}, {"type": "SetColumnProperty", "table": "part", "column": "p_size", "property": {"formatString": "0.0"}},
        {"type": "AddColumn", "table": "part", "name": "extra", "dataType": "string"}, {"type": "UpdateMeasureExpression", "name": "Orders", "expression": "COUNTROWS(orders) + 0"}, {"type": "SetMeasureFormatString", "name": "Orders", "formatString": None},
        {"type": "UpdateRelationship", "name": "events.user_id-customer.c_custkey", "isActive": False, "bidirectional": True}, {"type": "RenameMeasure", "name": "Revenue", "newName": "Net"}, {"type": "DeleteTable", "table": "labels"},
    ])
    assert new.name == "Shop" and new.properties == {"culture": "de-DE"} and new.table("sales lines").source == "lineitem.parquet"
    assert new.measure("Quantity").expression == "SUM('Sales Lines'[Pieces])" and new.measure("Quantity").table == "Sales Lines"
    assert new.column("Sales Lines", "Pieces").source == "l_quantity" and new.column("part", "p_size").data_type == "double" and new.column("part", "p_size").format == "0.0" and new.table("part").hidden
    assert {r.from_table for r in new.relationships} == {"Sales Lines", "orders", "customer", "nation", "supplier", "events"}
    assert "[Net]" in new.measure("Return Rate").expression and any(r.both and not r.active for r in new.relationships)
    assert new.apply([{"type": "RenameTable", "table": "part", "newName": "Part"}]).table("part").name == "Part"
    for bad in ({"type": "RenameTable", "table": "part", "newName": "orders"}, {"type": "RenameColumn", "table": "part", "column": "p_size", "newName": "p_name"}, {"type": "SetModelProperty", "property": {"colour": 1}}, {"type": "ChangeColumnType", "table": "orders", "column": "o_custkey", "dataType": "string"}, {"type": "Nothing"}):
        with pytest.raises(ModelError):
            m.apply([bad])


def test_renamed_columns_are_read(spark, sf):
    new = demo_model().apply([{"type": "RenameColumn", "table": "lineitem", "column": "l_quantity", "newName": "Pieces"}, {"type": "RenameTable", "table": "lineitem", "newName": "Sales Lines"}])
    old = Engine(spark, demo_model(), sf).query('EVALUATE ROW("q", [Quantity])')[0].first()[0]
    assert Engine(spark, new, sf).query("EVALUATE ROW(\"q\", [Quantity] + 0 * SUM('Sales Lines'[Pieces]))")[0].first()[0] == old


def test_documented_model_shape(spark, tmp_path):
    """Tables at the top, a data source each, types in any case; the many side stands first in a relationship."""
    spark.createDataFrame([(1, 10.0, 2.0), (1, 40.0, 1.0), (2, 50.0, 3.0)], "ProductSK long, Amount double, Quantity double").write.parquet(f"{tmp_path}/data/sales.parquet")
    spark.createDataFrame([(1, "a", "Red"), (2, "b", "Blue")], "ProductSK long, ProductType string, Color string").write.parquet(f"{tmp_path}/data/product.parquet")
    text = """{"name": "DemoModel", "tables": [
      {"name": "Sales", "dataSource": "data/sales.parquet", "columns": [{"name": "ProductSK", "dataType": "Int64"}, {"name": "Amount", "dataType": "double", "summarizeBy": "sum"}, {"name": "Quantity", "dataType": "double"}],
       "measures": [{"name": "TotalAmount", "expression": "SUM(Sales[Amount])"}, {"name": "AmountAbove30", "expression": "CALCULATE(SUM(Sales[Amount]), Sales[Amount] > 30)"}, {"name": "DoubleTotal", "expression": "[TotalAmount] * 2"}]},
      {"name": "Product", "dataSource": "data/product.parquet", "dataCategory": "Regular", "columns": [{"name": "ProductSK", "dataType": "Int64", "isKey": true}, {"name": "ProductType", "dataType": "string"}, {"name": "Color", "dataType": "String", "displayFolder": "x"}], "measures": []}],
      "relationships": [{"name": "Sales_Product", "fromTable": "Sales", "fromColumn": "ProductSK", "toTable": "Product", "toColumn": "ProductSK", "crossFilteringBehavior": "single", "isActive": true}]}"""
    m = Model.from_json(text)
    got = Engine(spark, m, str(tmp_path)).query('EVALUATE SUMMARIZECOLUMNS(Product[Color], "t", [TotalAmount], "a", [AmountAbove30], "d", [DoubleTotal])')[0].collect()
    assert sorted(map(tuple, got)) == [("Blue", 50.0, 50.0, 100.0), ("Red", 50.0, 40.0, 100.0)]
    again = Model.from_json(m.to_json())
    assert again.tables == m.tables and again.measures == m.measures and again.relationships == m.relationships


def test_sinks(spark, sf):
    e = Engine(spark, demo_model(), sf)
    two = 'EVALUATE SELECTCOLUMNS(region, "n <&>", region[r_name], "k", IF(region[r_regionkey] > 0, region[r_regionkey])) ORDER BY [k] EVALUATE ROW("t", TRUE(), "d", DATE(2024, 1, 31))'
    got = json.loads(evaluate_json(e, two))
    assert [len(x["rows"]) for x in got] == [5, 1] and got[0]["rows"][0][1] is None and got[0]["columns"][1]["dataType"] == "xsd:long" and got[1]["rows"] == [[True, "2024-01-31T00:00:00"]]
    root = ElementTree.fromstring(evaluate_rowsets(e, two))
    ns = "{urn:schemas-microsoft-com:xml-analysis:rowset}"
    assert [len(r.findall(f"{ns}row")) for r in root] == [5, 1] and len(root[0].find(f"{ns}row")) == 1  # the null has no element
    assert ElementTree.fromstring(csdl(demo_model())) is not None
    doc = ElementTree.fromstring(csdl(demo_model()))
    edm = "{http://schemas.microsoft.com/ado/2008/09/edm}"
    assert len(doc.findall(f"{edm}EntityType")) == 10 and len(doc.findall(f"{edm}Association")) == 9
    assert len(ElementTree.fromstring(xml_metadata(demo_model())).findall("Model/Tables/Table")) == 10
