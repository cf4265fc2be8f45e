"""Schema rowsets of a model as DataFrames, and the $system queries over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from prismata.functions.scalar import SCALARS
from prismata.model import TYPES, Measure, Model
from prismata.plans.compiler import _COLUMN_AGGS, _ITERATORS, _TABLES
from prismata.plans.mdx import parse_mdx
from prismata.plans.parser import DaxError, parse_expression
from prismata.sources.results import csdl, xml_metadata

#: Rowsets that a model of this kind leaves empty.
EMPTY = {
    "DISCOVER_KEYWORDS": "Keyword", "DISCOVER_INSTANCES": "INSTANCE_NAME", "DBSCHEMA_COLUMNS": "TABLE_NAME", "MDSCHEMA_SETS": "SET_NAME", "MDSCHEMA_KPIS": "KPI_NAME", "TMSCHEMA_HIERARCHIES": "Name", "TMSCHEMA_LEVELS": "Name",
    "TMSCHEMA_DATA_SOURCES": "Name", "TMSCHEMA_ROLES": "Name", "TMSCHEMA_ROLE_MEMBERSHIPS": "Name", "TMSCHEMA_KPIS": "Name", "TMSCHEMA_PERSPECTIVES": "Name", "TMSCHEMA_ANNOTATIONS": "Name",
}
_OTHERS = ["ISINSCOPE", "ISSUBTOTAL", "ISFILTERED", "SELECTEDVALUE", "LOOKUPVALUE", "CONTAINS", "RELATED", "EARLIER", "EARLIEST", "COUNTROWS", "ISEMPTY", "CALCULATE", "ROLLUP", "ROLLUPADDISSUBTOTAL", "ROLLUPGROUP", "IGNORE", "TODAY", "NOW"]


def function_names() -> list[str]:
    return sorted({*SCALARS, *_COLUMN_AGGS, *_ITERATORS, *_TABLES, *_OTHERS})


CUBE = "Model"
#: Numbers that the rowsets use for types: OLE DB types of columns, and the tabular model's own.
OLE = {"string": 130, "int64": 20, "double": 5, "decimal": 14, "boolean": 11, "dateTime": 7, "binary": 128}
TOM = {"string": 2, "int64": 6, "double": 8, "dateTime": 9, "decimal": 10, "boolean": 11, "binary": 17}


def _unique(*path: str) -> str:
    return ".".join(f"[{x}]" for x in path)


def _aggregator(m: Measure) -> int:
    """The number of a plain sum, count, minimum, maximum, average or distinct count; 127 for any other expression."""
    n = parse_expression(m.expression)
    return {"SUM": 1, "COUNT": 2, "COUNTROWS": 2, "MIN": 3, "MAX": 4, "AVERAGE": 5, "DISTINCTCOUNT": 8}.get(n[1], 127) if n[0] == "call" else 127


def _tables(rows: list[dict], types: str) -> tuple[list[str], list[tuple]]:
    """Columns as ``types`` names them (? Boolean, # number), rows by name; what a row lacks is null."""
    names = types.split()
    return names, [tuple(r.get(n.rstrip("?#")) for n in names) for r in rows]


def _rows(m: Model, name: str) -> tuple[list[str], list[tuple]]:
    """Column names (those ending in ? are Boolean, in # numbers) and rows of a rowset."""
    visible = [t for t in m.tables.values() if not t.hidden]
    levels = [(t, c) for t in visible for c in t.columns if not c.hidden]
    home = {"CATALOG_NAME": m.name, "CUBE_NAME": CUBE}
    ids = {t.name: str(k + 1) for k, t in enumerate(m.tables.values())}
    column_id = {(t.name, c.name): str(k + 1) for k, (t, c) in enumerate((t, c) for t in m.tables.values() for c in t.columns)}

    def cubes():
        return _tables([home | {"CUBE_TYPE": "CUBE", "CUBE_CAPTION": CUBE, "DESCRIPTION": m.description, "IS_DRILLTHROUGH_ENABLED": True, "IS_LINKABLE": False, "IS_WRITE_ENABLED": False, "IS_SQL_ENABLED": False, "CUBE_SOURCE": 1, "PREFERRED_QUERY_PATTERNS": 1}], "CATALOG_NAME SCHEMA_NAME CUBE_NAME CUBE_TYPE DESCRIPTION IS_DRILLTHROUGH_ENABLED? IS_LINKABLE? IS_WRITE_ENABLED? IS_SQL_ENABLED? CUBE_CAPTION BASE_CUBE_NAME CUBE_SOURCE# PREFERRED_QUERY_PATTERNS#")

    def measures():
        rows = [
            home | {"MEASURE_NAME": x.name, "MEASURE_UNIQUE_NAME": _unique("Measures", x.name), "MEASURE_CAPTION": x.name, "MEASURE_AGGREGATOR": _aggregator(x), "DATA_TYPE": 5, "NUMERIC_PRECISION": 65535, "NUMERIC_SCALE": -1, "DESCRIPTION": x.description, "EXPRESSION": x.expression,
                    "MEASURE_IS_VISIBLE": not x.hidden, "MEASURE_NAME_SQL_COLUMN_NAME": x.name, "MEASURE_UNQUALIFIED_CAPTION": x.name, "MEASUREGROUP_NAME": x.table, "MEASURE_DISPLAY_FOLDER": x.folder, "DEFAULT_FORMAT_STRING": x.format}
            for x in m.measures.values()
        ]
        return _tables(rows, "CATALOG_NAME SCHEMA_NAME CUBE_NAME MEASURE_NAME MEASURE_UNIQUE_NAME MEASURE_CAPTION MEASURE_AGGREGATOR# DATA_TYPE# NUMERIC_PRECISION# NUMERIC_SCALE# DESCRIPTION EXPRESSION MEASURE_IS_VISIBLE? MEASURE_NAME_SQL_COLUMN_NAME MEASURE_UNQUALIFIED_CAPTION MEASUREGROUP_NAME MEASURE_DISPLAY_FOLDER DEFAULT_FORMAT_STRING")

    def dimensions():
        rows = [home | {"DIMENSION_NAME": "Measures", "DIMENSION_UNIQUE_NAME": "[Measures]", "DIMENSION_CAPTION": "Measures", "DIMENSION_ORDINAL": 0, "DIMENSION_TYPE": 2, "DIMENSION_CARDINALITY": len(m.measures), "DEFAULT_HIERARCHY": "[Measures]", "DIMENSION_IS_VISIBLE": True, "IS_VIRTUAL": False, "IS_READWRITE": False, "DIMENSION_UNIQUE_SETTINGS": 1}]
        rows += [home | {"DIMENSION_NAME": t.name, "DIMENSION_UNIQUE_NAME": _unique(t.name), "DIMENSION_CAPTION": t.name, "DIMENSION_ORDINAL": k + 1, "DIMENSION_TYPE": 1 if t.category == "Time" else 3, "DEFAULT_HIERARCHY": _unique(t.name, t.columns[0].name) if t.columns else None, "DESCRIPTION": t.description, "DIMENSION_IS_VISIBLE": True, "IS_VIRTUAL": False, "IS_READWRITE": False, "DIMENSION_UNIQUE_SETTINGS": 1} for k, t in enumerate(visible)]
        return _tables(rows, "CATALOG_NAME SCHEMA_NAME CUBE_NAME DIMENSION_NAME DIMENSION_UNIQUE_NAME DIMENSION_GUID DIMENSION_CAPTION DIMENSION_ORDINAL# DIMENSION_TYPE# DIMENSION_CARDINALITY# DEFAULT_HIERARCHY DESCRIPTION IS_VIRTUAL? IS_READWRITE? DIMENSION_UNIQUE_SETTINGS# DIMENSION_IS_VISIBLE?")

    def hierarchies():
        rows = [home | {"DIMENSION_UNIQUE_NAME": _unique(t.name), "HIERARCHY_NAME": c.name, "HIERARCHY_UNIQUE_NAME": _unique(t.name, c.name), "HIERARCHY_CAPTION": c.name, "DIMENSION_TYPE": 1 if t.category == "Time" else 3, "DEFAULT_MEMBER": _unique(t.name, c.name, "All"), "ALL_MEMBER": _unique(t.name, c.name, "All"), "DESCRIPTION": c.description, "STRUCTURE": 0, "IS_VIRTUAL": False, "IS_READWRITE": False, "DIMENSION_UNIQUE_SETTINGS": 1, "DIMENSION_IS_VISIBLE": True, "HIERARCHY_ORDINAL": k + 1, "HIERARCHY_IS_VISIBLE": True, "HIERARCHY_ORIGIN": 2, "HIERARCHY_DISPLAY_FOLDER": c.folder, "INSTANCE_SELECTION": 0, "GROUPING_BEHAVIOR": 1} for k, (t, c) in enumerate(levels)]
        return _tables(rows, "CATALOG_NAME SCHEMA_NAME CUBE_NAME DIMENSION_UNIQUE_NAME HIERARCHY_NAME HIERARCHY_UNIQUE_NAME HIERARCHY_GUID HIERARCHY_CAPTION DIMENSION_TYPE# HIERARCHY_CARDINALITY# DEFAULT_MEMBER ALL_MEMBER DESCRIPTION STRUCTURE# IS_VIRTUAL? IS_READWRITE? DIMENSION_UNIQUE_SETTINGS# DIMENSION_IS_VISIBLE? HIERARCHY_ORDINAL# HIERARCHY_IS_VISIBLE? HIERARCHY_ORIGIN# HIERARCHY_DISPLAY_FOLDER INSTANCE_SELECTION# GROUPING_BEHAVIOR#")

    def leveled():
        rows = [home | {"DIMENSION_UNIQUE_NAME": _unique(t.name), "HIERARCHY_UNIQUE_NAME": _unique(t.name, c.name), "LEVEL_NAME": x, "LEVEL_UNIQUE_NAME": _unique(t.name, c.name, x), "LEVEL_CAPTION": x, "LEVEL_NUMBER": k, "LEVEL_TYPE": 0 if k else 1, "DESCRIPTION": c.description if k else None, "CUSTOM_ROLLUP_SETTINGS": 0, "LEVEL_UNIQUE_SETTINGS": 0, "LEVEL_IS_VISIBLE": True, "LEVEL_ORDERING_PROPERTY": (c.sort_by or c.name) if k else x, "LEVEL_DBTYPE": OLE[c.data_type] if k else 3, "LEVEL_ATTRIBUTE_HIERARCHY_NAME": c.name if k else None, "LEVEL_KEY_CARDINALITY": 1, "LEVEL_ORIGIN": 2} for t, c in levels for k, x in enumerate(["(All)", c.name])]
        return _tables(rows, "CATALOG_NAME SCHEMA_NAME CUBE_NAME DIMENSION_UNIQUE_NAME HIERARCHY_UNIQUE_NAME LEVEL_NAME LEVEL_UNIQUE_NAME LEVEL_GUID LEVEL_CAPTION LEVEL_NUMBER# LEVEL_CARDINALITY# LEVEL_TYPE# DESCRIPTION CUSTOM_ROLLUP_SETTINGS# LEVEL_UNIQUE_SETTINGS# LEVEL_IS_VISIBLE? LEVEL_ORDERING_PROPERTY LEVEL_DBTYPE# LEVEL_ATTRIBUTE_HIERARCHY_NAME LEVEL_KEY_CARDINALITY# LEVEL_ORIGIN#")

    def members():
        """The member that holds all; a condition on TREE_OP keeps it where the operation includes the member itself (8)."""
        rows = [home | {"DIMENSION_UNIQUE_NAME": _unique(t.name), "HIERARCHY_UNIQUE_NAME": _unique(t.name, c.name), "LEVEL_UNIQUE_NAME": _unique(t.name, c.name, "(All)"), "LEVEL_NUMBER": 0, "MEMBER_ORDINAL": 0, "MEMBER_NAME": "All", "MEMBER_UNIQUE_NAME": _unique(t.name, c.name, "All"), "MEMBER_TYPE": 2, "MEMBER_CAPTION": "All", "CHILDREN_CARDINALITY": 1, "PARENT_COUNT": 0, "MEMBER_KEY": "0", "IS_PLACEHOLDERMEMBER": False, "IS_DATAMEMBER": False, "TREE_OP": 8} for t, c in levels]
        return _tables(rows, "CATALOG_NAME SCHEMA_NAME CUBE_NAME DIMENSION_UNIQUE_NAME HIERARCHY_UNIQUE_NAME LEVEL_UNIQUE_NAME LEVEL_NUMBER# MEMBER_ORDINAL# MEMBER_NAME MEMBER_UNIQUE_NAME MEMBER_TYPE# MEMBER_GUID MEMBER_CAPTION CHILDREN_CARDINALITY# PARENT_LEVEL# PARENT_UNIQUE_NAME PARENT_COUNT# DESCRIPTION EXPRESSION MEMBER_KEY IS_PLACEHOLDERMEMBER? IS_DATAMEMBER? SCOPE# TREE_OP#")

    def properties():
        rows = [home | {"DIMENSION_UNIQUE_NAME": _unique(t.name), "HIERARCHY_UNIQUE_NAME": _unique(t.name, c.name), "LEVEL_UNIQUE_NAME": _unique(t.name, c.name, c.name), "PROPERTY_TYPE": 4, "PROPERTY_NAME": p, "PROPERTY_CAPTION": p, "DATA_TYPE": 130 if p == "MEMBER_CAPTION" else OLE[c.data_type], "PROPERTY_CONTENT_TYPE": 0, "PROPERTY_IS_VISIBLE": True} for t, c in levels for p in ("MEMBER_CAPTION", "MEMBER_KEY")]
        return _tables(rows, "CATALOG_NAME SCHEMA_NAME CUBE_NAME DIMENSION_UNIQUE_NAME HIERARCHY_UNIQUE_NAME LEVEL_UNIQUE_NAME MEMBER_UNIQUE_NAME PROPERTY_TYPE# PROPERTY_NAME PROPERTY_CAPTION DATA_TYPE# PROPERTY_CONTENT_TYPE# PROPERTY_IS_VISIBLE?")

    def group_dimensions():
        """Each table that a fact reaches over active relationships, near or far."""
        rows = []
        for g in sorted({x.table for x in m.measures.values()}):
            seen, queue = [g], [g]
            while queue:
                at = queue.pop(0)
                for r in m.relationships:
                    if r.active and r.from_table == at and r.to_table not in seen:
                        seen.append(r.to_table)
                        queue.append(r.to_table)
            rows += [home | {"MEASUREGROUP_NAME": g, "MEASUREGROUP_CARDINALITY": "MANY", "DIMENSION_UNIQUE_NAME": _unique(t), "DIMENSION_CARDINALITY": "ONE" if t != g else "MANY", "DIMENSION_IS_VISIBLE": True, "DIMENSION_IS_FACT_DIMENSION": t == g} for t in seen]
        return _tables(rows, "CATALOG_NAME SCHEMA_NAME CUBE_NAME MEASUREGROUP_NAME MEASUREGROUP_CARDINALITY DIMENSION_UNIQUE_NAME DIMENSION_CARDINALITY DIMENSION_IS_VISIBLE? DIMENSION_IS_FACT_DIMENSION? DIMENSION_PATH DIMENSION_GRANULARITY")

    made = {
        "DISCOVER_DATASOURCES": lambda: _tables([{"DataSourceName": m.name, "DataSourceDescription": m.description, "ProviderName": "Spark SQL", "ProviderType": "MDP", "AuthenticationMode": "Unauthenticated"}], "DataSourceName DataSourceDescription URL DataSourceInfo ProviderName ProviderType AuthenticationMode"),
        "DISCOVER_PROPERTIES": lambda: _tables([{"PropertyName": n, "PropertyDescription": n, "PropertyType": t, "PropertyAccessType": "ReadWrite" if n == "Catalog" else "Read", "IsRequired": False, "Value": v} for n, t, v in (("Catalog", "string", m.name), ("Cube", "string", CUBE), ("DbpropMsmdSubqueries", "int", "1"), ("Format", "string", "Tabular"), ("ServerMode", "string", "Tabular"), ("MdpropMdxSubqueries", "int", "15"))], "PropertyName PropertyDescription PropertyType PropertyAccessType IsRequired? Value"),
        "DISCOVER_SCHEMA_ROWSETS": lambda: _tables([{"SchemaName": n, "Description": n} for n in rowsets()], "SchemaName SchemaGuid Restrictions Description RestrictionsMask#"),
        "DISCOVER_LITERALS": lambda: _tables([{"LiteralName": n, "LiteralValue": v, "LiteralMaxLength": k} for n, v, k in (("DBLITERAL_CATALOG_NAME", "", 24), ("DBLITERAL_CATALOG_SEPARATOR", ".", 0), ("DBLITERAL_COLUMN_ALIAS", "", -1), ("DBLITERAL_COLUMN_NAME", "", -1), ("DBLITERAL_CUBE_NAME", "", 24), ("DBLITERAL_QUOTE_PREFIX", "[", -1), ("DBLITERAL_QUOTE_SUFFIX", "]", -1))], "LiteralName LiteralValue LiteralInvalidChars LiteralInvalidStartingChars LiteralMaxLength#"),
        "DISCOVER_CATALOGS": lambda: _tables([{"CATALOG_NAME": m.name, "DESCRIPTION": m.description}], "CATALOG_NAME DESCRIPTION"),
        "DISCOVER_XML_METADATA": lambda: (["METADATA"], [(xml_metadata(m),)]),
        "DISCOVER_CSDL_METADATA": lambda: (["METADATA"], [(csdl(m),)]),
        "DBSCHEMA_CATALOGS": lambda: _tables([{"CATALOG_NAME": m.name, "DESCRIPTION": m.description, "ROLES": "*", "TYPE": 1, "COMPATIBILITY_LEVEL": 1200}], "CATALOG_NAME DESCRIPTION ROLES DATE_MODIFIED COMPATIBILITY_LEVEL# TYPE#"),
        "DBSCHEMA_TABLES": lambda: _tables([{"TABLE_CATALOG": m.name, "TABLE_SCHEMA": CUBE, "TABLE_NAME": t.name, "TABLE_TYPE": "TABLE", "DESCRIPTION": t.description} for t in visible], "TABLE_CATALOG TABLE_SCHEMA TABLE_NAME TABLE_TYPE TABLE_GUID DESCRIPTION TABLE_PROPID# DATE_CREATED DATE_MODIFIED"),
        "MDSCHEMA_CUBES": cubes, "MDSCHEMA_MEASURES": measures, "MDSCHEMA_DIMENSIONS": dimensions, "MDSCHEMA_HIERARCHIES": hierarchies, "MDSCHEMA_LEVELS": leveled, "MDSCHEMA_PROPERTIES": properties, "MDSCHEMA_MEMBERS": members, "MDSCHEMA_MEASUREGROUP_DIMENSIONS": group_dimensions,
        "MDSCHEMA_MEASUREGROUPS": lambda: _tables([home | {"MEASUREGROUP_NAME": n, "MEASUREGROUP_CAPTION": n, "IS_WRITE_ENABLED": False} for n in sorted({x.table for x in m.measures.values()})], "CATALOG_NAME SCHEMA_NAME CUBE_NAME MEASUREGROUP_NAME DESCRIPTION IS_WRITE_ENABLED? MEASUREGROUP_CAPTION"),
        "MDSCHEMA_FUNCTIONS": lambda: _tables([{"FUNCTION_NAME": n, "PARAMETER_LIST": "(none)", "RETURN_TYPE": 12, "ORIGIN": 4, "INTERFACE_NAME": "DAX", "CAPTION": n} for n in function_names()], "FUNCTION_NAME DESCRIPTION PARAMETER_LIST RETURN_TYPE# ORIGIN# INTERFACE_NAME LIBRARY_NAME CAPTION"),
        "TMSCHEMA_MODEL": lambda: _tables([{"ID": "1", "Name": m.name, "Description": m.description, "DefaultMode": "0", "Culture": m.properties.get("culture", "en-US")}], "ID Name Description DefaultMode Culture"),
        "TMSCHEMA_TABLES": lambda: _tables([{"ID": ids[t.name], "ModelID": "1", "Name": t.name, "DataCategory": t.category, "Description": t.description, "IsHidden": t.hidden} for t in m.tables.values()], "ID ModelID Name DataCategory Description IsHidden?"),
        "TMSCHEMA_COLUMNS": lambda: _tables([{"ID": column_id[t.name, c.name], "TableID": ids[t.name], "TableName": t.name, "Name": c.name, "ExplicitName": c.name, "DataType": c.data_type, "ExplicitDataType": TOM[c.data_type], "SparkType": TYPES[c.data_type], "IsHidden": c.hidden, "FormatString": c.format, "SortByColumn": c.sort_by, "IsKey": c.key, "SourceColumn": c.source or c.name, "DisplayFolder": c.folder, "DataCategory": c.category, "SummarizeBy": c.summarize_by, "Description": c.description} for t in m.tables.values() for c in t.columns], "ID TableID TableName Name ExplicitName DataType ExplicitDataType# SparkType IsHidden? FormatString SortByColumn IsKey? SourceColumn DisplayFolder DataCategory SummarizeBy Description"),
        "TMSCHEMA_MEASURES": lambda: _tables([{"ID": str(k + 1), "TableID": ids[x.table], "TableName": x.table, "Name": x.name, "Description": x.description, "Expression": x.expression, "IsHidden": x.hidden, "FormatString": x.format, "DisplayFolder": x.folder} for k, x in enumerate(m.measures.values())], "ID TableID TableName Name Description Expression IsHidden? FormatString DisplayFolder"),
        "TMSCHEMA_RELATIONSHIPS": lambda: _tables([{"ID": str(k + 1), "ModelID": "1", "Name": r.name, "IsActive": r.active, "FromTableID": ids[r.from_table], "FromTable": r.from_table, "FromColumnID": column_id[r.from_table, r.from_column], "FromColumn": r.from_column, "FromCardinality": "many", "ToTableID": ids[r.to_table], "ToTable": r.to_table, "ToColumnID": column_id[r.to_table, r.to_column], "ToColumn": r.to_column, "ToCardinality": "one", "CrossFilter": "both" if r.both else "one"} for k, r in enumerate(m.relationships)], "ID ModelID Name IsActive? FromTableID FromTable FromColumnID FromColumn FromCardinality ToTableID ToTable ToColumnID ToColumn ToCardinality CrossFilter"),
        "TMSCHEMA_PARTITIONS": lambda: _tables([{"ID": str(k + 1), "TableID": ids[t.name], "TableName": t.name, "Name": t.name, "Source": t.source, "Type": "parquet"} for k, t in enumerate(m.tables.values())], "ID TableID TableName Name Source Type"),
        "LINEAGE": lambda: (["Measure", "DependsOn"], [(x.name, d) for x in m.measures.values() for d in m.upstream(x.name)]),
        "LINEAGE_IMPACT": lambda: (["Object", "Measure"], [(o, x) for o in [*(x.name for x in m.measures.values()), *(f"{t.name}[{c.name}]" for t in m.tables.values() for c in t.columns)] for x in m.downstream(o)]),
    }
    if name in EMPTY:
        return [EMPTY[name]], []
    if name == "":
        return sorted(made), []
    if name not in made:
        raise DaxError(f"unknown rowset {name}")
    return made[name]()


def rowsets() -> list[str]:
    return sorted([*_rows(Model(""), "")[0], *EMPTY])


def rowset(spark: SparkSession, model: Model, name: str) -> DataFrame:
    """A schema rowset, built from the catalog alone."""
    names, rows = _rows(model, name.upper())
    schema = ", ".join(f"`{n.rstrip('?#')}` {'boolean' if n.endswith('?') else 'int' if n.endswith('#') else 'string'}" for n in names)
    return spark.createDataFrame(rows, schema)


def system_query(spark: SparkSession, model: Model, text: str, parameters: dict[str, str] | None = None) -> DataFrame:
    """``SELECT cols FROM $system.ROWSET WHERE a = 'x' AND b``: projection and conditions both apply."""
    q = parse_mdx(text)
    kind, _, name = q.cube.partition(".")
    if kind.lower() != "$system":
        raise DaxError("not a $system query")
    df = rowset(spark, model, name.strip("[]"))
    have = {c.lower(): c for c in df.columns}
    for col, op, value in q.conditions:
        if str(value).startswith("@"):
            value = (parameters or {})[value[1:]]
        if col.lower() not in have:
            raise DaxError(f"{name} has no column {col}")
        c = F.lower(F.col(have[col.lower()]).cast("string"))
        df = df.where(c == str(value).lower() if op == "=" else c != str(value).lower())
    wanted = [c for c in q.columns if c != "*"]
    return df.select(*[have[c.lower()] for c in wanted]) if wanted else df
