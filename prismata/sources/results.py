"""Results and metadata as documents: JSON tables, XML rowsets, and the CSDL and XML descriptions of a model.

Rows are drawn from the executors one partition at a time and written as they come, so a document of any
length needs the memory of one partition.
"""

from __future__ import annotations

import datetime
import decimal
import io
import json
import math
from collections.abc import Iterable
from typing import IO
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame

from prismata.model import TYPES, Model

#: XML Schema types of result columns, by Spark type.
XSD = {"string": "string", "bigint": "long", "int": "int", "double": "double", "boolean": "boolean", "timestamp_ntz": "dateTime", "timestamp": "dateTime", "date": "date", "binary": "base64Binary"}
#: Entity data model types, by model type.
EDM = {"string": "String", "int64": "Int64", "double": "Double", "decimal": "Decimal", "boolean": "Boolean", "dateTime": "DateTime", "binary": "Binary"}


def _plain(v: object) -> object:
    """A value as JSON has it: moments in ISO form, numbers that JSON lacks as null."""
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    return None if isinstance(v, float) and not math.isfinite(v) else v


def _xsd(df: DataFrame) -> list[tuple[str, str]]:
    return [(n, XSD.get(t, "decimal" if t.startswith("decimal") else "string")) for n, t in df.dtypes]


def write_json(results: Iterable[DataFrame], out: IO[str]) -> None:
    """A list with an object for each result: its columns with their types, and its rows as lists."""
    out.write("[")
    for k, df in enumerate(results):
        columns = json.dumps([{"name": n, "dataType": f"xsd:{t}"} for n, t in _xsd(df)], ensure_ascii=False)
        out.write(f'{"," if k else ""}{{"columns": {columns}, "rows": [')
        for j, r in enumerate(df.toLocalIterator()):
            out.write(("," if j else "") + json.dumps([_plain(v) for v in r], ensure_ascii=False))
        out.write("]}")
    out.write("]")


def evaluate_json(engine, text: str) -> str:
    """All results of a query as one JSON document."""
    out = io.StringIO()
    write_json(engine.query(text), out)
    return out.getvalue()


def _xml_text(v: object) -> str:
    return escape(str(v).lower() if isinstance(v, bool) else str(_plain(v)))


def write_rowset(df: DataFrame, out: IO[str]) -> None:
    """One rowset: a schema that names the columns C0, C1, ..., then a row element for each row; a null has no element."""
    out.write('<root xmlns="urn:schemas-microsoft-com:xml-analysis:rowset" xmlns:xsd="http://www.w3.org/2001/XMLSchema" xmlns:sql="urn:schemas-microsoft-com:xml-sql">')
    fields = "".join(f'<xsd:element sql:field={quoteattr(n)} name="C{k}" type="xsd:{t}" minOccurs="0"/>' for k, (n, t) in enumerate(_xsd(df)))
    out.write(f'<xsd:schema elementFormDefault="qualified"><xsd:complexType name="row"><xsd:sequence>{fields}</xsd:sequence></xsd:complexType></xsd:schema>')
    for r in df.toLocalIterator():
        out.write("<row>" + "".join(f"<C{k}>{_xml_text(v)}</C{k}>" for k, v in enumerate(r) if v is not None) + "</row>")
    out.write("</root>")


def evaluate_rowsets(engine, text: str) -> str:
    """The rowset of a query, or of several in the order asked for, as one XML document."""
    out, results = io.StringIO(), engine.query(text)
    if len(results) > 1:
        out.write('<results xmlns="http://schemas.microsoft.com/analysisservices/2003/xmla-multipleresults">')
    for df in results:
        write_rowset(df, out)
    if len(results) > 1:
        out.write("</results>")
    return out.getvalue()


def _edm_name(name: str) -> str:
    """A name as the entity data model allows it: letters, digits and underscores, not a digit first."""
    out = "".join(c if c.isalnum() else "_" for c in name)
    return f"_{out}" if out[:1].isdigit() else out


def csdl(m: Model) -> str:
    """The model as a conceptual schema: an entity type for each table, measures as properties, an association for each relationship."""
    sets, types, links, ends = [], [], [], []
    for t in m.tables.values():
        name = _edm_name(t.name)
        hidden = ' Hidden="true"' if t.hidden else ""
        sets.append(f'<EntitySet Name="{name}" EntityType="Model.{name}"><bi:EntitySet Caption={quoteattr(t.name)}{hidden}/></EntitySet>')
        body = []
        for c in t.columns:
            more = "".join(f" {k}={quoteattr(v)}" for k, v in (("FormatString", c.format), ("DisplayFolder", c.folder), ("OrderBy", c.sort_by and _edm_name(c.sort_by)), ("Hidden", c.hidden and "true")) if v)
            body.append(f'<Property Name="{_edm_name(c.name)}" Type="{EDM[c.data_type]}" Nullable="{str(not c.key).lower()}"><bi:Property Caption={quoteattr(c.name)}{more}/></Property>')
        for x in m.measures.values():
            if x.table == t.name:
                more = "".join(f" {k}={quoteattr(v)}" for k, v in (("FormatString", x.format), ("DisplayFolder", x.folder), ("Hidden", x.hidden and "true")) if v)
                body.append(f'<Property Name="{_edm_name(x.name)}" Type="Double"><bi:Measure Caption={quoteattr(x.name)}{more}/></Property>')
        keys = [c for c in t.columns if c.key] or [c for c in t.columns if c.name == m.one_key(t.name)]
        key = "<Key>" + "".join(f'<PropertyRef Name="{_edm_name(c.name)}"/>' for c in keys) + "</Key>" if keys else ""
        types.append(f'<EntityType Name="{name}">{key}{"".join(body)}</EntityType>')
    for r in m.relationships:
        name, many, one = _edm_name(r.name), _edm_name(r.from_table), _edm_name(r.to_table)
        state = "" if r.active else '<bi:AssociationSet State="Inactive"/>'
        ends.append(f'<AssociationSet Name="{name}" Association="Model.{name}"><End EntitySet="{many}"/><End EntitySet="{one}"/>{state}</AssociationSet>')
        links.append(f'<Association Name="{name}"><End Type="Model.{many}" Multiplicity="*"/><End Type="Model.{one}" Multiplicity="0..1"/></Association>')
    return f'<Schema Namespace="Model" xmlns="http://schemas.microsoft.com/ado/2008/09/edm" xmlns:bi="http://schemas.microsoft.com/sqlbi/2010/10/edm/extensions"><EntityContainer Name={quoteattr(_edm_name(m.name))}>{"".join(sets + ends)}</EntityContainer>{"".join(types + links)}</Schema>'


def xml_metadata(m: Model) -> str:
    """The model as nested elements: tables with columns and measures, relationships."""
    item = lambda tag, **kv: f"<{tag}>" + "".join(f"<{k}>{_xml_text(v)}</{k}>" for k, v in kv.items() if v not in ("", None)) + f"</{tag}>"
    tables = []
    for t in m.tables.values():
        columns = "".join(item("Column", Name=c.name, DataType=c.data_type, SparkType=TYPES[c.data_type], IsHidden=c.hidden, FormatString=c.format, SortByColumn=c.sort_by) for c in t.columns)
        measures = "".join(item("Measure", Name=x.name, Expression=x.expression, IsHidden=x.hidden, FormatString=x.format) for x in m.measures.values() if x.table == t.name)
        tables.append(f"<Table><Name>{escape(t.name)}</Name><Columns>{columns}</Columns><Measures>{measures}</Measures></Table>")
    links = "".join(item("Relationship", Name=r.name, FromTable=r.from_table, FromColumn=r.from_column, ToTable=r.to_table, ToColumn=r.to_column, IsActive=r.active) for r in m.relationships)
    return f"<Database><Name>{escape(m.name)}</Name><Model><Tables>{''.join(tables)}</Tables><Relationships>{links}</Relationships></Model></Database>"
