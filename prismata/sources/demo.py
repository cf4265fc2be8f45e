"""The model over the supplied test tables."""

from __future__ import annotations

from prismata.model import ColumnDef, Measure, Model, ModelError, Relationship, Table

#: table -> columns with a one-letter type: s string, i int64, d double, t dateTime
_TABLES = {
    "region": "i:r_regionkey s:r_name",
    "nation": "i:n_nationkey s:n_name i:n_regionkey",
    "supplier": "i:s_suppkey s:s_name i:s_nationkey d:s_acctbal",
    "part": "i:p_partkey s:p_name s:p_brand s:p_type i:p_size d:p_retailprice",
    "customer": "i:c_custkey s:c_name i:c_nationkey d:c_acctbal s:c_mktsegment",
    "orders": "i:o_orderkey i:o_custkey s:o_orderstatus d:o_totalprice t:o_orderdate s:o_orderpriority",
    "lineitem": "i:l_orderkey i:l_partkey i:l_suppkey i:l_linenumber d:l_quantity d:l_extendedprice d:l_discount d:l_tax s:l_returnflag s:l_linestatus t:l_shipdate",
    "events": "i:event_id t:ts i:user_id s:event_type d:value s:props",
    "documents": "i:doc_id s:text s:lang s:source i:n_chars",
    "labels": "i:doc_id i:quality i:toxic",
}
_KINDS = {"s": "string", "i": "int64", "d": "double", "t": "dateTime"}
_LINKS = [
    ("lineitem.l_orderkey", "orders.o_orderkey", True), ("lineitem.l_partkey", "part.p_partkey", True), ("lineitem.l_suppkey", "supplier.s_suppkey", True), ("orders.o_custkey", "customer.c_custkey", True),
    ("customer.c_nationkey", "nation.n_nationkey", True), ("nation.n_regionkey", "region.r_regionkey", True), ("supplier.s_nationkey", "nation.n_nationkey", False), ("events.user_id", "customer.c_custkey", True), ("labels.doc_id", "documents.doc_id", True),
]
_MEASURES = [
    ("lineitem", "Quantity", "SUM(lineitem[l_quantity])"),
    ("lineitem", "Revenue", "SUMX(lineitem, lineitem[l_extendedprice] * (1 - lineitem[l_discount]))"),
    ("lineitem", "Returned Revenue", 'CALCULATE([Revenue], lineitem[l_returnflag] = "R")'),
    ("lineitem", "Return Rate", "DIVIDE([Returned Revenue], [Revenue])"),
    ("lineitem", "All Region Revenue", "CALCULATE([Revenue], ALL(region))"),
    ("orders", "Orders", "COUNTROWS(orders)"),
    ("orders", "Customers", "DISTINCTCOUNT(orders[o_custkey])"),
    ("events", "Event Value", "SUM(events[value])"),
]


def demo_model() -> Model:
    m = Model("Demo")
    for t, cols in _TABLES.items():
        m.tables[t] = Table(t, f"{t}.parquet", tuple(ColumnDef(c[2:], _KINDS[c[0]]) for c in cols.split()))
    m.measures = {n.lower(): Measure(t, n, e) for t, n, e in _MEASURES}
    m.relationships = [Relationship(f"{a}-{b}", *a.split("."), *b.split("."), active) for a, b, active in _LINKS]
    if bad := m.validate():
        raise ModelError("; ".join(bad))
    return m
