"""Registered DAX queries over the test tables, each with the SQL that DuckDB answers alike.

An entry is the DAX text, the names given to its columns in order, and the SQL.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Callable
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession

from prismata.model import Model
from prismata.plans.compiler import Engine
from prismata.plans.mdx import run_mdx
from prismata.sources.demo import demo_model
from prismata.sources.metadata import system_query
from prismata.sources.results import evaluate_json, evaluate_rowsets

_STAR = "lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
_REV = "l_extendedprice * (1 - l_discount)"

# The query that a matrix visual sends: both axes with their totals, the page of rows, the column heads, and the body.
_MATRIX = """
DEFINE
    VAR core = SUMMARIZECOLUMNS(ROLLUPADDISSUBTOTAL(region[r_name], "rs"), ROLLUPADDISSUBTOTAL(lineitem[l_returnflag], "fs"), "value", {measure})
    VAR page = TOPN(102, SUMMARIZE(core, region[r_name], [rs]), [rs], 0, region[r_name], 1)
    VAR allheads = SUMMARIZE(core, lineitem[l_returnflag], [fs])
    VAR heads = TOPN(102, allheads, [fs], 1, lineitem[l_returnflag], 1)
    VAR body = NATURALLEFTOUTERJOIN(page, SUBSTITUTEWITHINDEX(core, "place", heads, [fs], ASC, lineitem[l_returnflag], ASC))
EVALUATE heads ORDER BY [fs], lineitem[l_returnflag]
EVALUATE body ORDER BY [rs] DESC, region[r_name], [place]
"""
_MATRIX_SQL = f"""WITH b AS (SELECT r_name, grouping(r_name) = 1 AS rs, l_returnflag AS f, grouping(l_returnflag) = 1 AS fs, {{value}} AS v FROM {_STAR} GROUP BY CUBE (r_name, l_returnflag)),
h AS (SELECT f, fs, row_number() OVER (ORDER BY fs, f NULLS FIRST) - 1 AS place FROM (SELECT DISTINCT f, fs FROM b))
SELECT r_name AS region, rs, v AS {{name}}, place FROM b JOIN h ON b.f IS NOT DISTINCT FROM h.f AND b.fs = h.fs"""
FIRST = {"matrix_heads"}  # queries of two EVALUATEs whose first result is compared; of the others it is the last

CASES: dict[str, tuple[str, str, str]] = {
    "qty_by_region_flag": (
        'EVALUATE SUMMARIZECOLUMNS(region[r_name], lineitem[l_returnflag], "Quantity", SUM(lineitem[l_quantity]))',
        "region flag quantity",
        f"SELECT r_name AS region, l_returnflag AS flag, sum(l_quantity) AS quantity FROM {_STAR} GROUP BY 1, 2",
    ),
    "matrix_quantity": (
        'EVALUATE SUMMARIZECOLUMNS(ROLLUPADDISSUBTOTAL(region[r_name], "rs"), ROLLUPADDISSUBTOTAL(lineitem[l_returnflag], "fs"), "Quantity", SUM(lineitem[l_quantity]))',
        "region rs flag fs quantity",
        f"SELECT r_name AS region, grouping(r_name) = 1 AS rs, l_returnflag AS flag, grouping(l_returnflag) = 1 AS fs, sum(l_quantity) AS quantity FROM {_STAR} GROUP BY CUBE (r_name, l_returnflag)",
    ),
    "matrix_measure": (
        'EVALUATE SUMMARIZECOLUMNS(ROLLUPADDISSUBTOTAL(region[r_name], "rs"), ROLLUPADDISSUBTOTAL(lineitem[l_returnflag], "fs"), "Revenue", ROUND([Revenue], 2), "Returned", ROUND([Returned Revenue], 2), "Rate", ROUND([Return Rate], 6))',
        "region rs flag fs revenue returned rate",
        f"""WITH b AS (SELECT r_name, l_returnflag, grouping(r_name) = 1 AS rs, grouping(l_returnflag) = 1 AS fs, sum({_REV}) AS v FROM {_STAR} GROUP BY CUBE (r_name, l_returnflag)),
        r AS (SELECT r_name, grouping(r_name) = 1 AS rs, sum({_REV}) AS v FROM {_STAR} WHERE l_returnflag = 'R' GROUP BY ROLLUP (r_name))
        SELECT b.r_name AS region, b.rs, b.l_returnflag AS flag, b.fs, round(b.v, 2) AS revenue, round(r.v, 2) AS returned, round(r.v / b.v, 6) AS rate FROM b LEFT JOIN r ON r.r_name IS NOT DISTINCT FROM b.r_name AND r.rs = b.rs""",
    ),
    "matrix_heads": (_MATRIX.format(measure="lineitem[Quantity]"), "flag fs", "SELECT l_returnflag AS flag, grouping(l_returnflag) = 1 AS fs FROM lineitem GROUP BY ROLLUP (l_returnflag)"),
    "matrix_body": (_MATRIX.format(measure="lineitem[Quantity]"), "region rs quantity place", _MATRIX_SQL.format(value="sum(l_quantity)", name="quantity")),
    "matrix_body_revenue": (_MATRIX.format(measure="ROUND(lineitem[Revenue], 2)"), "region rs revenue place", _MATRIX_SQL.format(value=f"round(sum({_REV}), 2)", name="revenue")),
    "sumx_lookup": (
        'EVALUATE ROW("total", ROUND(SUMX(lineitem, lineitem[l_extendedprice] * LOOKUPVALUE(region[r_regionkey], region[r_name], "ASIA", region[r_regionkey], MOD(lineitem[l_linenumber], 5), 1)), 2))',
        "total",
        "SELECT round(sum(l_extendedprice * coalesce((SELECT max(r_regionkey) FROM region WHERE r_name = 'ASIA' AND r_regionkey = l_linenumber % 5), 1)), 2) AS total FROM lineitem",
    ),
    "rollup_one_axis": (
        'EVALUATE SUMMARIZE(lineitem, ROLLUP(region[r_name], nation[n_name]), "q", SUM(lineitem[l_quantity]), "sub", ISSUBTOTAL(nation[n_name]))',
        "region nation q sub",
        f"SELECT r_name AS region, n_name AS nation, sum(l_quantity) AS q, grouping(n_name) = 1 AS sub FROM {_STAR} GROUP BY ROLLUP (r_name, n_name)",
    ),
    "returned_share": (
        'EVALUATE SUMMARIZECOLUMNS(nation[n_name], "rate", ROUND([Return Rate], 6))',
        "nation rate",
        f"SELECT n_name AS nation, round(sum(CASE WHEN l_returnflag = 'R' THEN {_REV} END) / nullif(sum({_REV}), 0), 6) AS rate FROM {_STAR} GROUP BY 1",
    ),
    "share_of_all": (
        'EVALUATE SUMMARIZECOLUMNS(region[r_name], lineitem[l_returnflag], "share", ROUND(DIVIDE([Revenue], [All Region Revenue]), 6))',
        "region flag share",
        f"SELECT r_name AS region, l_returnflag AS flag, round(sum({_REV}) / sum(sum({_REV})) OVER (PARTITION BY l_returnflag), 6) AS share FROM {_STAR} GROUP BY 1, 2",
    ),
    "sumx_revenue": ('EVALUATE ROW("revenue", ROUND([Revenue], 2))', "revenue", f"SELECT round(sum({_REV}), 2) AS revenue FROM lineitem"),
    "topn_customers": (
        'EVALUATE TOPN(10, SUMMARIZE(orders, customer[c_custkey], customer[c_name], "spent", ROUND(SUM(orders[o_totalprice]), 2)), [spent], 0, customer[c_custkey], 1) ORDER BY [spent] DESC',
        "custkey name spent",
        "SELECT c_custkey AS custkey, c_name AS name, round(sum(o_totalprice), 2) AS spent FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2 ORDER BY 3 DESC, 1 LIMIT 10",
    ),
    "keepfilters_and": (
        """EVALUATE SUMMARIZECOLUMNS(lineitem[l_returnflag], "kept", CALCULATE(SUM(lineitem[l_quantity]), KEEPFILTERS(lineitem[l_returnflag] IN {"A", "R"})), "replaced", CALCULATE(SUM(lineitem[l_quantity]), lineitem[l_returnflag] = "A"))""",
        "flag kept replaced",
        "SELECT l_returnflag AS flag, sum(CASE WHEN l_returnflag IN ('A', 'R') THEN l_quantity END) AS kept, (SELECT sum(l_quantity) FROM lineitem WHERE l_returnflag = 'A') AS replaced FROM lineitem GROUP BY 1",
    ),
    "supplier_region": (
        'EVALUATE SUMMARIZECOLUMNS(nation[n_name], "bySupplier", CALCULATE(SUM(lineitem[l_quantity]), USERELATIONSHIP(supplier[s_nationkey], nation[n_nationkey])))',
        "nation q",
        "SELECT n_name AS nation, sum(l_quantity) AS q FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1",
    ),
    "except_intersect": (
        'EVALUATE ADDCOLUMNS(UNION(EXCEPT(VALUES(customer[c_custkey]), VALUES(events[user_id])), INTERSECT(VALUES(orders[o_custkey]), VALUES(events[user_id]))), "one", 1)',
        "custkey one",
        "SELECT * FROM (SELECT c_custkey AS custkey, 1 AS one FROM (SELECT c_custkey FROM customer UNION ALL SELECT NULL) WHERE c_custkey IS NULL OR c_custkey NOT IN (SELECT user_id FROM events) UNION ALL SELECT DISTINCT o_custkey, 1 FROM orders WHERE o_custkey IN (SELECT user_id FROM events))",
    ),
    "generate_top_order": (
        'EVALUATE SELECTCOLUMNS(GENERATE(customer, TOPN(2, RELATEDTABLE(orders), orders[o_totalprice], 0, orders[o_orderkey], 1)), "c", customer[c_custkey], "o", orders[o_orderkey])',
        "custkey orderkey",
        "SELECT c_custkey AS custkey, o_orderkey AS orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders JOIN customer ON o_custkey = c_custkey) WHERE k <= 2",
    ),
    "generate_all": (
        'EVALUATE SELECTCOLUMNS(GENERATEALL(customer, TOPN(1, RELATEDTABLE(events), events[event_id], 1)), "c", customer[c_custkey], "e", events[event_id])',
        "custkey event",
        "SELECT c_custkey AS custkey, min(event_id) AS event FROM customer LEFT JOIN events ON user_id = c_custkey GROUP BY 1",
    ),
    "events_by_segment": (
        'EVALUATE SUMMARIZECOLUMNS(customer[c_mktsegment], "orders", [Orders], "events", ROUND([Event Value], 4))',
        "segment orders events",
        "SELECT s AS segment, o AS orders, e AS events FROM (SELECT c_mktsegment AS s, count(*) AS o FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1) FULL JOIN (SELECT c_mktsegment AS s, round(sum(value), 4) AS e FROM events JOIN customer ON user_id = c_custkey GROUP BY 1) USING (s)",
    ),
    "column_aggregates": (
        """EVALUATE SUMMARIZECOLUMNS(orders[o_orderpriority], "s", ROUND(SUM(orders[o_totalprice]), 2), "n", COUNT(orders[o_orderkey]), "na", COUNTA(orders[o_orderstatus]), "avg", ROUND(AVERAGE(orders[o_totalprice]), 4), "avga", ROUND(AVERAGEA(orders[o_totalprice]), 4),
        "lo", MIN(orders[o_orderdate]), "hi", MAX(orders[o_orderdate]), "loa", MINA(orders[o_totalprice]), "hia", MAXA(orders[o_totalprice]), "rows", COUNTROWS(orders), "kinds", DISTINCTCOUNT(orders[o_custkey]), "one", IGNORE(HASONEVALUE(orders[o_orderstatus])), "none", IGNORE(ISEMPTY(orders)))""",
        "priority s n na avg avga lo hi loa hia rows kinds one none",
        "SELECT o_orderpriority AS priority, round(sum(o_totalprice), 2) AS s, count(o_orderkey) AS n, count(o_orderstatus) AS na, round(avg(o_totalprice), 4) AS avg, round(avg(o_totalprice), 4) AS avga, min(o_orderdate) AS lo, max(o_orderdate) AS hi, min(o_totalprice) AS loa, max(o_totalprice) AS hia, count(*) AS rows, count(DISTINCT o_custkey) AS kinds, count(DISTINCT o_orderstatus) = 1 AS one, false AS none FROM orders GROUP BY 1",
    ),
    "iterators": (
        """EVALUATE SUMMARIZECOLUMNS(lineitem[l_linestatus], "s", ROUND(SUMX(lineitem, lineitem[l_quantity] * RELATED(part[p_retailprice])), 2), "a", ROUND(AVERAGEX(lineitem, lineitem[l_quantity] + 1), 6), "hi", MAXX(FILTER(lineitem, lineitem[l_tax] < 0.05), lineitem[l_extendedprice]), "lo", MINX(lineitem, lineitem[l_extendedprice]), "n", COUNTX(lineitem, IF(lineitem[l_quantity] > 25, 1)), "na", COUNTAX(lineitem, lineitem[l_returnflag]))""",
        "status s a hi lo n na",
        "SELECT l_linestatus AS status, round(sum(l_quantity * p_retailprice), 2) AS s, round(avg(l_quantity + 1), 6) AS a, max(CASE WHEN l_tax < 0.05 THEN l_extendedprice END) AS hi, min(l_extendedprice) AS lo, nullif(count(*) FILTER (l_quantity > 25), 0) AS n, count(*) AS na FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1",
    ),
    "context_transition": (
        'EVALUATE ADDCOLUMNS(FILTER(customer, [Orders] > 10), "orders", [Orders], "spent", ROUND(CALCULATE(SUM(orders[o_totalprice])), 2))',
        "custkey name nationkey acctbal segment orders spent",
        "SELECT c_custkey AS custkey, c_name AS name, c_nationkey AS nationkey, c_acctbal AS acctbal, c_mktsegment AS segment, count(*) AS orders, round(sum(o_totalprice), 2) AS spent FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2, 3, 4, 5 HAVING count(*) > 10",
    ),
    "average_of_measure": (
        'EVALUATE SUMMARIZECOLUMNS(region[r_name], "perNation", ROUND(AVERAGEX(VALUES(nation[n_name]), [Revenue]), 2))',
        "region avg",
        f"SELECT r_name AS region, round(avg(v), 2) AS avg FROM (SELECT r_name, n_name, sum({_REV}) AS v FROM {_STAR} GROUP BY 1, 2) GROUP BY 1",
    ),
    "calculate_modifiers": (
        """EVALUATE SUMMARIZECOLUMNS(region[r_name], lineitem[l_returnflag], "all", CALCULATE([Quantity], ALL(lineitem[l_returnflag])), "removed", CALCULATE([Quantity], REMOVEFILTERS(region)), "except", CALCULATE([Quantity], ALLEXCEPT(lineitem, lineitem[l_returnflag])), "total", CALCULATE([Quantity], ALL()), "mine", [Quantity])""",
        "region flag every removed except total mine",
        f"WITH b AS (SELECT r_name, l_returnflag, sum(l_quantity) AS q FROM {_STAR} GROUP BY 1, 2) SELECT r_name AS region, l_returnflag AS flag, sum(q) OVER (PARTITION BY r_name) AS every, sum(q) OVER (PARTITION BY l_returnflag) AS removed, sum(q) OVER (PARTITION BY l_returnflag) AS except, sum(q) OVER () AS total, q AS mine FROM b",
    ),
    "allselected": (
        """EVALUATE CALCULATETABLE(SUMMARIZECOLUMNS(region[r_name], "q", [Quantity], "selected", CALCULATE([Quantity], ALLSELECTED(region)), "all", CALCULATE([Quantity], ALL(region))), region[r_name] IN {"ASIA", "EUROPE"})""",
        "region q selected every",
        f"WITH b AS (SELECT r_name, sum(l_quantity) AS q FROM {_STAR} GROUP BY 1) SELECT r_name AS region, q, (SELECT sum(q) FROM b WHERE r_name IN ('ASIA', 'EUROPE')) AS selected, (SELECT sum(q) FROM b) AS every FROM b WHERE r_name IN ('ASIA', 'EUROPE')",
    ),
    "filter_table_argument": (
        """EVALUATE SUMMARIZECOLUMNS(nation[n_name], "big", CALCULATE([Orders], FILTER(orders, orders[o_totalprice] > 100000)), "rich", CALCULATE([Orders], FILTER(ALL(customer), customer[c_acctbal] > 5000)), "some", CALCULATE([Orders], FILTER(VALUES(customer[c_mktsegment]), [Orders] > 40)))""",
        "nation big rich some",
        """WITH o AS (SELECT n_name, c_mktsegment, c_acctbal, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey), seg AS (SELECT n_name, c_mktsegment FROM o GROUP BY 1, 2 HAVING count(*) > 40)
        SELECT n_name AS nation, nullif(count(*) FILTER (o_totalprice > 100000), 0) AS big, nullif(count(*) FILTER (c_acctbal > 5000), 0) AS rich, nullif((SELECT count(*) FROM o x JOIN seg USING (n_name, c_mktsegment) WHERE x.n_name = o.n_name), 0) AS some FROM o GROUP BY 1""",
    ),
    "asked_predicate": (
        """EVALUATE SUMMARIZECOLUMNS(customer[c_mktsegment], "latest", CALCULATE([Orders], orders[o_orderdate] = MAX(orders[o_orderdate])), "picked", CALCULATE([Orders], customer[c_mktsegment] = SELECTEDVALUE(customer[c_mktsegment], "BUILDING")))""",
        "segment latest picked",
        "WITH o AS (SELECT c_mktsegment AS s, o_orderdate AS d FROM orders JOIN customer ON o_custkey = c_custkey), m AS (SELECT s, max(d) AS d FROM o GROUP BY 1) SELECT o.s AS segment, count(*) FILTER (o.d = m.d) AS latest, count(*) AS picked FROM o JOIN m USING (s) GROUP BY 1",
    ),
    "crossfilter_both": (
        """EVALUATE SUMMARIZECOLUMNS(part[p_brand], "customers", CALCULATE(COUNTROWS(orders), CROSSFILTER(lineitem[l_orderkey], orders[o_orderkey], BOTH)))""",
        "brand orders",
        "SELECT p_brand AS brand, count(DISTINCT l_orderkey) AS orders FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1",
    ),
    "crossfilter_none": (
        'EVALUATE SUMMARIZECOLUMNS(part[p_type], "q", CALCULATE([Quantity], CROSSFILTER(lineitem[l_partkey], part[p_partkey], NONE)))',
        "type q",
        "SELECT DISTINCT p_type AS type, (SELECT sum(l_quantity) FROM lineitem) AS q FROM part",
    ),
    "treatas_tuple": (
        """EVALUATE SUMMARIZECOLUMNS(region[r_name], "q", CALCULATE([Quantity], TREATAS({("A", "F"), ("N", "O")}, lineitem[l_returnflag], lineitem[l_linestatus])))""",
        "region q",
        f"SELECT r_name AS region, sum(l_quantity) AS q FROM {_STAR} WHERE (l_returnflag, l_linestatus) IN (('A', 'F'), ('N', 'O')) GROUP BY 1",
    ),
    "variables": (
        """EVALUATE SUMMARIZECOLUMNS(region[r_name], "over", VAR r = [Revenue] VAR a = CALCULATE([Revenue], ALL(region)) RETURN IF(r > a * 0.2, ROUND(r, 2), 0))""",
        "region over",
        f"SELECT r_name AS region, CASE WHEN sum({_REV}) > sum(sum({_REV})) OVER () * 0.2 THEN round(sum({_REV}), 2) ELSE 0 END AS over FROM {_STAR} GROUP BY 1",
    ),
    "var_predicates": (
        """EVALUATE ROW("a", VAR x = 10 RETURN CALCULATE([Quantity], lineitem[l_quantity] > x), "b", VAR x = 40 RETURN CALCULATE([Quantity], lineitem[l_quantity] > x), "c", VAR x = 10 RETURN COUNTROWS(FILTER(lineitem, lineitem[l_quantity] > x)), "d", VAR x = 40 RETURN COUNTROWS(FILTER(lineitem, lineitem[l_quantity] > x)))""",
        "a b c d",
        "SELECT sum(l_quantity) FILTER (l_quantity > 10) AS a, sum(l_quantity) FILTER (l_quantity > 40) AS b, count(*) FILTER (l_quantity > 10) AS c, count(*) FILTER (l_quantity > 40) AS d FROM lineitem",
    ),
    "var_measures": (
        """DEFINE MEASURE lineitem[A] = VAR t = 10 RETURN CALCULATE([Quantity], lineitem[l_quantity] > t) MEASURE lineitem[B] = VAR t = 40 RETURN CALCULATE([Quantity], lineitem[l_quantity] > t)
        EVALUATE SUMMARIZECOLUMNS(ROLLUPADDISSUBTOTAL(region[r_name], "total"), "a", [A], "b", [B])""",
        "region total a b",
        f"SELECT r_name AS region, grouping(r_name) = 1 AS total, sum(l_quantity) FILTER (l_quantity > 10) AS a, sum(l_quantity) FILTER (l_quantity > 40) AS b FROM {_STAR} GROUP BY ROLLUP (r_name)",
    ),
    "var_shadowed": (
        """EVALUATE ADDCOLUMNS(VALUES(lineitem[l_returnflag]), "v", VAR x = 10 RETURN CALCULATE(VAR x = 40 RETURN CALCULATE([Quantity], KEEPFILTERS(lineitem[l_quantity] > x)), KEEPFILTERS(lineitem[l_quantity] > x)),
        "w", VAR x = 40 RETURN CALCULATE(VAR x = 10 RETURN CALCULATE([Quantity], KEEPFILTERS(lineitem[l_quantity] <= x + 5)), KEEPFILTERS(lineitem[l_quantity] <= x)))""",
        "flag v w",
        "SELECT l_returnflag AS flag, sum(l_quantity) FILTER (l_quantity > 40) AS v, sum(l_quantity) FILTER (l_quantity <= 15) AS w FROM lineitem GROUP BY 1",
    ),
    "keepfilters_table": (
        """EVALUATE SUMMARIZECOLUMNS(region[r_name], "kept", CALCULATE([Orders], KEEPFILTERS(FILTER(ALL(region[r_name]), region[r_name] IN {"ASIA", "EUROPE"}))), "put", CALCULATE([Orders], FILTER(ALL(region[r_name]), region[r_name] IN {"ASIA", "EUROPE"})))""",
        "region kept put",
        "WITH o AS (SELECT r_name, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1) SELECT r_name AS region, CASE WHEN r_name IN ('ASIA', 'EUROPE') THEN n END AS kept, (SELECT sum(n) FROM o WHERE r_name IN ('ASIA', 'EUROPE'))::BIGINT AS put FROM region JOIN o USING (r_name)",
    ),
    "math_over_parts": (
        """EVALUATE SELECTCOLUMNS(part, "k", part[p_partkey], "r", ROUND(part[p_retailprice] / 7, 3), "ru", ROUNDUP(part[p_retailprice] / 7, 1), "rd", ROUNDDOWN(part[p_retailprice] / 7, 1), "m", MOD(part[p_partkey], -7), "f", FACT(MOD(part[p_size], 20)), "ev", EVEN(part[p_retailprice] / 3), "od", ODD(part[p_retailprice] / 3), "mr", MROUND(part[p_partkey], 5),
        "p", POWER(part[p_size], 2), "s", ROUND(SQRT(part[p_size]), 9), "l", ROUND(LN(part[p_size]), 9), "t", TRUNC(0 - part[p_retailprice] / 7), "i", INT(0 - part[p_retailprice] / 7), "d", DIVIDE(part[p_size], part[p_size] - 10, -1), "at", ROUND(ATAN2(part[p_size], part[p_partkey]), 9))""",
        "k r ru rd m f ev od mr p s l t i d at",
        """SELECT p_partkey AS k, floor(p_retailprice / 7 * 1000 + 0.5) / 1000 AS r, ceil(p_retailprice / 7 * 10) / 10 AS ru, floor(p_retailprice / 7 * 10) / 10 AS rd, p_partkey + 7 * floor(p_partkey / -7) AS m, factorial((p_size % 20)::INTEGER)::DOUBLE AS f, ceil(p_retailprice / 6) * 2 AS ev, ceil((p_retailprice / 3 - 1) / 2) * 2 + 1 AS od, round(p_partkey / 5) * 5 AS mr,
        p_size * p_size AS p, round(sqrt(p_size), 9) AS s, round(ln(p_size), 9) AS l, -floor(p_retailprice / 7) AS t, floor(-p_retailprice / 7) AS i, CASE WHEN p_size = 10 THEN -1 ELSE p_size / (p_size - 10) END AS d, round(atan2(p_partkey, p_size), 9) AS at FROM part""",
    ),
    "all_beside_filter": (
        """EVALUATE CALCULATETABLE(SUMMARIZECOLUMNS(lineitem[l_returnflag], "kept", [Quantity], "every", CALCULATE([Quantity], ALL(lineitem[l_linestatus]))), lineitem[l_linestatus] = "F")""",
        "flag kept every",
        "SELECT l_returnflag AS flag, sum(l_quantity) FILTER (l_linestatus = 'F') AS kept, sum(l_quantity) AS every FROM lineitem GROUP BY 1 HAVING count(*) FILTER (l_linestatus = 'F') > 0",
    ),
    "rollup_two_facts": (
        """EVALUATE SUMMARIZECOLUMNS(ROLLUPADDISSUBTOTAL(region[r_name], "rs", customer[c_mktsegment], "ss"), "orders", [Orders], "events", ROUND([Event Value], 4), "share", ROUND(DIVIDE([Orders], CALCULATE([Orders], ALL(customer[c_mktsegment]))), 6))""",
        "region rs segment ss orders events share",
        """WITH c AS (SELECT c_custkey, c_mktsegment AS s, r_name AS r FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey), g AS (SELECT r, s, grouping(r) = 1 AS rs, grouping(s) = 1 AS ss FROM c GROUP BY ROLLUP (r, s)),
        o AS (SELECT r, s, grouping(r) = 1 AS rs, grouping(s) = 1 AS ss, count(*) AS n FROM orders JOIN c ON o_custkey = c_custkey GROUP BY ROLLUP (r, s)), e AS (SELECT r, s, grouping(r) = 1 AS rs, grouping(s) = 1 AS ss, round(sum(value), 4) AS v FROM events JOIN c ON user_id = c_custkey GROUP BY ROLLUP (r, s))
        SELECT g.r AS region, g.rs, g.s AS segment, g.ss, o.n AS orders, e.v AS events, round(o.n / t.n, 6) AS share FROM g LEFT JOIN o ON o.r IS NOT DISTINCT FROM g.r AND o.s IS NOT DISTINCT FROM g.s AND o.rs = g.rs AND o.ss = g.ss LEFT JOIN e ON e.r IS NOT DISTINCT FROM g.r AND e.s IS NOT DISTINCT FROM g.s AND e.rs = g.rs AND e.ss = g.ss
        LEFT JOIN o t ON t.r IS NOT DISTINCT FROM g.r AND t.rs = g.rs AND t.ss WHERE coalesce(o.n, e.v) IS NOT NULL""",
    ),
    "summarize_extension": (
        """EVALUATE SUMMARIZE(ADDCOLUMNS(nation, "even", MOD(nation[n_nationkey], 2) = 0), region[r_name], [even])""",
        "region even",
        "SELECT DISTINCT r_name AS region, n_nationkey % 2 = 0 AS even FROM nation JOIN region ON n_regionkey = r_regionkey",
    ),
    "topn_expression": (
        """DEFINE VAR n = COUNTROWS(region) EVALUATE SELECTCOLUMNS(TOPN(n * 2 + 1, customer, customer[c_acctbal], 0, customer[c_custkey], 1), "c", customer[c_custkey])""",
        "custkey",
        "SELECT c_custkey AS custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT (SELECT count(*) * 2 + 1 FROM region)",
    ),
    "blanks_first": (
        """EVALUATE UNION(TOPN(2, ALL(region[r_name]), region[r_name], 0), TOPN(2, ALL(region[r_name]), region[r_name], 1))""",
        "name",
        "SELECT NULL AS name UNION ALL SELECT max(r_name) FROM region UNION ALL SELECT NULL UNION ALL SELECT min(r_name) FROM region",
    ),
    "sample_fact": (
        'EVALUATE SELECTCOLUMNS(SAMPLE(100, orders, orders[o_orderkey], 1), "k", orders[o_orderkey])',
        "k",
        "SELECT o_orderkey AS k FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS h FROM orders) WHERE i IN (SELECT j * (h - 1) // 99 FROM range(100) t(j))",
    ),
    "index_places": (
        'EVALUATE SUBSTITUTEWITHINDEX(SELECTCOLUMNS(orders, "o", orders[o_orderkey], "c", orders[o_custkey]), "place", SELECTCOLUMNS(customer, "c", customer[c_custkey]), [c], DESC)',
        "orderkey place",
        "SELECT o_orderkey AS orderkey, place FROM orders JOIN (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey DESC) - 1 AS place FROM customer) ON o_custkey = c_custkey",
    ),
    "clock": (
        'EVALUATE ROW("today", TODAY(), "utc", UTCTODAY(), "now", DATEDIFF(TODAY(), NOW(), "DAY"), "unow", DATEDIFF(UTCTODAY(), UTCNOW(), "DAY"), "year", YEAR(UTCNOW()))',
        "today utc now unow year",
        "SELECT d AS today, d AS utc, 0 AS now, 0 AS unow, year(d) AS year FROM (SELECT make_timestamp(epoch_us(now()) // 86400000000 * 86400000000) AS d)",
    ),
    "error_unmet": (
        'EVALUATE SELECTCOLUMNS(nation, "n", IF(nation[n_nationkey] >= 0, nation[n_name], ERROR("a key below 0")), "notin", nation[n_regionkey] NOT IN {0, 2}, "measure", lineitem[Orders])',
        "name other orders",
        "SELECT n_name AS name, n_regionkey NOT IN (0, 2) AS other, (SELECT count(*) FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = n_nationkey) AS orders FROM nation",
    ),
    "define_measure": (
        """DEFINE MEASURE lineitem[Net] = [Revenue] * 0.9 VAR low = 0.05 EVALUATE SUMMARIZECOLUMNS(lineitem[l_returnflag], "net", ROUND([Net], 2), "cheap", CALCULATE([Orders], ALL(lineitem)), "taxed", COUNTROWS(FILTER(lineitem, lineitem[l_tax] > low)))""",
        "flag net cheap taxed",
        f"SELECT l_returnflag AS flag, round(sum({_REV}) * 0.9, 2) AS net, (SELECT count(*) FROM orders) AS cheap, count(*) FILTER (l_tax > 0.05) AS taxed FROM lineitem GROUP BY 1",
    ),
    "start_at": (
        'EVALUATE SELECTCOLUMNS(nation, "n", nation[n_name], "r", nation[n_regionkey]) ORDER BY [r] ASC, [n] DESC START AT 2, "J"',
        "name region",
        "SELECT n_name AS name, n_regionkey AS region FROM nation WHERE n_regionkey > 2 OR (n_regionkey = 2 AND n_name <= 'J')",
    ),
    "groupby_currentgroup": (
        'EVALUATE GROUPBY(orders, orders[o_orderstatus], customer[c_mktsegment], "hi", MAXX(CURRENTGROUP(), orders[o_totalprice]), "n", COUNTROWS(CURRENTGROUP()), "avg", ROUND(AVERAGEX(CURRENTGROUP(), orders[o_totalprice] * 2), 4))',
        "status segment hi n avg",
        "SELECT o_orderstatus AS status, c_mktsegment AS segment, max(o_totalprice) AS hi, count(*) AS n, round(avg(o_totalprice * 2), 4) AS avg FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2",
    ),
    "earlier_rank": (
        'EVALUATE SELECTCOLUMNS(nation, "n", nation[n_name], "rank", COUNTROWS(FILTER(nation, nation[n_regionkey] = EARLIER(nation[n_regionkey]) && nation[n_name] <= EARLIER(nation[n_name]))))',
        "nation rank",
        "SELECT n_name AS nation, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS rank FROM nation",
    ),
    "earliest": (
        'EVALUATE SELECTCOLUMNS(region, "r", region[r_name], "after", COUNTROWS(FILTER(region, region[r_regionkey] > EARLIEST(region[r_regionkey]))))',
        "region after",
        "SELECT r_name AS region, nullif((SELECT count(*) FROM region x WHERE x.r_regionkey > region.r_regionkey), 0) AS after FROM region",
    ),
    "related_and_tables": (
        'EVALUATE SELECTCOLUMNS(nation, "n", nation[n_name], "r", RELATED(region[r_name]), "customers", COUNTROWS(RELATEDTABLE(customer)), "lookup", LOOKUPVALUE(region[r_name], region[r_regionkey], nation[n_regionkey], "none"), "has", CONTAINS(customer, customer[c_nationkey], nation[n_nationkey]))',
        "nation region customers lookup has",
        "SELECT n_name AS nation, r_name AS region, nullif((SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey), 0) AS customers, r_name AS lookup, n_nationkey IN (SELECT c_nationkey FROM customer) AS has FROM nation JOIN region ON n_regionkey = r_regionkey",
    ),
    "natural_joins": (
        """DEFINE VAR a = SELECTCOLUMNS(nation, "k", nation[n_regionkey], "n", nation[n_name]) VAR b = SELECTCOLUMNS(FILTER(region, region[r_regionkey] < 3), "k", region[r_regionkey], "r", region[r_name])
        EVALUATE UNION(NATURALLEFTOUTERJOIN(a, b), NATURALINNERJOIN(a, b))""",
        "k n r",
        "WITH b AS (SELECT * FROM region WHERE r_regionkey < 3) SELECT n_regionkey AS k, n_name AS n, r_name AS r FROM nation LEFT JOIN b ON n_regionkey = r_regionkey UNION ALL SELECT n_regionkey, n_name, r_name FROM nation JOIN b ON n_regionkey = r_regionkey",
    ),
    "crossjoin_values": (
        'EVALUATE ADDCOLUMNS(CROSSJOIN(ALL(region[r_name]), DISTINCT(lineitem[l_returnflag])), "q", [Quantity])',
        "region flag q",
        f"WITH b AS (SELECT r_name, l_returnflag, sum(l_quantity) AS q FROM {_STAR} GROUP BY 1, 2) SELECT x.r_name AS region, f.l_returnflag AS flag, b.q FROM (SELECT r_name FROM region UNION ALL SELECT NULL) x CROSS JOIN (SELECT DISTINCT l_returnflag FROM lineitem) f LEFT JOIN b USING (r_name, l_returnflag)",
    ),
    "blank_member": (
        'EVALUATE ROW("values", COUNTROWS(VALUES(region[r_name])), "kinds", DISTINCTCOUNT(region[r_name]), "rows", COUNTROWS(region), "facts", DISTINCTCOUNT(lineitem[l_returnflag]), "all", COUNTROWS(ALL(region)))',
        "vals kinds rows facts every",
        "SELECT count(DISTINCT r_name) + 1 AS vals, count(DISTINCT r_name) + 1 AS kinds, count(*) AS rows, (SELECT count(DISTINCT l_returnflag) FROM lineitem) AS facts, count(*) + 1 AS every FROM region",
    ),
    "sample_rows": (
        'EVALUATE SELECTCOLUMNS(SAMPLE(6, nation, nation[n_nationkey], 1), "k", nation[n_nationkey])',
        "k",
        "SELECT n_nationkey AS k FROM (SELECT *, row_number() OVER (ORDER BY n_nationkey) - 1 AS i, count(*) OVER () AS h FROM nation) WHERE i IN (SELECT j * (h - 1) // 5 FROM range(6) t(j))",
    ),
    "rollup_group": (
        'EVALUATE SUMMARIZECOLUMNS(ROLLUPADDISSUBTOTAL(ROLLUPGROUP(region[r_name], nation[n_name]), "gs"), "orders", [Orders], "in", IGNORE(ISINSCOPE(nation[n_name])))',
        "region nation gs orders scoped",
        "SELECT r_name AS region, n_name AS nation, grouping(r_name) = 1 AS gs, count(*) AS orders, grouping(r_name) = 0 AS scoped FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY GROUPING SETS ((r_name, n_name), ())",
    ),
    "rollup_axis_steps": (
        'EVALUATE SUMMARIZECOLUMNS(ROLLUPADDISSUBTOTAL(region[r_name], "a", nation[n_name], "b"), "customers", [Customers])',
        "region a nation b customers",
        "SELECT r_name AS region, grouping(r_name) = 1 AS a, n_name AS nation, grouping(n_name) = 1 AS b, count(DISTINCT o_custkey) + grouping(r_name) AS customers FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)",
    ),
    "unrelated_groups": (
        'EVALUATE SUMMARIZECOLUMNS(region[r_name], part[p_type], "q", [Quantity])',
        "region type q",
        f"SELECT r_name AS region, p_type AS type, sum(l_quantity) AS q FROM {_STAR} JOIN part ON l_partkey = p_partkey GROUP BY 1, 2",
    ),
    "filtered_columns": (
        """EVALUATE SUMMARIZECOLUMNS(customer[c_mktsegment], FILTER(VALUES(region[r_name]), region[r_name] = "ASIA"), TREATAS({"1-URGENT", "2-HIGH"}, orders[o_orderpriority]), "orders", [Orders], "filtered", IGNORE(ISFILTERED(region[r_name])))""",
        "segment orders filtered",
        "SELECT c_mktsegment AS segment, count(*) AS orders, true AS filtered FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' AND o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY 1",
    ),
    "nested_iterators": (
        'EVALUATE ROW("v", ROUND(SUMX(region, SUMX(RELATEDTABLE(nation), [Orders] * nation[n_nationkey]) * (region[r_regionkey] + 1)), 2))',
        "v",
        "SELECT round(sum(n * n_nationkey * (r_regionkey + 1))::DOUBLE, 2) AS v FROM (SELECT n_nationkey, r_regionkey, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2)",
    ),
    "table_functions": (
        'EVALUATE UNION(SELECTCOLUMNS({(1, "a"), (2, "b")}, "x", [Value1], "y", [Value2]), ROW("x", 3, "y", "c"))',
        "x y",
        "SELECT * FROM (VALUES (1, 'a'), (2, 'b'), (3, 'c')) t(x, y)",
    ),
    "calculatetable_distinct": (
        'EVALUATE CALCULATETABLE(DISTINCT(nation[n_name]), region[r_name] = "EUROPE" || region[r_name] = "ASIA", NOT(nation[n_name] IN {"FRANCE"}))',
        "nation",
        "SELECT n_name AS nation FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('EUROPE', 'ASIA') AND n_name <> 'FRANCE'",
    ),
    "date_functions": (
        """EVALUATE SELECTCOLUMNS(orders, "k", orders[o_orderkey], "y", YEAR(orders[o_orderdate]), "m", MONTH(orders[o_orderdate]), "d", DAY(orders[o_orderdate]), "h", HOUR(orders[o_orderdate]), "mi", MINUTE(orders[o_orderdate]), "s", SECOND(orders[o_orderdate]), "q", QUARTER(orders[o_orderdate]),
        "w1", WEEKDAY(orders[o_orderdate]), "w2", WEEKDAY(orders[o_orderdate], 2), "w3", WEEKDAY(orders[o_orderdate], 3), "wn", WEEKNUM(orders[o_orderdate]), "e", EDATE(orders[o_orderdate], 1), "eo", EOMONTH(orders[o_orderdate], 0), "dm", DATEDIFF(DATE(1995, 1, 31), orders[o_orderdate], "MONTH"), "dd", orders[o_orderdate] - DATE(1995, 1, 1), "dt", DATE(2024, 14, 31), "plus", orders[o_orderdate] + 7)""",
        "k y m d h mi s q w1 w2 w3 wn e eo dm dd dt plus",
        """SELECT o_orderkey AS k, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, hour(o_orderdate) AS h, minute(o_orderdate) AS mi, second(o_orderdate) AS s, quarter(o_orderdate) AS q, dayofweek(o_orderdate) + 1 AS w1, isodow(o_orderdate) AS w2, isodow(o_orderdate) - 1 AS w3,
        (dayofyear(o_orderdate) - 1 + dayofweek(date_trunc('year', o_orderdate))) // 7 + 1 AS wn, (date_trunc('day', o_orderdate) + INTERVAL 1 MONTH)::TIMESTAMP AS e, last_day(o_orderdate)::TIMESTAMP AS eo, (year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1 AS dm, datediff('day', TIMESTAMP '1995-01-01', o_orderdate) AS dd, TIMESTAMP '2025-03-03' AS dt, o_orderdate + INTERVAL 7 DAY AS plus FROM orders""",
    ),
    "math_functions": (
        """EVALUATE SELECTCOLUMNS({1.5, -2.5, 7, 0.25}, "x", [Value], "abs", ABS([Value]), "sqrt", ROUND(SQRT(ABS([Value])), 9), "exp", ROUND(EXP([Value]), 6), "ln", ROUND(LN(ABS([Value])), 9), "log", ROUND(LOG(ABS([Value]), 2), 9), "log10", ROUND(LOG10(ABS([Value])), 9), "fl", FLOOR([Value], 0.5), "ce", CEILING([Value]), "tr", TRUNC([Value]), "i", INT([Value]), "sg", SIGN([Value]),
        "pw", POWER([Value], 2), "md", MOD([Value], 3), "fa", FACT(5), "ev", EVEN([Value]), "od", ODD([Value]), "mr", MROUND([Value], 0.5), "ru", ROUNDUP([Value], 0), "rd", ROUNDDOWN([Value], 0), "gcd", GCD(12, 18), "lcm", LCM(4, 6), "sp", ROUND(SQRTPI(2), 9), "deg", ROUND(DEGREES(1), 9), "rad", ROUND(RADIANS(180), 9), "pi", ROUND(PI(), 9), "dv", DIVIDE([Value], 0, -1), "rnd", ROUND(2.567, 1))""",
        "x abs sqrt exp ln log log10 fl ce tr i sg pw md fa ev od mr ru rd gcd lcm sp deg rad pi dv rnd",
        """SELECT x, abs(x) AS abs, round(sqrt(abs(x)), 9) AS sqrt, round(exp(x), 6) AS exp, round(ln(abs(x)), 9) AS ln, round(log2(abs(x)), 9) AS log, round(log10(abs(x)), 9) AS log10, floor(x / 0.5) * 0.5 AS fl, ceil(x) AS ce, trunc(x) AS tr, floor(x) AS i, sign(x) AS sg, x * x AS pw, x - 3 * floor(x / 3) AS md, 120 AS fa, sign(x) * ceil(abs(x) / 2) * 2 AS ev, sign(x) * CASE WHEN ceil(abs(x))::INT % 2 = 1 THEN ceil(abs(x)) ELSE ceil(abs(x)) + 1 END AS od,
        round(x / 0.5) * 0.5 AS mr, sign(x) * ceil(abs(x)) AS ru, sign(x) * floor(abs(x)) AS rd, 6 AS gcd, 12 AS lcm, round(sqrt(2 * pi()), 9) AS sp, round(degrees(1), 9) AS deg, round(radians(180), 9) AS rad, round(pi(), 9) AS pi, -1.0 AS dv, 2.6 AS rnd FROM (VALUES (1.5::DOUBLE), (-2.5), (7), (0.25)) t(x)""",
    ),
    "trigonometry": (
        """EVALUATE SELECTCOLUMNS({0.25, 0.5}, "x", [Value], "sin", ROUND(SIN([Value]), 9), "cos", ROUND(COS([Value]), 9), "tan", ROUND(TAN([Value]), 9), "asin", ROUND(ASIN([Value]), 9), "acos", ROUND(ACOS([Value]), 9), "atan", ROUND(ATAN([Value]), 9), "atan2", ROUND(ATAN2(2, [Value]), 9), "sinh", ROUND(SINH([Value]), 9), "cosh", ROUND(COSH([Value]), 9), "tanh", ROUND(TANH([Value]), 9), "acosh", ROUND(ACOSH(1 + [Value]), 9), "asinh", ROUND(ASINH([Value]), 9), "atanh", ROUND(ATANH([Value]), 9), "cot", ROUND(COT([Value]), 9), "coth", ROUND(COTH([Value]), 9), "acot", ROUND(ACOT([Value]), 9), "acoth", ROUND(ACOTH(1 + [Value]), 9))""",
        "x sin cos tan asin acos atan atan2 sinh cosh tanh acosh asinh atanh cot coth acot acoth",
        "SELECT x, round(sin(x), 9) AS sin, round(cos(x), 9) AS cos, round(tan(x), 9) AS tan, round(asin(x), 9) AS asin, round(acos(x), 9) AS acos, round(atan(x), 9) AS atan, round(atan2(x, 2), 9) AS atan2, round(sinh(x), 9) AS sinh, round(cosh(x), 9) AS cosh, round(tanh(x), 9) AS tanh, round(acosh(1 + x), 9) AS acosh, round(asinh(x), 9) AS asinh, round(atanh(x), 9) AS atanh, round(1 / tan(x), 9) AS cot, round(cosh(x) / sinh(x), 9) AS coth, round(pi() / 2 - atan(x), 9) AS acot, round(0.5 * ln((x + 2) / x), 9) AS acoth FROM (VALUES (0.25::DOUBLE), (0.5)) t(x)",
    ),
    "logic_functions": (
        """EVALUATE SELECTCOLUMNS(nation, "k", nation[n_nationkey], "a", AND(nation[n_nationkey] > 3, nation[n_regionkey] = 1), "o", OR(nation[n_nationkey] > 20, FALSE()), "n", NOT(TRUE()), "b", ISBLANK(BLANK()), "i", IF(nation[n_regionkey] = 2, "two"), "c", COALESCE(BLANK(), nation[n_name]), "s", SWITCH(nation[n_regionkey], 0, "zero", 1, "one", "many"), "t", SWITCH(TRUE(), nation[n_nationkey] < 5, 1, nation[n_nationkey] < 10, 2, 3), "j", nation[n_name] & "-" & "x", "z", BLANK() + 1, "e", BLANK() = 0, "in", nation[n_regionkey] IN {1, 3}, "neg", -nation[n_nationkey])""",
        "k a o n b i c s t j z e isin neg",
        "SELECT n_nationkey AS k, n_nationkey > 3 AND n_regionkey = 1 AS a, n_nationkey > 20 AS o, false AS n, true AS b, CASE WHEN n_regionkey = 2 THEN 'two' END AS i, n_name AS c, CASE n_regionkey WHEN 0 THEN 'zero' WHEN 1 THEN 'one' ELSE 'many' END AS s, CASE WHEN n_nationkey < 5 THEN 1 WHEN n_nationkey < 10 THEN 2 ELSE 3 END AS t, n_name || '-x' AS j, 1 AS z, true AS e, n_regionkey IN (1, 3) AS isin, -n_nationkey AS neg FROM nation",
    ),
}

@functools.lru_cache(4)
def _engine(spark: SparkSession, sf_dir: str) -> Engine:
    """One engine a session and folder, which reads the files' schemas once."""
    return Engine(spark, demo_model(), sf_dir)


def _run(text: str, names: list[str], which: int) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _engine(spark, sf_dir).query(text)[which].toDF(*names)

    return run


def _mdx(text: str, names: list[str], total: bool) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        _, cells, grand = run_mdx(_engine(spark, sf_dir), text)
        return (grand if total else cells).toDF(*names)

    return run


def _system(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: system_query(spark, demo_model(), text)


_REGIONS = "SELECT r_name AS region, {} FROM " + _STAR + " GROUP BY 1"

# MDX as spreadsheets send it: text, column names, SQL.
MDX: dict[str, tuple[str, str, str]] = {
    "mdx_single_dim": (
        "SELECT NON EMPTY Hierarchize({DrilldownLevel({[region].[r_name].[All]},,,INCLUDE_CALC_MEMBERS)}) DIMENSION PROPERTIES PARENT_UNIQUE_NAME ON COLUMNS FROM [Model] WHERE ([Measures].[Quantity]) CELL PROPERTIES VALUE",
        "region quantity",
        _REGIONS.format("sum(l_quantity) AS quantity"),
    ),
    "mdx_total": ("SELECT {[region].[r_name].Members} ON COLUMNS FROM [Model] WHERE ([Measures].[Quantity], [lineitem].[l_returnflag].&[R])", "quantity", "SELECT sum(l_quantity) AS quantity FROM lineitem WHERE l_returnflag = 'R'"),
    "mdx_two_axes": (
        "SELECT {[region].[r_name].Members} ON COLUMNS, {[lineitem].[l_returnflag].Members} ON ROWS FROM (SELECT ({[region].[r_name].&[ASIA], [region].[r_name].&[EUROPE]}) ON COLUMNS FROM [Model]) WHERE ([Measures].[Quantity])",
        "region flag quantity",
        f"SELECT r_name AS region, l_returnflag AS flag, sum(l_quantity) AS quantity FROM {_STAR} WHERE r_name IN ('ASIA', 'EUROPE') GROUP BY 1, 2",
    ),
    "mdx_cross_join": (
        "SELECT NON EMPTY CrossJoin(Hierarchize({[region].[r_name].Members}), {[Measures].[Quantity],[Measures].[Orders]}) ON COLUMNS, {[customer].[c_mktsegment].Members} ON ROWS FROM [Model]",
        "region segment quantity orders",
        """SELECT region, segment, quantity, orders FROM (SELECT r_name AS region, c_mktsegment AS segment, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2)
        JOIN (SELECT r_name AS region, c_mktsegment AS segment, sum(l_quantity) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2) USING (region, segment)""",
    ),
    "mdx_drilldown_member": (
        "SELECT NON EMPTY Hierarchize(DrilldownMember(CrossJoin({[region].[r_name].[All],[region].[r_name].[r_name].AllMembers}, {([nation].[n_name].[All])}), [region].[r_name].[r_name].AllMembers, [nation].[n_name])) ON COLUMNS FROM [Model] WHERE ([Measures].[Orders])",
        "region nation orders",
        "SELECT r_name AS region, n_name AS nation, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2",
    ),
    "mdx_with_set": (
        "WITH SET [Chosen] AS {[region].[r_name].&[ASIA],[region].[r_name].&[AFRICA]} SELECT Hierarchize(Generate([Chosen], Ascendants([region].[r_name].currentMember))) ON COLUMNS, {[Measures].[Quantity]} ON ROWS FROM [Model]",
        "region quantity",
        f"SELECT r_name AS region, sum(l_quantity) AS quantity FROM {_STAR} WHERE r_name IN ('ASIA', 'AFRICA') GROUP BY 1",
    ),
    "mdx_with_set_total": (
        "WITH SET [Chosen] AS {[region].[r_name].&[ASIA],[region].[r_name].&[AFRICA]} SELECT Hierarchize(Generate([Chosen], Ascendants([region].[r_name].currentMember))) ON COLUMNS FROM [Model] WHERE ([Measures].[Quantity])",
        "quantity",
        "SELECT sum(l_quantity) AS quantity FROM lineitem",
    ),
    "mdx_with_member": (
        "WITH MEMBER [Measures].[Twice] AS '[Quantity] * 2' MEMBER [Measures].[Below] AS 'AddCalculatedMembers([nation].[n_name].currentmember.children).count' SELECT {[Measures].[Twice],[Measures].[Below]} ON COLUMNS, {[region].[r_name].Members} ON ROWS FROM [Model]",
        "region twice below",
        f"SELECT r_name AS region, sum(l_quantity) * 2 AS twice, count(DISTINCT n_name) AS below FROM {_STAR.replace('JOIN nation ON c_nationkey = n_nationkey JOIN region', 'RIGHT JOIN nation ON c_nationkey = n_nationkey JOIN region')} GROUP BY 1",
    ),
    "mdx_measures_only": ("SELECT {[Measures].[Quantity],[Measures].[Orders]} ON COLUMNS FROM [Model] WHERE ([region].[r_name].&[ASIA])", "quantity orders", f"SELECT sum(l_quantity) AS quantity, count(DISTINCT l_orderkey) + (SELECT count(*) FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) AS orders FROM {_STAR} WHERE r_name = 'ASIA'"),
    "mdx_scalar": ("SELECT FROM [Model] WHERE ([Measures].[Orders], [customer].[c_mktsegment].&[BUILDING])", "orders", "SELECT count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'"),
    "mdx_members": ("SELECT {[part].[p_type].[p_type].AllMembers} ON COLUMNS FROM [Model]", "type", "SELECT DISTINCT p_type AS type FROM part UNION ALL SELECT NULL"),
}
_TOTALS = {"mdx_total", "mdx_with_set_total"}

_MODEL_TABLES = "('region', 'nation', 'supplier', 'part', 'customer', 'orders', 'lineitem', 'events', 'documents', 'labels')"
_KIND = "CASE data_type WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' WHEN 'BIGINT' THEN 'int64' WHEN 'INTEGER' THEN 'int64' ELSE 'dateTime' END"

# Metadata as $system queries; the SQL asks the catalog of the files, or lists what the model states.
SYSTEM: dict[str, tuple[str, str]] = {
    "tmschema_columns": ("SELECT [TableName], [Name], [DataType] FROM $system.TMSCHEMA_COLUMNS WHERE [IsHidden] <> 'true'", f"SELECT table_name AS TableName, column_name AS Name, {_KIND} AS DataType FROM information_schema.columns WHERE table_name IN {_MODEL_TABLES}"),
    "tmschema_tables": ("SELECT [Name], [IsHidden] FROM $system.TMSCHEMA_TABLES", f"SELECT DISTINCT table_name AS Name, false AS IsHidden FROM information_schema.columns WHERE table_name IN {_MODEL_TABLES}"),
    "tmschema_relationships": (
        "SELECT [FromTable], [FromColumn], [ToTable], [ToColumn], [IsActive] FROM $system.TMSCHEMA_RELATIONSHIPS",
        "SELECT * FROM (VALUES ('lineitem', 'l_orderkey', 'orders', 'o_orderkey', true), ('lineitem', 'l_partkey', 'part', 'p_partkey', true), ('lineitem', 'l_suppkey', 'supplier', 's_suppkey', true), ('orders', 'o_custkey', 'customer', 'c_custkey', true), ('customer', 'c_nationkey', 'nation', 'n_nationkey', true), ('nation', 'n_regionkey', 'region', 'r_regionkey', true), ('supplier', 's_nationkey', 'nation', 'n_nationkey', false), ('events', 'user_id', 'customer', 'c_custkey', true), ('labels', 'doc_id', 'documents', 'doc_id', true)) t(FromTable, FromColumn, ToTable, ToColumn, IsActive)",
    ),
    "mdschema_hierarchies": ("SELECT [DIMENSION_UNIQUE_NAME], [HIERARCHY_UNIQUE_NAME], [DEFAULT_MEMBER] FROM $system.MDSCHEMA_HIERARCHIES", f"SELECT '[' || table_name || ']' AS DIMENSION_UNIQUE_NAME, '[' || table_name || '].[' || column_name || ']' AS HIERARCHY_UNIQUE_NAME, '[' || table_name || '].[' || column_name || '].[All]' AS DEFAULT_MEMBER FROM information_schema.columns WHERE table_name IN {_MODEL_TABLES}"),
    "mdschema_levels": ("SELECT [HIERARCHY_UNIQUE_NAME], [LEVEL_NAME], [LEVEL_NUMBER] FROM $system.MDSCHEMA_LEVELS WHERE [CUBE_NAME] = 'Model'", f"SELECT '[' || table_name || '].[' || column_name || ']' AS HIERARCHY_UNIQUE_NAME, CASE k WHEN 0 THEN '(All)' ELSE column_name END AS LEVEL_NAME, k::INTEGER AS LEVEL_NUMBER FROM information_schema.columns, range(2) r(k) WHERE table_name IN {_MODEL_TABLES}"),
    "mdschema_members": ("SELECT [MEMBER_UNIQUE_NAME], [LEVEL_NUMBER] FROM $system.MDSCHEMA_MEMBERS WHERE [TREE_OP] = 8 AND [HIERARCHY_UNIQUE_NAME] = '[region].[r_name]'", "SELECT '[region].[r_name].[All]' AS MEMBER_UNIQUE_NAME, 0 AS LEVEL_NUMBER"),
    "mdschema_measures": (
        "SELECT [MEASURE_NAME], [MEASUREGROUP_NAME], [MEASURE_AGGREGATOR] FROM $system.MDSCHEMA_MEASURES WHERE [MEASURE_IS_VISIBLE]",
        "SELECT * FROM (VALUES ('Quantity', 'lineitem', 1), ('Revenue', 'lineitem', 127), ('Returned Revenue', 'lineitem', 127), ('Return Rate', 'lineitem', 127), ('All Region Revenue', 'lineitem', 127), ('Orders', 'orders', 2), ('Customers', 'orders', 8), ('Event Value', 'events', 1)) t(MEASURE_NAME, MEASUREGROUP_NAME, MEASURE_AGGREGATOR)",
    ),
    "mdschema_group_dimensions": (
        "SELECT [MEASUREGROUP_NAME], [DIMENSION_UNIQUE_NAME] FROM $system.MDSCHEMA_MEASUREGROUP_DIMENSIONS WHERE [MEASUREGROUP_NAME] = 'events'",
        "SELECT 'events' AS MEASUREGROUP_NAME, '[' || t || ']' AS DIMENSION_UNIQUE_NAME FROM (VALUES ('events'), ('customer'), ('nation'), ('region')) x(t)",
    ),
    "lineage_upstream": (
        "SELECT [DependsOn] FROM $system.LINEAGE WHERE [Measure] = 'Return Rate'",
        "SELECT * FROM (VALUES ('Returned Revenue'), ('Revenue'), ('lineitem[l_returnflag]'), ('lineitem[l_extendedprice]'), ('lineitem[l_discount]')) t(DependsOn)",
    ),
    "lineage_impact": ("SELECT [Measure] FROM $system.LINEAGE_IMPACT WHERE [Object] = 'lineitem[l_discount]'", "SELECT * FROM (VALUES ('Revenue'), ('Returned Revenue'), ('Return Rate'), ('All Region Revenue')) t(Measure)"),
}

QUERIES = {name: _run(text, names.split(), 0 if name in FIRST else -1) for name, (text, names, _) in CASES.items()}
ORACLES = {name: sql for name, (_, _, sql) in CASES.items()}


def _rows(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rows], schema)


_BY_REGION = 'EVALUATE SUMMARIZECOLUMNS(region[r_name], "quantity", [Quantity])'


def _model_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(spark, Model.from_json(demo_model().to_json()), sf_dir).query(_BY_REGION)[0].toDF("region", "quantity")


def _commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    commands = [{"type": "RenameTable", "table": "region", "newName": "Big Area"}, {"type": "RenameColumn", "table": "Big Area", "column": "r_name", "newName": "Label"}, {"type": "RenameMeasure", "name": "Quantity", "newName": "Pieces"}, {"type": "UpdateMeasureExpression", "name": "Pieces", "expression": "SUM(lineitem[l_quantity]) * 2"}]
    return Engine(spark, demo_model().apply(commands), sf_dir).query("EVALUATE SUMMARIZECOLUMNS('Big Area'[Label], \"pieces\", [Pieces])")[0].toDF("region", "pieces")


def _refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark, demo_model(), sf_dir)
    engine.query(_BY_REGION)
    engine.refresh()
    return engine.query(_BY_REGION)[0].toDF("region", "quantity")


def _json_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, second = json.loads(evaluate_json(Engine(spark, demo_model(), sf_dir), f"{_BY_REGION} EVALUATE ROW(\"x\", BLANK())"))
    return _rows(spark, [*first["rows"], ["blank", *second["rows"][0]]], "region string, quantity double")


def _rowset_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = ElementTree.fromstring(evaluate_rowsets(Engine(spark, demo_model(), sf_dir), _BY_REGION))
    rows = [[c.text for c in r] for r in root if r.tag.endswith("}row")]
    return _rows(spark, [(a, float(b)) for a, b in rows], "region string, quantity double")


_SUMS = f"SELECT r_name AS region, sum(l_quantity) AS quantity FROM {_STAR} GROUP BY 1"
OTHERS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "model_json": (_model_json, _SUMS),
    "schema_commands": (_commands, f"SELECT r_name AS region, sum(l_quantity) * 2 AS pieces FROM {_STAR} GROUP BY 1"),
    "refresh_data": (_refresh, _SUMS),
    "json_result": (_json_result, f"{_SUMS} UNION ALL SELECT 'blank', NULL"),
    "rowset_result": (_rowset_result, _SUMS),
}
QUERIES |= {name: f for name, (f, _) in OTHERS.items()}
ORACLES |= {name: sql for name, (_, sql) in OTHERS.items()}
QUERIES |= {name: _mdx(text, names.split(), name in _TOTALS) for name, (text, names, _) in MDX.items()} | {name: _system(text) for name, (text, _) in SYSTEM.items()}
ORACLES |= {name: sql for name, (_, _, sql) in MDX.items()} | {name: sql for name, (_, sql) in SYSTEM.items()}
