"""DAX to DataFrames. A measure under grouping compiles once, to a frame keyed by the group columns that reach it."""

from __future__ import annotations

import copy
import functools
import itertools
import math
import re
from collections import deque
from dataclasses import dataclass, field, replace

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from prismata.functions.scalar import SCALARS, Val, arithmetic, common, compare, concat, flag, kind_of, literal, num, zoned
from prismata.model import TYPES, Model, Relationship
from prismata.plans.context import Col, Context, Key, Pred, Rowset
from prismata.plans.parser import DaxError, Evaluate, Node, calls, parse_expression, parse_query
from prismata.plans.rows import Frame, Impure, Level, Out, Request, Rows, Scan, Unfused, fresh
from prismata.sources import physical, read_table

_ids = itertools.count()
_MODIFIERS = {"ALL", "REMOVEFILTERS", "ALLEXCEPT", "ALLSELECTED", "USERELATIONSHIP", "CROSSFILTER"}
FEW = 100_000  # rows that one task may number
CROSSED = 10_000_000  # combinations of unrelated group columns that a query may have
_ITERATORS = {"SUMX", "AVERAGEX", "MAXX", "MINX", "COUNTX", "COUNTAX"}


@dataclass(frozen=True)
class Env:
    """Where an expression stands: filter context, rows to join to, row context, variables, grouping flags."""

    context: Context
    rows: Rows
    scope: Rows | None = None
    live: bool = False  # the row context has not become filters yet
    variables: dict = field(default_factory=dict)
    axes: frozenset[Col] | None = None  # grouping columns of this row, for ISINSCOPE
    rolled: frozenset[Col] = frozenset()  # columns that a subtotal row leaves blank
    group: list | None = None  # aggregates of the current GROUPBY group


@dataclass
class GroupingSet:
    """Group columns of a level, those that it rolls up, what its expressions see, and the scan that its groups come from."""

    cols: list[Col]
    rolled: frozenset[Col]
    context: Context
    spine: Scan | None


class ScanRows(Rows):
    """A scan as row context: its columns by physical name; anything that needs a join is refused."""

    def __init__(self, scan: Scan, parent: Rows | None):
        super().__init__(None, [], parent=parent)
        self.scan, self.used = scan, set()

    @property
    def cols(self) -> dict[Col, Out]:
        e = self.scan.engine
        return {(self.scan.table, c.name): Out("", physical(self.scan.table, c.name), e.kind(self.scan.table, c.name)) for c in e.model.table(self.scan.table).columns}

    def need(self, name: str) -> Column:
        if "__" not in name:
            raise Impure(name)
        return F.col(name)

    def flush(self) -> DataFrame:
        raise Impure

    ensure = flush


class Engine:
    """A model over a folder of Parquet files, and the compiler of queries against it."""

    def __init__(self, spark: SparkSession, model: Model, folder: str, time_zone: str = "UTC"):
        self.spark, self.model, self.folder = spark, model, folder
        self.scalars = SCALARS | zoned(time_zone)
        self.measures = {m.name.lower(): parse_expression(m.expression) for m in model.measures.values()}
        self.held: list[DataFrame] = []
        self._blanks: dict[tuple[str, ...], bool] = {}  # whether expressions are blank where all they sum is
        self._frames: dict[str, DataFrame] = {}
        self._paths: dict[tuple, dict[str, list[Relationship]]] = {}

    # Tables and relationships

    def frame(self, table: str) -> DataFrame:
        if table not in self._frames:
            self._frames[table] = read_table(self.spark, self.folder, self.model.table(table))
        return self._frames[table]

    def refresh(self) -> None:
        """Read the files anew from now on."""
        for t in self._frames:
            self.spark.catalog.refreshByPath(f"{self.folder}/{self.model.table(t).source}")
        self._frames.clear()

    def kind(self, table: str, column: str) -> str:
        return kind_of(TYPES[self.model.column(table, column).data_type])

    def table_name(self, name: str) -> str:
        t = self.model.table(name)
        if not t:
            raise DaxError(f"unknown table {name}")
        return t.name

    def col(self, node: Node) -> Col:
        if node[0] != "col" or not self.model.column(node[1], node[2]):
            raise DaxError(f"a model column is expected, not {node}")
        return self.table_name(node[1]), self.model.column(node[1], node[2]).name

    def mode(self, r: Relationship, context: Context) -> str:
        """off, oneway or both."""
        over = dict(context.relations).get(r.name)
        if over == "on":
            return "both" if r.both else "oneway"
        return over or (("both" if r.both else "oneway") if r.active else "off")

    def paths(self, table: str, context: Context) -> dict[str, list[Relationship]]:
        """For every table on the one side of ``table``, near or far, the shortest chain of relationships to it; switched-on ones first."""
        key = (table, context.relations)
        if key not in self._paths:
            on = dict(context.relations)
            order = sorted(self.model.relationships, key=lambda r: on.get(r.name) != "on")
            found, queue = {table: []}, deque([table])
            while queue:
                at = queue.popleft()
                for r in order:
                    if r.from_table == at and r.to_table not in found and self.mode(r, context) != "off":
                        found[r.to_table] = [*found[at], r]
                        queue.append(r.to_table)
            self._paths[key] = found
        return self._paths[key]

    def scan(self, table: str, context: Context) -> Scan:
        """The rows of a table that the context lets through, directly or over relationships."""
        s = Scan(self, table, context, self.paths(table, context))
        for f in context.filters:
            reach = {c for c in f.cols if c[0] in s.paths}
            if isinstance(f, Key) and reach:
                s.keys[f.name] = physical(*f.col)
                s.needed.add(f.col[0])
            elif isinstance(f, Pred) and reach:
                s.preds[f.text] = f.cond
                s.needed |= {t for t, _ in f.cols}
            elif isinstance(f, Rowset) and reach:
                self._add_set(s, replace(f, names=tuple(x for x in f.names if x[0] in reach)))
        for r in self.model.relationships:
            if self.mode(r, context) == "both" and r.to_table in s.paths and r.from_table not in s.paths:
                other = self.scan(r.from_table, context.relate(r.name, "off"))
                far = [f for f in context.filters if any(t in other.paths and t not in s.paths for t, _ in f.cols)]
                if far and (other.preds or other.sets or other.keys):
                    df, keys = other.plan()
                    name = fresh()
                    df = df.select(F.col(physical(r.from_table, r.from_column)).alias(name), *[F.col(p).alias(k) for k, p in keys.items()]).distinct()
                    self._add_set(s, Rowset(next(_ids), (((r.to_table, r.to_column), name),), tuple(keys), df))
        s.needed.discard(table)
        return s

    def _add_set(self, s: Scan, f: Rowset) -> None:
        s.sets.append(f)
        s.needed |= {t for (t, _), _ in f.names}
        for k in f.keys:
            s.keys.setdefault(k, "")

    def whole(self, scan: Scan, env: Env) -> Rows:
        """A scan as rows of its own, all columns of its table visible."""
        df, keys = scan.plan()
        t = self.model.table(scan.table)
        out = [Out(self.shown(t.name, c.name), fresh(), self.kind(t.name, c.name), (t.name, c.name)) for c in t.columns]
        df = df.select(*[F.col(physical(*o.col)).alias(o.name) for o in out], *[F.col(p).alias(k) for k, p in keys.items()])
        return Rows(df, out, list(keys), env.rows, env.scope)

    @staticmethod
    def shown(table: str, column: str) -> str:
        return f"'{table}'[{column}]" if " " in table else f"{table}[{column}]"

    # Scalars

    def scalar(self, n: Node, env: Env) -> Val:
        kind = n[0]
        if kind == "lit":
            return literal(n[1])
        if kind == "neg":
            v = self.scalar(n[1], env)
            return literal(-v.const) if isinstance(v.const, (int, float)) else Val(-(v.col if v.kind == "int" else num(v)), v.kind if v.kind == "int" else "num")
        if kind == "bin":
            return self._binary(n, env)
        if kind == "col":
            return self._column(n, env)
        if kind == "ref":
            return self._measure(n[1], env)
        if kind == "name":
            return self._name(n[1], env)
        if kind == "var":
            return self.scalar(n[2], self._bind(n[1], env))
        if kind == "call":
            return self._call(n[1], n[2], env)
        raise DaxError(f"{kind} is no scalar")

    def _binary(self, n: Node, env: Env) -> Val:
        op = n[1]
        if op == "in":
            v = self.scalar(n[2], env)
            if n[3][0] == "rows":
                hit = F.lit(False)
                for r in n[3][1]:
                    w = self.scalar(r[0], env)
                    if w.const is not None or w.kind != "blank":
                        hit = hit | F.coalesce(v.col == w.col, F.lit(False))
                return Val(hit, "bool")
            return self._contains(self.table(n[3], env), None, [v], env)
        a, b = self.scalar(n[2], env), self.scalar(n[3], env)
        if op in ("&&", "||"):
            return Val(flag(a) & flag(b) if op == "&&" else flag(a) | flag(b), "bool")
        if op == "&":
            return concat(a, b)
        return arithmetic(op, a, b) if op in "+-*/" else compare(op, a, b)

    def _column(self, n: Node, env: Env) -> Val:
        if not self.model.column(n[1], n[2]):
            if self.model.measure(n[2]) or n[2].lower() in self.measures:
                return self._measure(n[2], env)
            raise DaxError(f"unknown column {n[1]}[{n[2]}]")
        col, s = self.col(n), env.scope
        while s is not None:
            if col in s.cols:
                o = s.cols[col]
                return Val(env.rows.need(o.name), o.kind)
            s = s.parent
        for f in env.context.on_column(col):
            if isinstance(f, Key):
                return Val(env.rows.need(f.name), self.kind(*col))
        raise DaxError(f"{n[1]}[{n[2]}] has no current row")

    def _measure(self, name: str, env: Env) -> Val:
        body = self.measures.get(name.lower())
        if body is not None:
            inner = self._transition(env)
            return self.scalar(body, replace(inner, scope=None, live=False, variables={}, group=None))
        s = env.scope
        while s is not None:
            if o := s.named(name):
                return Val(env.rows.need(o.name), o.kind)
            s = s.parent
        raise DaxError(f"unknown measure or column [{name}]")

    def _name(self, name: str, env: Env) -> Val:
        bound = env.variables.get(name.lower())
        if bound is None:
            if name.upper() in ("TRUE", "FALSE"):
                return literal(name.upper() == "TRUE")
            raise DaxError(f"unknown name {name}")
        if isinstance(bound, Val):
            return bound
        o, home = bound
        if isinstance(o, Out):
            return Val(env.rows.need(o.name), o.kind)
        raise DaxError(f"{name} is a table")

    def _is_table(self, n: Node, env: Env) -> bool:
        if n[0] == "name":
            b = env.variables.get(n[1].lower())
            return isinstance(b, tuple) and isinstance(b[0], Rows) if b is not None else bool(self.model.table(n[1]))
        if n[0] == "var":
            return self._is_table(n[2], env) or n[2][0] == "call" and n[2][1] in _TABLES
        return n[0] == "rows" or n[0] == "call" and n[1] in _TABLES

    def _bind(self, bound: list[tuple[str, Node]], env: Env) -> Env:
        """Each variable is a value of the place where it is defined: a literal, a column of the rows there, or a table."""
        for name, n in bound:
            if self._is_table(n, env):
                value = (self.table(n, env), env.rows)
            else:
                v = self.scalar(n, env)
                value = v if v.const is not None or v.kind == "blank" else (env.rows.add(f"__{name}", v.col, v.kind), env.rows)
            env = replace(env, variables={**env.variables, name.lower(): value})
        return env

    def _transition(self, env: Env) -> Env:
        if not (env.live and env.scope):
            return env
        if isinstance(env.scope, ScanRows):
            raise Impure
        keys, whole = [], {}
        for o in env.scope.out:
            if o.col:
                whole.setdefault(o.col[0], {})[o.col[1]] = o
        for t, its in whole.items():
            one = self.model.one_key(t)
            its = {one: its[one]} if one in its and len(its) > 1 else its  # the key of a one-side table settles its row
            keys += [Key((t, c), o.name) for c, o in its.items()]
        return replace(env, context=env.context.with_keys(keys), live=False)

    def _agg(self, env: Env, col: Col, agg, kind: str) -> Val:
        """One aggregate of a model column under the context."""
        scan = self.scan(col[0], env.context)
        x = F.col(physical(*col))
        return self._ask(env, scan, lambda w: agg(w, w(x)), kind)

    def _ask(self, env: Env, scan: Scan, agg, kind: str) -> Val:
        if isinstance(env.rows, ScanRows):
            raise Impure
        name = fresh("m")
        env.rows.pending.append(Request(scan, agg, name))
        for k in scan.keys:
            env.rows.hold(k)
        return Val(F.col(name), kind)

    def _frame(self, env: Env, p: Rows, agg: Column, kind: str) -> Val:
        if isinstance(env.rows, ScanRows):
            raise Impure
        name, df = fresh("m"), p.flush()
        df = df.groupBy(*p.keys).agg(agg.alias(name)) if p.keys else df.agg(agg.alias(name))
        env.rows.pending.append(Frame(df, list(p.keys), [name]))
        return Val(F.col(name), kind)

    def _call(self, f: str, args: list[Node], env: Env) -> Val:
        if f in _COLUMN_AGGS and len(args) == 1 and args[0][0] == "col" and self.model.column(args[0][1], args[0][2]):
            return self._column_agg(f, self.col(args[0]), env)
        if f in ("MIN", "MAX") and args:
            vs = [self.scalar(a, env) for a in args]
            return vs[0] if len(vs) == 1 else Val((F.least if f == "MIN" else F.greatest)(*[v.col for v in vs]), common(*[v.kind for v in vs]))
        if f in _COLUMN_AGGS:
            raise DaxError(f"{f} takes a column")
        if f in self.scalars:
            low, high, make = self.scalars[f]
            if not low <= len(args) <= high:
                raise DaxError(f"{f} takes {low} to {high} arguments")
            return make([self.scalar(a, env) for a in args])
        if f in _ITERATORS:
            return self._iterate(f, args, env)
        if f in ("COUNTROWS", "ISEMPTY"):
            if f == "COUNTROWS" and args and args[0] == ("call", "CURRENTGROUP", []):
                return self._grouped(env, F.count(F.lit(1)), "int")
            v = self._over(args[0], None, env, lambda w, x: F.count(w(F.lit(1))), "int")
            return Val(F.nullif(v.col, F.lit(0)), "int") if f == "COUNTROWS" else Val(F.coalesce(v.col, F.lit(0)) == 0, "bool")
        if f == "CALCULATE":
            return self.scalar(args[0], self.calculate(args[1:], env))
        if f in ("RELATED",):
            return self._related(self.col(args[0]), env)
        if f == "LOOKUPVALUE":
            return self._lookup(args, env)
        if f == "CONTAINS":
            return self._contains(self.table(args[0], env), [self.col(a) if self.model.column(*a[1:3]) else a for a in args[1::2]], [self.scalar(a, env) for a in args[2::2]], env)
        if f == "SELECTEDVALUE":
            col = self.col(args[0])
            v = self._agg(env, col, lambda w, x: F.when(_distinct(w, x) == 1, F.min(x)), self.kind(*col))
            if len(args) == 1:
                return v
            alt = self.scalar(args[1], env)
            one = self._column_agg("HASONEVALUE", col, env)
            return Val(F.when(flag(one), v.col).otherwise(alt.col), common(v.kind, alt.kind))
        if f == "ISINSCOPE":
            return literal(self.col(args[0]) in (env.axes or ()) and self.col(args[0]) not in env.rolled)
        if f == "ISSUBTOTAL":
            return literal(self.col(args[0]) in env.rolled)
        if f == "ISFILTERED":
            if args[0][0] == "name":
                return literal(bool(env.context.on_table(self.table_name(args[0][1]))))
            return literal(bool(env.context.on_column(self.col(args[0]))))
        if f in ("EARLIER", "EARLIEST"):
            return self._earlier(f, args, env)
        if f in _TABLES:
            p = self.table(("call", f, args), env)  # a table of one column as a scalar: its only value
            o = p.out[0]
            return self._frame(env, p, F.when(F.count_distinct(F.struct(o.name)) > 1, F.raise_error(F.lit("a table of several rows is no scalar")).cast(dict(p.df.dtypes)[o.name])).otherwise(F.min(o.name)), o.kind)
        raise DaxError(f"unknown function {f}")

    def _column_agg(self, f: str, col: Col, env: Env) -> Val:
        kind = self.kind(*col)
        if f in ("SUM", "AVERAGE") and kind not in ("int", "num"):
            raise DaxError(f"{f} takes a numeric column")
        if f in ("MIN", "MAX") and kind not in ("int", "num", "date"):
            raise DaxError(f"{f} takes a numeric or date column")
        as_number = (lambda x: x.cast("int").cast("double")) if kind == "bool" else (lambda x: F.when(x.isNotNull(), F.lit(0.0))) if kind == "str" else (lambda x: x.cast("double"))
        agg, out = {
            "SUM": (lambda w, x: F.when(F.count(w(F.lit(1))) > 0, F.coalesce(F.sum(x), F.lit(0))), kind),
            "AVERAGE": (lambda w, x: F.avg(x), "num"),
            "COUNT": (lambda w, x: F.nullif(F.count(x), F.lit(0)), "int"),
            "COUNTA": (lambda w, x: F.nullif(F.count(x), F.lit(0)), "int"),
            "MIN": (lambda w, x: F.min(x), kind),
            "MAX": (lambda w, x: F.max(x), kind),
            "AVERAGEA": (lambda w, x: F.avg(as_number(x)), "num"),
            "MINA": (lambda w, x: F.min(as_number(x)), "num"),
            "MAXA": (lambda w, x: F.max(as_number(x)), "num"),
            "DISTINCTCOUNT": (lambda w, x: F.nullif(_distinct(w, x), F.lit(0)), "int"),
            "HASONEVALUE": (lambda w, x: _distinct(w, x) == 1, "bool"),
        }[f]
        v = self._agg(env, col, agg, out)
        if f in ("DISTINCTCOUNT", "HASONEVALUE") and self._blank_member(col[0], env.context):
            plus = self._agg(env, col, lambda w, x: F.coalesce(F.max(w(F.when(F.col(physical(*col)).isNull(), 1).otherwise(0))), F.lit(0)), "int")
            total = F.coalesce(self._agg(env, col, lambda w, x: _distinct(w, x), "int").col, F.lit(0)) + 1 - plus.col
            return Val(total, "int") if f == "DISTINCTCOUNT" else Val(total == 1, "bool")
        return Val(F.coalesce(v.col, F.lit(False)), "bool") if f == "HASONEVALUE" else v

    def _blank_member(self, table: str, context: Context) -> bool:
        """A one-side table has one more, blank, member while nothing filters it."""
        if not self.model.is_one_side(table):
            return False
        s = self.scan(table, context)
        return not (s.preds or s.sets or s.keys)

    def _over(self, table: Node, body: Node | None, env: Env, agg, kind: str | None) -> Val:
        """An aggregate of an expression over a table: in the scan's own pass if it can be, else over rows of its own."""
        base = self.table(table, env, scan=True)
        if isinstance(base, Scan):
            try:
                view = ScanRows(base, env.scope)
                v = self.scalar(body, replace(env, rows=view, scope=view, live=True)) if body else literal(1)
                seen = base.filtered("", F.lit(True), view.used)
                del seen.preds[""]
                return self._ask(env, seen, lambda w: agg(w, v.col), kind or v.kind)
            except Impure:
                base = self.whole(base, env)
        v = self.scalar(body, replace(env, rows=base, scope=base, live=True)) if body else literal(1)
        return self._frame(env, base, agg(lambda x: x, v.col), kind or v.kind)

    def _iterate(self, f: str, args: list[Node], env: Env) -> Val:
        agg, kind = {
            "SUMX": (lambda w, x: F.sum(w(x.cast("double"))), "num"),
            "AVERAGEX": (lambda w, x: F.avg(w(x.cast("double"))), "num"),
            "MAXX": (lambda w, x: F.max(w(x)), None),
            "MINX": (lambda w, x: F.min(w(x)), None),
            "COUNTX": (lambda w, x: F.nullif(F.count(w(x)), F.lit(0)), "int"),
            "COUNTAX": (lambda w, x: F.nullif(F.count(F.nullif(w(x).cast("string"), F.lit(""))), F.lit(0)), "int"),
        }[f]
        if args[0] == ("call", "CURRENTGROUP", []):
            rows = env.scope
            v = self.scalar(args[1], replace(env, rows=rows, group=None, live=True))
            rows.flush()
            return self._grouped(env, agg(lambda x: x, v.col), kind or v.kind)
        return self._over(args[0], args[1], env, agg, kind)

    def _grouped(self, env: Env, agg: Column, kind: str) -> Val:
        if env.group is None:
            raise DaxError("CURRENTGROUP stands only in GROUPBY")
        name = fresh("g")
        env.group.append(agg.alias(name))
        return Val(F.col(name), kind)

    def _related(self, col: Col, env: Env) -> Val:
        s = env.scope
        while s is not None:
            if isinstance(s, ScanRows):
                if col[0] in s.scan.paths:
                    s.used.add(col[0])
                    return Val(F.col(physical(*col)), self.kind(*col))
            elif col in s.cols:
                return Val(env.rows.need(s.cols[col].name), self.kind(*col))
            else:
                o = self._join_related(s, col, env.context)
                if o:
                    return Val(env.rows.need(o.name), o.kind)
            s = s.parent
        raise DaxError(f"nothing leads to {col[0]}[{col[1]}]")

    def _join_related(self, rows: Rows, col: Col, context: Context) -> Out | None:
        """Bring a column of a table on the one side to rows, over the relationship columns that they hold."""
        for t in dict.fromkeys(o.col[0] for o in rows.out if o.col):
            chain = self.paths(t, context).get(col[0])
            if chain and (chain[0].from_table, chain[0].from_column) in rows.cols:
                first, want = chain[0], fresh()
                dim = self.frame(first.to_table)
                for e in chain[1:]:
                    dim = dim.join(self.frame(e.to_table), F.col(physical(e.from_table, e.from_column)) == F.col(physical(e.to_table, e.to_column)), "left")
                key = fresh("k")
                dim = dim.select(F.col(physical(first.to_table, first.to_column)).alias(key), F.col(physical(*col)).alias(want))
                rows.df = rows.flush().join(dim, F.col(rows.cols[(first.from_table, first.from_column)].name) == F.col(key), "left").drop(key)
                return Out(self.shown(*col), want, self.kind(*col), col)
        return None

    def _earlier(self, f: str, args: list[Node], env: Env) -> Val:
        col, frames, s = self.col(args[0]), [], env.scope
        while s is not None:
            if col in s.cols:
                frames.append(s)
            s = s.parent
        steps = args[1][1] if len(args) > 1 else 1
        if len(frames) < 2 or f == "EARLIER" and len(frames) <= steps:
            raise DaxError(f"{f} needs an outer row")
        o = frames[-1 if f == "EARLIEST" else steps].cols[col]
        return Val(env.rows.need(o.name), o.kind)

    def _keyed(self, env: Env, values: list[Val]) -> list[str]:
        """Columns of the asking rows that hold the values."""
        if isinstance(env.rows, ScanRows):
            raise Impure
        return [env.rows.add("", v.col, v.kind).name for v in values]

    def _lookup(self, args: list[Node], env: Env) -> Val:
        """LOOKUPVALUE: the table is summed by its search columns first, so rows never multiply; results that differ are an error."""
        if isinstance(env.rows, ScanRows):
            raise Impure
        col = self.col(args[0])
        pairs = args[1:] if len(args) % 2 else args[1:-1]
        search = [self.col(a) for a in pairs[::2]]
        names = self._keyed(env, [self.scalar(a, env) for a in pairs[1::2]])
        df, keys = self.scan(col[0], env.context).plan({t for t, _ in search} - {col[0]})
        x = F.col(physical(*col))
        keep = {n: F.col(physical(*c)) for n, c in zip(names, search, strict=True)} | {k: F.col(p) for k, p in keys.items()}
        got, low, high, rows = fresh("m"), fresh(), fresh(), fresh()
        df = df.select(*[c.alias(n) for n, c in keep.items()], x.alias(got)).groupBy(*keep).agg(F.min(got).alias(low), F.max(got).alias(high), F.count(F.lit(1)).alias(rows))
        env.rows.pending.append(Frame(df, list(keep), [low, high, rows]))
        kind = self.kind(*col)
        found = F.when(F.col(low) != F.col(high), F.raise_error(F.lit("LOOKUPVALUE found several values")).cast(TYPES[self.model.column(*col).data_type])).otherwise(F.col(low))
        if len(args) % 2 == 0:
            found = F.when(F.col(rows).isNull(), self.scalar(args[-1], env).col).otherwise(found)
        return Val(found, kind)

    def _contains(self, p: Rows, columns: list | None, values: list[Val], env: Env) -> Val:
        outs = [p.out[k] for k in range(len(values))] if columns is None else [p.cols[c] if c in p.cols else p.named(c[-1]) for c in columns]
        if None in outs:
            raise DaxError("the table lacks a column that is searched")
        names, hit = self._keyed(env, values), fresh("m")
        df = p.flush().select(*[F.col(o.name).alias(n) for o, n in zip(outs, names, strict=True)], *p.keys).distinct().withColumn(hit, F.lit(True))
        env.rows.pending.append(Frame(df, [*names, *p.keys], [hit]))
        return Val(F.coalesce(F.col(hit), F.lit(False)), "bool")

    # Filter context

    def _columns_of(self, args: list[Node]) -> set[Col]:
        out: set[Col] = set()
        for a in args:
            if a[0] == "name":
                t = self.model.table(self.table_name(a[1]))
                out |= {(t.name, c.name) for c in t.columns}
            else:
                out.add(self.col(a))
        return out

    def calculate(self, filters: list[Node], env: Env) -> Env:
        """The environment of CALCULATE's first argument: rows become filters, then modifiers, then the rest, all seen from outside."""
        new = self._transition(env)
        context = new.context
        for f in filters:
            if f[0] == "call" and f[1] in _MODIFIERS:
                context = self._modify(f[1], f[2], context, env)
        for f in filters:
            if not (f[0] == "call" and f[1] in _MODIFIERS):
                context = self._filter(f, context, env, False)
        return replace(new, context=context, live=False)

    def _modify(self, f: str, args: list[Node], context: Context, env: Env) -> Context:
        if f in ("USERELATIONSHIP", "CROSSFILTER"):
            r = self.model.find_relationship(self.col(args[0]), self.col(args[1]))
            if f == "CROSSFILTER":
                mode = {"NONE": "off", "ONEWAY": "oneway", "BOTH": "both"}.get(str(args[2][1]).upper())
                if not mode:
                    raise DaxError("CROSSFILTER takes NONE, ONEWAY or BOTH")
                return context.relate(r.name, mode)
            for other in self.model.relationships:
                if other is not r and other.active and {other.from_table, other.to_table} == {r.from_table, r.to_table}:
                    context = context.relate(other.name, "off")
            return context.relate(r.name, "on")
        if f == "ALLEXCEPT":
            t = self.table_name(args[0][1])
            expanded = {(x, c.name) for x in self.paths(t, context) for c in self.model.table(x).columns}
            return context.without(expanded - self._columns_of(args[1:]))
        if not args:
            if f == "ALLSELECTED":
                return replace(context, filters=(context.visual or context).filters)
            return replace(context, filters=())
        cols = self._columns_of(args)
        for a in args:
            if a[0] == "name" and f != "ALLSELECTED":  # a table takes its one-side tables with it
                cols |= {(x, c.name) for x in self.paths(self.table_name(a[1]), context) for c in self.model.table(x).columns}
        bare = context.without(cols)
        if f == "ALLSELECTED" and context.visual:
            bare = bare.plus(*[x for x in context.visual.filters if x.cols & cols])
        return bare

    def _filter(self, f: Node, context: Context, env: Env, keep: bool) -> Context:
        if f[0] == "call" and f[1] == "KEEPFILTERS":
            return self._filter(f[2][0], context, env, True)
        if f[0] == "call" and f[1] == "FILTER" and (quick := self._filter_pred(f, context, env, keep)):
            return quick
        if self._is_table(f, env):
            p = self.table(f, env)
            names = {o.col: o.name for o in p.out if o.col}
            if not names:
                raise DaxError("a filter table needs model columns")
            removed = set(names)
            for t in {t for t, _ in names}:  # the key of a one-side table stands for its row
                one = self.model.one_key(t)
                if one and (t, one) in names:
                    names = {c: n for c, n in names.items() if c[0] != t or c[1] == one}
            found = Rowset(next(_ids), tuple(names.items()), tuple(p.keys), p.flush())
            return (context if keep else context.without(removed)).plus(found)
        cols = self._direct_columns(f)
        tables = {t for t, _ in cols}
        if not cols or len(tables) > 1:
            raise DaxError("a filter is a condition on columns of one table, or a table")
        table = tables.pop()
        view = ScanRows(self.scan(table, Context()), None)
        try:
            v = self.scalar(f, replace(env, rows=view, scope=view, live=True, context=Context()))
            found = Pred(frozenset(cols), _identity(f, flag(v)), flag(v))
        except (Impure, DaxError):
            found = self._asked_filter(f, table, cols, env)
        return (context if keep else context.without(cols)).plus(found)

    def _direct_columns(self, n) -> set[Col]:
        """The model columns that a condition tests itself, not inside an aggregate or a table."""
        if not isinstance(n, (tuple, list)) or not n:
            return set()
        if n[0] == "col":
            return {self.col(n)}
        if n[0] == "call" and n[1] not in self.scalars:
            return set()
        if n[0] == "bin" and n[1] == "in":
            return self._direct_columns(n[2])
        return set().union(*[self._direct_columns(x) for x in n if isinstance(x, (tuple, list))])

    def _asked_filter(self, f: Node, table: str, cols: set[Col], env: Env) -> Rowset:
        """A condition whose other side depends on the outer context: the column's values joined with the value asked for."""
        out = [Out("", fresh(), self.kind(*c), c) for c in sorted(cols)]
        values = self.frame(table).select(*[F.col(physical(*o.col)).alias(o.name) for o in out]).distinct()
        home = Rows(values, out, [], env.rows, env.scope)
        v = self.scalar(f, replace(env, rows=home, scope=home, live=False))
        df = home.flush().where(flag(v))
        return Rowset(next(_ids), tuple((o.col, o.name) for o in out), tuple(home.keys), df)

    def _filter_pred(self, f: Node, context: Context, env: Env, keep: bool) -> Context | None:
        """FILTER over a bare table or over ALL, with a condition on its own columns, is a condition on the context."""
        base, cond = f[2]
        if base[0] == "call" and base[1] == "ALL" and base[2]:
            removed = self._columns_of(base[2])
        elif base[0] == "name" and base[1].lower() not in env.variables and self.model.table(base[1]):
            removed = set()
        elif base[0] == "call" and base[1] == "VALUES" and base[2][0][0] == "col":
            removed = set()
        else:
            return None
        cols = self._direct_columns(cond)
        if len({t for t, _ in cols}) != 1 or calls(cond) - set(self.scalars):
            return None
        table = next(iter(cols))[0]
        view = ScanRows(self.scan(table, Context()), None)
        try:
            v = self.scalar(cond, replace(env, rows=view, scope=view, live=True, context=Context()))
        except (Impure, DaxError):
            return None
        return (context if keep else context.without(removed)).plus(Pred(frozenset(cols), _identity(cond, flag(v)), flag(v)))

    # Tables

    def table(self, n: Node, env: Env, scan: bool = False):
        """Rows of a table expression; with ``scan`` a bare or filtered model table may stay a scan."""
        got = self._table(n, env)
        return self.whole(got, env) if isinstance(got, Scan) and not scan else got

    def _table(self, n: Node, env: Env):
        if n[0] == "name":
            bound = env.variables.get(n[1].lower())
            if isinstance(bound, tuple) and isinstance(bound[0], Rows):
                return bound[0].copy(env.rows, env.scope)
            return self.scan(self.table_name(n[1]), env.context)
        if n[0] == "rows":
            return self._rows(n[1], env)
        if n[0] == "var":
            return self._table(n[2], self._bind(n[1], env))
        if n[0] != "call" or n[1] not in _TABLES:
            raise DaxError(f"{n[:2]} is no table")
        return getattr(self, _TABLES[n[1]])(n[1], n[2], env)

    def _rows(self, lines: list[list[Node]], env: Env) -> Rows:
        if not lines:
            raise DaxError("a table needs a row")
        home = Rows(self.spark.range(1).select(F.lit(1).alias(fresh())), [], [], env.rows, env.scope)
        values = [[self.scalar(c, replace(env, rows=home)) for c in r] for r in lines]
        home.flush()
        kinds = [common(*[r[k].kind for r in values]) for k in range(len(lines[0]))]
        names = [fresh() for _ in kinds]
        pick = lambda v, k: num(v) if k == "num" else v.col
        made = F.explode(F.array(*[F.struct(*[pick(v, k).alias(x) for v, k, x in zip(r, kinds, names, strict=True)]) for r in values]))
        df = home.df.select(*home.keys, made.alias("__r")).select(*home.keys, *[F.col(f"__r.{x}").alias(x) for x in names])
        shown = ["Value"] if len(names) == 1 else [f"Value{k + 1}" for k in range(len(names))]
        return Rows(df, [Out(s, x, k) for s, x, k in zip(shown, names, kinds, strict=True)], home.keys, env.rows, env.scope)

    def _t_filter(self, f: str, args: list[Node], env: Env):
        base = self.table(args[0], env, scan=True)
        if isinstance(base, Scan):
            view = ScanRows(base, env.scope)
            try:
                v = self.scalar(args[1], replace(env, rows=view, scope=view, live=True))
                return base.filtered(_identity(args[1], flag(v)), flag(v), view.used)
            except Impure:
                base = self.whole(base, env)
        v = self.scalar(args[1], replace(env, rows=base, scope=base, live=True))
        base.df = base.flush().where(flag(v))
        return base

    def _distinct_cols(self, scan: Scan, cols: list[Col], env: Env, blank: bool) -> Rows:
        df, keys = scan.plan({t for t, _ in cols} - {scan.table})
        out = [Out(self.shown(*c), fresh(), self.kind(*c), c) for c in cols]
        df = df.select(*[F.col(physical(*o.col)).alias(o.name) for o in out], *[F.col(p).alias(k) for k, p in keys.items()])
        if blank:
            df = df.unionByName(self.spark.range(1).select(*[F.lit(None).cast(t).alias(c) for c, t in df.dtypes]))
        return Rows(df.distinct(), out, list(keys), env.rows, env.scope)

    def _t_values(self, f: str, args: list[Node], env: Env):
        n = args[0]
        if n[0] == "col":
            col = self.col(n)
            p = self._distinct_cols(self.scan(col[0], env.context), [col], env, f == "VALUES" and self._blank_member(col[0], env.context))
            if f == "DISTINCT":
                p.df = p.df.where(F.col(p.out[0].name).isNotNull())
            return p
        p = self.table(n, env)
        p.df = p.flush().select(*p.keys, *[o.name for o in p.out]).distinct()
        if f == "VALUES" and n[0] == "name" and self.model.table(n[1]) and self._blank_member(self.table_name(n[1]), env.context):
            p.df = p.df.unionByName(self.spark.range(1).select(*[F.lit(None).cast(t).alias(c) for c, t in p.df.dtypes]))
        if f == "DISTINCT":
            p.df = p.df.where(F.coalesce(*[F.col(o.name).cast("string") for o in p.out]).isNotNull())
        return p

    def _t_all(self, f: str, args: list[Node], env: Env):
        bare = Context(relations=env.context.relations)
        if f == "ALLSELECTED":
            bare = env.context.visual or env.context
        if not args:
            raise DaxError(f"{f} needs a table or columns here")
        if f == "ALLEXCEPT" or args[0][0] == "name":
            t = self.table_name(args[0][1])
            s = self.scan(t, bare)
            if f == "ALL" and self.model.is_one_side(t):
                p = self.whole(s, env)
                p.df = p.df.unionByName(self.spark.range(1).select(*[F.lit(None).cast(k).alias(c) for c, k in p.df.dtypes]))
                return p
            return s
        cols = [self.col(a) for a in args]
        if len({t for t, _ in cols}) > 1:
            raise DaxError(f"the columns of {f} are of one table")
        return self._distinct_cols(self.scan(cols[0][0], bare), cols, env, f == "ALL" and self.model.is_one_side(cols[0][0]))

    def _t_keep(self, f: str, args: list[Node], env: Env):
        return self._table(args[0], env)

    def _t_modifier(self, f: str, args: list[Node], env: Env):
        raise DaxError(f"{f} only changes the filters of CALCULATE")

    def _t_calculate(self, f: str, args: list[Node], env: Env):
        return self._table(args[0], self.calculate(args[1:], env))

    def _t_related(self, f: str, args: list[Node], env: Env):
        return self._table(args[0], self._transition(env))

    def _aligned(self, args: list[Node], env: Env) -> list[Rows]:
        ps = [self.table(a, env) for a in args]
        for p in ps:
            p.flush()
        if len({len(p.out) for p in ps}) > 1:
            raise DaxError("the tables have different numbers of columns")
        keys = list(dict.fromkeys(k for p in ps for k in p.keys))
        for p in ps:
            p.pull(keys)
        return ps

    def _t_union(self, f: str, args: list[Node], env: Env):
        ps = self._aligned(args, env)
        first = ps[0]
        df = first.df.select(*first.keys, *[o.name for o in first.out])
        for p in ps[1:]:
            df = df.unionByName(p.df.select(*first.keys, *[F.col(o.name).alias(x.name) for o, x in zip(p.out, first.out, strict=True)]))
        kinds = [common(*[p.out[k].kind for p in ps]) for k in range(len(first.out))]
        return Rows(df, [replace(o, kind=k, col=o.col if all(p.out[j].col == o.col for p in ps) else None) for j, (o, k) in enumerate(zip(first.out, kinds, strict=True))], first.keys, env.rows, env.scope)

    def _t_semi(self, f: str, args: list[Node], env: Env):
        a, b = self._aligned(args, env)
        other = {n: fresh() for n in [*b.keys, *[o.name for o in b.out]]}
        right = b.df.select(*[F.col(n).alias(x) for n, x in other.items()])
        cond = functools.reduce(lambda x, y: x & y, [F.col(o.name).eqNullSafe(F.col(other[x.name])) for o, x in zip(a.out, b.out, strict=True)] + [F.col(k).eqNullSafe(F.col(other[k])) for k in b.keys])
        return Rows(a.df.join(right, cond, "left_anti" if f == "EXCEPT" else "left_semi"), a.out, a.keys, env.rows, env.scope)

    def _t_natural(self, f: str, args: list[Node], env: Env):
        a, b = (self.table(x, env) for x in args)
        a.flush(), b.flush()
        mine = {o.shown.lower(): o for o in a.out}
        shared = [(mine[o.shown.lower()], o) for o in b.out if o.shown.lower() in mine]
        if not shared:
            raise DaxError("the tables share no column")
        other = {n: fresh() for n in [*[o.name for o in b.out], *b.keys]}
        cond = functools.reduce(lambda x, y: x & y, [F.col(x.name).eqNullSafe(F.col(other[y.name])) for x, y in shared] + [F.col(k).eqNullSafe(F.col(other[k])) for k in b.keys if k in a.keys])
        df = a.df.join(b.df.select(*[F.col(n).alias(x) for n, x in other.items()]), cond, "left" if f == "NATURALLEFTOUTERJOIN" else "inner")
        gone = {o.name for _, o in shared}
        more = [k for k in b.keys if k not in a.keys]
        df = df.withColumnsRenamed({other[k]: k for k in more})
        return Rows(df, a.out + [replace(o, name=other[o.name]) for o in b.out if o.name not in gone], a.keys + more, env.rows, env.scope)

    def _t_row(self, f: str, args: list[Node], env: Env):
        home = Rows(self.spark.range(1).select(F.lit(1).alias(fresh())), [], [], env.rows, env.scope)
        vs = [(a[1], self.scalar(b, replace(env, rows=home))) for a, b in zip(args[::2], args[1::2], strict=True)]
        home.out = [home.add(s, v.col, v.kind) for s, v in vs]
        return home

    def _pairs(self, args: list[Node], what: str) -> list[tuple[str, Node]]:
        if len(args) % 2 or any(a[0] != "lit" or not isinstance(a[1], str) for a in args[::2]):
            raise DaxError(f"{what} takes pairs of a name and an expression")
        return [(a[1], b) for a, b in zip(args[::2], args[1::2], strict=True)]

    def _extend(self, p: Rows, pairs: list[tuple[str, Node]], env: Env) -> list[Out]:
        inner = replace(env, rows=p, scope=p, live=True)
        vs = [(s, self.scalar(e, inner), e) for s, e in pairs]
        p.flush()
        return [p.add(s, v.col, v.kind) for s, v, _ in vs]

    def _t_add(self, f: str, args: list[Node], env: Env):
        p = self.table(args[0], env)
        made = self._extend(p, self._pairs(args[1:], f), env)
        if f == "ADDCOLUMNS":
            p.out = p.out + made
            return p
        return Rows(p.df.select(*p.keys, *[o.name for o in made]), made, p.keys, env.rows, env.scope)

    def _order(self, p: Rows, args: list[Node], env: Env) -> list[Column]:
        inner = replace(env, rows=p, scope=p, live=True)
        out, k = [], 0
        vs = []
        while k < len(args):
            v = self.scalar(args[k], inner)
            asc = False
            if k + 1 < len(args) and (args[k + 1][0] == "name" and args[k + 1][1].upper() in ("ASC", "DESC") or args[k + 1] in (("lit", 0), ("lit", 1))):
                asc = args[k + 1][1] == 1 or str(args[k + 1][1]).upper() == "ASC"
                k += 1
            vs.append((v, asc))
            k += 1
        p.flush()
        for v, asc in vs:
            out.append(v.col.asc_nulls_first() if asc else v.col.desc_nulls_first())  # blanks first both ways, as in ORDER BY
        return out

    def _count_arg(self, n: Node, env: Env) -> int:
        """A number of rows: a literal, or an expression of one value that is asked for while the query is compiled."""
        home = Rows(self.spark.range(1).select(F.lit(1).alias(fresh())), [], [], env.rows)
        v = self.scalar(n, replace(env, rows=home, live=False))
        got = v.const
        if got is None:
            o = home.add("", v.col, v.kind)
            found = home.df.select(o.name).limit(2).collect()
            if len(found) != 1:
                raise DaxError("the number of rows must be one value for all rows")
            got = found[0][0]
        if isinstance(got, bool) or not isinstance(got, (int, float)) or got < 0:
            raise DaxError("the number of rows must be a number from 0")
        return int(got)

    def _numbered(self, df: DataFrame, order: list[Column], rank: str, size: str | None = None) -> DataFrame:
        """Each row's place in the order, from 0, and how many there are: counted by range partitions, so that no task holds all rows."""
        at = fresh()
        held = df.orderBy(*order).withColumn(at, F.monotonically_increasing_id()).persist()
        self.held.append(held)
        part, n, before = fresh(), fresh(), fresh()
        counts = held.groupBy(F.shiftright(at, 33).alias(part)).agg(F.count(F.lit(1)).alias(n))  # a row for each partition
        counts = counts.select(part, (F.sum(n).over(Window.orderBy(part)) - F.col(n)).alias(before), F.sum(n).over(Window.partitionBy()).alias(size or n))
        out = held.join(F.broadcast(counts), F.shiftright(at, 33) == F.col(part)).withColumn(rank, F.col(before) + F.col(at).bitwiseAND(F.lit((1 << 33) - 1)))
        return out.drop(at, part, before, *([] if size else [n]))

    def release(self) -> None:
        """Free what the results so far keep for the places of rows; they compute it again if they are read later."""
        for df in self.held:
            df.unpersist()
        self.held.clear()

    def _t_topn(self, f: str, args: list[Node], env: Env):
        """The first n rows, ties cut at n; one a group where the rows belong to groups."""
        n, p = self._count_arg(args[0], env), self.table(args[1], env)
        order = self._order(p, args[2:], env)
        if p.keys:
            rn = fresh()
            p.df = p.df.withColumn(rn, F.row_number().over(Window.partitionBy(*p.keys).orderBy(*(order or [F.lit(1)])))).where(F.col(rn) <= n).drop(rn)
        else:
            p.df = (p.df.orderBy(*order) if order else p.df).limit(n)
            p.few = n <= FEW
        return p

    def _t_sample(self, f: str, args: list[Node], env: Env):
        """n evenly spaced rows of the order, the first and the last among them."""
        n, p = self._count_arg(args[0], env), self.table(args[1], env)
        order = self._order(p, args[2:], env) or [F.lit(1).asc()]
        rn, size = fresh(), fresh()
        if p.keys:
            numbered = p.df.select("*", (F.row_number().over(Window.partitionBy(*p.keys).orderBy(*order)) - 1).alias(rn), F.count(F.lit(1)).over(Window.partitionBy(*p.keys)).alias(size))
        else:
            numbered = self._numbered(p.df, order, rn, size)
        # row k of h is picked where it is floor(i * (h - 1) / (n - 1)) for some i
        h, k = F.col(size), F.col(rn)
        i = F.ceil(k * (n - 1) / F.greatest(h - 1, F.lit(1)))
        picked = (h <= n) | ((i <= n - 1) & (F.floor(i * (h - 1) / max(n - 1, 1)) == k)) if n > 1 else k < n
        p.df = numbered.where(picked).drop(rn, size)
        return p

    def _t_index(self, f: str, args: list[Node], env: Env):
        """SUBSTITUTEWITHINDEX: columns shared with the index table give way to the row's place in its order."""
        p, idx = self.table(args[0], env), self.table(args[2], env)
        p.flush()
        order = self._order(idx, args[3:], env)
        shared = [(o, x) for o in p.out for x in idx.out if o.shown.lower() == x.shown.lower()]
        if not shared:
            raise DaxError("the tables share no column")
        names = {x.name: fresh() for _, x in shared}
        place = fresh()
        if idx.few:
            ranked = idx.df.withColumn(place, (F.row_number().over(Window.orderBy(*order)) - 1).cast("bigint"))  # as many rows as TOPN lets through
        else:
            ranked = self._numbered(idx.df, order, place)
        ranked = ranked.select(*[F.col(n).alias(a) for n, a in names.items()], place)
        cond = functools.reduce(lambda x, y: x & y, [F.col(o.name).eqNullSafe(F.col(names[x.name])) for o, x in shared])
        gone = {o.name for o, _ in shared}
        return Rows(p.df.join(ranked, cond, "inner").drop(*names.values()), [o for o in p.out if o.name not in gone] + [Out(args[1][1], place, "int")], p.keys, env.rows, env.scope)

    def _t_cross(self, f: str, args: list[Node], env: Env):
        ps = [self.table(a, env) for a in args]
        out, df, keys = [], None, []
        for p in ps:
            p.flush()
            both = [k for k in p.keys if k in keys]
            if {o.shown.lower() for o in p.out} & {o.shown.lower() for o in out}:
                raise DaxError("a column name occurs twice")
            if df is None:
                df = p.df
            elif both:
                other = {k: fresh() for k in both}
                df = df.join(p.df.withColumnsRenamed(other), functools.reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(other[k])) for k in both])).drop(*other.values())
            else:
                df = df.crossJoin(p.df)
            out, keys = out + p.out, list(dict.fromkeys(keys + p.keys))
        return Rows(df, out, keys, env.rows, env.scope)

    def _t_generate(self, f: str, args: list[Node], env: Env):
        """Each row with its rows of the second table, which are joined over the columns they depend on, not looped."""
        a = self.table(args[0], env)
        a.flush()
        b = self.table(args[1], replace(env, rows=a, scope=a, live=True))
        b.flush()
        if {o.shown.lower() for o in a.out} & {o.shown.lower() for o in b.out}:
            raise DaxError("a column name occurs twice")
        a.flush()
        other = {k: fresh() for k in b.keys}
        right = b.df.select(*[F.col(k).alias(x) for k, x in other.items()], *[o.name for o in b.out])
        how = "left" if f == "GENERATEALL" else "inner"
        if other:
            a.pull(list(other))
            df = a.df.join(right, functools.reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(x)) for k, x in other.items()]), how).drop(*other.values())
        else:
            df = a.df.join(right, F.lit(True), how)
        return Rows(df, a.out + b.out, a.keys, env.rows, env.scope)

    def _t_groupby(self, f: str, args: list[Node], env: Env):
        p = self.table(args[0], env)
        cols = list(itertools.takewhile(lambda a: a[0] in ("col", "ref"), args[1:]))
        outs = []
        for c in cols:
            o = p.cols.get(self.col(c)) if c[0] == "col" and self.model.column(*c[1:3]) else p.named(c[-1])
            if not o and c[0] == "col":
                o = self._join_related(p, self.col(c), env.context)
            if not o:
                raise DaxError(f"GROUPBY lacks {c}")
            outs.append(o)
        aggs: list[Column] = []
        vs = [(s, self.scalar(e, replace(env, rows=p, scope=p, live=False, group=aggs))) for s, e in self._pairs(args[1 + len(cols) :], f)]
        df = p.flush()
        names = [*p.keys, *[o.name for o in outs]]
        df = (df.groupBy(*names).agg(*aggs) if names else df.agg(*aggs)) if aggs else df.select(*names).distinct()
        out = Rows(df, [*outs], p.keys, env.rows, env.scope)
        out.out = outs + [out.add(s, v.col, v.kind) for s, v in vs]
        return out

    def _t_treatas(self, f: str, args: list[Node], env: Env):
        p = self.table(args[0], env)
        cols = [self.col(a) for a in args[1:]]
        if len(cols) != len(p.out):
            raise DaxError("TREATAS needs a column for each of the table's")
        df = p.flush()
        out = [Out(self.shown(*c), fresh(), self.kind(*c), c) for c in cols]
        df = df.select(*p.keys, *[F.col(o.name).cast(TYPES[self.model.column(*c).data_type]).alias(x.name) for o, x, c in zip(p.out, out, cols, strict=True)])
        return Rows(df.distinct(), out, p.keys, env.rows, env.scope)

    def _t_current(self, f: str, args: list[Node], env: Env):
        raise DaxError("CURRENTGROUP stands only as the table of an iterator in GROUPBY")

    # Grouping

    def _t_summarize(self, f: str, args: list[Node], env: Env):
        cols, rolled, rest = [], [], list(args[1:])
        while rest and (rest[0][0] in ("col", "ref") or rest[0][0] == "call" and rest[0][1] == "ROLLUP"):
            n = rest.pop(0)
            if n[0] == "call":
                rolled += [self.col(c) for c in n[2]]
            else:  # a column of the table that the model does not know goes by its name
                cols.append(self.col(n) if n[0] == "col" and self.model.column(*n[1:3]) else n[-1])
        pairs = self._pairs(rest, f)
        levels = [(cols + rolled[:k], frozenset(rolled[k:])) for k in range(len(rolled), -1, -1)]
        done: set[int] = set()
        parts = []
        if rolled and not any(isinstance(c, str) for c in cols):
            base = self.table(args[0], env, scan=True)
            if isinstance(base, Scan) and not base.sets and not base.keys:
                context = self._base_context(args[0], base, env)
                self._reachable(base, cols + rolled)
                outs = {c: Out(self.shown(*c), fresh(), self.kind(*c), c) for c in cols + rolled}
                sets = [GroupingSet(x, r, context.with_keys([Key(c, outs[c].name) for c in x], grouping=True), base if x else None) for x, r in levels]
                rows, done = self._fused(sets, outs, [(n, e, False) for n, e in pairs], [], env)
                if rows:
                    rows.df = rows.df.where(F.coalesce(*[F.col(o.name).cast("string") for o in outs.values()]).isNotNull())
                    parts.append(rows)
        parts += [self._summarized(args[0], x, r, pairs, env) for k, (x, r) in enumerate(levels) if k not in done]
        return self._stack(parts, cols + rolled, env) if len(parts) > 1 else parts[0]

    @staticmethod
    def _reachable(base: Scan, cols: list[Col]) -> None:
        for c in cols:
            if c[0] not in base.paths:
                raise DaxError(f"nothing leads from {base.table} to {c[0]}")

    @staticmethod
    def _base_context(table: Node, base: Scan, env: Env) -> Context:
        """What the expressions of SUMMARIZE see besides their group: the conditions of a filtered table."""
        if table[0] == "name":
            return env.context
        own = [Pred(frozenset({(base.table, "")}), k, c) for k, c in base.preds.items() if not any(isinstance(x, Pred) and x.text == k for x in env.context.filters)]
        return env.context.plus(*own)

    def _summarized(self, table: Node, cols: list[Col | str], rolled: frozenset[Col], pairs: list, env: Env) -> Rows:
        base = self.table(table, env, scan=True)
        if isinstance(base, Scan) and any(isinstance(c, str) for c in cols):
            base = self.whole(base, env)
        out = []
        context = env.context
        if isinstance(base, Scan):
            out = [Out(self.shown(*c), fresh(), self.kind(*c), c) for c in cols]
            self._reachable(base, cols)
            keyed = base.filtered("", F.lit(True), {c[0] for c in cols} - {base.table})
            del keyed.preds[""]
            keyed.keys = {**base.keys, **{o.name: physical(*o.col) for o in out}}
            rows = Rows(None, out, list(base.keys), env.rows, env.scope, keyed) if out or base.keys else Rows(self.spark.range(1).select(F.lit(1).alias(fresh())), [], [], env.rows, env.scope)
            context = self._base_context(table, base, env)
        else:
            for c in cols:
                have = base.named(c) if isinstance(c, str) else base.cols.get(c) or self._join_related(base, c, context)
                if not have:
                    raise DaxError(f"nothing leads to {c if isinstance(c, str) else self.shown(*c)}")
                out.append(Out(have.shown if isinstance(c, str) else self.shown(*c), fresh(), have.kind, have.col))
                base.df = base.flush().withColumn(out[-1].name, F.col(have.name))
            rows = Rows(base.flush().select(*base.keys, *[o.name for o in out]).distinct(), out, base.keys, env.rows, env.scope)
            names = {o.col: o.name for o in base.out if o.col}
            if names and pairs:
                context = context.without(set(names)).plus(Rowset(next(_ids), tuple(names.items()), tuple(base.keys), base.df))
        context = context.with_keys([Key(o.col, o.name) for o in out if o.col], grouping=True)
        inner = replace(env, context=context, rows=rows, scope=None, live=False, rolled=rolled, axes=frozenset(o.col for o in out if o.col))
        vs = [(s, self.scalar(e, inner)) for s, e in pairs]
        rows.flush()
        if out and all(o.col for o in out):
            rows.df = rows.df.where(F.coalesce(*[F.col(o.name).cast("string") for o in out]).isNotNull())
        rows.out = out + [rows.add(s, v.col, v.kind) for s, v in vs]
        return rows

    def _fused(self, sets: list[GroupingSet], outs: dict[Col, Out], pairs: list[tuple[str, Node, bool]], flags: list, env: Env) -> tuple[Rows | None, set[int]]:
        """The grouping sets that one pass over one scan can answer, as one table, and which they are.

        The scan is the one that the groups of the first set come from, or the one that its measures sum.
        Aggregates that a set asks for under other keys than its own, or over other rows, come from one more
        pass for each way in which they differ. A set whose groups would come from another table than the
        scan, or the grand total, is in only if all that is tested is blank where the scan has no rows.
        """
        ready: list[tuple[int, GroupingSet, Level, list[Val]]] = []
        for k, one in enumerate(sets):
            rows = Level([outs[c] for c in one.cols], env.scope)
            inner = replace(env, context=one.context, rows=rows, scope=None, live=False, rolled=one.rolled, axes=frozenset(one.cols))
            try:
                ready.append((k, one, rows, [self.scalar(e, inner) for _, e, _ in pairs]))
            except Unfused:
                continue
        if not ready or ready[0][0]:
            return None, set()
        levels: list[tuple[int, GroupingSet, Level, list[Val]]] = []
        main = None
        asked = [r.scan for r in ready[0][2].pending if isinstance(r, Request)]
        summed = [replace(s, preds={k: c for k, c in s.preds.items() if all(k in x.preds for x in asked if x.source() == s.source())}) for s in asked[:1]]
        for scan, least in [(sets[0].spine, 2), *[(s, 1) for s in summed]]:
            if scan is None or any(x.keys for x in scan.sets):
                continue
            fit = [x for x in ready if self._fits(scan, x[1], outs, x[2], [(v, t) for v, (_, _, t) in zip(x[3], pairs, strict=True)])]
            if len(fit) >= least and not fit[0][0] and len(fit) > len(levels):
                levels, main = fit, scan
        if main is None:
            return None, set()
        cols = list(sets[0].cols)
        names = [outs[c].name for c in cols]
        level = fresh("g")
        number = {k: sum(1 << (len(cols) - 1 - j) for j, c in enumerate(cols) if c not in one.cols) for k, one, _, _ in levels}
        own, other = [], []  # requests over the set's own keys, and groups of others by source and keys
        for k, one, rows, _ in levels:
            keys = {outs[c].name for c in one.cols}
            for r in rows.pending:
                if r.scan.source() == main.source() and set(r.scan.keys) == keys and set(main.preds) <= set(r.scan.preds):
                    own.append((k, r))
                    continue
                asked = frozenset(r.scan.keys)
                home = next((g for g in other if g[0] == r.scan.source() and g[1].get(k, asked) == asked), None)
                if not home:
                    home = (r.scan.source(), {}, [])
                    other.append(home)
                home[1][k] = asked
                home[2].append((k, r))
        df, where = main.grouping_sets([r for _, r in own], set(main.preds), {outs[c].name: c for c in cols}, [[outs[c].name for c in one.cols] for _, one, _, _ in levels], level)
        for _, asked, requests in other:
            df, more = self._join_sets(df, level, number, asked, [r for _, r in requests], {outs[c].name: c for c in cols})
            where |= more
        df = df.select("*", *[F.col(a).alias(m) for m, a in where.items()])
        at = lambda k: F.col(level) == number[k]
        for k, _, rows, _ in levels:
            for name, col in rows.made:
                df = df.withColumn(name, F.when(at(k), col))
        made = []
        for j, (shown, _, _) in enumerate(pairs):
            kind = common(*[vs[j].kind for _, _, _, vs in levels])
            col = None
            for k, _, _, vs in levels:
                one = num(vs[j]) if kind == "num" else vs[j].col
                col = F.when(at(k), one) if col is None else col.when(at(k), one)
            made.append((Out(shown, fresh(), kind), col))
        made += [(Out(shown, fresh(), "bool"), F.col(level).isin([number[k] for k, one, _, _ in levels if any(c in one.rolled for c in its)])) for shown, its in flags]
        df = df.select(*names, *[c.alias(o.name) for o, c in made])
        tested = [o for (o, _), (_, _, t) in zip(made, pairs, strict=False) if t]
        if tested and not any(o.kind == "bool" for o in tested):
            df = df.where(F.coalesce(*[F.col(o.name).cast("string") for o in tested]).isNotNull())
        return Rows(df, [outs[c] for c in cols] + [o for o, _ in made], [], env.rows, env.scope), {k for k, _, _, _ in levels}

    def _fits(self, main: Scan, one: GroupingSet, outs: dict[Col, Out], rows: Level, vs: list[tuple[Val, bool]]) -> bool:
        asked = rows.pending
        if not all(isinstance(r, Request) for r in asked) or any(x.keys for r in asked for x in r.scan.sets):
            return False
        if one.spine and one.spine.source() == main.source():
            return set(one.spine.preds) == set(main.preds)
        keys = {outs[c].name for c in one.cols}
        if rows.reads or not all(r.scan.source() == main.source() and set(r.scan.keys) == keys and set(main.preds) <= set(r.scan.preds) for r in asked):
            return False
        tested = [v for v, t in vs if t]
        if not asked or not tested or any(v.kind == "bool" for v in tested):
            return False
        names = {r.name: f"r{k}" for k, r in enumerate(asked)} | {n: f"v{k}" for k, (n, _) in enumerate(rows.made)}
        plain = re.compile("|".join(rf"\b{n}\b" for n in names))
        same = tuple(plain.sub(lambda m: names[m[0]], str(c)) for c in [*(c for _, c in rows.made), *(v.col for v in tested)])
        if same not in self._blanks:
            try:  # a table of one row given in the query is folded by the optimizer: no job runs
                df = self.spark.sql(f"SELECT * FROM VALUES ({', '.join(['NULL'] * len(asked))}) t({', '.join(r.name for r in asked)})")
                for name, col in rows.made:
                    df = df.withColumn(name, col)
                self._blanks[same] = all(x is None for x in df.select(*[v.col for v in tested]).first())
            except PySparkException:  # of another type than the blanks tried, or an error of the measure itself
                self._blanks[same] = False
        return self._blanks[same]

    def _join_sets(self, df: DataFrame, level: str, number: dict[int, int], asked: dict[int, frozenset[str]], requests: list[Request], keys: dict[str, Col]) -> tuple[DataFrame, dict[str, str]]:
        """Join aggregates that the sets ``asked`` for under keys of their own, made in one pass for all of them."""
        used = {n: c for n, c in keys.items() if any(n in q for q in asked.values())}
        sets = sorted({tuple(n for n in used if n in q) for q in asked.values()})
        code = {q: sum(1 << (len(used) - 1 - j) for j, n in enumerate(used) if n not in q) for q in sets}
        shared = set.intersection(*[set(r.scan.preds) for r in requests])
        other, want = fresh("g"), fresh("w")
        right, where = requests[0].scan.grouping_sets(requests, shared, used, [list(q) for q in sets], other)
        if not used:
            return df.crossJoin(F.broadcast(right.drop(other))), where  # one row
        renamed = {n: fresh("k") for n in used}
        right = right.withColumnsRenamed(renamed)
        which = None
        for k, q in asked.items():
            one = F.lit(code[tuple(n for n in used if n in q)]).cast("long")
            which = F.when(F.col(level) == number[k], one) if which is None else which.when(F.col(level) == number[k], one)
        cond = F.col(want) == F.col(other)
        for n, x in renamed.items():
            of = [number[k] for k, q in asked.items() if n in q]
            cond = cond & F.when(F.col(level).isin(of), F.col(n)).eqNullSafe(F.col(x))
        return df.withColumn(want, which).join(right, cond, "left").drop(want, other, *renamed.values()), where

    def _stack(self, parts: list[Rows], cols: list[Col], env: Env) -> Rows:
        """Detail and subtotal rows in one table; a column that a part lacks is blank there."""
        first = parts[0]
        by = {o.col or o.shown: o for o in first.out}
        kinds = {k: common(*[x.kind for p in parts for x in p.out if (x.col or x.shown) == k]) for k in by}
        df, types = None, dict(first.df.dtypes)
        for p in parts:
            have = {o.col or o.shown: o for o in p.out}
            sel = [F.col(have[k].name).cast("double" if kinds[k] == "num" else types[o.name]).alias(o.name) if k in have else F.lit(None).cast(types[o.name]).alias(o.name) for k, o in by.items()]
            one = p.df.select(*first.keys, *sel)
            df = one if df is None else df.unionByName(one)
        return Rows(df, [replace(o, kind=kinds[k]) for k, o in by.items()], first.keys, env.rows, env.scope)

    def _axis(self, args: list[Node]) -> list[tuple[list[Col], str | None]]:
        steps, k = [], 0
        while k < len(args):
            n = args[k]
            cols = [self.col(c) for c in n[2]] if n[0] == "call" and n[1] == "ROLLUPGROUP" else [self.col(n)]
            k += 1
            name = None
            if k < len(args) and args[k][0] == "lit":
                name = args[k][1]
                k += 1
            steps.append((cols, name))
        return steps

    def _t_columns(self, f: str, args: list[Node], env: Env):
        """SUMMARIZECOLUMNS."""
        order: list[Col] = []
        axes, flags, filters, k = [], [], [], 0
        while k < len(args) and not (args[k][0] == "lit" and isinstance(args[k][1], str)):
            n = args[k]
            if n[0] == "col":
                order.append(self.col(n))
            elif n[0] == "call" and n[1] == "ROLLUPADDISSUBTOTAL":
                axes.append(self._axis(n[2]))
                for cols, name in axes[-1]:
                    order += cols
                    if name:
                        flags.append((name, cols))
            elif n[0] == "call" and n[1] == "ROLLUPGROUP":
                order += [self.col(c) for c in n[2]]
            else:
                filters.append(n)
            k += 1
        pairs = self._pairs(args[k:], f)
        context = env.context
        for n in filters:
            context = self._filter(n, context, env, True)
        rolling = {c for a in axes for cols, _ in a for c in cols}
        sets, parts, done = [], [], set()
        wide = replace(env, context=context)
        outs = {c: Out(self.shown(*c), fresh(), self.kind(*c), c) for c in order}
        for depth in itertools.product(*[range(len(a), -1, -1) for a in axes]):
            live = {c for a, d in zip(axes, depth, strict=True) for cols, _ in a[:d] for c in cols}
            cols = [c for c in order if c not in rolling or c in live]
            grouped = context.with_keys([Key(c, outs[c].name) for c in cols], grouping=True) if cols else replace(context, visual=context.visual or context)
            sets.append(GroupingSet(cols, frozenset(rolling - live), grouped, None))
        for one in sets:
            one.spine = self._spine([outs[c] for c in one.cols], wide, one.context, [e for _, e in pairs]).spine
        plain = [(s, e[2][0], False) if e[0] == "call" and e[1] == "IGNORE" else (s, e, True) for s, e in pairs]
        rows, done = self._fused(sets, outs, plain, flags, wide)
        if rows:
            parts.append(rows)
        parts += [self._columns_part(one.cols, one.rolled, flags, pairs, wide) for k, one in enumerate(sets) if k not in done]
        stacked = self._stack(parts, order, env)
        by = {o.col: o for o in stacked.out if o.col}
        named = {o.shown: o for o in stacked.out if not o.col}
        shown: list[Out] = []
        for c in order:
            shown.append(by[c])
            shown += [named[name] for name, cols in flags if cols[-1] == c]
        stacked.out = shown + [named[s] for s, _ in pairs]
        return stacked

    def _columns_part(self, cols: list[Col], rolled: frozenset[Col], flags: list, pairs: list, env: Env) -> Rows:
        out = [Out(self.shown(*c), fresh(), self.kind(*c), c) for c in cols]
        context = env.context.with_keys([Key(o.col, o.name) for o in out], grouping=True) if out else replace(env.context, visual=env.context.visual or env.context)
        rows = self._spine(out, env, context, [e for _, e in pairs])
        inner = replace(env, context=context, rows=rows, scope=None, live=False, rolled=rolled, axes=frozenset(cols))
        vs, tested = [], []
        for s, e in pairs:
            skip = e[0] == "call" and e[1] == "IGNORE"
            v = self.scalar(e[2][0] if skip else e, inner)
            vs.append((s, v))
            tested.append(not skip)
        rows.flush()
        made = [rows.add(s, v.col, v.kind) for s, v in vs]
        keep = [F.col(o.name) for o, t in zip(made, tested, strict=True) if t]
        if keep and not any(o.kind == "bool" for o, t in zip(made, tested, strict=True) if t):
            rows.df = rows.df.where(F.coalesce(*[c.cast("string") for c in keep]).isNotNull())
        made += [rows.add(name, F.lit(any(c in rolled for c in its)), "bool") for name, its in flags]
        rows.out = out + made
        return rows

    def _spine(self, out: list[Out], env: Env, context: Context, exprs: list[Node]) -> Rows:
        """The existing combinations of the group columns: of the table that reaches all of them, else of each group of columns and crossed."""
        if not out:
            return Rows(self.spark.range(1).select(F.lit(1).alias(fresh())), [], [], env.rows, env.scope)
        tables = list(dict.fromkeys(o.col[0] for o in out))
        degree = lambda t: sum(r.from_table == t and self.mode(r, context) != "off" for r in self.model.relationships)
        able = [t for t in tables if set(tables) <= set(self.paths(t, context))]
        if not able:  # a fact that the measures sum may reach them all
            used = self._facts(exprs)
            able = [t for t in used if set(tables) <= set(self.paths(t, context))]
        if able:
            s = self.scan(max(able, key=degree), context)
            return Rows(None, out, [], env.rows, env.scope, s)
        parts: list[DataFrame] = []
        left = list(tables)
        while left:
            best = max(left, key=lambda t: (len(set(left) & set(self.paths(t, context))), degree(t)))
            own = [t for t in left if t in self.paths(best, context)]
            left = [t for t in left if t not in own]
            names = {o.name for o in out if o.col[0] in own}
            kept = replace(context, filters=tuple(f for f in context.filters if not (isinstance(f, Key) and f.name not in names)))
            parts.append(self.scan(best, kept).groups())
        if len(parts) > 1 and math.prod(p.count() for p in parts) > CROSSED:  # a few numbers, asked for while the query is compiled
            raise DaxError("nothing relates the group columns, and they have too many combinations")
        return Rows(functools.reduce(DataFrame.crossJoin, parts), out, [], env.rows, env.scope)

    def _facts(self, exprs: list[Node]) -> list[str]:
        """Tables whose columns or rows the expressions name, measures looked into."""
        found: list[str] = []
        seen: set[str] = set()

        def look(n) -> None:
            if not isinstance(n, (tuple, list)) or not n:
                return
            if n[0] == "ref" and n[1].lower() in self.measures and n[1].lower() not in seen:
                seen.add(n[1].lower())
                look(self.measures[n[1].lower()])
            elif n[0] in ("col", "name") and self.model.table(n[1]) and self.table_name(n[1]) not in found:
                found.append(self.table_name(n[1]))
            for x in n:
                if isinstance(x, (tuple, list)):
                    look(x)

        look(list(exprs))
        return found

    # Queries

    def query(self, text: str) -> list[DataFrame]:
        """One DataFrame for each EVALUATE, columns named as DAX names them."""
        q = parse_query(text)
        own = copy.copy(self)  # its measures are seen by this query alone
        own.measures = self.measures | {name.lower(): body for _, name, body in q.measures}
        root = Rows(self.spark.range(1).select(F.lit(1).alias(fresh())), [])
        env = own._bind(q.variables, Env(Context(), root))
        return [own._evaluate(e, env) for e in q.evaluates]

    def _evaluate(self, e: Evaluate, env: Env) -> DataFrame:
        p = self.table(e.table, env)
        df = p.flush()
        order = []
        for n, asc in e.order:
            o = p.cols.get(self.col(n)) if n[0] == "col" and self.model.column(*n[1:3]) else p.named(n[-1]) if n[0] in ("ref", "name", "col") else None
            if not o:
                raise DaxError("ORDER BY takes columns of the result")
            order.append((o, asc))
        if e.start:
            if len(e.start) > len(order):
                raise DaxError("START AT has more values than ORDER BY has columns")
            keep, same = F.lit(False), F.lit(True)
            for k, (n, (o, asc)) in enumerate(zip(e.start, order, strict=False)):
                v = self.scalar(n, env)
                if v.const is None:
                    raise DaxError("START AT takes literals")
                c, last = F.col(o.name), k == len(e.start) - 1
                past = (c >= v.col if last else c > v.col) if asc else (c <= v.col if last else c < v.col)
                keep, same = keep | (same & past), same & (c == v.col)
            df = df.where(keep)
        if order:
            df = df.orderBy(*[F.col(o.name).asc_nulls_first() if asc else F.col(o.name).desc_nulls_first() for o, asc in order])
        return df.select(*[F.col(o.name).alias(o.shown) for o in p.out])


def _identity(n: Node, cond: Column) -> str:
    """What tells conditions apart: the text, and the compiled form, in which a variable's value stands for its name."""
    return f"{n} {cond}"


def _distinct(w, x: Column) -> Column:
    """Distinct values with null as one of them."""
    null = F.when(x.isNull(), 1)
    seen = w(F.lit(1))
    return F.count_distinct(x) + F.coalesce(F.max(F.when(seen.isNotNull(), null)), F.lit(0))


_COLUMN_AGGS = {"SUM", "COUNT", "COUNTA", "AVERAGE", "AVERAGEA", "MIN", "MAX", "MINA", "MAXA", "DISTINCTCOUNT", "HASONEVALUE"}
_TABLES = {
    "FILTER": "_t_filter", "VALUES": "_t_values", "DISTINCT": "_t_values", "ALL": "_t_all", "ALLEXCEPT": "_t_all", "ALLSELECTED": "_t_all", "KEEPFILTERS": "_t_keep", "REMOVEFILTERS": "_t_modifier", "USERELATIONSHIP": "_t_modifier", "CROSSFILTER": "_t_modifier",
    "CALCULATETABLE": "_t_calculate", "RELATEDTABLE": "_t_related", "UNION": "_t_union", "EXCEPT": "_t_semi", "INTERSECT": "_t_semi", "NATURALLEFTOUTERJOIN": "_t_natural", "NATURALINNERJOIN": "_t_natural", "ROW": "_t_row",
    "ADDCOLUMNS": "_t_add", "SELECTCOLUMNS": "_t_add", "TOPN": "_t_topn", "SAMPLE": "_t_sample", "SUBSTITUTEWITHINDEX": "_t_index", "CROSSJOIN": "_t_cross", "GENERATE": "_t_generate", "GENERATEALL": "_t_generate", "GROUPBY": "_t_groupby", "CURRENTGROUP": "_t_current",
    "TREATAS": "_t_treatas", "SUMMARIZE": "_t_summarize", "SUMMARIZECOLUMNS": "_t_columns",
}
