"""Row sets under construction: base-table scans, rows with lineage, and the frames that are joined to them."""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from prismata.plans.context import Col, Context, Rowset
from prismata.sources import physical

_fresh = itertools.count()


def fresh(prefix: str = "c") -> str:
    return f"{prefix}{next(_fresh)}"


class Impure(Exception):
    """An expression over a scan needs rows of its own."""


@dataclass
class Out:
    """A visible column: how it is shown, its name in the plan, its kind, and where it comes from."""

    shown: str
    name: str
    kind: str
    col: Col | None = None


class Rows:
    """A DataFrame whose columns are known by lineage or by name, and what is still to be joined to it.

    ``keys`` are columns that the rows carry for whoever asked for them; ``source`` is where columns
    that are asked for but missing are pulled from (a cross join of its distinct values, which a later
    condition usually turns into an equi-join); ``parent`` is the enclosing row context.
    """

    def __init__(self, df: DataFrame | None, out: list[Out], keys: list[str] | None = None, source: Rows | None = None, parent: Rows | None = None, spine: Scan | None = None):
        self.df, self.out, self.keys, self.source, self.parent, self.spine = df, out, list(keys or []), source, parent, spine
        self.pending: list[Request | Frame] = []
        self.needs: list[str] = []
        self.few = False  # whether their number has a small bound

    @property
    def cols(self) -> dict[Col, Out]:
        return {o.col: o for o in self.out if o.col}

    def named(self, name: str) -> Out | None:
        return next((o for o in self.out if o.shown.lower() == name.lower() or o.col and o.col[1].lower() == name.lower()), None)

    def ensure(self) -> DataFrame:
        if self.df is None:
            self.df = self.spine.groups()
        return self.df

    def need(self, name: str) -> Column:
        if self.df is None or name not in self.df.columns:
            self.needs.append(name)
        return F.col(name)

    def hold(self, name: str) -> None:
        """A key that an aggregate is joined over must be at hand."""
        self.need(name)

    def pull(self, names: list[str]) -> None:
        missing = [n for n in dict.fromkeys(names) if n not in self.ensure().columns]
        if missing:
            if not self.source:
                raise Impure(f"no rows hold {missing}")
            self.source.pull(missing)
            self.df = self.df.crossJoin(self.source.ensure().select(*missing).distinct())
            self.keys += missing

    def flush(self) -> DataFrame:
        """Join all that is pending; requests over the same scan become one aggregation."""
        while self.pending or self.needs or self.df is None:
            todo, self.pending = self.pending, []
            groups: dict[tuple, list[Request]] = {}
            for r in todo:
                if isinstance(r, Request):
                    groups.setdefault(r.scan.signature(), []).append(r)
            if self.df is None and (own := groups.pop(self.spine.signature(), None)):
                apart = [r for r in own if not set(self.spine.preds) <= set(r.scan.preds)]  # they see rows that the spine's conditions drop
                if apart:
                    groups[self.spine.signature()] = apart
                if len(apart) < len(own):
                    self.df = self.spine.aggregate([r for r in own if r not in apart], self.spine)
            self.ensure()
            needs, self.needs = self.needs, []
            self.pull(needs)
            for rs in groups.values():
                scan = rs[0].scan
                self._join(scan.aggregate(rs, None), list(scan.keys), [r.name for r in rs])
            for f in todo:
                if isinstance(f, Frame):
                    self._join(f.df, f.keys, f.names)
        return self.df

    def _join(self, frame: DataFrame, keys: list[str], names: list[str]) -> None:
        if not keys:
            self.df = self.df.crossJoin(F.broadcast(frame.select(*names)))  # one row
            return
        self.pull(keys)
        other = {k: fresh("k") for k in keys}
        frame = frame.select(*[F.col(k).alias(other[k]) for k in keys], *names)
        cond = None
        for k in keys:
            one = F.col(k).eqNullSafe(F.col(other[k]))
            cond = one if cond is None else cond & one
        self.df = self.df.join(frame, cond, "left").drop(*other.values())

    def add(self, shown: str, col: Column, kind: str, lineage: Col | None = None) -> Out:
        self.flush()
        o = Out(shown, fresh(), kind, lineage)
        self.df = self.df.withColumn(o.name, col)
        return o

    def copy(self, source: Rows | None, parent: Rows | None) -> Rows:
        out = Rows(self.flush(), list(self.out), self.keys, source, parent)
        out.few = self.few
        return out


class Unfused(Exception):
    """A grouping set needs rows of its own."""


class Level(Rows):
    """The rows of one grouping set before anything is planned: what its expressions ask for is only noted."""

    def __init__(self, out: list[Out], parent: Rows | None):
        super().__init__(None, out, parent=parent)
        self.made: list[tuple[str, Column]] = []
        self.reads = False  # whether an expression looks at a group's own value

    def hold(self, name: str) -> None:
        if name not in {o.name for o in self.out}:
            raise Unfused

    def need(self, name: str) -> Column:
        if name not in {n for n, _ in self.made}:
            self.hold(name)
            self.reads = True
        return F.col(name)

    def add(self, shown: str, col: Column, kind: str, lineage: Col | None = None) -> Out:
        o = Out(shown, fresh(), kind, lineage)
        self.made.append((o.name, col))
        return o

    def flush(self) -> DataFrame:
        raise Unfused

    ensure = flush

    def pull(self, names: list[str]) -> None:
        raise Unfused


@dataclass
class Frame:
    df: DataFrame
    keys: list[str]
    names: list[str]


@dataclass
class Request:
    """One aggregate over a scan. ``agg`` gets a function that blanks its argument where the scan's own conditions fail."""

    scan: Scan
    agg: Callable[[Callable[[Column], Column]], Column]
    name: str


@dataclass
class Scan:
    """A model table seen under a context: conditions, related tables it needs, and group keys, not yet a plan."""

    engine: object
    table: str
    context: Context
    paths: dict[str, list]
    preds: dict[str, Column] = field(default_factory=dict)
    sets: list[Rowset] = field(default_factory=list)
    keys: dict[str, str] = field(default_factory=dict)  # key name -> physical name, "" where a row set brings it
    needed: set[str] = field(default_factory=set)

    def source(self) -> tuple:
        return (self.table, self.context.relations, tuple(s.id for s in self.sets), tuple(s.names for s in self.sets))

    def signature(self) -> tuple:
        return (*self.source(), tuple(sorted(self.keys.items())))

    def filtered(self, text: str, cond: Column, needed: set[str]) -> Scan:
        return Scan(self.engine, self.table, self.context, self.paths, {**self.preds, text: cond}, self.sets, dict(self.keys), self.needed | needed)

    def base(self, needed: set[str]) -> DataFrame:
        df, joined = self.engine.frame(self.table), {self.table}
        for t in sorted(needed):
            for e in self.paths[t]:
                if e.to_table not in joined:
                    df = df.join(self.engine.frame(e.to_table), F.col(physical(e.from_table, e.from_column)) == F.col(physical(e.to_table, e.to_column)), "left")
                    joined.add(e.to_table)
        return df

    def _sets(self, df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
        """The frame restricted by the row sets, and the physical name of every key."""
        keys = {k: p for k, p in self.keys.items() if p}
        for s in self.sets:
            names = {n: fresh("f") for _, n in s.names} | {k: fresh("f") for k in s.keys}
            rows = s.df.select(*[F.col(n).alias(a) for n, a in names.items()])
            cond = None
            for (t, c), n in s.names:
                one = F.col(physical(t, c)).eqNullSafe(F.col(names[n]))
                cond = one if cond is None else cond & one
            for k in s.keys:
                if k in keys:
                    cond = cond & F.col(keys[k]).eqNullSafe(F.col(names[k]))
            df = df.join(rows.distinct() if s.keys else rows, cond, "inner" if s.keys else "left_semi")
            for k in s.keys:
                keys.setdefault(k, names[k])
        return df, keys

    def plan(self, needed: set[str] | None = None) -> tuple[DataFrame, dict[str, str]]:
        df, keys = self._sets(self.base(self.needed | (needed or set())))
        for c in self.preds.values():
            df = df.where(c)
        return df, keys

    def groups(self) -> DataFrame:
        """The distinct combinations of the keys."""
        df, keys = self.plan()
        return df.select(*[F.col(p).alias(k) for k, p in keys.items()]).distinct()

    def grouping_sets(self, requests: list[Request], common: set[str], keys: dict[str, Col], sets: list[list[str]], level: str) -> tuple[DataFrame, dict[str, str]]:
        """One pass for all sets of keys: a row for each group of each set, its grouping id as ``level``; and the column of each request.

        Equal aggregates are made once. Conditions that are not ``common`` blank the arguments.
        """
        df, _ = self._sets(self.base(self.needed.union(*[r.scan.needed for r in requests], {t for t, _ in keys.values()} - {self.table})))
        every = dict(self.preds)
        for r in requests:
            every |= r.scan.preds
        for k in common:
            df = df.where(every[k])
        made: dict[str, tuple[str, Column]] = {}
        where = {}
        for r in requests:
            both = None
            for k, c in r.scan.preds.items():
                if k not in common:
                    both = c if both is None else both & c
            agg = r.agg((lambda x: x) if both is None else (lambda x, b=both: F.when(b, x)))
            where[r.name] = made.setdefault(str(agg), (fresh("a"), agg))[0]
        aggs = [c.alias(n) for n, c in made.values()]
        if not keys:
            return df.agg(F.lit(0).alias(level), *aggs), where
        df = df.select("*", *[F.col(physical(*c)).alias(k) for k, c in keys.items()])
        return df.groupingSets(sets, *keys).agg(F.grouping_id().alias(level), *aggs), where

    def aggregate(self, requests: list[Request], spine: Scan | None) -> DataFrame:
        """One pass for all requests. Conditions that not all share blank the arguments instead of dropping rows.

        With ``spine`` only its conditions drop rows, so that each of its groups stays.
        """
        scans = [r.scan for r in requests]
        needed = set().union(*[s.needed for s in scans], spine.needed if spine else set())
        common = set(spine.preds) if spine else set.intersection(*[set(s.preds) for s in scans])
        df, keys = self._sets(self.base(needed))
        every = {k: c for s in scans for k, c in s.preds.items()} | (spine.preds if spine else {})
        for k in common:
            df = df.where(every[k])
        rest = [[s.preds[k] for k in s.preds if k not in common] for s in scans]
        if not spine and all(rest):
            either = None
            for conds in rest:
                one = conds[0]
                for c in conds[1:]:
                    one = one & c
                either = one if either is None else either | one
            df = df.where(either)
        aggs = []
        for r, conds in zip(requests, rest, strict=True):
            both = None
            for c in conds:
                both = c if both is None else both & c
            wrap = (lambda x: x) if both is None else (lambda x, b=both: F.when(b, x))
            aggs.append(r.agg(wrap).alias(r.name))
        if not keys:
            return df.agg(*aggs)
        return df.select("*", *[F.col(p).alias(k) for k, p in keys.items()]).groupBy(*keys).agg(*aggs)
