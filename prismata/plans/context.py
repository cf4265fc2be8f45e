"""The filter context: what is known at compile time about the rows that an expression sees."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame

Col = tuple[str, str]


@dataclass(frozen=True)
class Key:
    """A column equals the value in a named column of the rows that ask: a group or the current row."""

    col: Col
    name: str

    @property
    def cols(self) -> frozenset[Col]:
        return frozenset([self.col])


@dataclass(frozen=True)
class Pred:
    """A condition on columns of one table, over their physical names."""

    cols: frozenset[Col]
    text: str
    cond: Column = field(compare=False, hash=False)


@dataclass(frozen=True)
class Rowset:
    """Columns must equal those of a row of a DataFrame; ``keys`` are names of asking columns it depends on."""

    id: int
    names: tuple[tuple[Col, str], ...]
    keys: tuple[str, ...]
    df: DataFrame = field(compare=False, hash=False)

    @property
    def cols(self) -> frozenset[Col]:
        return frozenset(c for c, _ in self.names)


@dataclass(frozen=True)
class Context:
    filters: tuple[Key | Pred | Rowset, ...] = ()
    relations: tuple[tuple[str, str], ...] = ()  # relationship name -> off, on, oneway or both
    visual: Context | None = None  # the context before groups or rows were added

    def without(self, cols: set[Col]) -> Context:
        kept = []
        for f in self.filters:
            if isinstance(f, Rowset):
                names = tuple(x for x in f.names if x[0] not in cols)
                if names:
                    kept.append(f if names == f.names else replace(f, names=names))
            elif not f.cols <= cols:
                kept.append(f)
        return replace(self, filters=tuple(kept))

    def plus(self, *added: Key | Pred | Rowset) -> Context:
        return replace(self, filters=self.filters + tuple(a for a in added if a not in self.filters))

    def with_keys(self, keys: list[Key], grouping: bool = False) -> Context:
        """Rows replace what filters their columns; groups come from what the filters let through and stand beside them."""
        cols = {k.col for k in keys}
        base = replace(self, filters=tuple(f for f in self.filters if not (isinstance(f, Key) and f.col in cols))) if grouping else self.without(cols)
        return replace(base.plus(*keys), visual=self.visual or self)

    def relate(self, name: str, mode: str) -> Context:
        return replace(self, relations=tuple(x for x in self.relations if x[0] != name) + ((name, mode),))

    def on_table(self, table: str) -> list[Key | Pred | Rowset]:
        return [f for f in self.filters if any(t == table for t, _ in f.cols)]

    def on_column(self, col: Col) -> list[Key | Pred | Rowset]:
        return [f for f in self.filters if col in f.cols]
