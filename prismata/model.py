"""The semantic model: typed tables over Parquet files, measures, relationships; JSON form, checks, commands, lineage."""

from __future__ import annotations

import json
import re
from collections import deque
from dataclasses import asdict, dataclass, field, replace

from prismata.plans.parser import DaxError, parse_expression, references

#: Model data types and the Spark types they are read as.
TYPES = {"string": "string", "int64": "bigint", "double": "double", "decimal": "double", "boolean": "boolean", "dateTime": "timestamp_ntz", "binary": "binary"}


#: Properties of a model besides its name and description.
PROPERTIES = ("culture", "collation", "defaultMode", "compatibilityLevel")


def _data_type(name: str) -> str:
    """A data type as the model writes it; documents differ in case."""
    return next((t for t in TYPES if t.lower() == name.lower()), name)


class ModelError(ValueError):
    """A model that doesn't hold together."""


@dataclass(frozen=True)
class ColumnDef:
    name: str
    data_type: str
    source: str = ""
    hidden: bool = False
    format: str = ""
    folder: str = ""
    category: str = ""
    sort_by: str = ""
    summarize_by: str = "default"
    key: bool = False
    description: str = ""


@dataclass(frozen=True)
class Measure:
    table: str
    name: str
    expression: str
    hidden: bool = False
    format: str = ""
    folder: str = ""
    description: str = ""


@dataclass(frozen=True)
class Relationship:
    name: str
    from_table: str  # many side
    from_column: str
    to_table: str  # one side
    to_column: str
    active: bool = True
    both: bool = False


@dataclass(frozen=True)
class Table:
    name: str
    source: str  # file name below the data folder
    columns: tuple[ColumnDef, ...]
    hidden: bool = False
    description: str = ""
    category: str = ""


@dataclass
class Model:
    name: str
    tables: dict[str, Table] = field(default_factory=dict)
    measures: dict[str, Measure] = field(default_factory=dict)
    relationships: list[Relationship] = field(default_factory=list)
    description: str = ""
    properties: dict[str, str] = field(default_factory=dict)

    def table(self, name: str) -> Table | None:
        return self.tables.get(name.lower())

    def measure(self, name: str) -> Measure | None:
        return self.measures.get(name.lower())

    def column(self, table: str, name: str) -> ColumnDef | None:
        t = self.table(table)
        return next((c for c in t.columns if c.name.lower() == name.lower()), None) if t else None

    def is_one_side(self, table: str) -> bool:
        return any(r.to_table == table for r in self.relationships)

    def one_key(self, table: str) -> str | None:
        return next((r.to_column for r in self.relationships if r.to_table == table), None)

    def find_relationship(self, a: tuple[str, str], b: tuple[str, str]) -> Relationship:
        for r in self.relationships:
            ends = {(r.from_table.lower(), r.from_column.lower()), (r.to_table.lower(), r.to_column.lower())}
            if ends == {tuple(x.lower() for x in a), tuple(x.lower() for x in b)}:
                return r
        raise DaxError(f"no relationship between {a} and {b}")

    def validate(self) -> list[str]:
        """What is wrong with the model, if anything."""
        bad = []
        for t in self.tables.values():
            seen = set()
            for c in t.columns:
                if c.data_type not in TYPES:
                    bad.append(f"{t.name}[{c.name}]: type {c.data_type} is not supported")
                if c.name.lower() in seen:
                    bad.append(f"{t.name}[{c.name}] is declared twice")
                seen.add(c.name.lower())
                if c.sort_by and not self.column(t.name, c.sort_by):
                    bad.append(f"{t.name}[{c.name}] sorts by an unknown column")
        for r in self.relationships:
            ends = (self.column(r.from_table, r.from_column), self.column(r.to_table, r.to_column))
            if None in ends:
                bad.append(f"relationship {r.name} names an unknown column")
            elif TYPES.get(ends[0].data_type) != TYPES.get(ends[1].data_type):
                bad.append(f"relationship {r.name} joins different types")
            elif ends[0].data_type == "binary":
                bad.append(f"relationship {r.name} joins binary columns")
        for m in self.measures.values():
            if not self.table(m.table):
                bad.append(f"measure {m.name} belongs to an unknown table")
            try:
                parse_expression(m.expression)
            except DaxError as e:
                bad.append(f"measure {m.name}: {e}")
        return bad + [f"measures depend on each other: {' -> '.join(c)}" for c in self.cycles()]

    # Lineage

    def uses(self, measure: str) -> tuple[set[str], set[tuple[str, str]]]:
        """(measures, columns) that a measure's expression names."""
        measures, columns = set(), set()
        for table, name in references(parse_expression(self.measure(measure).expression)):
            if table and self.column(table, name):
                columns.add((self.table(table).name, self.column(table, name).name))
            elif self.measure(name):
                measures.add(self.measure(name).name)
        return measures, columns

    def cycles(self) -> list[list[str]]:
        state: dict[str, int] = {}
        found: list[list[str]] = []

        def visit(name: str, path: list[str]) -> None:
            if state.get(name) == 2:
                return
            if state.get(name) == 1:
                found.append(path[path.index(name) :] + [name])
                return
            state[name] = 1
            try:
                for other in sorted(self.uses(name)[0]):
                    visit(other, [*path, name])
            except DaxError:
                pass
            state[name] = 2

        for m in self.measures.values():
            visit(m.name, [])
        return found

    def upstream(self, measure: str) -> list[str]:
        """All measures and columns that a measure depends on, nearest first."""
        out, queue = [], deque([self.measure(measure).name])
        while queue:
            measures, columns = self.uses(queue.popleft())
            for m in sorted(measures):
                if m not in out:
                    out.append(m)
                    queue.append(m)
            out += [x for t, c in sorted(columns) if (x := f"{t}[{c}]") not in out]
        return out

    def downstream(self, name: str) -> list[str]:
        """All measures that depend on a measure or a column ``Table[Column]``, nearest first."""
        out: list[str] = []
        queue = deque([name.lower()])
        while queue:
            now = queue.popleft()
            for m in self.measures.values():
                measures, columns = self.uses(m.name)
                named = {x.lower() for x in measures} | {f"{t}[{c}]".lower() for t, c in columns}
                if now in named and m.name not in out:
                    out.append(m.name)
                    queue.append(m.name.lower())
        return out

    # JSON

    def to_json(self) -> str:
        of = lambda x: {k: v for k, v in asdict(x).items()}
        tables = []
        for t in self.tables.values():
            tables.append({
                "name": t.name, "isHidden": t.hidden, "description": t.description, "dataCategory": t.category, "partitions": [{"name": t.name, "source": {"type": "parquet", "path": t.source}}],
                "columns": [{"name": c.name, "dataType": c.data_type, "sourceColumn": c.source, "isHidden": c.hidden, "formatString": c.format, "displayFolder": c.folder, "dataCategory": c.category, "sortByColumn": c.sort_by, "summarizeBy": c.summarize_by, "isKey": c.key, "description": c.description} for c in t.columns],
                "measures": [{"name": m.name, "expression": m.expression, "isHidden": m.hidden, "formatString": m.format, "displayFolder": m.folder, "description": m.description} for m in self.measures.values() if m.table == t.name],
            })
        rels = [{"name": r["name"], "fromTable": r["from_table"], "fromColumn": r["from_column"], "toTable": r["to_table"], "toColumn": r["to_column"], "isActive": r["active"], "crossFilteringBehavior": "bothDirections" if r["both"] else "oneDirection"} for r in map(of, self.relationships)]
        return json.dumps({"name": self.name, "description": self.description, **self.properties, "model": {"tables": tables, "relationships": rels}}, indent=1)

    @classmethod
    def from_json(cls, text: str) -> Model:
        raw = json.loads(text)
        body = raw.get("model", raw)
        out = cls(raw.get("name", "Model"), description=raw.get("description") or "", properties={k: raw[k] for k in PROPERTIES if k in raw})
        for t in body.get("tables", []):
            said = lambda c, k, default="": c.get(k) or default
            cols = tuple(ColumnDef(c["name"], _data_type(c["dataType"]), said(c, "sourceColumn"), said(c, "isHidden", False), said(c, "formatString"), said(c, "displayFolder"), said(c, "dataCategory"), said(c, "sortByColumn"), said(c, "summarizeBy", "default"), said(c, "isKey", False), said(c, "description")) for c in t.get("columns", []))
            parts = t.get("partitions") or [{}]
            source = parts[0].get("source", {})
            out.tables[t["name"].lower()] = Table(t["name"], t.get("dataSource") or source.get("path") or source.get("file") or f"{t['name']}.parquet", cols, said(t, "isHidden", False), said(t, "description"), said(t, "dataCategory"))
            for m in t.get("measures", []):
                text = m["expression"]
                if m["name"].lower() in out.measures:
                    raise ModelError(f"measure {m['name']} is declared twice")
                out.measures[m["name"].lower()] = Measure(t["name"], m["name"], "\n".join(text) if isinstance(text, list) else text, m.get("isHidden", False), m.get("formatString", ""), m.get("displayFolder", ""), m.get("description", ""))
        for k, r in enumerate(body.get("relationships", [])):
            name = lambda t: out.table(t).name if out.table(t) else t
            out.relationships.append(Relationship(r.get("name", f"r{k}"), name(r["fromTable"]), r["fromColumn"], name(r["toTable"]), r["toColumn"], r.get("isActive", True), r.get("crossFilteringBehavior", "single") in ("bothDirections", "both")))
        if bad := out.validate():
            raise ModelError("; ".join(bad))
        return out

    # Commands

    def apply(self, commands: list[dict], dry_run: bool = False) -> Model:
        """The model after the commands, in order; the first that fails raises and none takes effect. With ``dry_run`` only checked."""
        new = Model(self.name, dict(self.tables), dict(self.measures), list(self.relationships), self.description, dict(self.properties))
        for c in commands:
            own = _own_command(c) if "type" in c else dict(c)
            said = own["command"]
            new._one(own)
            if bad := new.validate():
                raise ModelError(f"{said}: {'; '.join(bad)}")
        return self if dry_run else new

    def _rewrite(self, change) -> None:
        """Change the expression of every measure."""
        self.measures = {k: replace(m, expression=change(m.expression)) for k, m in self.measures.items()}

    def _one(self, c: dict) -> None:
        what = c.pop("command")
        key = lambda n: n.lower()

        def known(where: dict, name: str):
            if key(name) not in where:
                raise ModelError(f"{what}: {name} is unknown")
            return where[key(name)]

        def fresh(where: dict, name: str) -> None:
            if key(name) in where:
                raise ModelError(f"{what}: {name} exists")

        def edit_column(change) -> None:
            t = known(self.tables, c["table"])
            if not self.column(t.name, c["column"]):
                raise ModelError(f"{what}: {c['column']} is unknown")
            cols = [x for col in t.columns for x in ([change(col)] if col.name.lower() == key(c["column"]) else [col])]
            self.tables[key(t.name)] = replace(t, columns=tuple(x for x in cols if x))

        if what == "createMeasure":
            fresh(self.measures, c["name"])
            self.measures[key(c["name"])] = Measure(known(self.tables, c["table"]).name, c["name"], c["expression"], c.get("hidden", False), c.get("format", ""), c.get("folder", ""), c.get("description", ""))
        elif what == "deleteMeasure":
            known(self.measures, c["name"])
            del self.measures[key(c["name"])]
        elif what == "updateMeasure":
            m = known(self.measures, c["name"])
            self.measures[key(m.name)] = replace(m, **{k: c[k] for k in ("expression", "format", "folder", "hidden", "description") if k in c})
        elif what == "renameMeasure":
            m = known(self.measures, c["name"])
            fresh(self.measures, c["newName"])
            del self.measures[key(m.name)]
            self.measures[key(c["newName"])] = replace(m, name=c["newName"])
            bare = re.compile(rf"(?<![\w'\]])\[{re.escape(m.name)}\]", re.I)
            home = _reference(m.table, m.name)
            self._rewrite(lambda x: _outside_strings(x, lambda part: home.sub(lambda _: f"'{m.table}'[{c['newName']}]", bare.sub(lambda _: f"[{c['newName']}]", part))))
        elif what == "moveMeasure":
            m = known(self.measures, c["name"])
            self.measures[key(m.name)] = replace(m, table=known(self.tables, c["table"]).name)
        elif what == "renameModel":
            self.name = c["newName"]
        elif what == "setModelProperty":
            for k, v in c["property"].items():
                if k == "description":
                    self.description = v or ""
                elif k in PROPERTIES:
                    self.properties[k] = v
                else:
                    raise ModelError(f"{what}: {k} is unknown")
        elif what == "createTable":
            fresh(self.tables, c["name"])
            self.tables[key(c["name"])] = Table(c["name"], c.get("source") or f"{c['name']}.parquet", tuple(ColumnDef(x["name"], _data_type(x["dataType"]), x.get("sourceColumn", "")) for x in c.get("columns", [])))
        elif what == "renameTable":
            t = known(self.tables, c["table"])
            if key(c["newName"]) != key(t.name):
                fresh(self.tables, c["newName"])
            to = c["newName"]
            self.tables = {(key(to) if k == key(t.name) else k): (replace(x, name=to) if k == key(t.name) else x) for k, x in self.tables.items()}
            moved = lambda n: to if n == t.name else n
            self.measures = {k: replace(m, table=moved(m.table)) for k, m in self.measures.items()}
            self.relationships = [replace(r, from_table=moved(r.from_table), to_table=moved(r.to_table)) for r in self.relationships]
            named = re.compile(rf"'{re.escape(t.name)}'|(?<![\w'\[]){re.escape(t.name)}(?![\w'\]])(?!\s*\()", re.I)
            self._rewrite(lambda x: _outside_strings(x, lambda part: named.sub(lambda _: f"'{to}'", part), True))
        elif what == "renameColumn":
            t = known(self.tables, c["table"])
            old = self.column(t.name, c["column"])
            if old and self.column(t.name, c["newName"]) not in (None, old):
                raise ModelError(f"{what}: {c['newName']} exists")
            edit_column(lambda col: replace(col, name=c["newName"], source=col.source or col.name))
            its = lambda x, n: c["newName"] if x == t.name and n == old.name else n
            self.tables[key(t.name)] = replace(self.tables[key(t.name)], columns=tuple(replace(x, sort_by=its(t.name, x.sort_by)) for x in self.tables[key(t.name)].columns))
            self.relationships = [replace(r, from_column=its(r.from_table, r.from_column), to_column=its(r.to_table, r.to_column)) for r in self.relationships]
            named = _reference(t.name, old.name)
            self._rewrite(lambda x: _outside_strings(x, lambda part: named.sub(lambda _: f"'{t.name}'[{c['newName']}]", part)))
        elif what == "changeColumnType":
            edit_column(lambda col: replace(col, data_type=_data_type(c["dataType"])))
        elif what == "deleteTable":
            t = known(self.tables, c["name"])
            del self.tables[key(t.name)]
            self.measures = {k: m for k, m in self.measures.items() if m.table != t.name}
            self.relationships = [r for r in self.relationships if t.name not in (r.from_table, r.to_table)]
        elif what in ("hideTable", "describeTable", "setTableSource", "categorizeTable"):
            t = known(self.tables, c["name"])
            self.tables[key(t.name)] = replace(t, **{k: c[k] for k in ("hidden", "description", "source", "category") if k in c})
        elif what == "createColumn":
            t = known(self.tables, c["table"])
            self.tables[key(t.name)] = replace(t, columns=(*t.columns, ColumnDef(c["column"], _data_type(c["dataType"]), c.get("sourceColumn", ""), c.get("hidden", False), c.get("format", ""), c.get("folder", ""), summarize_by=c.get("summarize_by", "default"), key=c.get("key", False), description=c.get("description", ""))))
        elif what == "deleteColumn":
            edit_column(lambda col: None)
        elif what in ("hideColumn", "formatColumn", "sortColumn", "summarizeColumn", "categorizeColumn", "moveColumn", "describeColumn"):
            edit_column(lambda col: replace(col, **{k: c[k] for k in ("hidden", "format", "sort_by", "summarize_by", "category", "folder", "description") if k in c}))
        elif what == "createRelationship":
            self.relationships.append(Relationship(c["name"], known(self.tables, c["fromTable"]).name, c["fromColumn"], known(self.tables, c["toTable"]).name, c["toColumn"], c.get("active", True), c.get("both", False)))
        elif what in ("deleteRelationship", "updateRelationship"):
            if not any(r.name == c["name"] for r in self.relationships):
                raise ModelError(f"{what}: {c['name']} is unknown")
            rest = [r for r in self.relationships if r.name != c["name"]]
            if what == "updateRelationship":
                rest += [replace(r, **{k: c[k] for k in ("active", "both") if k in c}) for r in self.relationships if r.name == c["name"]]
            self.relationships = rest
        else:
            raise ModelError(f"{what} is no command")


def _reference(table: str, name: str) -> re.Pattern:
    """A column or measure named with its table, quoted or not."""
    return re.compile(rf"(?:'{re.escape(table)}'|(?<![\w']){re.escape(table)})\s*\[{re.escape(name)}\]", re.I)


def _outside_strings(text: str, change, names: bool = False) -> str:
    """Change an expression but not its strings, nor, with ``names``, what stands in brackets."""
    kept = r'("(?:[^"]|"")*"|\[[^\]]*\])' if names else r'("(?:[^"]|"")*")'
    return "".join(part if k % 2 else change(part) for k, part in enumerate(re.split(kept, text)))


#: Names that command documents use, and those used here.
_FIELDS = {"isHidden": "hidden", "formatString": "format", "displayFolder": "folder", "dataCategory": "category", "sortByColumn": "sort_by", "summarizeBy": "summarize_by", "isKey": "key", "isActive": "active", "bidirectional": "both"}


def _own_command(c: dict) -> dict:
    """A command as documents write it, ``{"type": "SetTableProperty", "table": .., "property": {"isHidden": true}}``, in the form that ``apply`` takes."""
    body = {_FIELDS.get(k, k): v for k, v in c.items() if k not in ("type", "property")}
    given = {_FIELDS.get(k, k): v if v is not None else "" for k, v in (c.get("property") or {}).items()}
    kind = c["type"]
    plain = {"CreateMeasure", "DeleteMeasure", "RenameMeasure", "CreateTable", "RenameTable", "DeleteColumn", "RenameColumn", "ChangeColumnType", "CreateRelationship", "DeleteRelationship", "UpdateRelationship", "RenameModel"}
    if kind in plain:
        return {"command": kind[0].lower() + kind[1:], **{k: v if v is not None else "" for k, v in body.items()}}
    if kind == "DeleteTable":
        return {"command": "deleteTable", "name": body["table"]}
    if kind == "SetModelProperty":
        return {"command": "setModelProperty", "property": c["property"]}
    if kind == "SetTableProperty":
        return {"command": "describeTable", "name": body["table"], **given}
    if kind == "AddColumn":
        return {"command": "createColumn", "column": body["name"], **{k: v for k, v in body.items() if k != "name" and v is not None}}
    if kind == "SetColumnProperty":
        return {"command": "describeColumn", **body, **given}
    if kind in ("UpdateMeasureExpression", "SetMeasureFormatString"):
        return {"command": "updateMeasure", **{k: v if v is not None else "" for k, v in body.items()}}
    raise ModelError(f"{kind} is no command")
