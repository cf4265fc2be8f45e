"""Scalar functions as Spark columns, and the rules for BLANK (null).

A value is a column with a kind: int, num, str, bool, date or blank. Where the usual DAX meaning and a
literal reading differ, the DAX meaning is taken: FLOOR and CEILING honour their significance, TRUNC its
digits, EDATE keeps within the month, DIVIDE and IF accept BLANK.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from prismata.plans.parser import DaxError


@dataclass(frozen=True)
class Val:
    col: Column
    kind: str = "num"
    const: object = None  # the value of a literal


_EMPTY = {"int": 0, "num": 0.0, "str": "", "bool": False}


def literal(v: object) -> Val:
    kind = "bool" if isinstance(v, bool) else "int" if isinstance(v, int) else "num" if isinstance(v, float) else "str" if isinstance(v, str) else "blank"
    return Val(F.lit(v).cast({"int": "bigint", "num": "double", "str": "string", "bool": "boolean", "blank": "double"}[kind]), kind, v)


def kind_of(data_type: str) -> str:
    if data_type in ("bigint", "int", "smallint", "tinyint", "long", "integer"):
        return "int"
    if data_type in ("double", "float") or data_type.startswith("decimal"):
        return "num"
    return {"string": "str", "boolean": "bool"}.get(data_type, "date" if data_type.startswith(("timestamp", "date")) else "any")


def num(v: Val) -> Column:
    """As a double; null stays null."""
    if v.kind == "str":
        raise DaxError("a number is expected, not a string")
    if v.kind == "date":
        raise DaxError("a number is expected, not a date")
    return v.col.cast("int").cast("double") if v.kind == "bool" else v.col.cast("double")


def flag(v: Val) -> Column:
    """As a Boolean with BLANK false."""
    if v.kind in ("str", "date"):
        raise DaxError("a Boolean is expected")
    return F.coalesce(v.col if v.kind == "bool" else v.col != 0, F.lit(False))


def common(*kinds: str) -> str:
    known = set(kinds) - {"blank", "error"}
    if not known:
        return "error" if "error" in kinds else "blank"
    if len(known) == 1:
        return known.pop()
    return "num" if known <= {"int", "num", "bool"} else "any"


def arithmetic(op: str, a: Val, b: Val) -> Val:
    if "date" in (a.kind, b.kind):
        if op == "-" and a.kind == b.kind == "date":
            return Val(F.datediff(a.col, b.col).cast("double"), "num")
        if op in "+-" and a.kind == "date" and b.kind in ("int", "num", "blank"):
            days = F.coalesce(b.col, F.lit(0)).cast("int")
            return Val((a.col + F.make_dt_interval(days if op == "+" else -days)).cast("timestamp_ntz"), "date")
        if op == "+" and b.kind == "date":
            return arithmetic(op, b, a)
        raise DaxError(f"{op} is not defined for these types")
    whole = {a.kind, b.kind} <= {"int", "blank"} and op != "/"
    x, y = (v.col.cast("bigint") if whole else num(v) for v in (a, b))
    if op == "/":
        return Val(F.try_divide(x, F.coalesce(y, F.lit(0.0))), "num")
    both = x.isNull() & y.isNull()
    if op == "*":
        return Val(x * y, "int" if whole else "num")
    x, y = F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0))
    got = x + y if op == "+" else x - y
    return Val(got if a.const is not None or b.const is not None else F.when(~both, got), "int" if whole else "num")


def compare(op: str, a: Val, b: Val) -> Val:
    kinds = {a.kind, b.kind} - {"blank", "any"}
    if len(kinds) > 1 and not kinds <= {"int", "num"}:
        raise DaxError(f"{a.kind} and {b.kind} cannot be compared")
    kind = a.kind if a.kind not in ("blank", "any") else b.kind
    x, y = a.col, b.col
    if kind == "blank" or "blank" in (a.kind, b.kind) and op in ("=", "<>"):
        same = (x.isNull() if b.kind == "blank" else y.isNull()) if kind != "blank" else F.lit(True)
        if kind in _EMPTY:
            other = x if b.kind == "blank" else y
            same = other.isNull() | (other == F.lit(_EMPTY[kind]))
        return Val(same if op in ("=", ">=", "<=") else ~same, "bool")
    if kind in _EMPTY:
        zero = F.lit(_EMPTY[kind])
        x = x if a.const is not None else F.coalesce(x, zero)
        y = y if b.const is not None else F.coalesce(y, zero)
    made = {"=": lambda: x.eqNullSafe(y), "<>": lambda: ~x.eqNullSafe(y), ">": lambda: x > y, "<": lambda: x < y, ">=": lambda: x >= y, "<=": lambda: x <= y}[op]()
    return Val(F.coalesce(made, F.lit(False)), "bool")


def concat(a: Val, b: Val) -> Val:
    if any(v.kind == "date" for v in (a, b)):
        raise DaxError("& joins strings")
    return Val(F.concat(*[F.coalesce(v.col.cast("string"), F.lit("")) for v in (a, b)]), "str")


def _unary(f: Callable[[Column], Column], kind: str = "num") -> Callable[[list[Val]], Val]:
    return lambda a: Val(f(num(a[0])), kind)


def _sign(x: Column) -> Column:
    return F.when(x < 0, -1.0).otherwise(1.0)


def _scale(a: list[Val]) -> Column:
    return F.pow(F.lit(10.0), F.coalesce(num(a[1]), F.lit(0.0)) if len(a) > 1 else F.lit(0.0))


def _round_half_up(x: Column) -> Column:
    return _sign(x) * F.floor(F.abs(x) + 0.5)


def _round(a: list[Val]) -> Val:
    if len(a) > 1 and isinstance(a[1].const, int):
        return Val(F.round(num(a[0]), a[1].const), "num")
    p = _scale(a)
    return Val(_round_half_up(num(a[0]) * p) / p, "num")


def _log(x: Column) -> Column:
    return F.when(x > 0, F.ln(x)).when(x == 0, F.lit(-math.inf)).when(x < 0, F.lit(math.nan))


def _factorial(a: list[Val]) -> Val:
    n = num(a[0])
    product = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(n, F.lit(170.0)), F.lit(1.0)).cast("int")), F.lit(1.0), lambda acc, k: acc * k)
    return Val(F.when(n < 0, F.raise_error(F.lit("FACT of a negative number")).cast("double")).when(n > 170, F.lit(math.inf)).when(n.isNotNull(), product), "num")


def _gcd2(a: Column, b: Column) -> Column:
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), F.try_mod(s["a"], s["b"]).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), F.struct(F.abs(a).alias("a"), F.abs(b).alias("b")), step)["a"]


def _whole(v: Val) -> Column:
    return F.coalesce(num(v), F.lit(0.0)).cast("bigint")


def _gcd(a: list[Val]) -> Val:
    out = F.abs(_whole(a[0]))
    for v in a[1:]:
        out = _gcd2(out, _whole(v))
    return Val(out, "int")


def _lcm(a: list[Val]) -> Val:
    out = F.abs(_whole(a[0]))
    for v in a[1:]:
        w = F.abs(_whole(v))
        out = F.when((out == 0) | (w == 0), F.lit(0).cast("bigint")).otherwise(F.try_divide(out, _gcd2(out, w)).cast("bigint") * w)
    return Val(out, "int")


def _mod(a: list[Val]) -> Val:
    x, d = F.coalesce(num(a[0]), F.lit(0.0)), F.coalesce(num(a[1]), F.lit(0.0))
    return Val(F.when(d == 0, F.raise_error(F.lit("MOD by zero")).cast("double")).otherwise(x - d * F.floor(F.try_divide(x, d))), "num")


def _mround(a: list[Val]) -> Val:
    x, m = num(a[0]), num(a[1])
    return Val(F.when(m == 0, F.raise_error(F.lit("MROUND to zero")).cast("double")).otherwise(_round_half_up(F.try_divide(x, m)) * m), "num")


def _step(f: Callable[[Column], Column]) -> Callable[[list[Val]], Val]:
    def run(a: list[Val]) -> Val:
        if len(a) == 1:
            return Val(f(num(a[0])).cast("double"), "num")
        s = num(a[1])
        return Val(F.when(s == 0, F.lit(0.0)).otherwise(f(F.try_divide(num(a[0]), s)) * s), "num")

    return run


def _odd(a: list[Val]) -> Val:
    n = F.ceil(F.abs(num(a[0]))).cast("bigint")
    return Val((_sign(num(a[0])) * F.when(n % 2 == 1, n).otherwise(n + 1)).cast("bigint"), "int")


def _divide(a: list[Val]) -> Val:
    n, d = num(a[0]), F.coalesce(num(a[1]), F.lit(0.0))
    if len(a) < 3:
        return Val(F.try_divide(n, d), "num")
    return Val(F.when(d == 0, num(a[2])).otherwise(F.try_divide(n, d)), "num")


def _when(v: Val) -> Column:
    if v.kind not in ("date", "blank"):
        raise DaxError("a date is expected")
    return v.col


def _part(f: Callable[[Column], Column]) -> Callable[[list[Val]], Val]:
    return lambda a: Val(f(_when(a[0])).cast("bigint"), "int")


def _stamp(c: Column) -> Val:
    return Val(c.cast("timestamp_ntz"), "date")


def _date(a: list[Val]) -> Val:
    y, m, d = (_whole(v).cast("int") for v in a)
    return _stamp(F.date_add(F.add_months(F.make_date(y, F.lit(1), F.lit(1)), m - 1), d - 1))


def _option(a: list[Val], k: int, default: int) -> int:
    if len(a) <= k:
        return default
    if not isinstance(a[k].const, int):
        raise DaxError("the option must be a whole number literal")
    return a[k].const


def _weekday_of(c: Column, kind: int) -> Column:
    return {1: F.dayofweek(c), 2: F.weekday(c) + 1, 3: F.weekday(c)}[kind]


def _weekday(a: list[Val]) -> Val:
    kind = _option(a, 1, 1)
    if kind not in (1, 2, 3):
        raise DaxError("WEEKDAY takes 1, 2 or 3")
    return Val(_weekday_of(_when(a[0]), kind).cast("bigint"), "int")


def _weeknum(a: list[Val]) -> Val:
    """Week of the year; week one holds January 1; weeks begin on Sunday (1) or Monday (2)."""
    kind, c = _option(a, 1, 1), _when(a[0])
    if kind not in (1, 2):
        raise DaxError("WEEKNUM takes 1 or 2")
    first = _weekday_of(F.trunc(c.cast("date"), "year"), kind) - 1
    return Val((F.floor((F.dayofyear(c) - 1 + first) / 7) + 1).cast("bigint"), "int")


def _datediff(a: list[Val]) -> Val:
    unit = str(a[2].const or "").upper()
    x, y = _when(a[0]), _when(a[1])
    seconds = F.timestamp_diff("SECOND", x, y)
    length = {"SECOND": 1, "MINUTE": 60, "HOUR": 3600, "DAY": 86400, "WEEK": 604800}.get(unit)
    if length:
        q = F.try_divide(seconds.cast("double"), F.lit(float(length)))
        return Val((_sign(q) * F.floor(F.abs(q))).cast("bigint"), "int")
    months = (F.year(y) - F.year(x)) * 12 + F.month(y) - F.month(x)
    if unit == "MONTH":
        return Val(months.cast("bigint"), "int")
    if unit == "YEAR":
        return Val((F.year(y) - F.year(x)).cast("bigint"), "int")
    if unit == "QUARTER":
        return Val((_sign(months) * F.floor(F.abs(months) / 3)).cast("bigint"), "int")
    raise DaxError(f"DATEDIFF has no unit {unit}")


def _if(a: list[Val]) -> Val:
    kind = common(a[1].kind, *([a[2].kind] if len(a) > 2 else []))
    pick = lambda v: num(v) if kind == "num" else v.col if v.kind != "blank" else F.lit(None)
    out = F.when(flag(a[0]), pick(a[1]))
    return Val(out.otherwise(pick(a[2])) if len(a) > 2 else out, kind)


def _coalesce(a: list[Val]) -> Val:
    kind = common(*[v.kind for v in a])
    return Val(F.coalesce(*[num(v) if kind == "num" else v.col for v in a if v.kind != "blank"] or [F.lit(None).cast("double")]), kind)


def _switch(a: list[Val]) -> Val:
    results = [*a[2::2], *([a[-1]] if len(a) % 2 == 0 else [])]
    kind = common(*[v.kind for v in results])
    pick = lambda v: num(v) if kind == "num" else v.col if v.kind != "blank" else F.lit(None)
    out = None
    for k in range(1, len(a) - 1, 2):
        test, match = a[0], a[k]
        if test.kind in ("int", "num", "bool") and match.kind in ("int", "num", "bool"):
            same = num(test).eqNullSafe(num(match))
        else:
            same = test.col.eqNullSafe(match.col) if "blank" not in (test.kind, match.kind) else (test.col.isNull() if match.kind == "blank" else match.col.isNull())
        out = out.when(same, pick(a[k + 1])) if out is not None else F.when(same, pick(a[k + 1]))
    return Val(out.otherwise(pick(a[-1])) if len(a) % 2 == 0 else out, kind)


def _error(a: list[Val]) -> Val:
    return Val(F.raise_error(a[0].col), "error")  # of no type, so it stands beside values of any


def _now(zone: str, day: bool) -> Val:
    c = F.convert_timezone(F.lit("UTC"), F.lit(zone), F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()).cast("timestamp_ntz"))
    return _stamp(F.date_trunc("day", c) if day else c)


_U = _unary
#: name -> (fewest arguments, most arguments, how the column is made)
SCALARS: dict[str, tuple[int, int, Callable[[list[Val]], Val]]] = {
    "BLANK": (0, 0, lambda a: literal(None)), "TRUE": (0, 0, lambda a: literal(True)), "FALSE": (0, 0, lambda a: literal(False)),
    "AND": (2, 2, lambda a: Val(flag(a[0]) & flag(a[1]), "bool")), "OR": (2, 2, lambda a: Val(flag(a[0]) | flag(a[1]), "bool")), "NOT": (1, 1, lambda a: Val(~flag(a[0]), "bool")),
    "ISBLANK": (1, 1, lambda a: Val(a[0].col.isNull(), "bool")), "ERROR": (1, 1, _error), "IF": (2, 3, _if), "COALESCE": (1, 99, _coalesce), "SWITCH": (3, 199, _switch),
    "DATE": (3, 3, _date), "YEAR": (1, 1, _part(F.year)), "MONTH": (1, 1, _part(F.month)), "DAY": (1, 1, _part(F.day)), "HOUR": (1, 1, _part(F.hour)), "MINUTE": (1, 1, _part(F.minute)), "SECOND": (1, 1, _part(F.second)), "QUARTER": (1, 1, _part(F.quarter)),
    "WEEKDAY": (1, 2, _weekday), "WEEKNUM": (1, 2, _weeknum), "DATEDIFF": (3, 3, _datediff),
    "EDATE": (2, 2, lambda a: _stamp(F.add_months(_when(a[0]).cast("date"), _whole(a[1]).cast("int")))), "EOMONTH": (2, 2, lambda a: _stamp(F.last_day(F.add_months(_when(a[0]).cast("date"), _whole(a[1]).cast("int"))))),
    "UTCTODAY": (0, 0, lambda a: _now("UTC", True)), "UTCNOW": (0, 0, lambda a: _now("UTC", False)),
    "DIVIDE": (2, 3, _divide), "ABS": (1, 1, lambda a: Val(F.abs(a[0].col if a[0].kind == "int" else num(a[0])), "int" if a[0].kind == "int" else "num")), "ROUND": (2, 2, _round), "PI": (0, 0, lambda a: Val(F.pi(), "num")),
    "SQRT": (1, 1, _U(F.sqrt)), "EXP": (1, 1, _U(F.exp)), "LN": (1, 1, _U(_log)), "LOG10": (1, 1, _U(lambda x: _log(x) / F.lit(math.log(10)))),
    "LOG": (1, 2, lambda a: Val(F.log10(num(a[0])) if len(a) < 2 else _log(num(a[0])) / _log(num(a[1])), "num")),
    "FLOOR": (1, 2, _step(F.floor)), "CEILING": (1, 2, _step(F.ceil)), "TRUNC": (1, 2, lambda a: Val(_sign(num(a[0])) * F.floor(F.abs(num(a[0])) * _scale(a)) / _scale(a), "num")),
    "INT": (1, 1, _U(F.floor, "int")), "SIGN": (1, 1, _U(lambda x: F.signum(x).cast("bigint"), "int")), "POWER": (2, 2, lambda a: Val(F.pow(num(a[0]), num(a[1])), "num")), "MOD": (2, 2, _mod), "FACT": (1, 1, _factorial),
    "EVEN": (1, 1, _U(lambda x: (_sign(x) * F.ceil(F.abs(x) / 2) * 2).cast("bigint"), "int")), "ODD": (1, 1, _odd), "MROUND": (2, 2, _mround),
    "ROUNDUP": (2, 2, lambda a: Val(_sign(num(a[0])) * F.ceil(F.abs(num(a[0])) * _scale(a)) / _scale(a), "num")), "ROUNDDOWN": (2, 2, lambda a: Val(_sign(num(a[0])) * F.floor(F.abs(num(a[0])) * _scale(a)) / _scale(a), "num")),
    "GCD": (1, 99, _gcd), "LCM": (1, 99, _lcm), "SQRTPI": (1, 1, _U(lambda x: F.sqrt(x * F.pi()))), "DEGREES": (1, 1, _U(F.degrees)), "RADIANS": (1, 1, _U(F.radians)),
    "SIN": (1, 1, _U(F.sin)), "COS": (1, 1, _U(F.cos)), "TAN": (1, 1, _U(F.tan)), "ASIN": (1, 1, _U(F.asin)), "ACOS": (1, 1, _U(F.acos)), "ATAN": (1, 1, _U(F.atan)), "ATAN2": (2, 2, lambda a: Val(F.atan2(num(a[1]), num(a[0])), "num")),
    "SINH": (1, 1, _U(F.sinh)), "COSH": (1, 1, _U(F.cosh)), "TANH": (1, 1, _U(F.tanh)), "ACOSH": (1, 1, _U(F.acosh)), "ASINH": (1, 1, _U(F.asinh)), "ATANH": (1, 1, _U(F.atanh)), "COT": (1, 1, _U(F.cot)),
    "COTH": (1, 1, _U(lambda x: F.try_divide(F.cosh(x), F.sinh(x)))), "ACOT": (1, 1, _U(lambda x: F.pi() / 2 - F.atan(x))), "ACOTH": (1, 1, _U(lambda x: F.lit(0.5) * _log(F.try_divide(x + 1, x - 1)))),
}


def zoned(zone: str) -> dict[str, tuple[int, int, Callable[[list[Val]], Val]]]:
    """The clock functions of an engine's time zone."""
    return {"TODAY": (0, 0, lambda a: _now(zone, True)), "NOW": (0, 0, lambda a: _now(zone, False))}
