"""Scalar functions of the language as Columns; kinds are Spark type names, None where unknown."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

INTS = frozenset(("tinyint", "smallint", "int", "bigint"))
FLOATS = frozenset(("float", "double"))
AGGREGATES = frozenset(("count", "sum", "avg", "min", "max", "collect", "stdev", "stdevp"))


class Typed(NamedTuple):
    col: Column
    kind: str | None = None
    retype: Callable[[str], Typed] | None = None  # for values whose type their use decides

    def settled(self, kind: str | None = None) -> Typed:
        return self.retype(kind or "string") if self.retype else self


def element(kind: str | None) -> str | None:
    return kind[6:-1] if kind and kind.startswith("array<") else None


def is_list(kind: str | None) -> bool:
    return bool(kind and kind.startswith("array<"))


def numeric(kind: str | None) -> bool:
    return bool(kind) and (kind in INTS or kind in FLOATS or kind.startswith("decimal"))


def literal(value: object) -> Typed:
    if value is None:
        return Typed(F.lit(None), "void")
    if isinstance(value, bool):
        return Typed(F.lit(value), "boolean")
    if isinstance(value, int):
        return Typed(F.lit(value).cast("bigint"), "bigint")
    if isinstance(value, float):
        return Typed(F.lit(value), "double")
    if isinstance(value, str):
        return Typed(F.lit(value), "string")
    if isinstance(value, (list, tuple)):
        return array_of([literal(v) for v in value])
    if isinstance(value, dict):
        return struct_of([(k, literal(v)) for k, v in value.items()])
    return Typed(F.lit(value))


def array_of(items: list[Typed]) -> Typed:
    if not items:
        return Typed(F.array().cast("array<string>"), "array<string>")
    kinds = {t.kind for t in items if t.kind != "void"}
    if len(kinds) <= 1:
        kind = kinds.pop() if kinds else "void"
        return Typed(F.array(*[t.col for t in items]), f"array<{kind or 'string'}>" if kind else None)
    if all(numeric(k) for k in kinds):
        kind = "bigint" if kinds <= INTS else "double"
        return Typed(F.array(*[t.col.cast(kind) for t in items]), f"array<{kind}>")
    return Typed(F.array(*[t.col.cast("variant") for t in items]), "array<variant>")


def struct_of(items: list[tuple[str, Typed]]) -> Typed:
    kind = ",".join(f"{k}:{t.kind or 'string'}" for k, t in items)
    return Typed(F.struct(*[t.col.alias(k) for k, t in items]), f"struct<{kind}>")


def _prefix_number(text: Column, pattern: str, kind: str, zero: Column) -> Column:
    found = F.regexp_extract(text, pattern, 1).try_cast(kind)
    return F.when(text.isNotNull(), F.coalesce(found, zero))


def to_integer(x: Typed) -> Typed:
    if numeric(x.kind):
        return Typed(x.col.cast("bigint"), "bigint")
    if x.kind == "boolean":
        return Typed(x.col.cast("bigint"), "bigint")
    return Typed(_prefix_number(x.col.cast("string"), r"^\s*([+-]?\d+)", "bigint", F.lit(0).cast("bigint")), "bigint")


def to_float(x: Typed) -> Typed:
    if numeric(x.kind) or x.kind == "boolean":
        return Typed(x.col.cast("double"), "double")
    return Typed(_prefix_number(x.col.cast("string"), r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", "double", F.lit(0.0)), "double")


def to_boolean(x: Typed) -> Typed:
    if x.kind == "boolean":
        return x
    return Typed(F.lower(x.col.cast("string")).isin("true", "1", "yes"), "boolean")


def right(s: Typed, n: Typed) -> Typed:
    text, count = s.col.cast("string"), n.col.cast("int")
    return Typed(F.when(count == 0, text).otherwise(F.right(text, count)), "string")


def size(x: Typed) -> Typed:
    measured = F.length(x.col) if x.kind == "string" else F.when(x.col.isNotNull(), F.size(x.col))
    return Typed(measured.cast("bigint"), "bigint")


def item(x: Typed, at: Typed) -> Typed:
    """0-based, negative from the end, null outside."""
    i = at.col.cast("int")
    return Typed(F.get(x.col, F.when(i < 0, F.size(x.col) + i).otherwise(i)), element(x.kind))


def last(x: Typed) -> Typed:
    return Typed(F.get(x.col, F.size(x.col) - 1), element(x.kind))


def tail(x: Typed) -> Typed:
    return Typed(F.slice(x.col, F.lit(2), F.greatest(F.size(x.col) - 1, F.lit(0))), x.kind)


def keys(x: Typed) -> Typed:
    if x.kind and x.kind.startswith("struct<"):
        names = top_fields(x.kind)
        return Typed(F.when(x.col.isNotNull(), F.array(*[F.lit(n) for n, _ in names])), "array<string>")
    if x.kind and x.kind.startswith("map<"):
        return Typed(F.array_sort(F.map_keys(x.col)), "array<string>")
    return Typed(F.json_object_keys(x.col.cast("string")), "array<string>")


def top_fields(kind: str) -> list[tuple[str, str]]:
    """Names and types of a struct type's fields."""
    out, depth, start, body = [], 0, 0, kind[7:-1]
    for i, c in enumerate(body + ","):
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            name, _, rest = body[start:i].partition(":")
            out.append((name, rest))
            start = i + 1
    return [x for x in out if x[0]]


def span(a: Typed, b: Typed, step: Typed | None = None) -> Typed:
    """Inclusive; empty where the step goes the other way or is 0."""
    low, high = a.col.cast("bigint"), b.col.cast("bigint")
    by = step.col.cast("bigint") if step else F.lit(1).cast("bigint")
    none = F.array().cast("array<bigint>")
    runs = ((by > 0) & (low <= high)) | ((by < 0) & (low >= high))
    return Typed(F.when(runs, F.sequence(low, high, by)).otherwise(none), "array<bigint>")


def json_get(x: Typed, path: Typed) -> Typed:
    where = F.when(path.col.startswith("$"), path.col).otherwise(F.concat(F.lit("$."), path.col))
    return Typed(F.call_function("get_json_object", x.col.cast("string"), where), "string")


_SQLITE_TYPES = {"string": "text", "boolean": "integer", "void": "null", **{k: "integer" for k in INTS}, **{k: "real" for k in FLOATS}}


def type_name(x: Typed) -> Typed:
    return Typed(F.when(x.col.isNull(), "null").otherwise(_SQLITE_TYPES.get(x.kind or "", "text")), "string")


def _text(fn: Callable[..., Column], kind: str = "string") -> Callable[..., Typed]:
    return lambda x, *rest: Typed(fn(x.col.cast("string"), *[r.col for r in rest]), kind)


def _double(fn: Callable[[Column], Column]) -> Callable[[Typed], Typed]:
    return lambda x: Typed(fn(x.col.cast("double")), "double")


def _same(fn: Callable[[Column], Column]) -> Callable[[Typed], Typed]:
    return lambda x: Typed(fn(x.col), x.kind)


def _coalesce(*xs: Typed) -> Typed:
    known = next((x.kind for x in xs if x.kind not in (None, "void")), None)
    return Typed(F.coalesce(*[x.settled(known).col for x in xs]), known)


def _length(x: Typed) -> Typed:
    if is_list(x.kind):
        return Typed(F.size(x.col).cast("bigint"), "bigint")
    return Typed(F.length(x.col.cast("string")).cast("bigint"), "bigint")


def _nullif(a: Typed, b: Typed) -> Typed:
    return Typed(F.nullif(a.col, b.col), a.kind)


def moment(x: Typed | None) -> Column:
    """A time from its text; now where there is none."""
    if x is None:
        return F.current_timestamp()
    text = x.col.cast("string")
    return F.when(F.lower(text) == "now", F.current_timestamp()).otherwise(F.try_to_timestamp(text))


#: Conversions of a time format and the same in Spark's patterns.
TIME_PARTS = {
    "%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%f": "ss.SSS", "%j": "DDD", "%F": "yyyy-MM-dd",
    "%T": "HH:mm:ss", "%R": "HH:mm", "%I": "hh", "%p": "a",
}


def strftime(form: Typed, x: Typed | None = None) -> Typed:
    at, out = moment(x), form.col.cast("string")
    for part, pattern in TIME_PARTS.items():
        out = F.replace(out, F.lit(part), F.date_format(at, pattern))
    out = F.replace(out, F.lit("%s"), F.unix_seconds(at).cast("string"))
    out = F.replace(out, F.lit("%w"), (F.dayofweek(at) - 1).cast("string"))
    return Typed(F.when(at.isNotNull(), F.replace(out, F.lit("%%"), F.lit("%"))), "string")


def _dated(pattern: str) -> Callable[..., Typed]:
    return lambda x=None: Typed(F.date_format(moment(x), pattern), "string")


def julian_day(x: Typed | None = None) -> Typed:
    """Days since noon of 24 November 4714 BC; the Unix epoch is day 2440587.5."""
    return Typed(F.unix_millis(moment(x)) / 86400000.0 + 2440587.5, "double")


def extreme(fn: Callable[..., Column]) -> Callable[..., Typed]:
    """Least or greatest of several values; null where one is null."""

    def of(*xs: Typed) -> Typed:
        known = next((x.kind for x in xs if x.kind not in (None, "void")), None)
        cols = [x.settled(known).col for x in xs]
        none = cols[0].isNull()
        for c in cols[1:]:
            none = none | c.isNull()
        return Typed(F.when(~none, fn(*cols)), known)

    return of


def json_of(x: Typed) -> Column:
    """A value as JSON text."""
    if x.kind == "string":
        return F.coalesce(F.to_json(x.col.cast("variant")), F.lit("null"))
    if x.kind in (None, "void"):
        return F.lit("null") if x.kind == "void" else F.coalesce(F.to_json(x.col), F.lit("null"))
    if is_list(x.kind) or (x.kind or "").startswith(("struct", "map")):
        return F.coalesce(F.to_json(x.col), F.lit("null"))
    return F.coalesce(x.col.cast("string"), F.lit("null"))


def json_array(*xs: Typed) -> Typed:
    return Typed(F.concat(F.lit("["), F.concat_ws(",", *[json_of(x) for x in xs]), F.lit("]")), "string")


def json_object(*xs: Typed) -> Typed:
    pairs = [F.concat(json_of(Typed(k.col.cast("string"), "string")), F.lit(":"), json_of(v)) for k, v in zip(xs[::2], xs[1::2])]
    return Typed(F.concat(F.lit("{"), F.concat_ws(",", *pairs), F.lit("}")), "string")


def json_type(x: Typed, path: Typed | None = None) -> Typed:
    """object, array, text, integer, real, true, false or null; a null where nothing is."""
    v = F.try_parse_json(x.col.cast("string"))
    if path is not None:
        got = json_get(x, path).col
        v = F.coalesce(F.try_parse_json(got), F.when(got.isNotNull(), F.to_variant_object(F.struct(got.alias("x")))))
    kind = F.schema_of_variant(v)
    flag = F.try_variant_get(v, "$", "boolean")
    named = (
        F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(kind == "STRING", "text")
        .when(kind == "BIGINT", "integer").when(kind == "VOID", "null").when(kind == "BOOLEAN", F.when(flag, "true").otherwise("false")).otherwise("real")
    )
    if path is not None:
        # What is at the path comes as bare text where it is a string.
        named = F.when(F.try_parse_json(json_get(x, path).col).isNull(), "text").otherwise(named)
        named = F.when(json_get(x, path).col.isNotNull(), named)
    return Typed(F.when(v.isNotNull(), named), "string")


def _printf(form: Typed, *xs: Typed) -> Typed:
    return Typed(F.call_function("format_string", form.col, *[x.col for x in xs]), "string")


def _two(fn: Callable[..., Column], kind: str = "double") -> Callable[[Typed, Typed], Typed]:
    return lambda a, b: Typed(fn(a.col.cast("double"), b.col.cast("double")), kind)


def _substr(x: Typed, at: Typed, n: Typed | None = None) -> Typed:
    text = x.col.cast("string")
    return Typed(text.substr(at.col.cast("int"), n.col.cast("int") if n else F.length(text)), "string")


_one: Callable[[Typed], Typed] = lambda x: x
FUNCTIONS: dict[str, Callable[..., Typed]] = {
    "tostring": lambda x: Typed(x.col.cast("string"), "string"),
    "toupper": _text(F.upper), "tolower": _text(F.lower), "upper": _text(F.upper), "lower": _text(F.lower),
    "left": lambda x, n: Typed(F.left(x.col.cast("string"), n.col.cast("int")), "string"),
    "right": right,
    "substring": _substr, "substr": _substr,
    "trim": _text(F.trim), "ltrim": _text(F.ltrim), "rtrim": _text(F.rtrim),
    "replace": _text(F.replace), "reverse": lambda x: Typed(F.reverse(x.col), x.kind),
    "split": lambda x, d: Typed(F.split(x.col.cast("string"), F.concat(F.lit("\\Q"), d.col, F.lit("\\E"))), "array<string>"),
    "length": _length, "coalesce": _coalesce, "ifnull": _coalesce, "nullif": _nullif,
    "instr": lambda x, y: Typed(F.call_function("instr", x.col, y.col).cast("bigint"), "bigint"),
    "abs": _same(F.abs), "sign": lambda x: Typed(F.signum(x.col).cast("bigint"), "bigint"),
    "round": lambda x, d=None: Typed(F.call_function("round", x.col.cast("double"), d.col.cast("int") if d else F.lit(0)), "double"),
    "ceil": lambda x: Typed(F.ceil(x.col).cast("bigint"), "bigint"), "floor": lambda x: Typed(F.floor(x.col).cast("bigint"), "bigint"),
    "rand": lambda: Typed(F.rand(), "double"), "random": lambda: Typed(F.rand(), "double"),
    "sqrt": _double(F.sqrt), "log": _double(F.ln), "log10": _double(F.log10), "exp": _double(F.exp), "e": lambda: Typed(F.e(), "double"),
    "tointeger": to_integer, "toint": to_integer, "tofloat": to_float, "toboolean": to_boolean,
    "size": size, "head": lambda x: Typed(F.get(x.col, F.lit(0)), element(x.kind)), "tail": tail, "last": last, "keys": keys, "range": span,
    "json_get": json_get, "json_extract": json_get, "json_keys": lambda x: Typed(F.json_object_keys(x.col.cast("string")), "array<string>"),
    "json_array_length": lambda x: Typed(F.json_array_length(x.col.cast("string")).cast("bigint"), "bigint"),
    "json_valid": lambda x: Typed(F.try_parse_json(x.col.cast("string")).isNotNull(), "boolean"),
    "date": lambda x: Typed(F.to_date(x.col).cast("string"), "string"),
    "year": lambda x: Typed(F.year(x.col).cast("bigint"), "bigint"), "month": lambda x: Typed(F.month(x.col).cast("bigint"), "bigint"),
    "day": lambda x: Typed(F.dayofmonth(x.col).cast("bigint"), "bigint"), "hour": lambda x: Typed(F.hour(x.col).cast("bigint"), "bigint"),
    "strftime": strftime, "datetime": _dated("yyyy-MM-dd HH:mm:ss"), "time": _dated("HH:mm:ss"), "julianday": julian_day,
    "unixepoch": lambda x=None: Typed(F.unix_seconds(moment(x)), "bigint"),
    "printf": _printf, "format": _printf, "typeof": type_name, "hex": _text(F.hex), "unicode": lambda x: Typed(F.ascii(x.col.cast("string")).cast("bigint"), "bigint"),
    "char": lambda *xs: Typed(F.concat(*[F.decode(F.unhex(F.lpad(F.hex(x.col.cast("int")), 8, "0")), "UTF-32") for x in xs]), "string"),
    "concat": lambda *xs: Typed(F.concat(*[F.coalesce(x.col.cast("string"), F.lit("")) for x in xs]), "string"),
    "concat_ws": lambda d, *xs: Typed(F.call_function("concat_ws", d.col, *[x.col.cast("string") for x in xs]), "string"),
    "iif": lambda c, a, b=None: Typed(F.when(c.col, a.col).otherwise(b.settled(a.kind).col if b else F.lit(None)), a.kind),
    "pow": _two(F.pow), "power": _two(F.pow), "mod": _two(lambda a, b: a % F.nullif(b, F.lit(0.0))), "atan2": _two(F.atan2),
    "sin": _double(F.sin), "cos": _double(F.cos), "tan": _double(F.tan), "asin": _double(F.asin), "acos": _double(F.acos), "atan": _double(F.atan),
    "sinh": _double(F.sinh), "cosh": _double(F.cosh), "tanh": _double(F.tanh), "radians": _double(F.radians), "degrees": _double(F.degrees),
    "ln": _double(F.ln), "log2": _double(F.log2), "pi": lambda: Typed(F.pi(), "double"),
    "ceiling": lambda x: Typed(F.ceil(x.col).cast("bigint"), "bigint"), "trunc": lambda x: Typed(x.col.cast("bigint"), "bigint"),
    "least": extreme(F.least), "greatest": extreme(F.greatest),
    "json_object": json_object, "json_array": json_array, "json_type": json_type, "json": lambda x: Typed(F.to_json(F.try_parse_json(x.col.cast("string"))), "string"),
    "json_quote": lambda x: Typed(json_of(x), "string"),
    "graph": lambda *_: Typed(F.lit("default"), "string"),
    # Placeholders with fixed results; real ranking is operators.ranking.
    "pagerank": lambda *_: Typed(F.lit(0.0), "double"), "toppagerank": lambda *_: Typed(F.lit("[]"), "string"),
    "personalizedpagerank": lambda *_: Typed(F.lit("[]"), "string"),
}


def aggregate(name: str, x: Typed | None, distinct: bool) -> Typed:
    """An aggregate of x; x is None for count(*)."""
    if name == "count":
        if x is None:
            return Typed(F.count(F.lit(1)), "bigint")
        return Typed(F.count_distinct(x.col) if distinct else F.count(x.col), "bigint")
    assert x is not None
    if name == "collect":
        held = F.transform(F.collect_list(F.struct(x.col.alias("x"))), lambda s: s["x"])
        return Typed(F.array_distinct(held) if distinct else held, f"array<{x.kind}>" if x.kind else None)
    if name in ("min", "max"):
        return Typed(getattr(F, name)(x.col), x.kind)
    value = x.col if numeric(x.kind) else x.col.cast("double")
    if name == "sum":
        kind = "bigint" if x.kind in INTS else "double"
        return Typed(F.sum_distinct(value) if distinct else F.sum(value), kind)
    if name == "avg":
        return Typed(F.call_function("avg", value) if not distinct else F.sum_distinct(value) / F.count_distinct(value), "double")
    fn = F.stddev_samp if name == "stdev" else F.stddev_pop
    return Typed(fn(value), "double")
