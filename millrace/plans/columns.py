"""Compile a mapping to Catalyst expressions where the schema gives every type; the exact evaluator does the rest.

An expression becomes a value and an error, both Columns: Spark may evaluate any branch, so errors are values that ``|``, ``or`` and
``catch`` look at, never exceptions. ``Unsupported`` means that the mapping needs the evaluator.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.table import METHODS
from millrace.plans.parser import Mapping, parse


class Unsupported(Exception):
    pass


LONG, DOUBLE, STRING, BOOL, BINARY, STAMP, NULL = T.LongType(), T.DoubleType(), T.StringType(), T.BooleanType(), T.BinaryType(), T.TimestampType(), T.NullType()


@dataclass(frozen=True)
class Val:
    """A Column, its type, the Column of its error (null where there's none) and, for literals, the Python value."""

    col: Column
    type: T.DataType
    err: Column | None = None
    literal: Any = None
    control: str = ""

    def __post_init__(self) -> None:
        if isinstance(self.type, (T.IntegerType, T.ShortType, T.ByteType)):
            object.__setattr__(self, "col", self.col.cast("long"))
            object.__setattr__(self, "type", LONG)
        elif isinstance(self.type, (T.FloatType, T.DecimalType)):
            object.__setattr__(self, "col", self.col.cast("double"))
            object.__setattr__(self, "type", DOUBLE)
        elif isinstance(self.type, T.TimestampNTZType):
            # a clock without a zone is taken for UTC's, whatever zone the session is in
            object.__setattr__(self, "col", F.convert_timezone(F.lit("UTC"), F.current_timezone(), self.col).cast("timestamp"))
            object.__setattr__(self, "type", STAMP)


def _worst(*errors: Column | None) -> Column | None:
    there = [e for e in errors if e is not None]
    return None if not there else there[0] if len(there) == 1 else F.coalesce(*there)


def _name(t: T.DataType) -> str:
    if isinstance(t, (T.LongType, T.DoubleType)):
        return "number"
    return {T.StringType: "string", T.BooleanType: "bool", T.BinaryType: "bytes", T.TimestampType: "timestamp", T.ArrayType: "array", T.StructType: "object", T.MapType: "object", T.NullType: "null"}.get(type(t), "unknown")


def numeric(v: Val) -> bool:
    return isinstance(v.type, (T.LongType, T.DoubleType))


def _is(v: Val, *kinds: type) -> None:
    if not isinstance(v.type, kinds):
        raise Unsupported(f"{_name(v.type)} target")


def guarded(v: Val, what: str) -> Val:
    """A null is a type error wherever a value of a kind is needed."""
    if v.literal is not None:
        return v
    return replace(v, err=_worst(v.err, F.when(v.col.isNull(), F.lit(f"expected {what} value, got null"))))


class Scope:
    """Where names are looked up: the document's struct, bound lambda names and variables."""

    def __init__(self, fields: dict[str, Val] | None, this: Val | None = None, names: dict[str, Val] | None = None, variables: dict[str, Val] | None = None, maps: dict | None = None, ids: dict[str, Column] | None = None):
        self.fields, self.this, self.names, self.variables, self.maps, self.ids = fields, this, names or {}, variables if variables is not None else {}, maps or {}, ids or {}

    def bound(self, v: Val, name: str | None) -> "Scope":
        if name is None:
            return Scope(None, v, self.names, self.variables, self.maps, self.ids)
        return Scope(self.fields, self.this, {**self.names, name: v}, self.variables, self.maps, self.ids)


def field_of(v: Val, name: str) -> Val:
    if isinstance(v.type, T.StructType):
        for f in v.type.fields:
            if f.name == name:
                return Val(v.col.getField(name), f.dataType, v.err)
        return Val(F.lit(None), NULL, v.err)
    if isinstance(v.type, T.MapType) and isinstance(v.type.keyType, T.StringType):
        return Val(F.try_element_at(v.col, F.lit(name)), v.type.valueType, v.err)
    if isinstance(v.type, T.ArrayType) and name.isdigit():
        return Val(F.get(v.col, F.lit(int(name))), v.type.elementType, v.err)
    if isinstance(v.type, T.NullType):
        return v
    return Val(F.lit(None), NULL, v.err)


def joined(a: T.DataType, b: T.DataType) -> T.DataType:
    """The one type that two branches share."""
    if a == b:
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(b, T.NullType):
        return a
    if {type(a), type(b)} == {T.LongType, T.DoubleType}:
        raise Unsupported("a number that is sometimes an integer")
    raise Unsupported(f"branches of types {_name(a)} and {_name(b)}")


class Lowering:
    def __init__(self, scope: Scope):
        self.scope = scope

    def at(self, node: tuple, scope: Scope | None = None) -> Val:
        if scope is not None and scope is not self.scope:
            return Lowering(scope).at(node)
        call = getattr(self, f"_{node[0]}", None)
        if call is None:
            raise Unsupported(node[0])
        return call(*node[1:])

    def _literal(self, v: Any) -> Val:
        if v is None:
            return Val(F.lit(None), NULL)
        kind = BOOL if isinstance(v, bool) else LONG if isinstance(v, int) else DOUBLE if isinstance(v, float) else STRING
        return Val(F.lit(v).cast(kind), kind, None, v)

    def _this(self) -> Val:
        s = self.scope
        if s.this is not None:
            return s.this
        kinds = T.StructType([T.StructField(k, v.type) for k, v in sorted(s.fields.items())])
        return Val(F.struct(*(v.col.alias(k) for k, v in sorted(s.fields.items()))), kinds)

    def _bare(self, name: str) -> Val:
        s = self.scope
        if name in s.names:
            return s.names[name]
        if s.this is not None:
            return field_of(s.this, name)
        return s.fields.get(name, Val(F.lit(None), NULL))

    def _field(self, target: tuple, name: str) -> Val:
        if target == ("this",) and self.scope.this is None:
            return self.scope.fields.get(name, Val(F.lit(None), NULL))
        return field_of(self.at(target), name)

    def _variable(self, name: str) -> Val:
        if name not in self.scope.variables:
            raise Unsupported(f"variable {name}")
        return self.scope.variables[name]

    def _metadata(self, key: str | None) -> Val:
        if key is None or "meta" not in self.scope.ids:
            raise Unsupported("all metadata")
        return Val(F.try_element_at(self.scope.ids["meta"], F.lit(key)), STRING)

    def _index(self, target: tuple, index: tuple) -> Val:
        v, k = self.at(target), self.at(index)
        _is(v, T.ArrayType)
        _is(k, T.LongType)
        n = F.size(v.col)
        out = F.when((k.col >= n) | (k.col < -n), F.concat(F.lit("index "), k.col.cast("string"), F.lit(" was out of bounds for array size: "), n.cast("string")))
        return Val(F.get(v.col, F.when(k.col < 0, k.col + n).otherwise(k.col).cast("int")), v.type.elementType, _worst(v.err, k.err, out))

    def _not(self, x: tuple) -> Val:
        v = guarded(self.at(x), "bool")
        _is(v, T.BooleanType)
        return Val(~v.col, BOOL, v.err)

    def _minus(self, x: tuple) -> Val:
        return arithmetic("-", Val(F.lit(0).cast("long"), LONG, None, 0), self.at(x)) if not isinstance(self.at(x).type, T.DoubleType) else Val(-self.at(x).col, DOUBLE, guarded(self.at(x), "number").err)

    def _binary(self, o: str, a: tuple, b: tuple) -> Val:
        if o == "|":
            return fallback(self.at(a), self.at(b))
        x, y = self.at(a), self.at(b)
        if o in ("&&", "||"):
            x, y = guarded(x, "bool"), guarded(y, "bool")
            _is(x, T.BooleanType)
            _is(y, T.BooleanType)
            stop = x.col if o == "||" else ~x.col
            late = None if y.err is None else F.when(~F.coalesce(stop, F.lit(False)), y.err)
            return Val(x.col | y.col if o == "||" else x.col & y.col, BOOL, _worst(x.err, late))
        if o in "+-*/%":
            return arithmetic(o, x, y)
        return comparison(o, x, y)

    def _array(self, items: list) -> Val:
        parts = [self.at(i) for i in items]
        if any(p.control for p in parts):
            raise Unsupported("control values in an array")
        kind: T.DataType = NULL
        for p in parts:
            kind = joined(kind, p.type)
        return Val(F.array(*(p.col for p in parts)), T.ArrayType(kind), _worst(*(p.err for p in parts)))

    def _object(self, pairs: list) -> Val:
        parts = {}
        for k, v in pairs:
            if k[0] != "literal" or not isinstance(k[1], str):
                raise Unsupported("computed keys")
            parts[k[1]] = self.at(v)
        if any(p.control for p in parts.values()) or not parts:
            raise Unsupported("control values in an object")
        return Val(F.struct(*(parts[k].col.alias(k) for k in sorted(parts))), T.StructType([T.StructField(k, parts[k].type) for k in sorted(parts)]), _worst(*(p.err for p in parts.values())))

    def _if(self, arms: list, other: tuple | None) -> Val:
        return chosen([(guarded(self.at(t), "bool"), self.at(v)) for t, v in arms], self.at(other) if other is not None else Val(F.lit(None), NULL, control="nothing"))

    def _match(self, context: tuple | None, arms: list) -> Val:
        value = self.at(context) if context is not None else None
        inner = self.scope.bound(value, None) if value is not None else self.scope
        found, other = [], Val(F.lit(None), NULL, control="nothing")
        for test, then in arms:
            if test == ("any",):
                other = Lowering(inner).at(then)
                break
            if test[0] == "literal" and value is not None:
                t = comparison("==", value, self.at(test))
            else:
                t = Lowering(inner).at(test)
                _is(t, T.BooleanType)
                t = Val(F.coalesce(F.when(t.err.isNull(), t.col) if t.err is not None else t.col, F.lit(False)), BOOL)
            found.append((t, Lowering(inner).at(then)))
        return chosen(found, other) if found else other

    def _within(self, target: tuple, body: tuple) -> Val:
        name, inner = (body[1], body[2]) if body[0] == "lambda" else (None, body)
        return self.at(inner, self.scope.bound(self.at(target), name))

    def _call(self, name: str, args: list, named: dict, line: int) -> Val:
        call = CALLS.get(name)
        if call is None or named:
            raise Unsupported(f"function {name}")
        return call(self, *args)

    def _method(self, target: tuple, name: str, args: list, named: dict, line: int) -> Val:
        call = LOWERED.get(name)
        if call is None:
            raise Unsupported(f"method {name}")
        bound = [a for a in METHODS[name].bind(args, named) if not isinstance(a, object) or isinstance(a, tuple)]
        if name in ("or", "catch"):
            return fallback(self.at(target), self.at(bound[0][2] if bound[0][0] == "lambda" else bound[0]), errors_only=name == "catch")
        return call(self, self.at(target), *bound)

    def element(self, body: tuple, kind: T.DataType) -> Callable[[Column], Val]:
        name, inner = (body[1], body[2]) if body[0] == "lambda" else (None, body)
        return lambda c: self.at(inner, self.scope.bound(Val(c, kind), name))


def fallback(a: Val, b: Val, errors_only: bool = False) -> Val:
    kind = joined(a.type, b.type)
    bad = a.err.isNotNull() if a.err is not None else F.lit(False)
    if not errors_only:
        bad = bad | a.col.isNull()
    return Val(F.when(bad, b.col).otherwise(a.col), kind, None if b.err is None else F.when(bad, b.err))


def chosen(arms: list[tuple[Val, Val]], other: Val) -> Val:
    controls = [v.control for _, v in arms if v.control] + [other.control] * bool(other.control)
    kind = other.type
    for _, v in arms:
        kind = joined(kind, v.type)
    col, err, mark = other.col, other.err if other.err is not None else F.lit(None).cast("string"), F.lit(other.control)
    for t, v in reversed(arms):
        col = F.when(t.col, v.col).otherwise(col)
        mark = F.when(t.col, F.lit(v.control)).otherwise(mark)
        own = v.err if v.err is not None else F.lit(None).cast("string")
        err = F.when(t.err.isNotNull(), t.err).when(t.col, own).otherwise(err) if t.err is not None else F.when(t.col, own).otherwise(err)
    out = Val(col, kind, err)
    return replace(out, control="mixed", literal=mark) if controls else out


def arithmetic(o: str, x: Val, y: Val) -> Val:
    if o == "+" and isinstance(x.type, T.StringType) and isinstance(y.type, T.StringType):
        return Val(F.concat(x.col, y.col), STRING, _worst(x.err, y.err, _nulls("add", x, y)))
    if not numeric(x) or not numeric(y):
        raise Unsupported(f"{_name(x.type)} {o} {_name(y.type)}")
    what = {"+": "add", "-": "subtract", "*": "multiply", "/": "divide", "%": "modulo"}[o]
    err = _worst(x.err, y.err, _nulls(what, x, y))
    if o in "/%":
        a, b = (x.col.cast("double"), y.col.cast("double")) if o == "/" else (_long(x), _long(y))
        zero = b == 0
        out = F.when(zero, None).otherwise(a / b if o == "/" else F.when(b == -1, F.lit(0).cast("long")).otherwise(a % b))
        return Val(out, DOUBLE if o == "/" else LONG, _worst(err, F.when(zero, F.lit("attempted to divide by zero"))))
    if isinstance(x.type, T.LongType) and isinstance(y.type, T.LongType):
        return Val(wrapped(o, x.col, y.col), LONG, err)
    a, b = x.col.cast("double"), y.col.cast("double")
    return Val(a + b if o == "+" else a - b if o == "-" else a * b, DOUBLE, err)


def wrapped(o: str, a: Column, b: Column) -> Column:
    """64-bit arithmetic that wraps; in ANSI mode Spark's operators raise, so an overflow goes by way of wide decimals."""
    quick = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[o](a, b)
    wide = lambda c: c.cast("decimal(38,0)")
    full = wide(a) + wide(b) if o == "+" else wide(a) - wide(b) if o == "-" else wide(a) * wide(b)
    modulus = F.lit(str(1 << 64)).cast("decimal(38,0)")
    rest = F.pmod(full.cast("decimal(38,0)"), modulus)
    return F.coalesce(quick, F.when(rest >= F.lit(str(1 << 63)).cast("decimal(38,0)"), rest - modulus).otherwise(rest).cast("long"))


def _nulls(what: str, x: Val, y: Val) -> Column | None:
    names = [F.when(v.col.isNull(), F.lit("null")).otherwise(F.lit(_name(v.type))) for v in (x, y)]
    if x.literal is not None and y.literal is not None:
        return None
    return F.when(x.col.isNull() | y.col.isNull(), F.concat(F.lit(f"cannot {what} types "), names[0], F.lit(" and "), names[1]))


def _long(v: Val) -> Column:
    return v.col if isinstance(v.type, T.LongType) else F.when(F.abs(v.col) < 9.2e18, v.col.cast("long")).otherwise(F.lit(0).cast("long"))


def comparison(o: str, x: Val, y: Val) -> Val:
    err = _worst(x.err, y.err)
    if o in ("==", "!="):
        if isinstance(x.type, T.NullType) or isinstance(y.type, T.NullType) or type(x.type) is type(y.type) or numeric(x) and numeric(y):
            same = x.col.eqNullSafe(y.col)
        else:
            same = x.col.isNull() & y.col.isNull()
        return Val(same if o == "==" else ~same, BOOL, err)
    if not (numeric(x) and numeric(y) or isinstance(x.type, T.StringType) and isinstance(y.type, T.StringType)):
        raise Unsupported(f"{_name(x.type)} {o} {_name(y.type)}")
    a, b = (x.col.cast("double"), y.col.cast("double")) if numeric(x) else (x.col, y.col)
    return Val({"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[o], BOOL, _worst(err, _nulls("compare", x, y)))


LOWERED: dict[str, Callable] = {"or": lambda *a: None, "catch": lambda *a: None}
CALLS: dict[str, Callable] = {}


def lowered(names: str, kind: type | tuple, what: str):
    """Register a lowering of (target, arguments) for targets of a kind; a null target is an error."""

    def add(call: Callable) -> Callable:
        def run(low: Lowering, v: Val, *args: tuple) -> Val:
            if not isinstance(v.type, kind):
                raise Unsupported(f"{names} of {_name(v.type)}")
            return call(low, guarded(v, what), *args)

        for n in names.split():
            LOWERED[n] = run
        return call

    return add


def simple(names: str, kind: type | tuple, what: str, out: T.DataType | None, call: Callable) -> None:
    """A method of the target and literal or column arguments that one expression computes."""

    def run(low: Lowering, v: Val, *args: tuple) -> Val:
        given = [low.at(a) for a in args]
        return Val(call(v.col, *(g.col for g in given)), out or v.type, _worst(v.err, *(guarded(g, _name(g.type)).err for g in given)))

    lowered(names, kind, what)(run)


def _text(low: Lowering, node: tuple) -> str:
    v = low.at(node)
    if not isinstance(v.literal, str):
        raise Unsupported("an argument that isn't a literal")
    return v.literal


def _case(c: Column, upper: bool) -> Column:
    whole = F.upper if upper else F.lower
    one = F.transform(F.split(c, ""), lambda x: F.when(F.char_length(whole(x)) == 1, whole(x)).otherwise(x))
    return F.when(F.octet_length(c) == F.char_length(c), whole(c)).otherwise(F.array_join(one, ""))


def _sliced(low: Lowering, v: Val, start: tuple, stop: tuple | None = None) -> Val:
    lo, hi = low.at(start), low.at(stop) if stop else None
    of_list = isinstance(v.type, T.ArrayType)
    n = F.size(v.col) if of_list else F.octet_length(v.col)
    bound = lambda c: F.least(F.greatest(F.when(c < 0, c + n).otherwise(c), F.lit(0)), n)
    a = bound(lo.col)
    b = bound(hi.col) if hi else n
    err = _worst(v.err, lo.err, hi.err if hi else None, F.when(a > b, F.lit("lower slice bound is above the upper")))
    if of_list:
        return Val(F.slice(v.col, (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int")), v.type, err)
    return Val(F.substring(v.col.cast("binary"), (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int")).cast("string"), STRING, err)


S, A, N, B = T.StringType, T.ArrayType, (T.LongType, T.DoubleType), T.BooleanType
simple("uppercase", S, "string", STRING, lambda c: _case(c, True))
simple("lowercase", S, "string", STRING, lambda c: _case(c, False))
simple("trim", S, "string", STRING, lambda c, cut=None: F.btrim(c, F.lit(" \t\n\r\f\x0b") if cut is None else cut))
simple("trim_prefix", S, "string", STRING, lambda c, p: F.when(F.startswith(c, p), F.substring(c, F.char_length(p) + 1, F.char_length(c))).otherwise(c))
simple("trim_suffix", S, "string", STRING, lambda c, p: F.when(F.endswith(c, p), F.left(c, F.char_length(c) - F.char_length(p))).otherwise(c))
simple("has_prefix", S, "string", BOOL, F.startswith)
simple("has_suffix", S, "string", BOOL, F.endswith)
simple("replace_all replace", S, "string", STRING, lambda c, a, b: F.when(a == "", F.regexp_replace(c, F.lit(""), b)).otherwise(F.replace(c, a, b)))
simple("reverse", S, "string", STRING, F.reverse)
simple("repeat", S, "string", STRING, lambda c, n: F.array_join(F.array_repeat(c, F.greatest(n, F.lit(0)).cast("int")), ""))
simple("index_of", S, "string", LONG, lambda c, x: F.when(F.contains(c, x), F.octet_length(F.substring(c, F.lit(1), F.instr(c, x) - 1))).otherwise(F.lit(-1)).cast("long"))
simple("escape_html", S, "string", STRING, lambda c: F.replace(F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&#34;")), F.lit("'"), F.lit("&#39;")))
simple("escape_url_query", S, "string", STRING, lambda c: F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~")))
simple("unescape_url_query", S, "string", STRING, F.try_url_decode)
simple("bytes", S, "string", BINARY, lambda c: c.cast("binary"))
simple("abs", T.LongType, "number", LONG, lambda c: F.when(c == -(1 << 63), F.lit((1 << 63) - 1)).otherwise(F.abs(c)))
simple("pow", N, "number", DOUBLE, lambda c, e: F.pow(c.cast("double"), e.cast("double")))
for _n, _f in (("sin", F.sin), ("cos", F.cos), ("tan", F.tan)):
    simple(_n, N, "number", DOUBLE, _f)
for _n, _f in (("log", F.log), ("log10", F.log10)):
    simple(_n, N, "number", DOUBLE, lambda c, f=_f: F.when(c == 0, F.lit(float("-inf"))).when(c < 0, F.lit(float("nan"))).otherwise(f(c.cast("double"))))
for _n, _o in (("and", "bitwiseAND"), ("or", "bitwiseOR"), ("xor", "bitwiseXOR")):
    simple(f"bitwise_{_n}", T.LongType, "number", LONG, lambda c, x, o=_o: getattr(c, o)(x))
simple("not", B, "bool", BOOL, lambda c: ~c)
simple("float64", N, "number", DOUBLE, lambda c: c.cast("double"))
simple("int64", T.LongType, "number", LONG, lambda c: c)
simple("ts_unix format_timestamp_unix", T.TimestampType, "timestamp", LONG, F.unix_seconds)
simple("ts_unix_milli format_timestamp_unix_milli", T.TimestampType, "timestamp", LONG, F.unix_millis)
simple("ts_unix_micro format_timestamp_unix_micro", T.TimestampType, "timestamp", LONG, F.unix_micros)
simple("ts_unix_nano format_timestamp_unix_nano", T.TimestampType, "timestamp", LONG, lambda c: F.unix_micros(c) * 1000)
simple("ts_sub", T.TimestampType, "timestamp", LONG, lambda a, b: (F.unix_micros(a) - F.unix_micros(b)) * 1000)
simple("ts_round", T.TimestampType, "timestamp", STAMP, lambda c, d: F.timestamp_micros(F.floor((F.unix_micros(c) * 1000 + F.floor(d / 2)) / d).cast("long") * (d / 1000).cast("long")))
simple("unique", A, "array", None, F.array_distinct)
simple("find", A, "array", LONG, lambda c, x: (F.coalesce(F.array_position(c, x), F.lit(0)) - 1).cast("long"))


@lowered("abs", T.DoubleType, "number")
def _abs(low, v):
    return Val(F.abs(v.col), DOUBLE, v.err)


_abs_double = LOWERED["abs"]
simple("abs", T.LongType, "number", LONG, lambda c: F.when(c == -(1 << 63), F.lit((1 << 63) - 1)).otherwise(F.abs(c)))
_abs_long = LOWERED["abs"]
LOWERED["abs"] = lambda low, v: _abs_double(low, v) if isinstance(v.type, T.DoubleType) else _abs_long(low, v)


def _rounded(name: str, f: Callable) -> None:
    @lowered(name, N, "number")
    def run(low, v):
        return v if isinstance(v.type, T.LongType) else Val(F.when(F.abs(v.col) < 9e15, f(v.col).cast("double")).otherwise(v.col), DOUBLE, v.err)


_rounded("ceil", F.ceil)
_rounded("floor", F.floor)
_rounded("round", lambda c: F.round(c, 0))


@lowered("slice", (S, A), "string or array")
def _slice(low, v, start, stop=None):
    return _sliced(low, v, start, stop)


@lowered("split", S, "string")
def _split(low, v, delimiter):
    import re

    d = _text(low, delimiter)
    if d == "":
        raise Unsupported("an empty delimiter")
    return Val(F.split(v.col, re.escape(d), -1), T.ArrayType(STRING), v.err)


@lowered("join", A, "array")
def _join(low, v, delimiter=None):
    if not isinstance(v.type.elementType, T.StringType):
        raise Unsupported("join of other elements")
    return Val(F.array_join(v.col, _text(low, delimiter) if delimiter else ""), STRING, _worst(v.err, F.when(F.exists(v.col, lambda x: x.isNull()), F.lit("failed to join element: expected string value, got null"))))


@lowered("length", (S, A), "string or array")
def _length(low, v):
    return Val((F.size(v.col) if isinstance(v.type, T.ArrayType) else F.octet_length(v.col)).cast("long"), LONG, v.err)


@lowered("contains", (S, A), "string or array")
def _contains(low, v, x):
    y = guarded(low.at(x), "string")
    return Val(F.contains(v.col, y.col) if isinstance(v.type, T.StringType) else F.coalesce(F.array_contains(v.col, y.col), F.lit(False)), BOOL, _worst(v.err, y.err))


@lowered("sum", A, "array")
def _sum(low, v):
    kind = Val(F.lit(0), v.type.elementType).type
    if not isinstance(kind, (T.LongType, T.DoubleType)):
        raise Unsupported("sum of other elements")
    zero = F.lit(0).cast(kind)
    return Val(F.aggregate(v.col.cast(T.ArrayType(kind)), zero, lambda a, x: wrapped("+", a, x) if isinstance(kind, T.LongType) else a + x), kind, v.err)


def _extreme(name: str, f: Callable) -> None:
    @lowered(name, A, "array")
    def run(low, v):
        return Val(f(v.col.cast(T.ArrayType(DOUBLE))), DOUBLE, _worst(v.err, F.when(F.size(v.col) == 0, F.lit("the array was empty"))))


_extreme("min", F.array_min)
_extreme("max", F.array_max)


@lowered("map_each", A, "array")
def _map_each(low, v, body):
    of = low.element(body, v.type.elementType)
    probe: list[Val] = []

    def run(x: Column) -> Column:
        probe.append(of(x))
        return probe[-1].col

    out = F.transform(v.col, run)
    if probe[0].control:
        raise Unsupported("control values in map_each")
    errors = None if probe[0].err is None else F.get(F.filter(F.transform(v.col, lambda x: of(x).err), lambda e: e.isNotNull()), F.lit(0))
    return Val(out, T.ArrayType(probe[0].type), _worst(v.err, errors))


@lowered("filter", A, "array")
def _filter(low, v, body):
    of = low.element(body, v.type.elementType)
    errors = F.filter(F.transform(v.col, lambda x: _err(of(x))), lambda e: e.isNotNull())
    return Val(F.filter(v.col, lambda x: of(x).col), v.type, _worst(v.err, F.get(errors, F.lit(0))))


def _err(v: Val) -> Column:
    _is(v, T.BooleanType)
    return v.err if v.err is not None else F.lit(None).cast("string")


@lowered("any", A, "array")
def _any(low, v, body):
    of = low.element(body, v.type.elementType)
    return Val(F.coalesce(F.exists(v.col, lambda x: F.coalesce(of(x).col, F.lit(False))), F.lit(False)), BOOL, v.err)


@lowered("all", A, "array")
def _all(low, v, body):
    of = low.element(body, v.type.elementType)
    return Val((F.size(v.col) > 0) & F.forall(v.col, lambda x: F.coalesce(of(x).col, F.lit(False))), BOOL, v.err)


@lowered("fold", A, "array")
def _fold(low, v, initial, body):
    first = low.at(initial)
    kind = T.StructType([T.StructField("tally", first.type), T.StructField("value", v.type.elementType)])

    def step(a: Column, x: Column) -> Column:
        out = low.at(body[2] if body[0] == "lambda" else body, low.scope.bound(Val(F.struct(a.alias("tally"), x.alias("value")), kind), body[1] if body[0] == "lambda" else None))
        joined(first.type, out.type)
        return out.col

    return Val(F.aggregate(v.col, first.col, step), first.type, _worst(v.err, first.err))


@lowered("sort", A, "array")
def _sort(low, v, *compare):
    if compare or not isinstance(v.type.elementType, (T.LongType, T.DoubleType, T.StringType, T.IntegerType, T.FloatType)):
        raise Unsupported("a sort of other elements")
    return Val(F.array_sort(v.col), v.type, v.err)


@lowered("flatten", A, "array")
def _flatten(low, v):
    return Val(F.flatten(v.col), v.type.elementType, v.err) if isinstance(v.type.elementType, T.ArrayType) else v


@lowered("enumerated", A, "array")
def _enumerated(low, v):
    kind = T.StructType([T.StructField("index", LONG), T.StructField("value", v.type.elementType)])
    return Val(F.transform(v.col, lambda x, i: F.struct(i.cast("long").alias("index"), x.alias("value"))), T.ArrayType(kind), v.err)


@lowered("append", A, "array")
def _append(low, v, *items):
    parts = [low.at(i) for i in items]
    for p in parts:
        joined(v.type.elementType, p.type)
    return Val(F.concat(v.col, F.array(*(p.col for p in parts))), v.type, _worst(v.err, *(p.err for p in parts)))


@lowered("concat", A, "array")
def _concat(low, v, *others):
    parts = [guarded(low.at(i), "array") for i in others]
    for p in parts:
        joined(v.type, p.type)
    return Val(F.concat(v.col, *(p.col for p in parts)), v.type, _worst(v.err, *(p.err for p in parts)))


LOWERED["array"] = lambda low, v: v if isinstance(v.type, T.ArrayType) else Val(F.array(v.col), T.ArrayType(v.type), v.err)
LOWERED["type"] = lambda low, v: Val(F.when(v.col.isNull(), F.lit("null")).otherwise(F.lit(_name(v.type))), STRING, v.err)
LOWERED["not_null"] = lambda low, v: replace(v, err=_worst(v.err, F.when(v.col.isNull(), F.lit("value is null"))))


@lowered("not_empty", (S, A), "string or array")
def _not_empty(low, v):
    n = F.size(v.col) if isinstance(v.type, T.ArrayType) else F.octet_length(v.col)
    return replace(v, err=_worst(v.err, F.when(n == 0, F.lit(f"{_name(v.type)} value is empty"))))


def _string(low: Lowering, v: Val) -> Val:
    if isinstance(v.type, T.StringType):
        return Val(F.coalesce(v.col, F.lit("null")), STRING, v.err)
    if isinstance(v.type, (T.LongType, T.BooleanType)):
        return Val(F.coalesce(v.col.cast("string"), F.lit("null")), STRING, v.err)
    if isinstance(v.type, T.BinaryType):
        return Val(F.decode(v.col, "UTF-8"), STRING, v.err)
    raise Unsupported(f"string of {_name(v.type)}")


LOWERED["string"] = _string


@lowered("number", (T.LongType, T.DoubleType, S), "number")
def _number(low, v, default=None):
    n = v.col.cast("double") if numeric(v) else F.when(v.col.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), v.col.try_cast("double"))
    err = _worst(v.err, F.when(n.isNull(), F.lit("the text is not a number")))
    if default is not None:
        d = low.at(default)
        _is(d, T.LongType, T.DoubleType)
        if isinstance(d.type, T.LongType):
            raise Unsupported("an integer default")
        return Val(F.coalesce(n, d.col), DOUBLE)
    return Val(n, DOUBLE, err)


@lowered("hash", S, "string")
def _hash(low, v, algorithm, *more):
    kind = _text(low, algorithm)
    if more:
        raise Unsupported("a keyed hash")
    made = {"md5": lambda c: F.unhex(F.md5(c)), "sha1": lambda c: F.unhex(F.sha1(c)), "sha256": lambda c: F.unhex(F.sha2(c, 256)), "sha512": lambda c: F.unhex(F.sha2(c, 512)), "crc32": lambda c: F.unhex(F.lpad(F.hex(F.crc32(c)), 8, "0"))}.get(kind)
    if made is None:
        raise Unsupported(f"hash {kind}")
    return Val(made(v.col.cast("binary")), BINARY, v.err)


@lowered("encode", (S, T.BinaryType), "string")
def _encode(low, v, scheme):
    kind, raw = _text(low, scheme), v.col.cast("binary")
    if kind == "hex":
        return Val(F.lower(F.hex(raw)), STRING, v.err)
    plain = F.regexp_replace(F.base64(raw), r"[\r\n]", "")
    if kind == "base64":
        return Val(plain, STRING, v.err)
    if kind in ("base64url", "base64rawurl"):
        out = F.translate(plain, "+/", "-_")
        return Val(F.rtrim(out, F.lit("=")) if kind == "base64rawurl" else out, STRING, v.err)
    raise Unsupported(f"encoding {kind}")


def utc_wall(stamp: Column) -> Column:
    """The clock of UTC at an instant as a timestamp without a zone, whatever zone the session is in."""
    seconds = (F.unix_micros(stamp).cast("decimal(20,0)") / F.lit(1_000_000)).cast("decimal(18,6)")
    return F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


_STRFTIME = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "y": "yy", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "j": "DDD", "I": "hh", "p": "a", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "R": "HH:mm", "f": "SSSSSS"}


@lowered("ts_strftime format_timestamp_strftime", T.TimestampType, "timestamp")
def _strftime(low, v, form, *tz):
    import re

    if tz:
        raise Unsupported("a time zone")
    out = []
    for part in re.findall(r"%.|[^%]+", _text(low, form)):
        if part[0] == "%":
            if part[1] not in _STRFTIME:
                raise Unsupported(f"directive {part}")
            out.append(_STRFTIME[part[1]])
        else:
            out.append("'" + part.replace("'", "''") + "'")
    return Val(F.date_format(utc_wall(v.col), "".join(out)), STRING, v.err)


def _java(pattern: str) -> str:
    if any(x in pattern for x in ("(?P<", "\\z", "\\C", "[[:")):
        raise Unsupported("a regular expression of another dialect")
    return pattern


@lowered("re_match", S, "string")
def _re_match(low, v, pattern):
    return Val(v.col.rlike(_java(_text(low, pattern))), BOOL, v.err)


@lowered("re_replace_all re_replace", S, "string")
def _re_replace(low, v, pattern, value):
    import re

    p, t = _java(_text(low, pattern)), _text(low, value)
    groups = re.compile(p).groups
    if "\\" in t or any(int(g) > groups for g in re.findall(r"\$(\d+)", t)) or re.search(r"\$(?!\d)", t):
        raise Unsupported("a template with other groups")
    return Val(F.regexp_replace(v.col, p, t), STRING, v.err)


@lowered("re_find_all", S, "string")
def _re_find_all(low, v, pattern):
    p = _java(_text(low, pattern))
    import re

    if re.compile(p).match(""):
        raise Unsupported("a pattern that matches nothing")
    return Val(F.regexp_extract_all(v.col, F.lit(p), F.lit(0)), T.ArrayType(STRING), v.err)


def _keys(low: Lowering, v: Val) -> Val:
    if isinstance(v.type, T.StructType):
        return Val(F.array(*(F.lit(n) for n in sorted(v.type.names))), T.ArrayType(STRING), v.err)
    raise Unsupported("keys of a map")


LOWERED["keys"] = _keys


@lowered("get", T.StructType, "object")
def _get(low, v, path):
    for part in _text(low, path).split("."):
        v = field_of(v, part)
    return v


@lowered("with", T.StructType, "object")
def _with(low, v, *paths):
    wanted = [_text(low, p) for p in paths]
    if any("." in w for w in wanted):
        raise Unsupported("nested paths")
    kept = [f for f in v.type.fields if f.name in wanted]
    if not kept:
        raise Unsupported("an empty object")
    return Val(F.struct(*(v.col.getField(f.name).alias(f.name) for f in kept)), T.StructType(kept), v.err)


@lowered("without", T.StructType, "object")
def _without(low, v, *paths):
    gone = [_text(low, p) for p in paths]
    if any("." in w for w in gone):
        raise Unsupported("nested paths")
    kept = [f for f in v.type.fields if f.name not in gone]
    return Val(F.struct(*(v.col.getField(f.name).alias(f.name) for f in kept)), T.StructType(kept), v.err)


CALLS["deleted"] = lambda low: Val(F.lit(None), NULL, control="deleted")
CALLS["nothing"] = lambda low: Val(F.lit(None), NULL, control="nothing")
CALLS["pi"] = lambda low: Val(F.pi(), DOUBLE)
CALLS["now"] = lambda low: Val(F.current_timestamp(), STAMP)
CALLS["throw"] = lambda low, why: Val(F.lit(None), NULL, low.at(why).col)


def _identity(name: str, kind: T.DataType) -> None:
    def run(low: Lowering, *args: tuple) -> Val:
        if name not in low.scope.ids or args:
            raise Unsupported(f"function {name}")
        return Val(low.scope.ids[name], kind)

    CALLS[name] = run


for _n, _k in (("batch_index", LONG), ("batch_size", LONG), ("error", STRING), ("errored", BOOL)):
    _identity(_n, _k)


def _meta_call(low: Lowering, *args: tuple) -> Val:
    if len(args) != 1 or "meta" not in low.scope.ids:
        raise Unsupported("all metadata")
    return Val(F.try_element_at(low.scope.ids["meta"], low.at(args[0]).col), STRING)


CALLS["meta"] = CALLS["metadata"] = _meta_call


def _range(low: Lowering, start: tuple, stop: tuple, step: tuple | None = None) -> Val:
    a, b, s = low.at(start), low.at(stop), low.at(step) if step else Val(F.lit(1).cast("long"), LONG, None, 1)
    n = ((b.col - a.col) / s.col).cast("long")
    bad = F.when(n <= 0, F.lit("the range is empty"))
    return Val(F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(n - 1, F.lit(0))), lambda k: a.col + k * s.col)), T.ArrayType(LONG), _worst(a.err, b.err, s.err, bad))


CALLS["range"] = _range


@dataclass
class Compiled:
    """Fields of the new document, the filter of deleted ones (null: none), the error (null: none), metadata that was written."""

    fields: dict[str, Val]
    deleted: Column | None
    error: Column | None
    meta: Column | None
    root: Val | None = None


def compile_mapping(text: str | Mapping, fields: dict[str, Val], ids: dict[str, Column] | None = None, mutate: bool = False) -> Compiled:
    """Compile a mapping over a document of typed fields, or raise Unsupported."""
    mapping = parse(text) if isinstance(text, str) else text
    scope = Scope(fields, maps=mapping.maps, ids=ids)
    low = Lowering(scope)
    out: dict[str, Val] = dict(fields) if mutate else {}
    whole: Val | None = None
    deleted, meta = None, (ids or {}).get("meta")
    errors: list[Column] = []
    wrote = False
    for s in mapping.statements:
        kind, target, node, line = s if len(s) == 4 else (s[0], None, None, s[-1])
        if kind == "when":
            raise Unsupported("branches of statements")
        v = low.at(node)
        if v.err is not None:
            errors.append(F.when(v.err.isNotNull(), F.concat(F.lit(f"failed assignment (line {line}): "), v.err)))
        if kind == "let":
            if v.control:
                raise Unsupported("a control value in a variable")
            scope.variables[target] = v
        elif kind == "meta":
            if target is None or v.control or meta is None or not isinstance(v.type, T.StringType):
                raise Unsupported("metadata that isn't text")
            pair = F.create_map(F.lit(target[1]), v.col)
            meta = F.map_concat(F.map_filter(meta, lambda k, _: k != target[1]), pair)
            wrote = True
        elif not target:
            if v.control == "deleted":
                deleted = F.lit(True)
            elif v.control == "mixed":
                if not isinstance(v.type, T.NullType):
                    raise Unsupported("a root that is sometimes kept")
                deleted = (v.literal == "deleted") if deleted is None else deleted | (v.literal == "deleted")
            elif v.control:
                continue
            elif isinstance(v.type, T.StructType):
                out, whole = {f.name: Val(v.col.getField(f.name), f.dataType) for f in v.type.fields}, None
                if node == ("this",) and scope.this is None:
                    out = dict(fields)
            else:
                out, whole = {}, v
        else:
            if whole is not None:
                whole, out = None, {}
            if v.control == "deleted":
                if len(target) > 1:
                    raise Unsupported("a nested path")
                out.pop(target[0], None)
            elif v.control == "nothing":
                continue
            elif v.control == "mixed":
                old = out.get(target[0]) if len(target) == 1 else None
                if old is None or isinstance(v.type, T.NullType):
                    raise Unsupported("a field that is sometimes kept")
                joined(old.type, v.type)
                out[target[0]] = Val(F.when(v.literal == "nothing", old.col).otherwise(v.col), v.type)
            else:
                out[target[0]] = _nested(out.get(target[0]), target[1:], v)
    return Compiled(out, deleted, _worst(*errors), meta if wrote else None, whole)


def _nested(old: Val | None, path: list[str], v: Val) -> Val:
    if not path:
        return Val(v.col, v.type)
    below = {f.name: Val(old.col.getField(f.name), f.dataType) for f in old.type.fields} if old is not None and isinstance(old.type, T.StructType) else {}
    below[path[0]] = _nested(below.get(path[0]), path[1:], v)
    names = sorted(below)
    return Val(F.struct(*(below[n].col.alias(n) for n in names)), T.StructType([T.StructField(n, below[n].type) for n in names]))
