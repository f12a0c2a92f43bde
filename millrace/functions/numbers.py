"""Methods of numbers."""

from __future__ import annotations

import math
import re
from typing import Any

from millrace.functions.strings import integer
from millrace.functions.table import expected, method
from millrace.functions.values import Float32, MappingError, add, is_number, is_text, plain_number, type_name, wrap


def number(v: Any) -> int | float:
    if not is_number(v):
        raise expected("number", v)
    return plain_number(v)


@method("abs")
def _abs(v):
    n = number(v)
    return min(abs(n), (1 << 63) - 1) if isinstance(n, int) else abs(n)


@method("ceil")
def _ceil(v):
    n = number(v)
    return n if isinstance(n, int) or not math.isfinite(n) else float(math.ceil(n))


@method("floor")
def _floor(v):
    n = number(v)
    return n if isinstance(n, int) or not math.isfinite(n) else float(math.floor(n))


@method("round")
def _round(v):
    n = number(v)
    return n if isinstance(n, int) or not math.isfinite(n) else math.copysign(math.floor(abs(n) + 0.5), n)


def _numbers(v: Any) -> list:
    if not isinstance(v, list):
        raise expected("array", v)
    for k, x in enumerate(v):
        if not is_number(x):
            raise MappingError(f"index {k} of array: expected number value, got {type_name(x)}")
    return [plain_number(x) for x in v]


@method("min")
def _min(v):
    n = _numbers(v)
    if not n:
        raise MappingError("the array was empty")
    return float(min(n))


@method("max")
def _max(v):
    n = _numbers(v)
    if not n:
        raise MappingError("the array was empty")
    return float(max(n))


@method("sum")
def _sum(v):
    out: Any = 0
    for x in _numbers(v):
        out = add(out, x)
    return out


def _wide(name: str, call) -> None:
    @method(name)
    def of(v):
        n = float(number(v))
        try:
            return call(n)
        except ValueError:
            return math.nan
        except OverflowError:
            return math.inf


for _name, _call in (("cos", math.cos), ("sin", math.sin), ("tan", math.tan), ("log", lambda n: -math.inf if n == 0 else math.log(n)), ("log10", lambda n: -math.inf if n == 0 else math.log10(n))):
    _wide(_name, _call)


@method("pow", "exponent")
def _pow(v, exponent):
    try:
        return float(math.pow(number(v), number(exponent)))
    except OverflowError:
        return math.inf
    except ValueError:
        return math.nan


@method("bitwise_and", "value")
def _and(v, value):
    return integer(v) & integer(value)


@method("bitwise_or", "value")
def _or(v, value):
    return integer(v) | integer(value)


@method("bitwise_xor", "value")
def _xor(v, value):
    return wrap(integer(v) ^ integer(value))


def _whole(name: str, low: int, high: int) -> None:
    @method(name)
    def of(v):
        if is_text(v) or isinstance(v, bytes):
            text = (v.decode("utf-8", "replace") if isinstance(v, bytes) else v).strip()
            if not re.fullmatch(r"[+-]?(0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO]?[0-7_]+|[0-9][0-9_]*)", text):
                raise MappingError(f"cannot convert {text!r} to {name}")
            digits = re.sub(r"^([+-]?)0(?=[0-7])", r"\g<1>0o", text.replace("_", ""))
            n: Any = int(digits, 0)
        else:
            n = number(v)
            if isinstance(n, float):
                if not math.isfinite(n) or n != int(n):
                    raise MappingError(f"value {n} is not an integer")
                n = int(n)
        if not low <= n <= high:
            raise MappingError(f"value {n} is out of range of {name}")
        return n


for _bits in (8, 16, 32, 64):
    _whole(f"int{_bits}", -(1 << _bits - 1), (1 << _bits - 1) - 1)
    _whole(f"uint{_bits}", 0, min((1 << _bits) - 1, (1 << 63) - 1))


def _float(v: Any) -> float:
    if is_text(v):
        try:
            return float(v)
        except ValueError:
            raise MappingError(f"cannot convert {v!r} to a float") from None
    return float(number(v))


@method("float64")
def _float64(v):
    return _float(v)


@method("float32")
def _float32(v):
    return Float32(_float(v))
