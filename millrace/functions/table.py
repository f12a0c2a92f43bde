"""The table of functions and methods: name, parameters, implementation. The parser's callers check names and arguments against it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from millrace.functions.values import MappingError, type_name

MISSING = object()


@dataclass(frozen=True)
class Entry:
    """``parameters``: names, ``?`` after optional ones, ``&`` before those that get a query instead of a value, ``...`` for any number.
    ``lazy``: the target is handed over unevaluated."""

    name: str
    parameters: tuple[str, ...]
    call: Callable[..., Any]
    lazy: bool = False
    context: bool = False
    doc: str = ""

    def bind(self, args: list, named: dict) -> list:
        """Arguments in the order of the parameters, MISSING for optional ones not given."""
        if self.parameters == ("...",):
            if named:
                raise ValueError(f"{self.name}: takes no named arguments")
            return list(args)
        names = [p.strip("?&") for p in self.parameters]
        if len(args) > len(names):
            raise ValueError(f"{self.name}: wrong number of arguments, expected at most {len(names)}, got {len(args)}")
        for n in named:
            if n not in names:
                raise ValueError(f"{self.name}: unknown argument {n!r}")
        out = []
        for k, p in enumerate(self.parameters):
            if k < len(args):
                out.append(args[k])
            elif names[k] in named:
                out.append(named[names[k]])
            elif p.endswith("?"):
                out.append(MISSING)
            else:
                raise ValueError(f"{self.name}: missing argument {names[k]!r}")
        return out

    def takes_query(self, k: int) -> bool:
        return k < len(self.parameters) and self.parameters[k].startswith("&")


METHODS: dict[str, Entry] = {}
FUNCTIONS: dict[str, Entry] = {}


def method(names: str, parameters: str = "", **options: Any):
    """Register a function of the target and the arguments that were given."""

    def add(call: Callable) -> Callable:
        for name in names.split():
            METHODS[name] = Entry(name, tuple(parameters.split()), call, doc=(call.__doc__ or "").strip(), **options)
        return call

    return add


def function(names: str, parameters: str = "", **options: Any):
    def add(call: Callable) -> Callable:
        for name in names.split():
            FUNCTIONS[name] = Entry(name, tuple(parameters.split()), call, doc=(call.__doc__ or "").strip(), **options)
        return call

    return add


def expected(kind: str, v: Any) -> MappingError:
    return MappingError(f"expected {kind} value, got {type_name(v)}")
