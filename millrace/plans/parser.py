"""Mapping text to a syntax tree of tuples: the first item names the node, the last is the line where that helps errors."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

MOST_NESTING = 256
LEVELS = (("*", "/", "%", "|"), ("+", "-"), ("==", "!=", "<=", ">=", "<", ">"), ("&&", "||"))
_NUMBER = re.compile(r"\d+(\.\d+)?")
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
_PART = re.compile(r"[A-Za-z0-9_~\-]+|\*")
_KEYWORDS = {"true": True, "false": False, "null": None}


class ParseError(ValueError):
    pass


@dataclass
class Mapping:
    statements: list[tuple]
    maps: dict[str, "Mapping"] = field(default_factory=dict)
    text: str = ""


class Parser:
    def __init__(self, text: str):
        self.text, self.at, self.depth = text, 0, 0

    # text
    def line(self, at: int | None = None) -> int:
        return self.text.count("\n", 0, self.at if at is None else at) + 1

    def fail(self, what: str) -> ParseError:
        start = self.text.rfind("\n", 0, self.at) + 1
        return ParseError(f"line {self.line()} char {self.at - start + 1}: {what}")

    def blank(self, newlines: bool = False) -> None:
        while self.at < len(self.text):
            c = self.text[self.at]
            if c in " \t\r" or newlines and c == "\n":
                self.at += 1
            elif c == "#":
                end = self.text.find("\n", self.at)
                self.at = len(self.text) if end < 0 else end
                if not newlines:
                    return
            else:
                return

    def peek(self, token: str) -> bool:
        return self.text.startswith(token, self.at)

    def take(self, token: str) -> bool:
        if self.peek(token):
            self.at += len(token)
            return True
        return False

    def need(self, token: str) -> None:
        if not self.take(token):
            found = self.text[self.at : self.at + 1] or "end of input"
            raise self.fail(f"expected {token!r}, got {found!r}")

    def word(self, word: str) -> bool:
        end = self.at + len(word)
        if self.peek(word) and not re.match(r"[A-Za-z0-9_]", self.text[end : end + 1]):
            self.at = end
            return True
        return False

    def name(self) -> str:
        m = _NAME.match(self.text, self.at)
        if not m:
            raise self.fail("expected a name")
        self.at = m.end()
        return m[0]

    # statements
    def mapping(self, closed: bool = False) -> Mapping:
        out = Mapping([], {}, self.text)
        while True:
            self.blank(True)
            if self.at >= len(self.text):
                if closed:
                    raise self.fail("expected '}'")
                break
            if closed and self.take("}"):
                break
            self.statement(out, closed)
            self.blank()
            if self.at < len(self.text) and not self.peek("\n") and not (closed and self.peek("}")):
                raise self.fail("expected a line break between statements")
        if not closed and not out.statements and not out.maps:
            raise self.fail("the mapping is empty")
        return out

    def statement(self, out: Mapping, closed: bool) -> None:
        start = self.at
        line = self.line()
        if self.word("map"):
            self.blank()
            if not self.peek("="):
                name = self.name()
                self.blank()
                self.need("{")
                if name in out.maps:
                    raise self.fail(f"map {name} is defined twice")
                out.maps[name] = self.mapping(True)
                return
            self.at = start
        if self.word("let"):
            self.blank()
            name = self.string() if self.peek('"') else self.name()
            out.statements.append(("let", name, self.assigned(), line))
            return
        if self.word("meta"):
            self.blank()
            key: tuple | None = None
            if self.peek('"'):
                key = ("literal", self.string())
            elif not self.peek("="):
                key = ("literal", self.name())
            out.statements.append(("meta", key, self.assigned(), line))
            return
        if self.take("@"):
            key = ("literal", self.string() if self.peek('"') else self.name()) if not self.text[self.at : self.at + 1] in " =" else None
            out.statements.append(("meta", key, self.assigned(), line))
            return
        if self.word("import") or self.word("from"):
            raise self.fail("import and from are not supported")
        if self.word("if"):
            out.statements.append(self.conditional(line))
            return
        path = [self.part()]
        while self.take("."):
            path.append(self.part())
        if path[0] == "root":
            path = path[1:]
        elif path[0] == "this" and len(path) > 1:
            path = path[1:]
        out.statements.append(("assign", path, self.assigned(), line))

    def conditional(self, line: int) -> tuple:
        arms, other = [], []
        while True:
            self.blank(True)
            test = self.query()
            self.blank(True)
            self.need("{")
            arms.append((test, self.mapping(True).statements))
            mark = self.at
            self.blank(True)
            if not self.word("else"):
                self.at = mark
                break
            self.blank(True)
            if self.word("if"):
                continue
            self.need("{")
            other = self.mapping(True).statements
            break
        return ("when", arms, other, line)

    def assigned(self) -> tuple:
        self.blank()
        self.need("=")
        self.blank(True)
        return self.query()

    def part(self) -> str:
        if self.peek('"'):
            return self.string()
        m = _PART.match(self.text, self.at)
        if not m:
            raise self.fail("expected a path")
        self.at = m.end()
        return m[0].replace("~1", ".").replace("~0", "~")

    # expressions
    def query(self) -> tuple:
        self.depth += 1
        if self.depth > MOST_NESTING:
            raise self.fail("the expression is nested too deeply")
        operands, operators = [self.unary()], []
        while True:
            mark = self.at
            self.blank(True)
            found = next((o for o in ("&&", "||", "==", "!=", "<=", ">=", "<", ">", "+", "-", "*", "/", "%", "|") if self.peek(o)), None)
            if found is None or found == "-" and self.text.startswith("->", self.at):
                self.at = mark
                break
            self.at += len(found)
            self.blank(True)
            operators.append((found, self.line()))
            operands.append(self.unary())
        for level in LEVELS:
            left, kept = [operands[0]], []
            for (o, line), right in zip(operators, operands[1:]):
                if o in level:
                    left[-1] = ("binary", o, left[-1], right)
                else:
                    kept.append((o, line))
                    left.append(right)
            operands, operators = left, kept
        self.depth -= 1
        return operands[0]

    def unary(self) -> tuple:
        if self.take("!"):
            self.blank()
            return ("not", self.unary())
        if self.take("-"):
            self.blank()
            return ("minus", self.unary())
        return self.tail(self.term())

    def tail(self, out: tuple) -> tuple:
        while True:
            mark = self.at
            self.blank(True)
            if self.peek(".") and not self.peek(".."):
                self.at += 1
                self.blank(True)
                if self.take("("):
                    self.blank(True)
                    body = self.lambda_or_query()
                    self.blank(True)
                    self.need(")")
                    out = ("within", out, body)
                    continue
                if not self.peek('"') and (m := _NAME.match(self.text, self.at)) and self.text.startswith("(", m.end()):
                    line, name = self.line(), self.name()
                    out = ("method", out, name, *self.arguments(), line)
                else:
                    out = ("field", out, self.part())
                continue
            self.at = mark
            if self.take("["):
                self.blank(True)
                index = self.query()
                self.blank(True)
                self.need("]")
                out = ("index", out, index)
                continue
            return out

    def arguments(self) -> tuple[list, dict]:
        self.need("(")
        args, named = [], {}
        while True:
            self.blank(True)
            if self.take(")"):
                return args, named
            m = _NAME.match(self.text, self.at)
            after = re.compile(r"\s*:").match(self.text, m.end()) if m else None
            if after:
                self.at = after.end()
                self.blank(True)
                if m[0] in named:
                    raise self.fail(f"argument {m[0]} is given twice")
                named[m[0]] = self.lambda_or_query()
            else:
                if named:
                    raise self.fail("arguments are either all named or all in order")
                args.append(self.lambda_or_query())
            if args and named:
                raise self.fail("arguments are either all named or all in order")
            self.blank(True)
            if not self.peek(")"):
                self.need(",")

    def lambda_or_query(self) -> tuple:
        m = re.compile(r"([A-Za-z_][A-Za-z0-9_]*)\s*->").match(self.text, self.at)
        if m:
            self.at = m.end()
            self.blank(True)
            return ("lambda", m[1], self.query())
        return self.query()

    def string(self) -> str:
        if self.take('"""'):
            end = self.text.find('"""', self.at)
            if end < 0:
                raise self.fail("a string is not closed")
            out = self.text[self.at : end]
            self.at = end + 3
            return out
        quote = self.text[self.at]
        m = re.compile(rf"{quote}((?:[^{quote}\\\n]|\\.)*){quote}").match(self.text, self.at)
        if not m:
            raise self.fail("a string is not closed")
        self.at = m.end()
        return unescaped(m[1], self)

    def term(self) -> tuple:
        c = self.text[self.at : self.at + 1]
        if c and c in "\"'":
            return ("literal", self.string())
        if m := _NUMBER.match(self.text, self.at):
            self.at = m.end()
            if m[1]:
                return ("literal", float(m[0]))
            n = int(m[0])
            return ("literal", n if n < 1 << 63 else float(n))
        if self.take("("):
            self.blank(True)
            inner = self.lambda_or_query()
            self.blank(True)
            self.need(")")
            return inner
        if self.take("["):
            items = []
            while True:
                self.blank(True)
                if self.take("]"):
                    return ("array", items)
                items.append(self.query())
                self.blank(True)
                if not self.peek("]"):
                    self.need(",")
        if self.take("{"):
            pairs = []
            while True:
                self.blank(True)
                if self.take("}"):
                    return ("object", pairs)
                key = self.query()
                self.blank(True)
                self.need(":")
                self.blank(True)
                pairs.append((key, self.query()))
                self.blank(True)
                if not self.peek("}"):
                    self.need(",")
        if self.take("$"):
            return ("variable", self.name())
        if self.take("@"):
            if self.peek('"'):
                return ("metadata", self.string())
            m = _NAME.match(self.text, self.at)
            if m:
                self.at = m.end()
                return ("metadata", m[0])
            return ("metadata", None)
        line = self.line()
        if self.word("if"):
            return self.branches()
        if self.word("match"):
            return self.match()
        m = _NAME.match(self.text, self.at)
        if not m:
            raise self.fail(f"unexpected {c or 'end of input'!r}")
        if self.text.startswith("(", m.end()):
            self.at = m.end()
            return ("call", m[0], *self.arguments(), line)
        self.at = m.end()
        if m[0] in _KEYWORDS:
            return ("literal", _KEYWORDS[m[0]])
        if m[0] == "this":
            return ("this",)
        if m[0] == "root":
            return ("root",)
        if m[0] == "_":
            return ("any",)
        return ("bare", m[0])

    def branches(self) -> tuple:
        arms, other = [], None
        while True:
            self.blank(True)
            test = self.query()
            self.blank(True)
            self.need("{")
            self.blank(True)
            value = self.query()
            self.blank(True)
            self.need("}")
            arms.append((test, value))
            mark = self.at
            self.blank(True)
            if not self.word("else"):
                self.at = mark
                return ("if", arms, other)
            self.blank(True)
            if self.word("if"):
                continue
            self.need("{")
            self.blank(True)
            other = self.query()
            self.blank(True)
            self.need("}")
            return ("if", arms, other)

    def match(self) -> tuple:
        self.blank(True)
        context = None if self.peek("{") else self.query()
        self.blank(True)
        self.need("{")
        arms = []
        while True:
            self.blank(True)
            if self.take("}"):
                return ("match", context, arms)
            test = self.query()
            self.blank(True)
            self.need("=>")
            self.blank(True)
            arms.append((test, self.query()))
            self.blank(True)
            self.take(",")


def unescaped(text: str, where: Parser) -> str:
    if "\\" not in text:
        return text
    simple = {"n": "\n", "t": "\t", "r": "\r", '"': '"', "'": "'", "\\": "\\", "a": "\a", "b": "\b", "f": "\f", "v": "\v", "/": "/"}

    def one(m: re.Match) -> str:
        s = m[1]
        if s[0] in "xuU":
            return chr(int(s[1:], 16))
        if s in simple:
            return simple[s]
        raise where.fail(f"unknown escape \\{s}")

    out = re.sub(r"\\(x[0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", one, text, flags=re.S)
    return out.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def parse(text: str) -> Mapping:
    """A whole mapping; a text that is one expression is ``root = `` that expression."""
    p = Parser(text)
    p.blank(True)
    start = p.at
    try:
        return p.mapping()
    except ParseError as first:
        q = Parser(text)
        q.at = start
        try:
            value = q.query()
            q.blank(True)
        except ParseError:
            raise first from None
        if q.at < len(text):
            raise first from None
        return Mapping([("assign", [], value, 1)], {}, text)


def parse_query(text: str) -> tuple:
    p = Parser(text)
    p.blank(True)
    out = p.query()
    p.blank(True)
    if p.at < len(text):
        raise p.fail("unexpected text after the expression")
    return out


def interpolated(text: str) -> list[str | tuple]:
    """Parts of a config string with ${! query } interpolations: literal texts and queries; ${{!..}} stays as ${!..}."""
    out: list[str | tuple] = []
    at = 0
    for m in re.finditer(r"\$\{\{!(.*?)\}\}|\$\{!(.*?)\}", text, re.S):
        if m.start() > at:
            out.append(text[at : m.start()])
        out.append("${!" + m[1] + "}" if m[1] is not None else parse_query(m[2].strip()))
        at = m.end()
    if at < len(text):
        out.append(text[at:])
    return out
