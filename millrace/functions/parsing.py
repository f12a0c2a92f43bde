"""Methods that parse and format other notations."""

from __future__ import annotations

import math
import re
import struct
import urllib.parse
from typing import Any
from xml.sax.saxutils import escape

from millrace.functions.strings import string
from millrace.functions.table import expected, method
from millrace.functions.values import MappingError, RawNumber, Timestamp, bytes_of, equal, float_text, from_json, is_number, is_text, plain_number, text_of, to_json, type_name, wrap

MOST_DEPTH, MOST_NODES = 1024, 5_000_000


@method("parse_json", "use_number?")
def _parse_json(v, use_number=False):
    return from_json(bytes_of(string(v)), use_number is True)


@method("format_json", "indent? no_indent? escape_html?")
def _format_json(v, indent="    ", no_indent=False, escape_html=True):
    return to_json(v, "" if no_indent else string(indent), escape_html is True).encode("utf-8", "surrogateescape")


def csv_records(text: str, delimiter: str = ",", lazy: bool = False) -> list[list[str]]:
    """Records of quoted text: a doubled quote inside quotes is one; blank lines are no records; a lone carriage return is data."""
    records, record, at, n = [], [], 0, len(text)
    text = text.replace("\r\n", "\n")
    n = len(text)
    while at < n:
        if text[at] == "\n" and not record:
            at += 1
            continue
        if text[at] == '"':
            at, out = at + 1, []
            while True:
                end = text.find('"', at)
                if end < 0:
                    if not lazy:
                        raise MappingError('extraneous or missing " in quoted-field')
                    out.append(text[at:])
                    at = n
                    break
                out.append(text[at:end])
                at = end + 1
                if text.startswith('"', at):
                    out.append('"')
                    at += 1
                elif at >= n or text[at] in (delimiter, "\n"):
                    break
                elif lazy:
                    out.append('"')
                else:
                    raise MappingError('extraneous or missing " in quoted-field')
            record.append("".join(out))
        else:
            m = re.compile(f"[^{re.escape(delimiter)}\n]*").match(text, at)
            if '"' in m[0] and not lazy:
                raise MappingError('bare " in non-quoted-field')
            record.append(m[0])
            at = m.end()
        if at >= n or text[at] == "\n":
            records.append(record)
            record = []
            at += 1
        else:
            at += 1
            if at >= n:
                record.append("")
                records.append(record)
                record = []
    return records


@method("parse_csv", "parse_header_row? delimiter? lazy_quotes?")
def _parse_csv(v, header=True, delimiter=",", lazy=False):
    records = csv_records(string(v), string(delimiter), lazy is True)
    if not records:
        return []
    for k, r in enumerate(records):
        if len(r) != len(records[0]):
            raise MappingError(f"record on line {k + 1}: wrong number of fields")
    return [dict(zip(records[0], r)) for r in records[1:]] if header else records


@method("parse_form_url_encoded")
def _parse_form(v):
    out: dict[str, Any] = {}
    for part in string(v).split("&"):
        if not part:
            continue
        if ";" in part or re.search(r"%(?![0-9A-Fa-f]{2})", part):
            raise MappingError("failed to parse value as url-encoded data: invalid text")
        k, _, x = part.partition("=")
        k, x = urllib.parse.unquote_plus(k), urllib.parse.unquote_plus(x)
        out[k] = x if k not in out else [*(out[k] if isinstance(out[k], list) else [out[k]]), x]
    return out


@method("parse_logfmt")
def _parse_logfmt(v):
    out: dict[str, Any] = {}
    for m in re.finditer(r'([^\s="]+)(?:=(?:"((?:[^"\\]|\\.)*)"|([^\s"]*)))?', string(v)):
        if m[2] is not None:
            out[m[1]] = re.sub(r"\\(.)", lambda e: {"n": "\n", "t": "\t", "r": "\r"}.get(e[1], e[1]), m[2])
        else:
            out[m[1]] = True if m[3] is None else m[3]
    return out


@method("parse_url")
def _parse_url(v):
    text = string(v)
    if re.search(r"[\x00-\x1f\x7f]", text) or text.startswith(":"):
        raise MappingError(f"failed to parse url {to_json(text)}")
    main, _, fragment = text.partition("#")
    m = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):(.*)$", main, re.S)
    scheme, rest = (m[1].lower(), m[2]) if m else ("", main)
    rest, mark, query = rest.partition("?")
    out: dict[str, Any] = {"scheme": scheme, "opaque": "", "host": "", "path": "", "raw_path": "", "raw_query": query, "fragment": urllib.parse.unquote(fragment), "raw_fragment": ""}
    if urllib.parse.quote(out["fragment"], safe="!$&'()*+,;=:@/?") != fragment:
        out["raw_fragment"] = fragment
    if scheme and not rest.startswith("/") and rest:
        out["opaque"] = rest
        return out
    if rest.startswith("//"):
        authority, slash, path = rest[2:].partition("/")
        rest = slash + path
        user, at, host = authority.rpartition("@")
        if re.search(r"[ <>\"]", host) or re.search(r":(?!\d*$)", host.rpartition("]")[2]):
            raise MappingError(f"failed to parse url {to_json(text)}: invalid host")
        out["host"] = urllib.parse.unquote(host)
        if at:
            name, colon, password = user.partition(":")
            out["user"] = {"name": urllib.parse.unquote(name)} | ({"password": urllib.parse.unquote(password)} if colon else {})
    elif not scheme and ":" in rest.partition("/")[0]:
        raise MappingError("first path segment in URL cannot contain colon")
    if re.search(r"%(?![0-9A-Fa-f]{2})", rest):
        raise MappingError(f"failed to parse url {to_json(text)}: invalid URL escape")
    out["path"] = urllib.parse.unquote(rest)
    if urllib.parse.quote(out["path"], safe="$&+,/:;=@-_.~") != rest:
        out["raw_path"] = rest
    return out


def _from_yaml(x: Any, depth: int = 0) -> Any:
    import datetime

    if depth > MOST_DEPTH:
        raise MappingError("the document is nested too deeply")
    if isinstance(x, dict):
        return {k if isinstance(k, str) else text_of(_from_yaml(k)): _from_yaml(y, depth + 1) for k, y in x.items()}
    if isinstance(x, (list, set, tuple)):
        return [_from_yaml(y, depth + 1) for y in x]
    if isinstance(x, (datetime.datetime, datetime.date)):
        return x.isoformat()
    if isinstance(x, int) and not isinstance(x, bool):
        return x if x == wrap(x) else float(x)
    return x


@method("parse_yaml")
def _parse_yaml(v):
    import yaml

    try:
        return _from_yaml(yaml.safe_load(string(v)))
    except (yaml.YAMLError, RecursionError) as e:
        raise MappingError(f"failed to parse value as YAML: {e}") from None


def plain(v: Any) -> Any:
    """The value in JSON's own kinds."""
    if isinstance(v, dict):
        return {k: plain(v[k]) for k in sorted(v)}
    if isinstance(v, list):
        return [plain(x) for x in v]
    if isinstance(v, (Timestamp, bytes)):
        return text_of(v)
    return plain_number(v) if is_number(v) else v


@method("format_yaml")
def _format_yaml(v):
    import yaml

    return yaml.safe_dump(plain(v), allow_unicode=True, default_flow_style=False, indent=4).removesuffix("...\n").encode()


def _cast(text: str) -> Any:
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    try:
        n = float(text)
        return n if math.isfinite(n) else text
    except ValueError:
        return text


@method("parse_xml", "cast?")
def _parse_xml(v, cast=False):
    """Attributes under -name, text under #text beside others, repeated elements as arrays."""
    import xml.etree.ElementTree as ET

    try:
        top = ET.fromstring(bytes_of(string(v)))
    except ET.ParseError as e:
        raise MappingError(f"failed to parse value as XML: {e}") from None
    value = _cast if cast is True else lambda t: t
    name = lambda t: t.rpartition("}")[2]

    def go(e: Any, depth: int = 0) -> Any:
        if depth > MOST_DEPTH:
            raise MappingError("the document is nested too deeply")
        out: dict[str, Any] = {f"-{name(k)}": value(x) for k, x in e.attrib.items()}
        for c in e:
            k, x = name(c.tag), go(c, depth + 1)
            out[k] = x if k not in out else [*(out[k] if isinstance(out[k], list) else [out[k]]), x]
        text = "".join([e.text or "", *(c.tail or "" for c in e)]).strip()
        if not out:
            return value(text)
        if text:
            out["#text"] = value(text)
        return out

    return {name(top.tag): go(top)}


@method("format_xml", "indent? no_indent? root_tag?")
def _format_xml(v, indent="    ", no_indent=False, root_tag=None):
    if not isinstance(v, dict):
        raise expected("object", v)
    pad = "" if no_indent else string(indent)
    show = lambda x: escape("" if x is None else text_of(x), {'"': "&#34;", "'": "&#39;"})

    def go(name: str, x: Any, depth: int) -> str:
        if isinstance(x, list):
            return "".join(go(name, y, depth) for y in x)
        lead, end = (pad * depth, "\n") if pad else ("", "")
        if not isinstance(x, dict):
            return f"{lead}<{name}>{show(x)}</{name}>{end}"
        attributes = "".join(f' {k[1:]}="{show(x[k])}"' for k in sorted(x) if k.startswith("-"))
        text = show(x["#text"]) if "#text" in x else ""
        below = "".join(go(k, x[k], depth + 1) for k in sorted(x) if not k.startswith("-") and k != "#text")
        return f"{lead}<{name}{attributes}>{text}{end + below + lead if below else ''}</{name}>{end}"

    if root_tag is not None:
        out = go(string(root_tag), v, 0)
    elif len(v) == 1 and not isinstance(next(iter(v.values())), list):
        out = go(*next(iter(v.items())), 0)
    else:
        out = go("doc", v, 0)
    return out.rstrip("\n").encode()


@method("json_path", "expression")
def _json_path(v, expression):
    """Hits as an array; $ .k ..k .* [n] ['k'] [*] [?(@.k==v)]."""
    text = string(expression)
    if not text.startswith("$"):
        raise MappingError("a JSON path starts with $")
    hits, at = [v], 1
    step = re.compile(r"\.\.(?P<deep>\*|[\w-]+)|\.(?P<name>\*|[\w-]+)|\[\*\](?P<all>)|\[(?P<index>-?\d+)\]|\['(?P<q1>[^']*)'\]|\[\"(?P<q2>[^\"]*)\"\]|\[\?\(@\.(?P<key>[\w.-]+)\s*(?P<op>==|!=|<=|>=|<|>)\s*(?P<value>[^)]+)\)\]")

    def children(x: Any) -> list:
        return [x[k] for k in sorted(x)] if isinstance(x, dict) else list(x) if isinstance(x, list) else []

    def below(x: Any) -> list:
        return [x, *(z for y in children(x) for z in below(y))]

    while at < len(text):
        m = step.match(text, at)
        if not m:
            raise MappingError(f"the JSON path is not supported at {text[at:]!r}")
        at = m.end()
        g = m.groupdict()
        if g["deep"]:
            hits = [z for x in hits for y in below(x) for z in (children(y) if g["deep"] == "*" else [y[g["deep"]]] if isinstance(y, dict) and g["deep"] in y else [])]
        elif g["name"] == "*" or g["all"] is not None:
            hits = [y for x in hits for y in children(x)]
        elif g["index"]:
            k = int(g["index"])
            hits = [x[k] for x in hits if isinstance(x, list) and -len(x) <= k < len(x)]
        elif g["key"]:
            raw = g["value"].strip()
            want = from_json('"' + raw[1:-1] + '"' if raw[:1] == "'" else raw)

            def fits(y: Any) -> bool:
                from millrace.functions.values import order, walk

                if not isinstance(y, dict):
                    return False
                own = walk(y, g["key"].split("."))
                if g["op"] in ("==", "!="):
                    return equal(own, want) == (g["op"] == "==")
                try:
                    c = order(own, want)
                except MappingError:
                    return False
                return {"<": c < 0, ">": c > 0, "<=": c <= 0, ">=": c >= 0}[g["op"]]

            hits = [y for x in hits for y in children(x) if fits(y)]
        else:
            k = g["name"] or (g["q1"] if g["q1"] is not None else g["q2"])
            hits = [x[k] for x in hits if isinstance(x, dict) and k in x]
    return hits


def _schema_problems(v: Any, s: Any, at: str = "(root)") -> list[str]:
    if s is True or s is False:
        return [] if s else [f"{at}: nothing is allowed"]
    if "$ref" in s:
        raise MappingError("$ref is not supported in JSON schemas")
    out: list[str] = []
    kinds = s.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds

    def is_kind(k: str) -> bool:
        if k == "integer":
            return is_number(v) and float(plain_number(v)).is_integer()
        return {"number": is_number(v), "boolean": isinstance(v, bool)}.get(k, type_name(v) == k)

    if kinds and not any(map(is_kind, kinds)):
        return [f"{at}: Invalid type. Expected: {', '.join(kinds)}, given: {type_name(v)}"]
    if "enum" in s and not any(equal(v, x) for x in s["enum"]):
        out.append(f"{at} must be one of the following: {', '.join(map(to_json, s['enum']))}")
    if "const" in s and not equal(v, s["const"]):
        out.append(f"{at} does not match: {to_json(s['const'])}")
    if is_number(v):
        n = plain_number(v)
        for key, bad, what in (("minimum", lambda x: n < x, "greater than or equal to"), ("maximum", lambda x: n > x, "less than or equal to"), ("exclusiveMinimum", lambda x: not isinstance(x, bool) and n <= x, "greater than"), ("exclusiveMaximum", lambda x: not isinstance(x, bool) and n >= x, "less than"), ("multipleOf", lambda x: n % x != 0, "a multiple of")):
            if key in s and bad(s[key]):
                out.append(f"{at}: Must be {what} {float_text(s[key]) if isinstance(s[key], float) else s[key]}")
    if is_text(v):
        if len(v) < s.get("minLength", 0):
            out.append(f"{at}: String length must be greater than or equal to {s['minLength']}")
        if len(v) > s.get("maxLength", len(v)):
            out.append(f"{at}: String length must be less than or equal to {s['maxLength']}")
        if "pattern" in s and not re.search(s["pattern"], v):
            out.append(f"{at}: Does not match pattern '{s['pattern']}'")
    if isinstance(v, list):
        if len(v) < s.get("minItems", 0):
            out.append(f"{at}: Array must have at least {s['minItems']} items")
        if len(v) > s.get("maxItems", len(v)):
            out.append(f"{at}: Array must have at most {s['maxItems']} items")
        if s.get("uniqueItems") and any(equal(a, b) for k, a in enumerate(v) for b in v[k + 1 :]):
            out.append(f"{at}: array items must be unique")
        items = s.get("items")
        for k, x in enumerate(v):
            sub = items[k] if isinstance(items, list) and k < len(items) else s.get("additionalItems") if isinstance(items, list) else items
            if sub is not None:
                out += _schema_problems(x, sub, f"{at}.{k}".removeprefix("(root)."))
    if isinstance(v, dict):
        for k in s.get("required", []):
            if k not in v:
                out.append(f"{at}: {k} is required")
        if len(v) < s.get("minProperties", 0) or len(v) > s.get("maxProperties", len(v)):
            out.append(f"{at}: wrong number of properties")
        for k in sorted(v):
            subs = [s["properties"][k]] if k in s.get("properties", {}) else []
            subs += [x for p, x in s.get("patternProperties", {}).items() if re.search(p, k)]
            if not subs and "additionalProperties" in s:
                if s["additionalProperties"] is False:
                    out.append(f"{at}: Additional property {k} is not allowed")
                    continue
                subs = [s["additionalProperties"]]
            for x in subs:
                out += _schema_problems(v[k], x, f"{at}.{k}".removeprefix("(root)."))
    for x in s.get("allOf", []):
        out += _schema_problems(v, x, at)
    if "anyOf" in s and all(_schema_problems(v, x, at) for x in s["anyOf"]):
        out.append(f"{at}: Must validate at least one schema (anyOf)")
    if "oneOf" in s and sum(not _schema_problems(v, x, at) for x in s["oneOf"]) != 1:
        out.append(f"{at}: Must validate one and only one schema (oneOf)")
    if "not" in s and not _schema_problems(v, s["not"], at):
        out.append(f"{at}: Must not validate the schema (not)")
    return out


@method("json_schema", "schema")
def _json_schema(v, schema):
    problems = _schema_problems(v, from_json(string(schema)))
    if problems:
        raise MappingError("\n".join(problems))
    return v


@method("format_msgpack")
def _format_msgpack(v):
    def sized(n: int, small: tuple | None, forms: tuple) -> bytes:
        if small and n < small[1]:
            return bytes([small[0] | n])
        for code, size in forms:
            if n < 1 << 8 * size:
                return bytes([code]) + n.to_bytes(size, "big")
        raise MappingError("the value is too long for msgpack")

    def go(x: Any) -> bytes:
        if x is None:
            return b"\xc0"
        if isinstance(x, bool):
            return b"\xc3" if x else b"\xc2"
        if isinstance(x, int):
            if 0 <= x:
                return sized(x, (0, 128), ((0xCC, 1), (0xCD, 2), (0xCE, 4), (0xCF, 8)))
            for code, size in ((0xD0, 1), (0xD1, 2), (0xD2, 4), (0xD3, 8)):
                if x >= -32:
                    return x.to_bytes(1, "big", signed=True)
                if x >= -(1 << 8 * size - 1):
                    return bytes([code]) + x.to_bytes(size, "big", signed=True)
        if isinstance(x, float):
            return b"\xcb" + struct.pack(">d", x)
        if isinstance(x, bytes):
            return sized(len(x), None, ((0xC4, 1), (0xC5, 2), (0xC6, 4))) + x
        if isinstance(x, list):
            return sized(len(x), (0x90, 16), ((0xDC, 2), (0xDD, 4))) + b"".join(map(go, x))
        if isinstance(x, dict):
            return sized(len(x), (0x80, 16), ((0xDE, 2), (0xDF, 4))) + b"".join(go(k) + go(x[k]) for k in sorted(x))
        raw = text_of(x).encode("utf-8", "surrogateescape")
        return sized(len(raw), (0xA0, 32), ((0xD9, 1), (0xDA, 2), (0xDB, 4))) + raw

    return go(v)


@method("parse_msgpack")
def _parse_msgpack(v):
    raw, at = bytes_of(v), 0

    def take(n: int) -> bytes:
        nonlocal at
        if at + n > len(raw):
            raise MappingError("failed to parse value as msgpack: unexpected end")
        at += n
        return raw[at - n : at]

    def uint(n: int) -> int:
        return int.from_bytes(take(n), "big")

    def go() -> Any:
        c = uint(1)
        if c < 0x80:
            return c
        if c >= 0xE0:
            return c - 256
        if c < 0x90:
            return {text_of(go()): go() for _ in range(c & 15)}
        if c < 0xA0:
            return [go() for _ in range(c & 15)]
        if c < 0xC0:
            return take(c & 31).decode("utf-8", "surrogateescape")
        if c in (0xC0, 0xC2, 0xC3):
            return {0xC0: None, 0xC2: False, 0xC3: True}[c]
        if c in (0xC4, 0xC5, 0xC6):
            return take(uint(1 << c - 0xC4))
        if c == 0xCA:
            return struct.unpack(">f", take(4))[0]
        if c == 0xCB:
            return struct.unpack(">d", take(8))[0]
        if 0xCC <= c <= 0xCF:
            n = uint(1 << c - 0xCC)
            return n if n == wrap(n) else float(n)
        if 0xD0 <= c <= 0xD3:
            return int.from_bytes(take(1 << c - 0xD0), "big", signed=True)
        if 0xD9 <= c <= 0xDB:
            return take(uint(1 << c - 0xD9)).decode("utf-8", "surrogateescape")
        if c in (0xDC, 0xDD):
            return [go() for _ in range(uint(2 if c == 0xDC else 4))]
        if c in (0xDE, 0xDF):
            return {text_of(go()): go() for _ in range(uint(2 if c == 0xDE else 4))}
        raise MappingError(f"failed to parse value as msgpack: code {c:#x}")

    out = go()
    if at < len(raw):
        raise MappingError("failed to parse value as msgpack: bytes are left")
    return out


__all__ = ["RawNumber", "csv_records", "plain"]
