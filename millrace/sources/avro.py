"""Objects of an Avro container file: its header's schema, its codec and its blocks."""

from __future__ import annotations

import struct
import zlib
from typing import Any

from millrace.functions.encodings import decompress
from millrace.functions.values import MappingError, from_json


class Reader:
    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.raw):
            raise MappingError("avro: unexpected end")
        self.at += n
        return self.raw[self.at - n : self.at]

    def long(self) -> int:
        n = shift = 0
        while True:
            b = self.take(1)[0]
            n |= (b & 127) << shift
            shift += 7
            if b < 128:
                return n >> 1 ^ -(n & 1)

    def bytes(self) -> bytes:
        return self.take(self.long())


class Schema:
    def __init__(self, schema: Any, bare: bool):
        self.names: dict[str, Any] = {}
        self.bare = bare  # unions without the name of their branch
        self.top = schema
        self._learn(schema)

    def _learn(self, s: Any) -> None:
        if isinstance(s, list):
            for x in s:
                self._learn(x)
        elif isinstance(s, dict):
            if s.get("type") in ("record", "enum", "fixed"):
                self.names[s["name"]] = s
                if s.get("namespace"):
                    self.names[f"{s['namespace']}.{s['name']}"] = s
            for f in s.get("fields", []):
                self._learn(f["type"])
            for k in ("items", "values"):
                if k in s:
                    self._learn(s[k])
            if isinstance(s.get("type"), (dict, list)):
                self._learn(s["type"])

    def read(self, r: Reader, s: Any) -> Any:
        if isinstance(s, list):
            k = r.long()
            if not 0 <= k < len(s):
                raise MappingError("avro: a union's branch is out of range")
            v = self.read(r, s[k])
            if v is None or self.bare:
                return v
            kind = s[k]
            return {kind if isinstance(kind, str) else kind.get("name") or kind["type"]: v}
        kind = s if isinstance(s, str) else s["type"]
        if isinstance(kind, (dict, list)):
            return self.read(r, kind)
        if kind == "null":
            return None
        if kind == "boolean":
            return r.take(1) != b"\0"
        if kind in ("int", "long"):
            return r.long()
        if kind == "float":
            return struct.unpack("<f", r.take(4))[0]
        if kind == "double":
            return struct.unpack("<d", r.take(8))[0]
        if kind == "bytes":
            return r.bytes().decode("latin-1")
        if kind == "string":
            return r.bytes().decode("utf-8", "replace")
        if kind == "record":
            return {f["name"]: self.read(r, f["type"]) for f in s["fields"]}
        if kind == "enum":
            return s["symbols"][r.long()]
        if kind == "fixed":
            return r.take(s["size"]).decode("latin-1")
        if kind in ("array", "map"):
            out: Any = [] if kind == "array" else {}
            while n := r.long():
                if n < 0:
                    n = -n
                    r.long()
                for _ in range(n):
                    if kind == "array":
                        out.append(self.read(r, s["items"]))
                    else:
                        key = r.bytes().decode("utf-8", "replace")
                        out[key] = self.read(r, s["values"])
            return out
        if kind in self.names:
            return self.read(r, self.names[kind])
        raise MappingError(f"avro: type {kind!r} is not known")


def documents(raw: bytes, bare: bool = False) -> list[Any]:
    r = Reader(raw)
    if r.take(4) != b"Obj\x01":
        raise MappingError("avro: this is not a container file")
    meta = Schema({"type": "map", "values": "bytes"}, True).read(r, {"type": "map", "values": "bytes"})
    codec = meta.get("avro.codec", "null")
    schema = Schema(from_json(meta["avro.schema"].encode("latin-1")), bare)
    sync, out = r.take(16), []
    while r.at < len(raw):
        n, data = r.long(), r.bytes()
        if codec == "deflate":
            data = zlib.decompress(data, -15)
        elif codec == "snappy":
            data = decompress(data[:-4], "snappy")
        elif codec == "zstandard":
            data = decompress(data, "zstd")
        elif codec != "null":
            raise MappingError(f"avro: codec {codec!r} is not supported")
        block = Reader(data)
        out += [schema.read(block, schema.top) for _ in range(n)]
        if r.take(16) != sync:
            raise MappingError("avro: the sync mark doesn't match")
    return out
