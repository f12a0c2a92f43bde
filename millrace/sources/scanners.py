"""Scanners cut a source's bytes into messages. Formats that Spark reads by itself (lines) use its readers; the others work on whole
files as Spark hands them over, one file a task row."""

from __future__ import annotations

import io
import re
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from millrace.functions.encodings import decompress
from millrace.functions.parsing import csv_records
from millrace.functions.values import MappingError, from_json, to_json
from millrace.operators.batches import ConfigError, json_documents
from millrace.operators.flow import ERR, Flow, _no_err
from millrace.shipping import ship

Piece = tuple[bytes, dict, str | None]
_BOMS = (b"\x00\x00\xfe\xff", b"\xff\xfe\x00\x00", b"\xef\xbb\xbf", b"\xfe\xff", b"\xff\xfe")
KINDS = ("lines", "csv", "chunker", "to_the_end", "json_array", "json_documents", "re_match", "tar", "skip_bom", "decompress", "avro", "switch")


def from_codec(codec: str) -> dict:
    """The scanner that an older codec name stands for."""
    head, slash, rest = codec.partition("/")
    if head in ("skipbom", "gzip", "pgzip") and slash:
        inner = from_codec(rest)
        return {"skip_bom": {"into": inner}} if head == "skipbom" else {"decompress": {"algorithm": head, "into": inner}}
    name, _, argument = codec.partition(":")
    if name in ("lines", "tar", "csv") and not argument:
        return {name: {}}
    found = {"delim": {"lines": {"custom_delimiter": argument}}, "all-bytes": {"to_the_end": {}}, "csv": {"csv": {"custom_delimiter": argument}}, "chunker": {"chunker": {"size": int(argument or 0)}}, "regex": {"re_match": {"pattern": argument}}}.get(name)
    if found is None:
        raise ConfigError(f"codec '{codec}' is not known")
    return found


def pieces(raw: bytes, scanner: dict, name: str) -> Iterator[Piece]:
    """(content, metadata, error) of each message of a source."""
    kind = next(iter(scanner))
    c = scanner[kind] or {}
    if kind == "lines":
        mark = c.get("custom_delimiter") or "\n"
        parts = raw.split(mark.encode())
        if parts and not parts[-1]:
            parts.pop()
        for p in parts:
            if len(p) >= int(c.get("max_buffer_size", 65536)):
                raise MappingError("a line is longer than max_buffer_size")
            if not c.get("custom_delimiter"):
                p = p.removesuffix(b"\r")
            if p or not c.get("omit_empty"):
                yield p, {}, None
    elif kind == "csv":
        rows = csv_records(raw.decode("utf-8", "replace"), c.get("custom_delimiter") or ",", bool(c.get("lazy_quotes")))
        header = rows[0] if rows and c.get("parse_header_row", True) else None
        for k, r in enumerate(rows[1:] if header is not None else rows):
            meta = {"csv_row": str(k)}
            if len(r) != len(rows[0]):
                if not c.get("continue_on_error"):
                    raise MappingError(f"record {k}: wrong number of fields")
                yield to_json(r).encode(), meta, "wrong number of fields"
            else:
                yield to_json(dict(zip(header, r)) if header is not None else r).encode(), meta, None
    elif kind == "chunker":
        size = int(c.get("size") or 0)
        if size <= 0:
            raise ConfigError("chunker: size must be above 0")
        for k in range(0, len(raw), size):
            yield raw[k : k + size], {}, None
    elif kind == "to_the_end":
        yield raw, {}, None
    elif kind == "json_array":
        v = from_json(raw)
        if not isinstance(v, list):
            raise MappingError("the source is not a JSON array")
        for x in v:
            yield to_json(x).encode(), {}, None
    elif kind == "json_documents":
        for x in json_documents(raw):
            yield to_json(x).encode(), {}, None
    elif kind == "re_match":
        starts = [m.start() for m in re.finditer(c["pattern"].encode(), raw) if m.end() > m.start()]
        cuts = sorted({0, *starts, len(raw)})
        for a, b in zip(cuts, cuts[1:]):
            yield raw[a:b], {}, None
    elif kind == "tar":
        with tarfile.open(fileobj=io.BytesIO(raw)) as archive:
            for entry in archive:
                body = archive.extractfile(entry) if entry.isfile() else None
                yield body.read() if body else b"", {"tar_name": entry.name}, None
    elif kind == "skip_bom":
        bom = next((b for b in _BOMS if raw.startswith(b)), b"")
        yield from pieces(raw[len(bom) :], c.get("into") or {"to_the_end": {}}, name)
    elif kind == "decompress":
        yield from pieces(decompress(raw, c["algorithm"]), c.get("into") or {"to_the_end": {}}, name)
    elif kind == "avro":
        from millrace.sources.avro import documents

        for x in documents(raw, bool(c.get("raw_json"))):
            yield to_json(x).encode(), {}, None
    elif kind == "switch":
        for case in c:
            if not case.get("re_match_name") or re.search(case["re_match_name"], name):
                yield from pieces(raw, case["scanner"], name)
                return
        raise MappingError(f"no scanner matches the name {name!r}")
    else:
        raise ConfigError(f"scanner '{kind}' is not known or not supported")


def scan(spark: SparkSession, paths: list[str], scanner: dict) -> Flow:
    """Messages of files; ``ord`` is (path, number)."""
    kind = next(iter(scanner))
    if kind not in KINDS:
        raise ConfigError(f"scanner '{kind}' is not known or not supported")
    ship(spark)
    whole = spark.read.format("binaryFile").load(paths).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows, k = [], 0
                found = pieces(raw, scanner, path)
                while True:
                    try:
                        content, meta, err = next(found)
                    except StopIteration:
                        break
                    rows.append((content, list(meta.items()), None if err is None else {"msg": err, "name": "scanner", "label": "", "path": ""}, {"path": path, "k": k}, f"{path}#{k:012d}"))
                    k += 1
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.map_(pa.string(), pa.string())), pa.array([r[2] for r in rows], pa.struct([(n, pa.string()) for n in ("msg", "name", "label", "path")])), pa.array([r[3] for r in rows], pa.struct([("path", pa.string()), ("k", pa.int64())])), pa.array([r[4] for r in rows], pa.string())], names=["content", "meta", "err", "ord", "batch"])

    if kind == "lines" and not scanner[kind]:
        text = spark.read.text(paths, lineSep="\n").select("value", "_metadata.file_path", "_metadata.file_block_start")
        order = F.struct(F.col("file_path"), F.col("file_block_start"), F.monotonically_increasing_id().alias("k"))
        line = F.regexp_replace("value", r"\r$", "")
        return Flow(text.select(line.cast("binary").alias("content"), F.create_map().cast("map<string,string>").alias("meta"), _no_err().alias("err"), order.alias("ord"), F.to_json(order).alias("batch")), False)
    schema = f"content binary, meta map<string,string>, err {ERR}, ord struct<path:string,k:bigint>, batch string"
    return Flow(whole.mapInArrow(run, schema), False, True, kind == "csv")
