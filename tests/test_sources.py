import gzip
import io
import json
import tarfile

import pytest

from millrace.functions.values import MappingError
from millrace.operators.batches import Resources
from millrace.operators.flow import from_table, mapping
from millrace.pipeline import run
from millrace.sources import outputs
from millrace.sources.inputs import broker, files, generate, sequence
from millrace.sources.scanners import from_codec, pieces
from millrace.streaming.runner import from_lines, lines, start


def contents(raw, scanner):
    return [c for c, _, _ in pieces(raw, scanner, "name.txt")]


def test_scanners():
    assert contents(b"a\r\nb\n", {"lines": {}}) == [b"a", b"b"]
    assert contents(b"aXbX", {"lines": {"custom_delimiter": "X"}}) == [b"a", b"b"]
    assert [json.loads(c) for c in contents(b'h,i\n1,"2,3"\n', {"csv": {}})] == [{"h": "1", "i": "2,3"}]
    assert contents(b"abcde", {"chunker": {"size": 2}}) == [b"ab", b"cd", b"e"]
    assert contents(b"", {"to_the_end": {}}) == [b""]
    assert contents(b'[1,{"b":2,"a":1}]', {"json_array": {}}) == [b"1", b'{"a":1,"b":2}']
    assert contents(b'{"a":1} 2\n[3]', {"json_documents": {}}) == [b'{"a":1}', b"2", b"[3]"]
    assert contents(b"xx1a1b", {"re_match": {"pattern": "1"}}) == [b"xx", b"1a", b"1b"]
    assert contents(b"\xef\xbb\xbfhi", {"skip_bom": {}}) == [b"hi"]
    assert contents(gzip.compress(b"a\nb"), {"decompress": {"algorithm": "gzip", "into": {"lines": {}}}}) == [b"a", b"b"]
    assert contents(b"q", {"switch": [{"re_match_name": "csv$", "scanner": {"lines": {}}}, {"scanner": {"to_the_end": {}}}]}) == [b"q"]
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        info = tarfile.TarInfo("x")
        info.size = 2
        t.addfile(info, io.BytesIO(b"hi"))
    assert [(c, m) for c, m, _ in pieces(out.getvalue(), {"tar": {}}, "t")] == [(b"hi", {"tar_name": "x"})]
    with pytest.raises(MappingError):
        contents(b"h,i\n1\n", {"csv": {}})
    assert from_codec("gzip/lines") == {"decompress": {"algorithm": "gzip", "into": {"lines": {}}}}


def test_avro():
    def long(n):
        n, out = n << 1 ^ n >> 63, b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    def text(s):
        return long(len(s)) + s

    schema = b'{"type":"record","name":"r","fields":[{"name":"a","type":"long"},{"name":"b","type":["null","string"]}]}'
    block = long(7) + long(1) + text(b"hi") + long(-3) + long(0)
    raw = b"Obj\x01" + long(1) + text(b"avro.schema") + text(schema) + long(0) + b"s" * 16 + long(2) + long(len(block)) + block + b"s" * 16
    assert contents(raw, {"avro": {}}) == [b'{"a":7,"b":{"string":"hi"}}', b'{"a":-3,"b":null}']
    assert contents(raw, {"avro": {"raw_json": True}})[0] == b'{"a":7,"b":"hi"}'


def test_files_inputs_and_outputs(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text("k,v\n1,x\n2,y\n")
    flow = files(spark, [str(tmp_path / "in")], {"csv": {}})
    assert sorted(r.k for r in flow.rows_as("k string, v string").collect()) == ["1", "2"]
    a, b = generate(spark, "root.n = this.id", 3), generate(spark, "root.n = this.id + 10", 2)
    assert broker([a, b]).df.count() == 5
    assert [r.n for r in sequence([a, b]).df.orderBy("ord").select("doc.n").collect()] == [0, 1, 2, 10, 11]
    seen = []
    take = lambda flow: seen.append(flow.raw().df.count())
    outputs.switch([{"check": "this.n > 1", "output": take}, {"output": take}])(a)
    assert seen == [1, 2]
    outputs.fallback([outputs.reject("no"), take])(a)
    assert seen[-1] == 3
    with pytest.raises(RuntimeError, match="no"):
        outputs.reject("no")(a)
    run(spark, {"input": {"generate": {"count": 4, "mapping": "root.n = this.id"}}, "pipeline": {"processors": [{"mapping": "root.n = this.n * 2"}]}, "output": {"file": {"path": str(tmp_path / "out")}}})
    assert sorted(json.loads(r.value)["n"] for r in spark.read.text(str(tmp_path / "out")).collect()) == [0, 2, 4, 6]


def test_strict_errors_fail_the_write(spark):
    flow = mapping(from_table(spark.range(3), ["id"]), 'root = if this.id == 1 { throw("x") } else { this }', Resources())
    with pytest.raises(Exception, match="x"):
        outputs.drop(outputs.strict(flow))


def test_stream_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text('{"n":1}\n{"n":2}\n')
    (tmp_path / "in/b.txt").write_text('{"n":3}\n')
    configs, seen = [{"mapping": "root.m = this.n * 10"}], []
    q = start(lines(spark, str(tmp_path / "in"), 1), from_lines, configs, lambda f: seen.extend(r.m for r in f.rows_as("m long").collect()), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert sorted(seen) == [10, 20, 30]
