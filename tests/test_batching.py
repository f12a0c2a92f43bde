import json

import pytest

from millrace.config import lint, load
from millrace.operators.batches import ConfigError
from millrace.operators.flow import batching, from_content, from_table, mapping
from millrace.operators.batches import Resources
from millrace.pipeline import run


def sizes(flow):
    found = {}
    for r in flow.raw().df.orderBy("ord").collect():
        found.setdefault(r.batch, []).append(json.loads(bytes(r.content))["i"])
    return [found[k] for k in sorted(found)]


def expected(docs, count, byte_size, check):
    out, size = [[]], 0
    for d in docs:
        out[-1].append(d["i"])
        size += len(json.dumps(d, separators=(",", ":")))
        if 0 < count <= len(out[-1]) or 0 < byte_size <= size or check(d, len(out[-1])):
            out.append([])
            size = 0
    return [b for b in out if b]


DOCS = [{"i": k, "s": "x" * (k * 7 % 11)} for k in range(40)]
CHECKS = {None: lambda d, n: False, "this.i % 7 == 3": lambda d, n: d["i"] % 7 == 3, "this.s.length() > 2 && batch_size() >= 3": lambda d, n: len(d["s"]) > 2 and n >= 3, "this.s.parse_json() == 1": lambda d, n: False}


@pytest.mark.parametrize("check", CHECKS)
@pytest.mark.parametrize("count, byte_size", [(0, 0), (4, 0), (0, 60), (4, 60)])
def test_a_batch_ends_by_whichever_trigger_comes_first(spark, count, byte_size, check):
    if not (count or byte_size or check):
        return
    rows = spark.createDataFrame([(d["i"], d["s"]) for d in DOCS], "i long, s string").repartition(3)
    want = expected(DOCS, count, byte_size, CHECKS[check])
    assert sizes(batching(from_table(rows, ["i"]), count, check, byte_size=byte_size)) == want
    raw = spark.createDataFrame([(d["i"], json.dumps(d, separators=(",", ":"))) for d in DOCS], "i long, content string").repartition(3)
    assert sizes(batching(from_content(raw, order_by=["i"]), count, check, byte_size=byte_size)) == want


def test_batches_of_a_key_and_messages_that_failed(spark):
    rows = spark.createDataFrame([(k, k % 2) for k in range(20)], "i long, u long")
    found = sizes(batching(from_table(rows, ["i"]), 3, "this.i >= 10 && this.i < 14", key="u"))
    assert found == [[0, 2, 4], [6, 8, 10], [12], [14, 16, 18], [1, 3, 5], [7, 9, 11], [13], [15, 17, 19]]
    flow = mapping(from_table(rows, ["i"]), "root.i = this.i\nroot.v = 10 / this.u", Resources())
    assert [len(b) for b in sizes(batching(flow, 8, "this.i == 3"))] == [4, 8, 8]


DOCUMENT = """
input: {generate: {count: 10, mapping: 'root.n = this.id'}%s}
buffer: {memory: {batch_policy: {enabled: %s, count: 4}}}
output: {file: {path: '%s'%s}}
"""


@pytest.mark.parametrize("inside, buffer, outside, want", [
    (", batching: {count: 3, check: 'this.n == 1', processors: [{archive: {format: lines}}]}", "false", "", 10),
    ("", "true", ", batching: {byte_size: 1, count: 5}", 10),
    ("", "false", ", batching: {count: 5, processors: [{archive: {format: json_array}}]}", 2),
])
def test_policies_of_documents_are_run(spark, tmp_path, inside, buffer, outside, want):
    text = DOCUMENT % (inside, buffer, tmp_path / "out", outside)
    assert lint(text) == []
    run(spark, load(text))
    assert spark.read.text(str(tmp_path / "out")).count() == want


def test_the_buffer_makes_batches(spark, tmp_path):
    for enabled, want in (("true", 3), ("false", 10)):
        text = DOCUMENT % ("", enabled, tmp_path / enabled, "") + "pipeline: {processors: [{archive: {format: json_array}}]}"
        run(spark, load(text))
        assert spark.read.text(str(tmp_path / enabled)).count() == want


def test_what_a_policy_cannot_do_is_refused(spark, tmp_path):
    for fields, word in (("period: 1s, count: 3", "period"), ("counts: 3", "counts"), ("count: many", "count"), ("processors: [{noop: {}}]", "needs"), ("check: 'this.'", "check")):
        for text in (DOCUMENT % (f", batching: {{{fields}}}", "false", tmp_path, ""), DOCUMENT % ("", "false", tmp_path, f", batching: {{{fields}}}"), DOCUMENT.replace("count: 4", fields) % ("", "true", tmp_path, "")):
            assert any(word in p for p in lint(text)), text
    with pytest.raises(ConfigError, match="period"):
        run(spark, load(DOCUMENT % ("", "false", tmp_path / "no", ", batching: {period: 1s, count: 3}")))
