import json

import pytest
from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.operators.batches import Resources
from millrace.operators.flow import exact, from_content, from_table, mapping, run_chain, why_not

SCHEMA = "i long, a long, b long, x double, s string, t string, f boolean, l array<long>"
MAPPINGS = [
    "root.i = this.i\nroot.v = this.a + this.b * 2 - this.a % 7",
    "root.i = this.i\nroot.v = this.a / this.b",
    "root.i = this.i\nroot.v = (this.a / this.b) | 0.25",
    "root.i = this.i\nroot.v = this.s + \"-\" + this.t",
    "root.i = this.i\nroot.v = this.s.uppercase().trim()\nroot.n = this.s.length()",
    "root.i = this.i\nroot.v = this.s.slice(1)\nroot.w = this.s.split(\",\").join(\";\")",
    "root.i = this.i\nroot.v = if this.f { this.a > this.b } else { this.s == this.t }",
    "root.i = this.i\nroot.v = this.l.map_each(x -> x * 2).sum()\nroot.m = this.l.max()",
    "root.i = this.i\nroot.v = this.l.filter(x -> x > 1).length()\nroot.any = this.l.any(x -> x == 2)",
    "root.i = this.i\nroot.v = this.x.ceil()\nroot.w = this.x.floor()\nroot.r = this.x.round()",
    "root = this\nroot.z = this.a == this.b\nroot.s = deleted()",
    "root.i = this.i\nroot.v = this.s.replace_all(\"a\", \"bb\")\nroot.h = this.t.hash(\"sha1\").encode(\"hex\")",
    "root.i = this.i\nroot.v = match this.s { \"\" => \"empty\", _ => \"some\" }",
    "root = this\nroot = if this.f { deleted() }",
]
text = st.text(alphabet="ab,Z é\n\t", max_size=6)
maybe = lambda s: st.one_of(st.none(), s)
rows = st.lists(st.tuples(maybe(st.integers(-(2**63), 2**63 - 1) | st.integers(-9, 9)), maybe(st.integers(-3, 3)), maybe(st.floats(-1e6, 1e6)), maybe(text), maybe(text), maybe(st.booleans()), maybe(st.lists(st.integers(-3, 3), max_size=4))), min_size=1, max_size=12)


def documents(flow):
    found = {}
    for r in flow.raw().df.collect():
        doc = json.loads(bytes(r.content).decode("utf-8", "replace"))
        found[doc["i"]] = (doc, None if r.err is None else True)
    return found


@settings(max_examples=2, phases=[Phase.generate], derandomize=True, deadline=None, suppress_health_check=list(HealthCheck))
@given(data=rows)
def test_compiled_mappings_equal_the_evaluator(spark, data):
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(data)], SCHEMA)
    for m in MAPPINGS:
        flow = from_table(df, ["i"])
        assert why_not(flow, m) is None, m
        compiled, evaluated = documents(mapping(flow, m, Resources())), documents(exact(flow, [{"mapping": m}], Resources()))
        assert compiled == evaluated, m


def test_dynamic_mappings_fall_back(spark):
    flow = from_table(spark.createDataFrame([(1, '{"k": 5}')], "i long, s string"), ["i"])
    assert why_not(flow, "root = this.s.parse_json()") is not None
    assert mapping(flow, "root = this.s.parse_json()", Resources()).rows_as("k long").collect()[0].k == 5


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(1000).withColumn("v", F.col("id") * 2).withColumn("w", F.lit("x")).write.parquet(str(tmp_path / "t"))
    flow = mapping(from_table(spark.read.parquet(str(tmp_path / "t")), ["id"]), "root.v = this.v", Resources())
    plan = flow.rows()._jdf.queryExecution().executedPlan().toString()
    assert "w" not in plan.split("ReadSchema:")[1].split("\n")[0]


def test_errors_travel_and_catch_recovers(spark):
    flow = from_table(spark.createDataFrame([(k, k % 2) for k in range(6)], "i long, d long"), ["i"])
    out = run_chain(flow, [{"mapping": "root.i = this.i\nroot.v = 10 / this.d"}])
    assert out.raw().df.filter("err is not null").count() == 3
    assert json.loads(bytes(out.raw().df.filter("err is not null").first().content))["d"] == 0
    back = run_chain(out, [{"mapping": "root = this"}, {"catch": [{"mapping": "root.i = this.i\nroot.v = -1.0"}]}])
    assert sorted(r.v for r in back.rows_as("v double").collect()) == [-1, -1, -1, 10, 10, 10]


@pytest.mark.parametrize("empty", [True, False])
def test_processors_of_batches(spark, empty):
    df = spark.createDataFrame([(b, t, f"m{t}") for b in range(2) for t in range(3)], "b long, t long, s string")
    flow = from_table(df.filter("b < 0") if empty else df, ["b", "t"], "b")
    n = lambda f: f.raw().df.count()
    assert n(run_chain(flow, [{"archive": {"format": "json_array"}}])) == (0 if empty else 2)
    assert n(run_chain(flow, [{"select_parts": {"parts": [2, 0, 9]}}])) == (0 if empty else 4)
    assert n(run_chain(flow, [{"bounds_check": {"max_parts": 2}}])) == 0
    assert n(run_chain(flow, [{"insert_part": {"index": 0, "content": "x"}}])) == (0 if empty else 8)
    assert run_chain(flow, [{"split": {"size": 2}}]).df.select("batch").distinct().count() == (0 if empty else 4)
    assert n(run_chain(flow, [{"split": {"byte_size": 1}}])) == (0 if empty else 6)


def test_dedupe_takes_the_first(spark):
    flow = from_table(spark.createDataFrame([(k, k % 3) for k in range(30)], "i long, u long"), ["i"])
    out = run_chain(flow, [{"dedupe": {"cache": "c", "key": "${! this.u }"}}], Resources(caches={"c": {"memory": {}}}))
    assert sorted(r.i for r in out.rows().collect()) == [0, 1, 2]


def test_unarchive(spark):
    flow = from_content(spark.createDataFrame([(1, "a\nb"), (2, "")], "i long, content string"), order_by=["i"])
    assert sorted(bytes(r.content) for r in run_chain(flow, [{"unarchive": {"format": "lines"}}]).df.collect()) == [b"", b"a", b"b"]
