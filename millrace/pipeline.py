"""Run a pipeline document as one Spark job: input, processors, output."""

from __future__ import annotations

from typing import Any

from pyspark.sql import SparkSession

from millrace.config import resources_of
from millrace.operators.batches import ConfigError, Resources
from millrace.operators.flow import Flow, batched, from_table, run_chain
from millrace.sources import inputs, network, outputs
from millrace.sources.scanners import from_codec


def _kind(node: dict) -> str:
    return next(k for k in node if k not in ("label", "processors", "batching", "auto_replay_nacks"))


def policy_of(node: dict) -> Any:
    """The batching policy in or beside the body of an input or output."""
    body = node[_kind(node)]
    return node.get("batching") or (body.get("batching") if isinstance(body, dict) else None)


def buffered(flow: Flow, buffer: dict, resources: Resources) -> Flow:
    """Batches of the memory buffer's policy, where it is enabled; holding messages is Spark's."""
    policy = dict((buffer.get("memory") or {}).get("batch_policy") or {})
    return batched(flow, policy, resources) if policy.pop("enabled", False) else flow


def read(spark: SparkSession, node: dict, doc: dict, resources: Resources) -> Flow:
    kind = _kind(node)
    c: Any = node[kind] or {}
    if kind == "resource":
        found = next((r for r in doc.get("input_resources") or [] if r.get("label") == c), None)
        if found is None:
            raise ConfigError(f"input resource '{c}' was not found")
        flow = read(spark, {k: v for k, v in found.items() if k != "label"}, doc, resources)
    elif kind == "generate":
        if not int(c.get("count", 0)):
            raise ConfigError("generate: a batch run needs a count; use a stream for messages without end")
        flow = inputs.generate(spark, c.get("mapping", "root = {}"), int(c["count"]))
    elif kind == "file":
        flow = inputs.files(spark, c["paths"], c.get("scanner") or (from_codec(c["codec"]) if c.get("codec") else None))
    elif kind == "stdin":
        flow = inputs.stdin(spark, c.get("scanner"))
    elif kind == "http_client":
        flow = network.http_client_input(spark, c)
    elif kind == "socket":
        flow = network.socket_input(spark, c)
    elif kind == "broker":
        flow = inputs.broker([read(spark, x, doc, resources) for x in c["inputs"]], int(c.get("copies", 1)))
    elif kind == "sequence":
        flow = inputs.sequence([read(spark, x, doc, resources) for x in c["inputs"]])
    elif kind == "table":
        flow = from_table(spark.read.format(c.get("format", "parquet")).load(c["path"]), c["order_by"], c.get("batch_by"))
    else:
        raise ConfigError(f"input '{kind}' needs a stream or isn't supported")
    if node.get("processors"):
        flow = run_chain(flow, node["processors"], resources)
    if b := policy_of(node):
        flow = batched(flow, b, resources)
    return flow


def sink(node: dict, doc: dict, resources: Resources) -> outputs.Output:
    kind = _kind(node)
    c: Any = node[kind] or {}
    if kind == "resource":
        found = next((r for r in doc.get("output_resources") or [] if r.get("label") == c), None)
        if found is None:
            raise ConfigError(f"output resource '{c}' was not found")
        out = sink({k: v for k, v in found.items() if k != "label"}, doc, resources)
    elif kind == "stdout":
        out = outputs.stdout
    elif kind == "drop":
        out = outputs.drop
    elif kind == "file":
        out = outputs.file(c["path"])
    elif kind == "reject":
        out = outputs.reject(str(c))
    elif kind == "broker":
        out = outputs.broker([sink(x, doc, resources) for x in c["outputs"]], c.get("pattern", "fan_out"), int(c.get("copies", 1)))
    elif kind == "switch":
        out = outputs.switch([case | {"output": sink(case["output"], doc, resources)} for case in c["cases"]], bool(c.get("strict_mode")))
    elif kind == "fallback":
        out = outputs.fallback([sink(x, doc, resources) for x in c])
    elif kind == "http_client":
        out = network.http_client_output(c)
    elif kind == "socket":
        out = network.socket_output(c)
    elif kind == "kafka":
        out = lambda flow: outputs.kafka_writer(flow, c).save()
    else:
        raise ConfigError(f"output '{kind}' is not supported in a batch run")
    if b := policy_of(node):
        write = out
        out = lambda flow: write(batched(flow, b, resources))
    return outputs.with_processors(out, node["processors"], resources) if node.get("processors") else out


def run(spark: SparkSession, doc: dict, functions: dict | None = None) -> None:
    resources = resources_of(doc, functions)
    flow = buffered(read(spark, doc.get("input") or {"stdin": {}}, doc, resources), doc.get("buffer") or {}, resources)
    flow = run_chain(flow, (doc.get("pipeline") or {}).get("processors") or [], resources)
    if (doc.get("error_handling") or {}).get("strict"):
        flow = outputs.strict(flow)
    sink(doc.get("output") or {"stdout": {}}, doc, resources)(flow)
