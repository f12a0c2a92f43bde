"""Pipelines over streams: the same functions of flows, with checkpoints for at-least-once delivery."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.operators.batches import ConfigError, Resources
from millrace.operators.flow import Flow, from_content, key_column, run_chain
from millrace.sources.outputs import Output, retry

#: Processors that need whole batches or an order of all messages; inside a micro-batch they see that micro-batch.
WHOLE = {"archive", "split", "group_by", "dedupe", "bounds_check", "select_parts", "insert_part"}


def lines(spark: SparkSession, folder: str, files_a_trigger: int | None = None) -> DataFrame:
    """Lines of files as they appear under a folder."""
    reader = spark.readStream.format("text")
    if files_a_trigger:
        reader = reader.option("maxFilesPerTrigger", files_a_trigger)
    return reader.load(folder)


def kinds(node: Any, resources: Resources) -> set[str]:
    """The processors a chain names at any depth, through resources too."""
    if isinstance(node, list):
        return set().union(*(kinds(x, resources) for x in node))
    if not isinstance(node, dict):
        return set()
    found = set(node).union(*(kinds(x, resources) for x in node.values()))
    label = node.get("resource")
    if isinstance(label, str) and label in resources.processors:
        rest = Resources({k: v for k, v in resources.processors.items() if k != label}, resources.caches, resources.rate_limits, resources.functions)
        found |= kinds(resources.processors[label], rest)
    return found


def start(df: DataFrame, make: Callable[[DataFrame], Flow], configs: list[dict], output: Output, checkpoint: str, resources: Resources | None = None, interval: str | None = None, attempts: int = 5) -> StreamingQuery:
    """Start a stream: each micro-batch becomes a flow, runs through the processors and is written, again until it succeeds or
    ``attempts`` are used up. ``interval`` is the trigger; without it what is there is processed and the query ends."""
    resources = resources or Resources()
    if "dedupe" in kinds(configs, resources):
        raise ConfigError("dedupe is not supported in the chain of a stream, where each micro-batch would forget the keys; use dedupe_stream before it")
    write = retry(output, attempts)

    def batch(rows: DataFrame, number: int) -> None:
        kept = rows.persist()
        try:
            write(run_chain(make(kept), configs, resources))
        finally:
            kept.unpersist()

    writer = df.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    return writer.start()


def from_lines(df: DataFrame) -> Flow:
    return from_content(df, "value", ["value"])


def dedupe_stream(flow: Flow, key: str, time_column: str, ttl: str) -> Flow:
    """First message of each key within the time a key is remembered, over a whole stream."""
    marked = flow.df.withColumns({"_key": key_column(flow, key), "_at": F.col("doc").getField(time_column).cast("timestamp")})
    return replace(flow, df=marked.withWatermark("_at", ttl).dropDuplicatesWithinWatermark(["_key"]).drop("_key", "_at"))


def period_batches(flow: Flow, time_column: str, period: str) -> Flow:
    """Batches of the messages whose time is in the same window of a period."""
    window = F.window(F.col("doc").getField(time_column).cast("timestamp"), period)
    return replace(flow, df=flow.df.withColumn("batch", F.date_format(window["start"], "yyyy-MM-dd'T'HH:mm:ss.SSS")), single=False)
