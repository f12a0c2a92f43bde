"""Outputs: standard output, files, drop, reject, and brokers, switches and fallbacks of outputs."""

from __future__ import annotations

import sys
import time
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.batches import ConfigError, Resources
from millrace.operators.flow import Flow, _check, key_column, run_chain

Output = Callable[[Flow], None]


def text(flow: Flow) -> DataFrame:
    return flow.raw().df


def stdout(flow: Flow) -> None:
    """One line a message, in order, fetched partition by partition."""
    for row in text(flow).orderBy("ord").select("content").toLocalIterator():
        sys.stdout.write(bytes(row.content).decode("utf-8", "replace").removesuffix("\n") + "\n")
    sys.stdout.flush()


def drop(flow: Flow) -> None:
    text(flow).write.format("noop").mode("overwrite").save()


def file(path: str) -> Output:
    """Lines under a folder; a path with an interpolation becomes a folder for each of its values."""
    def run(flow: Flow) -> None:
        if "${!" not in path:
            text(flow).select(F.decode("content", "UTF-8").alias("value")).write.mode("overwrite").text(path)
            return
        top, _, _ = path.partition("${!")
        top = top.rpartition("/")[0] or "."
        keyed = flow.df.withColumn("to", key_column(flow, path.removeprefix(top + "/")))
        rows = keyed
        value = F.decode(F.coalesce(F.col("content"), F.to_json("doc", {"ignoreNullFields": "false"}).cast("binary")), "UTF-8") if flow.typed else F.decode("content", "UTF-8")
        rows.select(value.alias("value"), "to").write.mode("overwrite").partitionBy("to").text(top)

    return run


def reject(message: str) -> Output:
    """Every write fails with the text."""
    def run(flow: Flow) -> None:
        first = text(flow).limit(1).collect()
        if first:
            raise RuntimeError(message)

    return run


def strict(flow: Flow) -> Flow:
    """Fail the whole write if any message carries an error."""
    raw = flow.raw()
    return replace(raw, df=raw.df.filter(F.when(F.col("err").isNotNull(), F.raise_error(F.col("err.msg"))).otherwise(F.lit(True)).cast("boolean")))


def routes(flow: Flow, cases: list[dict]) -> DataFrame:
    """The messages with ``route``: the numbers of the cases they go to; the first that holds, and further ones behind ``continue``."""
    holds = [_check(flow, c["check"]) if c.get("check") else F.lit(True) for c in cases]
    open_, parts = F.lit(True), []
    for k, (case, ok) in enumerate(zip(cases, holds)):
        parts.append(F.when(open_ & ok, F.lit(k)))
        if not case.get("continue"):
            open_ = open_ & ~ok
    return flow.df.withColumn("route", F.filter(F.array(*parts), lambda x: x.isNotNull()))


def switch(cases: list[dict], strict_mode: bool = False) -> Output:
    """``output`` of each case gets its messages; what matches none is dropped, or an error in strict mode."""
    if len(cases) < 2:
        raise ConfigError("switch: at least two cases are needed")

    def run(flow: Flow) -> None:
        marked = routes(flow, cases)
        if strict_mode and marked.filter(F.size("route") == 0).limit(1).count():
            raise RuntimeError("a message matched no case")
        for k, case in enumerate(cases):
            case["output"](replace(flow, df=marked.filter(F.array_contains("route", k)).drop("route")))

    return run


def broker(outputs: list[Output], pattern: str = "fan_out", copies: int = 1) -> Output:
    """fan_out: all outputs get all messages; round_robin and greedy: each batch goes to one."""
    outputs = outputs * copies
    if pattern not in ("fan_out", "fan_out_fail_fast", "fan_out_sequential", "fan_out_sequential_fail_fast", "round_robin", "greedy"):
        raise ConfigError(f"broker: pattern '{pattern}' is not known")

    def run(flow: Flow) -> None:
        if pattern.startswith("fan_out"):
            for o in outputs:
                o(flow) if pattern.endswith("fail_fast") else retry(o)(flow)
            return
        to = F.pmod(F.xxhash64("batch"), F.lit(len(outputs)))
        for k, o in enumerate(outputs):
            o(replace(flow, df=flow.df.filter(to == k)))

    return run


def fallback(outputs: list[Output]) -> Output:
    """The next output gets the messages, with the metadata ``fallback_error``, when one fails."""
    def run(flow: Flow) -> None:
        for k, o in enumerate(outputs):
            try:
                return o(flow)
            except Exception as e:  # whatever an output raises
                if k == len(outputs) - 1:
                    raise
                pair = F.create_map(F.lit("fallback_error"), F.lit(str(e)))
                flow = replace(flow, df=flow.df.withColumn("meta", F.map_concat(F.map_filter("meta", lambda key, _: key != "fallback_error"), pair)))
        return None

    return run


def retry(output: Output, attempts: int = 5, first: float = 0.5, factor: float = 1.5, most: float = 3.0) -> Output:
    def run(flow: Flow) -> None:
        wait = first
        for k in range(attempts):
            try:
                return output(flow)
            except Exception:  # whatever an output raises
                if k == attempts - 1:
                    raise
                time.sleep(wait)
                wait = min(most, wait * factor)
        return None

    return run


def with_processors(output: Output, configs: list[dict], resources: Resources | None = None) -> Output:
    return lambda flow: output(run_chain(flow, configs, resources))


def kafka_writer(flow: Flow, config: dict):
    """The configured Kafka writer of key, value and topic; running it needs the Kafka connector on Spark's class path."""
    rows = text(flow).select(F.try_element_at("meta", F.lit(config.get("key_metadata", "kafka_key"))).alias("key"), F.col("content").alias("value"), F.lit(config["topic"]).alias("topic"))
    return rows.write.format("kafka").option("kafka.bootstrap.servers", ",".join(config.get("seed_brokers") or config["addresses"]))
