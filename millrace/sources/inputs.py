"""Inputs: generated messages, files by scanner, unions and sequences of inputs, standard input, Kafka and HTTP."""

from __future__ import annotations

import sys
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.batches import ConfigError, Resources
from millrace.operators.flow import Flow, _no_err, from_content, from_table, mapping, run_chain
from millrace.sources.scanners import scan


def generate(spark: SparkSession, text: str, count: int, partitions: int | None = None) -> Flow:
    """``count`` messages made by a mapping; its document has ``id``, the number of the message from 0."""
    ids = spark.range(0, count, 1, partitions) if partitions else spark.range(count)
    return mapping(from_table(ids, ["id"]), text, Resources())


def generate_stream(spark: SparkSession, text: str, rows_a_second: int = 1) -> Flow:
    """Messages without end, at a rate."""
    rate = spark.readStream.format("rate").option("rowsPerSecond", rows_a_second).load()
    return mapping(from_table(rate.select(F.col("value").alias("id")), ["id"]), text, Resources())


def files(spark: SparkSession, paths: list[str], scanner: dict | None = None) -> Flow:
    """Files in the order of their paths, cut into messages by a scanner (lines by default)."""
    return scan(spark, paths, scanner or {"lines": {}})


def stdin(spark: SparkSession, scanner: dict | None = None) -> Flow:
    """Standard input of the driver, read to its end."""
    from millrace.sources.scanners import pieces

    rows = [(k, bytearray(c), m) for k, (c, m, _) in enumerate(pieces(sys.stdin.buffer.read(), scanner or {"lines": {}}, "stdin"))]
    return from_content(spark.createDataFrame(rows, "k long, content binary, m map<string,string>"), "content", ["k"], meta=F.col("m"))


def _alike(flows: list[Flow]) -> list[Flow]:
    kinds = {f.df.schema["doc"].dataType.simpleString() if f.typed else "" for f in flows}
    return flows if len(kinds) == 1 else [f.raw() for f in flows]


def broker(flows: list[Flow], copies: int = 1) -> Flow:
    """All messages of all inputs; nothing is said about their order across inputs."""
    flows = _alike(flows * copies)
    marked = [f.df.withColumn("ord", F.to_json(F.struct(F.lit(k).alias("input"), F.col("ord").alias("o")))) for k, f in enumerate(flows)]
    out = marked[0]
    for df in marked[1:]:
        out = out.unionByName(df)
    return replace(flows[0], df=out, single=all(f.single for f in flows), failing=any(f.failing for f in flows))


def sequence(flows: list[Flow]) -> Flow:
    """All messages of the first input, then those of the next: ``ord.seq`` comes first."""
    flows = _alike(flows)
    kinds = {f.df.schema["ord"].dataType.simpleString() for f in flows}
    marked = [f.df.withColumn("ord", F.struct(F.lit(k).alias("seq"), (F.col("ord") if len(kinds) == 1 else F.to_json("ord")).alias("o"))) for k, f in enumerate(flows)]
    out = marked[0]
    for df in marked[1:]:
        out = out.unionByName(df)
    return replace(flows[0], df=out, single=all(f.single for f in flows), failing=any(f.failing for f in flows))


def kafka_reader(spark: SparkSession, config: dict):
    """The configured Kafka stream reader; running it needs the Kafka connector on Spark's class path."""
    if not config.get("seed_brokers") and not config.get("addresses"):
        raise ConfigError("kafka: seed_brokers is needed")
    if not config.get("topics"):
        raise ConfigError("kafka: topics is needed")
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", ",".join(config.get("seed_brokers") or config["addresses"])).option("subscribe", ",".join(config["topics"]))
    reader = reader.option("startingOffsets", "earliest" if config.get("start_from_oldest", True) else "latest").option("includeHeaders", "true")
    if config.get("consumer_group"):
        reader = reader.option("kafka.group.id", config["consumer_group"])
    return reader


def kafka_flow(df: DataFrame) -> Flow:
    """Rows of the Kafka source as messages with their metadata."""
    meta = F.map_concat(
        F.create_map(F.lit("kafka_topic"), F.col("topic"), F.lit("kafka_partition"), F.col("partition").cast("string"), F.lit("kafka_offset"), F.col("offset").cast("string"), F.lit("kafka_timestamp_ms"), F.unix_millis("timestamp").cast("string"), F.lit("kafka_key"), F.coalesce(F.decode("key", "UTF-8"), F.lit(""))),
        F.map_from_entries(F.transform(F.coalesce("headers", F.array().cast("array<struct<key:string,value:binary>>")), lambda h: F.struct(h["key"], F.decode(h["value"], "UTF-8")))),
    )
    order = F.struct("topic", "partition", "offset")
    return Flow(df.select(F.col("value").alias("content"), meta.alias("meta"), _no_err().alias("err"), order.alias("ord"), F.to_json(order).alias("batch")), False)


def with_processors(flow: Flow, configs: list[dict], resources: Resources | None = None) -> Flow:
    return run_chain(flow, configs, resources)
