"""Message pipelines as DataFrame plans.

A flow is a DataFrame with one row a message: ``doc`` (a struct, where the types are known) or ``content`` (bytes), ``meta``, ``err``, an orderable
``ord`` in place of arrival order and ``batch``, the key of the batch. Processors are functions of flows. Mappings compile to Columns
where they can; otherwise, and for processors that work on whole batches in ways SQL lacks, the exact evaluator runs in Arrow
tasks, by batch only where a batch matters.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators import batches
from millrace.operators.batches import ConfigError, Resources, name_of
from millrace.plans.columns import Lowering, Scope, Unsupported, Val, compile_mapping, utc_wall
from millrace.plans.evaluator import Message
from millrace.plans.parser import interpolated, parse
from millrace.shipping import ship

ERR = "struct<msg:string,name:string,label:string,path:string>"
_META = pa.map_(pa.string(), pa.string())
_ERRORS = pa.struct([(n, pa.string()) for n in ("msg", "name", "label", "path")])
_BATCHED = re.compile(r"\b(from|from_all|batch_index|batch_size)\s*\(")
_ORDERED = re.compile(r"\b(counter|count|random_int|snowflake_id)\s*\(")


def _no_err() -> Column:
    return F.lit(None).cast(ERR)


@dataclass(frozen=True)
class Flow:
    df: DataFrame
    typed: bool
    single: bool = True  # every message is a batch of its own
    failing: bool = False  # rows may carry an error
    aside: DataFrame | None = None  # messages that failed in a typed mapping, as bytes

    @property
    def fields(self) -> dict[str, Val]:
        return {f.name: Val(F.col("doc").getField(f.name), f.dataType) for f in self.df.schema["doc"].dataType.fields}

    def ids(self, indexed: bool = False) -> dict[str, Column]:
        out = {"meta": F.col("meta"), "error": F.col("err.msg"), "errored": F.col("err").isNotNull()}
        if self.single:
            out |= {"batch_index": F.lit(0).cast("long"), "batch_size": F.lit(1).cast("long")}
        else:
            whole = Window.partitionBy("batch")
            out |= {"batch_index": (F.row_number().over(whole.orderBy("ord")) - 1).cast("long"), "batch_size": F.count("*").over(whole)}
        return out

    def raw(self) -> "Flow":
        """The same messages as bytes."""
        if not self.typed:
            return self
        if self.aside is not None:
            return replace(self, df=replace(self, aside=None).raw().df.unionByName(self.aside), typed=False, failing=True, aside=None)
        text = F.coalesce(F.col("content"), _json(self.df.schema["doc"].dataType))
        return replace(self, df=self.df.select(text.alias("content"), "meta", "err", "ord", "batch"), typed=False)

    def parted(self) -> tuple["Flow", "Flow"]:
        """Messages without an error, still typed, and those with one."""
        failed = replace(self, df=self.df.filter("err is not null"), aside=None).raw()
        if self.aside is not None:
            failed = replace(failed, df=failed.df.unionByName(self.aside))
        return replace(self, df=self.df.filter("err is null"), failing=False, aside=None), failed

    def rows(self) -> DataFrame:
        """The documents as columns; messages with an error are left out."""
        if not self.typed:
            raise ValueError("the documents have no schema; use rows_as")
        df = self.df.filter("err is null") if self.failing else self.df
        return df.select("doc.*")

    def rows_as(self, schema: str) -> DataFrame:
        """Documents read by a schema, whichever form they are in; messages with an error are left out."""
        raw = self.raw().df.filter("err is null")
        return raw.select(F.from_json(F.decode("content", "UTF-8"), schema).alias("d")).select("d.*")


def _json(kind: T.StructType) -> Column:
    """The document as the evaluator would write it: keys sorted, whole doubles without a fraction, nulls kept."""
    def shaped(c: Column, t: T.DataType) -> Column:
        if isinstance(t, T.StructType):
            return F.struct(*(shaped(c.getField(f.name), f.dataType).alias(f.name) for f in sorted(t.fields, key=lambda f: f.name)))
        if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            c = utc_wall(c) if isinstance(t, T.TimestampType) else c
            return F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.regexp_replace(F.date_format(c, ".SSSSSS"), r"\.?0+$", ""), F.lit("Z"))
        return c

    return F.to_json(shaped(F.col("doc"), kind), {"ignoreNullFields": "false"}).cast("binary")


def from_table(df: DataFrame, order_by: list[str], batch_by: str | None = None, doc: list[str] | None = None) -> Flow:
    """Messages whose documents are the rows of a table. ``order_by`` stands for arrival order; ``batch_by`` makes batches of equal keys."""
    names = doc or df.columns
    order = F.struct(*order_by)
    key = F.col(batch_by).cast("string") if batch_by else F.to_json(order)
    out = df.select(F.struct(*(F.col(c) for c in sorted(names))).alias("doc"), F.lit(None).cast("binary").alias("content"), F.lit(None).cast("map<string,string>").alias("meta"), _no_err().alias("err"), order.alias("ord"), key.alias("batch"))
    out = out.withColumn("meta", F.create_map().cast("map<string,string>"))
    return Flow(out, True, batch_by is None)


def from_content(df: DataFrame, content: str = "content", order_by: list[str] | None = None, batch_by: str | None = None, meta: Column | None = None) -> Flow:
    """Messages whose contents are a text or binary column."""
    order = F.struct(*(order_by or [content]))
    key = F.col(batch_by).cast("string") if batch_by else F.to_json(order)
    return Flow(df.select(F.col(content).cast("binary").alias("content"), (meta if meta is not None else F.create_map()).cast("map<string,string>").alias("meta"), _no_err().alias("err"), order.alias("ord"), key.alias("batch")), False, batch_by is None)


# mappings
def mapping(flow: Flow, text: str, resources: Resources, mutate: bool = False, source: dict | None = None) -> Flow:
    source = source or {"name": "mutation" if mutate else "mapping", "label": "", "path": ""}
    if flow.typed and (flow.failing or flow.aside is not None):
        # the failed ones go on with the content they had; they are only read if someone asks for them
        main, failed = flow.parted()
        out, rest = mapping(main, text, resources, mutate, source), exact(failed, [{"mutation" if mutate else "mapping": text}], resources)
        return replace(out, aside=rest.df) if out.typed else replace(out, df=out.df.unionByName(rest.df))
    if flow.typed and not flow.failing:
        try:
            return _compiled(flow, text, mutate, source)
        except Unsupported:
            pass
    return exact(flow, [{"mutation" if mutate else "mapping": text}], resources)


def why_not(flow: Flow, text: str, mutate: bool = False) -> str | None:
    """What keeps a mapping from being compiled; null where it is compiled."""
    try:
        _compiled(flow, text, mutate, {"name": "", "label": "", "path": ""})
        return None
    except Unsupported as e:
        return str(e)


def _compiled(flow: Flow, text: str, mutate: bool, source: dict) -> Flow:
    c = compile_mapping(text, flow.fields, flow.ids(), mutate)
    df = flow.df
    extra: dict[str, Column] = {}
    if c.error is not None:
        extra["_error"] = c.error
    if c.deleted is not None:
        extra["_deleted"] = F.coalesce(c.deleted, F.lit(False))
    if not c.fields and c.root is None:
        if c.deleted is None and c.meta is None:
            raise Unsupported("an empty document")
        new = F.col("doc")
    elif c.root is not None:
        if not isinstance(c.root.type, (T.StringType, T.BinaryType)):
            raise Unsupported("a root that is neither an object nor text")
        extra["_content"] = c.root.col.cast("binary")
        new = F.col("doc")
    else:
        new = F.struct(*(c.fields[k].col.alias(k) for k in sorted(c.fields)))
    out = df.select("*", new.alias("_doc"), *(v.alias(k) for k, v in extra.items()), *([c.meta.alias("_meta")] if c.meta is not None else []))
    if c.deleted is not None:
        keep = ~F.col("_deleted")
        out = out.filter(keep if c.error is None else keep | F.col("_error").isNotNull())
    old_json = _json(df.schema["doc"].dataType)
    failed = F.col("_error").isNotNull() if c.error is not None else None
    content = F.col("_content") if c.root is not None else F.lit(None).cast("binary")
    doc, err = F.col("_doc"), F.col("err")
    if failed is not None:
        content = F.when(failed, F.coalesce(F.col("content"), old_json)).otherwise(content)
        doc = F.when(~failed, doc)
        err = F.when(failed, F.struct(F.col("_error").alias("msg"), *(F.lit(source[k]).alias(k) for k in ("name", "label", "path")))).otherwise(err)
    out = out.select(doc.alias("doc"), content.alias("content"), (F.col("_meta") if c.meta is not None else F.col("meta")).alias("meta"), err.cast(ERR).alias("err"), "ord", "batch")
    flow = replace(flow, df=out, failing=flow.failing or failed is not None)
    return flow.raw() if c.root is not None else flow


# the exact evaluator
def exact(flow: Flow, configs: list[dict], resources: Resources) -> Flow:
    """Run processors by the evaluator, in Arrow tasks; batches are brought together only where a processor looks at them."""
    raw = flow.raw()
    ship(raw.df.sparkSession)
    text = repr(configs)
    together = not flow.single or bool(_BATCHED.search(text))
    df = raw.df
    if together and not flow.single:
        df = df.repartition("batch").sortWithinPartitions("batch", "ord")
    elif _ORDERED.search(text):
        df = df.sortWithinPartitions("ord")
    order = df.schema["ord"].dataType
    columns = ["content", "meta", "err", "ord", "batch"]
    caches, limits, named, functions = resources.caches, resources.rate_limits, resources.processors, resources.functions

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Resources(named, caches, limits, functions)
        step = batches.chain(configs, own)
        schema = None

        def packed(ms: list[Message], order: pa.Array, key: pa.Array) -> pa.RecordBatch:
            if any(m.meta for m in ms):
                meta = pa.array([[(k, v if isinstance(v, str) else batches.text_of(v)) for k, v in m.meta.items()] for m in ms], _META)
            else:
                meta = pa.MapArray.from_arrays(pa.array([0] * (len(ms) + 1), pa.int32()), pa.array([], pa.string()), pa.array([], pa.string()))
            err = pa.array([m.err for m in ms], _ERRORS) if any(m.err for m in ms) else pa.nulls(len(ms), _ERRORS)
            return pa.RecordBatch.from_arrays([pa.array([m.content for m in ms], pa.binary()), meta, err, order, key], names=columns)

        def emit(found: list[tuple[str, list[tuple[Message, Any]]]]) -> pa.RecordBatch:
            rows = [(m, o, key) for key, ms in found for m, o in ms]
            return packed([m for m, _, _ in rows], pa.array([o for _, o, _ in rows], schema.field("ord").type), pa.array([k for _, _, k in rows], pa.string()))

        def alone(part: pa.RecordBatch) -> pa.RecordBatch:
            """Each message is a batch of its own: order and batch stay in Arrow."""
            out, at, later = [], [], {}
            for k, m in enumerate(messages(part)):
                for j, b in enumerate(step([m])):
                    if j:
                        later.update((n, j) for n in range(len(out), len(out) + len(b)))
                    out += b
                    at += [k] * len(b)
            index = pa.array(at, pa.int32())
            key = part.column(4).take(index)
            if later:
                key = pa.array([f"{k}/{later[n]}" if n in later else k for n, k in enumerate(key.to_pylist())], pa.string())
            return packed(out, part.column(3).take(index), key)

        def messages(part: pa.RecordBatch) -> Iterator[Message]:
            n, meta, err = part.num_rows, part.column(1), part.column(2)
            metas = meta.to_pylist() if n and meta.offsets[n].as_py() > meta.offsets[0].as_py() else [None] * n
            errs = err.to_pylist() if err.null_count < n else [None] * n
            return (Message(c, meta=dict(m or []), err=e) for c, m, e in zip(part.column(0).to_pylist(), metas, errs))

        def solve(key: str, members: list[tuple[Message, Any]]) -> list:
            out = []
            orders = [o for _, o in members]
            for k, b in enumerate(step([m for m, _ in members])):
                name = key if k == 0 else f"{key}/{k}"
                out.append((name, [(m, orders[min(j, len(orders) - 1)]) for j, m in enumerate(b)]))
            return out

        held_key, held = None, []
        for part in parts:
            schema = part.schema
            if not together:
                yield alone(part)
                continue
            found = []
            for m, ord_, key in zip(messages(part), part.column(3).to_pylist(), part.column(4).to_pylist()):
                if held and key != held_key:
                    found += solve(held_key, held)
                    held = []
                held_key = key
                held.append((m, ord_))
            if found:
                yield emit(found)
        if held:
            yield emit(solve(held_key, held))

    kinds = T.StructType([T.StructField("content", T.BinaryType()), T.StructField("meta", T.MapType(T.StringType(), T.StringType())), T.StructField("err", df.schema["err"].dataType), T.StructField("ord", order), T.StructField("batch", T.StringType())])
    return Flow(df.select(*columns).mapInArrow(run, kinds), False, flow.single and "unarchive" not in text and "split" not in text and "group_by" not in text, True)


# processors
def _check(flow: Flow, text: str) -> Column:
    """A condition as a Column; one that fails isn't met."""
    m = parse(text)
    if len(m.statements) != 1 or m.statements[0][:2] != ("assign", []):
        raise Unsupported("a check of several statements")
    v = Lowering(Scope(flow.fields, maps=m.maps, ids=flow.ids())).at(m.statements[0][2])
    if not isinstance(v.type, T.BooleanType):
        return F.lit(False)
    ok = v.col if v.err is None else F.when(v.err.isNull(), v.col)
    return F.coalesce(ok, F.lit(False))


def _together(flows: list[Flow]) -> Flow:
    first = flows[0]
    if all(f.typed for f in flows) and len({f.df.schema["doc"].dataType.simpleString() for f in flows}) > 1 or not all(f.typed for f in flows):
        flows = [f.raw() for f in flows]
    out = flows[0].df
    for f in flows[1:]:
        out = out.unionByName(f.df)
    return Flow(out, flows[0].typed, first.single, any(f.failing for f in flows))


def switch(flow: Flow, cases: list[dict], resources: Resources, group: bool = False) -> Flow:
    """Route each message to the first case whose check holds; ``group`` also makes a batch of each case, what matches none comes last."""
    if not flow.typed or flow.failing:
        return exact(flow, [{"group_by" if group else "switch": cases}], resources)
    try:
        number = F.lit(len(cases))
        for k in range(len(cases) - 1, -1, -1):
            number = F.when(_check(flow, cases[k]["check"]) if cases[k].get("check") else F.lit(True), F.lit(k)).otherwise(number)
        marked = flow.df.withColumn("_case", number)
    except Unsupported:
        return exact(flow, [{"group_by" if group else "switch": cases}], resources)
    flows = []
    for k in range(len(cases) + 1):
        own = marked.filter(F.col("_case") == k)
        if group:
            own = own.withColumn("batch", F.concat("batch", F.lit(f"#{k:03d}")))
        one = replace(flow, df=own.drop("_case"), single=flow.single)
        flows.append(run_chain(one, cases[k].get("processors") or [], resources) if k < len(cases) else one)
    return _together(flows)


def catch(flow: Flow, configs: list[dict], resources: Resources) -> Flow:
    """Messages with an error go through the children and lose it; the others pass."""
    if not flow.failing:
        return flow
    fine, failed = replace(flow, df=flow.df.filter("err is null"), failing=False), replace(flow, df=flow.df.filter("err is not null"))
    return _together([fine, exact(failed.raw(), [{"catch": configs}], resources)])


def split(flow: Flow, config: dict, resources: Resources) -> Flow:
    if int(config.get("byte_size", 0)) > 0:
        return exact(flow, [{"split": config}], resources)
    size = max(1, int(config.get("size", 1)))
    at = F.row_number().over(Window.partitionBy("batch").orderBy("ord")) - 1
    return replace(flow, df=flow.df.withColumn("batch", F.concat("batch", F.lit("/"), F.lpad(F.floor(at / size).cast("string"), 12, "0"))), single=flow.single)


def archive(flow: Flow, config: dict, resources: Resources) -> Flow:
    """One message a batch; lists of contents stay as large as a batch."""
    form = config["format"]
    if form not in ("json_array", "lines", "concatenate"):
        raise ConfigError(f"archive: format '{form}' is not supported")
    raw = flow.raw().df
    parts = F.array_sort(F.collect_list(F.struct("ord", F.decode("content", "UTF-8").alias("c"))))
    one = raw.groupBy("batch").agg(parts.alias("p"), F.min_by("meta", "ord").alias("meta"), F.min("ord").alias("ord"))
    text = F.array_join(F.transform("p", lambda x: x["c"]), {"json_array": ",", "lines": "\n", "concatenate": ""}[form])
    if form == "json_array":
        text = F.concat(F.lit("["), text, F.lit("]"))
    return Flow(one.select(text.cast("binary").alias("content"), "meta", _no_err().alias("err"), "ord", "batch"), False, flow.single, False)


def unarchive(flow: Flow, config: dict, resources: Resources) -> Flow:
    if config["format"] != "lines":
        return exact(flow, [{"unarchive": config}], resources)
    raw = flow.raw()
    lines = F.posexplode(F.split(F.decode("content", "UTF-8"), "\n", -1)).alias("_k", "_c")
    out = raw.df.select("*", lines).select(F.col("_c").cast("binary").alias("content"), "meta", "err", F.struct("ord", "_k").alias("ord"), "batch")
    return Flow(out, False, False, raw.failing)


def key_column(flow: Flow, text: str) -> Column:
    parts = []
    for p in interpolated(text):
        if isinstance(p, str):
            parts.append(F.lit(p))
            continue
        v = Lowering(Scope(flow.fields, ids=flow.ids())).at(p)
        if v.err is not None or not isinstance(v.type, (T.StringType, T.LongType, T.BooleanType)):
            raise Unsupported("a key that may fail")
        parts.append(F.coalesce(v.col.cast("string"), F.lit("null")))
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def dedupe(flow: Flow, config: dict, resources: Resources) -> Flow:
    """The first message of each key in arrival order. A batch plan keeps all keys (no expiry); the first of each task's rows is taken before
    rows meet, so a hot key costs one row a task. Streams use ``dropDuplicatesWithinWatermark``."""
    if config.get("cache") not in resources.caches:
        raise ConfigError(f"cache resource '{config.get('cache')}' was not found")
    try:
        key = key_column(flow, config["key"]) if flow.typed else None
    except Unsupported:
        key = None
    if key is None:
        return exact(replace(flow.raw(), df=flow.raw().df.repartition(1).sortWithinPartitions("ord")), [{"dedupe": config}], resources)
    if flow.df.isStreaming:
        return replace(flow, df=flow.df.withColumn("_key", key).dropDuplicates(["_key"]).drop("_key"))
    columns = flow.df.columns
    kept = flow.df.withColumn("_key", key).groupBy("_key").agg(F.min_by(F.struct(*columns), "ord").alias("_m"))
    return replace(flow, df=kept.select("_m.*"))


def bounds_check(flow: Flow, config: dict, resources: Resources) -> Flow:
    c = {"min_parts": 1, "max_parts": 100, "min_part_size": 1, "max_part_size": 1 << 30} | (config or {})
    raw = flow.raw()
    size = F.octet_length("content")
    if flow.single:
        ok = size.between(c["min_part_size"], c["max_part_size"]) & F.lit(c["min_parts"] <= 1 <= c["max_parts"])
        return replace(raw, df=raw.df.filter(ok))
    w = Window.partitionBy("batch")
    out = raw.df.withColumns({"_n": F.count("*").over(w), "_low": F.min(size).over(w), "_high": F.max(size).over(w)})
    return replace(raw, df=out.filter((F.col("_n").between(c["min_parts"], c["max_parts"])) & (F.col("_low") >= c["min_part_size"]) & (F.col("_high") <= c["max_part_size"])).drop("_n", "_low", "_high"))


def select_parts(flow: Flow, config: dict, resources: Resources) -> Flow:
    parts = [int(p) for p in (config or {}).get("parts", [0])]
    w = Window.partitionBy("batch")
    at = (F.row_number().over(w.orderBy("ord")) - 1).alias("_at")
    rows = flow.df.select("*", at, F.count("*").over(w).alias("_n"))
    places = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(p).alias("p")) for k, p in enumerate(parts)))
    mine = F.filter(places, lambda x: F.when(x["p"] < 0, x["p"] + F.col("_n")).otherwise(x["p"]) == F.col("_at"))
    out = rows.select("*", F.explode(mine).alias("_to")).withColumn("ord", F.struct(F.col("_to.k").alias("k"), F.col("ord").alias("o"))).drop("_at", "_n", "_to")
    return replace(flow, df=out.select(*flow.df.columns))


def insert_part(flow: Flow, config: dict, resources: Resources) -> Flow:
    return exact(replace(flow, single=False), [{"insert_part": config or {}}], resources)


def for_each(flow: Flow, configs: list[dict], resources: Resources) -> Flow:
    """Each message as a batch of its own while the children run."""
    if flow.single:
        return run_chain(flow, configs, resources)
    return exact(flow, [{"for_each": configs}], resources)


def workflow(flow: Flow, config: dict, resources: Resources) -> Flow:
    return exact(flow, [{"workflow": config}], resources)


def branch(flow: Flow, config: dict, resources: Resources) -> Flow:
    """Request, children and result on one row: the original document stands beside the request's, so there is no join."""
    children = config.get("processors") or []
    if flow.typed and not flow.failing and all(name_of(c) in ("mapping", "mutation", "bloblang", "noop") for c in children) and config.get("result_map"):
        try:
            return _branch_compiled(flow, config, children)
        except Unsupported:
            pass
    return exact(flow, [{"branch": config}], resources)


def _branch_compiled(flow: Flow, config: dict, children: list[dict]) -> Flow:
    fields, ids, skipped, errors = flow.fields, flow.ids(), None, []
    steps = ([(config["request_map"], False, "request mapping failed: ")] if config.get("request_map") else []) + [(next(iter(c.values())), name_of(c) == "mutation", "processors failed: ") for c in children if name_of(c) != "noop"]
    now = fields
    for k, (text, mutate, what) in enumerate([*steps, (config["result_map"], False, "result mapping failed: ")]):
        c = compile_mapping(text, now, ids, mutate)
        if c.root is not None or c.meta is not None or c.deleted is not None and (k or not config.get("request_map")) or not c.fields:
            raise Unsupported("a branch step that leaves the document's form")
        if c.error is not None:
            errors.append(F.when(c.error.isNotNull(), F.concat(F.lit(what), c.error)))
        skipped = c.deleted if c.deleted is not None else skipped
        now = c.fields
    skip = F.coalesce(skipped, F.lit(False)) if skipped is not None else None
    out = dict(fields)
    for name, v in now.items():
        if skip is not None and name not in fields:
            raise Unsupported("a result field that skipped messages lack")
        out[name] = v if skip is None else Val(F.when(skip, fields[name].col).otherwise(v.col), v.type)
    new = F.struct(*(out[k].col.alias(k) for k in sorted(out)))
    if not errors:
        return replace(flow, df=flow.df.withColumn("doc", new))
    error = F.coalesce(*errors)
    error = error if skip is None else F.when(~skip, error)
    df = flow.df.select("*", new.alias("_doc"), error.alias("_error"))
    failed = F.col("_error").isNotNull()
    err = F.when(failed, F.struct(F.col("_error").alias("msg"), F.lit("branch").alias("name"), F.lit("").alias("label"), F.lit("").alias("path"))).otherwise(F.col("err"))
    out_df = df.select(F.when(~failed, F.col("_doc")).alias("doc"), F.when(failed, F.coalesce(F.col("content"), _json(flow.df.schema["doc"].dataType))).alias("content"), "meta", err.cast(ERR).alias("err"), "ord", "batch")
    return replace(flow, df=out_df, failing=True)


def _exactly(kind: str) -> Callable:
    return lambda flow, config, resources: exact(flow, [{kind: config}], resources)


PROCESSORS: dict[str, Callable[[Flow, Any, Resources], Flow]] = {
    "mapping": mapping, "bloblang": mapping, "mutation": lambda f, c, r: mapping(f, c, r, True), "switch": switch, "group_by": lambda f, c, r: replace(switch(f, c, r, True), single=False), "catch": catch, "try": lambda f, c, r: run_chain(f, c or [], r), "split": split,
    "archive": archive, "unarchive": unarchive, "dedupe": dedupe, "bounds_check": bounds_check, "select_parts": select_parts, "insert_part": insert_part, "for_each": for_each, "branch": branch, "workflow": workflow, "compress": _exactly("compress"),
    "decompress": _exactly("decompress"), "log": _exactly("log"), "sleep": _exactly("sleep"), "rate_limit": lambda f, c, r: f, "noop": lambda f, c, r: f, "python": _exactly("python"), "cpp": _exactly("cpp"),
}


def run_chain(flow: Flow, configs: list[dict], resources: Resources | None = None) -> Flow:
    """Apply processors one after another."""
    resources = resources or Resources()
    for config in configs or []:
        kind = name_of(config)
        if kind == "resource":
            if config[kind] not in resources.processors:
                raise ConfigError(f"processor resource '{config[kind]}' was not found")
            flow = run_chain(flow, [resources.processors[config[kind]]], resources)
            continue
        if kind not in PROCESSORS:
            raise ConfigError(f"processor '{kind}' is not known or not supported")
        if flow.aside is not None and kind not in ("mapping", "bloblang", "mutation", "noop", "rate_limit", "try"):
            flow = flow.raw()
        flow = PROCESSORS[kind](flow, config[kind], resources)
    return flow


# batching policies
POLICY = ("count", "byte_size", "check", "period", "processors")


def policy_problems(policy: Any) -> list[str]:
    """What of a policy's fields can't be run as written."""
    if not isinstance(policy, dict):
        return ["batching: expected an object"]
    found = [f"batching: field '{k}' not recognised" for k in policy if k not in POLICY]
    if str(policy.get("period") or "0s") not in ("0s", "0"):
        found.append("batching: period is not supported in documents: messages of a batch run have no time of arrival")
    for k in ("count", "byte_size"):
        try:
            int(policy.get(k) or 0)
        except (TypeError, ValueError):
            found.append(f"batching: {k} is not a number")
    if policy.get("processors") and not any(policy.get(k) for k in ("count", "byte_size", "check", "period")):
        found.append("batching: a policy with processors needs a count, a byte_size or a check")
    return found


def batched(flow: Flow, policy: dict, resources: Resources) -> Flow:
    """A document's policy with its processors; one without a trigger leaves the batches alone."""
    if found := policy_problems(policy):
        raise ConfigError("; ".join(found))
    count, byte_size, check = int(policy.get("count") or 0), int(policy.get("byte_size") or 0), policy.get("check")
    if count <= 0 and byte_size <= 0 and not check:
        return flow
    return run_chain(batching(flow, count, check, byte_size=byte_size), policy.get("processors") or [], resources)


def batching(flow: Flow, count: int = 0, check: str | None = None, order: Column | None = None, key: str | None = None, byte_size: int = 0) -> Flow:
    """Batches that end with the message that makes them ``count`` messages or ``byte_size`` bytes, or that a check holds for, whichever
    comes first, within each value of the column ``key`` of the document, or over all messages, which then have to be put in one order."""
    if count <= 0 and byte_size <= 0 and not check:
        raise ConfigError("batching needs a count, a byte_size or a check")
    if flow.aside is not None:
        if key:
            raise ConfigError("batching by a key needs messages that are all typed")
        flow = flow.raw()
    by = [F.col("doc").getField(key)] if key else []
    w = Window.partitionBy(*by).orderBy("ord")
    ends = None
    if check and flow.typed and not flow.failing and not _BATCHED.search(check):
        try:
            ends = _check(flow, check)
        except Unsupported:
            pass
    if not check and byte_size <= 0:
        df = flow.df.withColumn("_b", F.floor((F.row_number().over(w) - 1) / count))
    elif ends is not None and count <= 0 and byte_size <= 0:
        before = F.coalesce(F.lag(ends.cast("int")).over(w), F.lit(0))
        df = flow.df.withColumn("_before", before).withColumn("_b", F.sum("_before").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_before")
    else:
        df = _accumulated(flow, count, byte_size, check, ends, by)
    name = F.lpad(F.col("_b").cast("string"), 12, "0")
    if key:
        name = F.concat(F.coalesce(F.col("doc").getField(key).cast("string"), F.lit("")), F.lit("/"), name)
    return replace(flow, df=df.withColumn("batch", name).drop("_b"), single=False)


def _accumulated(flow: Flow, count: int, byte_size: int, check: str | None, ends: Column | None, by: list[Column]) -> DataFrame:
    """The messages with ``_b``, the number of their batch: one task goes through a key's messages in order and ends a batch by the first
    trigger that fires. A check that isn't compiled is evaluated there, over the batch so far where it looks at batches."""
    ship(flow.df.sparkSession)
    columns = flow.df.columns
    content = F.coalesce(F.col("content"), _json(flow.df.schema["doc"].dataType)) if flow.typed else F.col("content")
    dynamic, whole = check is not None and check != "" and ends is None, bool(check and _BATCHED.search(check))
    df = flow.df.select(
        *columns, F.to_json(F.struct(*(c.alias("k") for c in by))).alias("_key") if by else F.lit("").alias("_key"), F.octet_length(content).cast("long").alias("_size") if byte_size > 0 else F.lit(0).cast("long").alias("_size"),
        (ends if ends is not None else F.lit(False)).alias("_ends"), (content if dynamic else F.lit(None).cast("binary")).alias("_text"),
    )
    df = (df.repartition("_key") if by else df.repartition(1)).sortWithinPartitions("_key", "ord")
    n, meta, err = len(columns), columns.index("meta"), columns.index("err")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = batches.check(check) if dynamic else None
        last, number, held, size, members = None, 0, 0, 0, []
        for part in parts:
            numbers = []
            texts = zip(*(part.column(k).to_pylist() for k in (n + 3, meta, err))) if dynamic else iter([(None, None, None)] * part.num_rows)
            for key, more, ended, (text, m, e) in zip(part.column(n).to_pylist(), part.column(n + 1).to_pylist(), part.column(n + 2).to_pylist(), texts):
                if key != last:
                    last, number, held, size, members = key, 0, 0, 0, []
                numbers.append(number)
                held, size = held + 1, size + (more or 0)
                full = 0 < count <= held or 0 < byte_size <= size or bool(ended)
                if dynamic and (whole or not full):
                    members.append(Message(text, meta=dict(m or []), err=e))
                    full = full or test(members, len(members) - 1)
                    if not whole:
                        members.clear()
                if full:
                    number, held, size, members = number + 1, 0, 0, []
            yield pa.RecordBatch.from_arrays([*part.columns[:n], pa.array(numbers, pa.int64())], names=[*columns, "_b"])

    return df.mapInArrow(run, T.StructType([*flow.df.schema.fields, T.StructField("_b", T.LongType())]))
