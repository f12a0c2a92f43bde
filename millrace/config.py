"""Pipeline documents: YAML with environment variables, templates, resources, lint, and the unit tests written beside a pipeline."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, field
from typing import Any

import yaml

from millrace.functions.values import MappingError, equal, from_json, text_of
from millrace.operators import batches
from millrace.operators.batches import ConfigError, Resources
from millrace.operators.flow import policy_problems
from millrace.plans.evaluator import Message, context_of, evaluate, program
from millrace.plans.parser import ParseError, parse

ROOT_FIELDS = ("input", "buffer", "pipeline", "output", "input_resources", "output_resources", "processor_resources", "cache_resources", "rate_limit_resources", "metrics", "tracer", "http", "shutdown_timeout", "shutdown_delay", "error_handling", "tests", "templates")
INPUTS = ("generate", "file", "stdin", "broker", "sequence", "kafka", "http_client", "http_server", "socket", "socket_server", "websocket", "table", "resource")
OUTPUTS = ("stdout", "drop", "file", "reject", "broker", "switch", "fallback", "kafka", "http_client", "http_server", "socket", "websocket", "sync_response", "resource")
#: Known by name and refused: (path of the field, why).
REFUSED = {
    "generate.batch_size": "generate: batch_size is not supported", "file.delete_on_finish": "file: delete_on_finish is not supported", "sequence.sharded_join": "sequence: only sharded_join type none is supported", "http_server.ws_path": "http_server: ws_path is not supported",
    "pipeline.threads": "pipeline.threads is not supported: Spark plans the parallelism", "logger": "the logger block is not supported",
}


def substituted(text: str, env: dict[str, str] | None = None) -> str:
    """${NAME} and ${NAME:default} from the environment; ${! ...} is left alone."""
    known = os.environ if env is None else env

    def one(m: re.Match) -> str:
        if m[1] in known:
            return known[m[1]]
        if m[2] is not None:
            return m[2][1:]
        return ""

    return re.sub(r"\$\{([A-Za-z_][A-Za-z0-9_]*)(:[^}]*)?\}", one, text)


def load(text: str, env: dict[str, str] | None = None) -> dict:
    out = yaml.safe_load(substituted(text, env)) or {}
    if not isinstance(out, dict):
        raise ConfigError("a pipeline document is an object")
    return expanded(out, {t["name"]: t for t in out.get("templates") or []})


def expanded(node: Any, templates: dict[str, dict]) -> Any:
    """Replace components that a template names by what its mapping makes of their fields."""
    if isinstance(node, list):
        return [expanded(x, templates) for x in node]
    if not isinstance(node, dict):
        return node
    out = {}
    for k, v in node.items():
        if k in templates and k != "templates":
            t = templates[k]
            given = dict(v or {})
            for f in t.get("fields") or []:
                if f["name"] not in given:
                    if "default" not in f:
                        raise ConfigError(f"template {k}: field '{f['name']}' is required")
                    given[f["name"]] = f["default"]
            for name in given:
                if name not in {f["name"] for f in t.get("fields") or []}:
                    raise ConfigError(f"template {k}: field '{name}' is not known")
            made = evaluate(program(t["mapping"]), Message(None, given)).root
            out |= expanded(made, {n: x for n, x in templates.items() if n != k})
        else:
            out[k] = v if k == "templates" else expanded(v, templates)
    return out


def resources_of(doc: dict, functions: dict | None = None) -> Resources:
    def by_label(key: str) -> dict[str, dict]:
        out = {}
        for r in doc.get(key) or []:
            if not r.get("label"):
                raise ConfigError(f"{key}: a label is needed")
            if r["label"] in out:
                raise ConfigError(f"{key}: label '{r['label']}' is used twice")
            out[r["label"]] = {k: v for k, v in r.items() if k != "label"}
        return out

    caches = by_label("cache_resources")
    for label, c in caches.items():
        kind = next(iter(c))
        if kind not in ("memory", "lru", "file"):
            raise ConfigError(f"cache '{label}': kind '{kind}' is not supported")
        if kind == "lru" and (c[kind] or {}).get("algorithm", "standard") != "standard":
            raise ConfigError(f"cache '{label}': only the standard algorithm is supported")
    return Resources(by_label("processor_resources"), caches, by_label("rate_limit_resources"), functions)


def lint(text: str, env: dict[str, str] | None = None) -> list[str]:
    """Every problem of a document, each with its path."""
    try:
        doc = load(text, env)
    except (yaml.YAMLError, ConfigError, MappingError) as e:
        return [str(e)]
    found: list[str] = []
    for k in doc:
        if k in REFUSED:
            found.append(REFUSED[k])
        elif k not in ROOT_FIELDS:
            found.append(f"field '{k}' not recognised")
    try:
        resources = resources_of(doc)
    except ConfigError as e:
        return [*found, str(e)]

    def component(node: Any, path: str, known: tuple) -> None:
        if not isinstance(node, dict):
            found.append(f"{path}: expected an object")
            return
        kinds = [k for k in node if k not in ("label", "processors", "batching", "auto_replay_nacks")]
        if len(kinds) != 1:
            found.append(f"{path}: one component is needed, found {sorted(kinds)}")
            return
        kind = kinds[0]
        if kind not in known:
            found.append(f"{path}: unable to infer component type: '{kind}' is not known or not supported")
            return
        config = node[kind] if isinstance(node[kind], dict) else {}
        for name in config:
            if f"{kind}.{name}" in REFUSED:
                found.append(f"{path}: {REFUSED[f'{kind}.{name}']}")
        for name in ("url", "address"):
            if re.match(r"(https|wss)://", str(config.get(name, ""))):
                found.append(f"{path}.{kind}.{name}: https and wss are not supported")
        if kind == "generate":
            if re.match(r"@|\S+ \S+ ", str(config.get("interval", ""))):
                found.append(f"{path}: generate: cron intervals are not supported")
            mapping(config.get("mapping", "root = {}"), f"{path}.generate.mapping")
        if policy := node.get("batching") or config.get("batching"):
            batching(policy, path)
        for k, child in enumerate(config.get("inputs") or config.get("outputs") or []):
            component(child, f"{path}.{kind}.{k}", known)
        if kind == "switch":
            for k, case in enumerate(config.get("cases") or []):
                component(case.get("output"), f"{path}.switch.cases.{k}.output", known)
        processors(node.get("processors") or [], f"{path}.processors")

    def mapping(text: Any, path: str) -> None:
        try:
            parse(str(text))
            program(str(text))
        except (ParseError, MappingError) as e:
            found.append(f"{path}: {e}")

    def batching(policy: Any, path: str) -> None:
        found.extend(f"{path}: {p}" for p in policy_problems(policy))
        if isinstance(policy, dict):
            if policy.get("check"):
                mapping(policy["check"], f"{path}.batching.check")
            processors(policy.get("processors") or [], f"{path}.batching.processors")

    def processors(configs: Any, path: str) -> None:
        for k, c in enumerate(configs):
            where = f"{path}.{k}"
            try:
                kind = batches.name_of(c)
                if kind in ("mapping", "mutation", "bloblang"):
                    mapping(c[kind], f"{where}.{kind}")
                else:
                    batches.build(c, resources, where)
            except (ConfigError, ParseError, MappingError, KeyError, TypeError, AttributeError) as e:
                found.append(f"{where}: {e}")

    if "input" in doc:
        component(doc["input"], "input", INPUTS)
    if "output" in doc:
        component(doc["output"], "output", OUTPUTS)
    pipeline = doc.get("pipeline") or {}
    for k in pipeline:
        if f"pipeline.{k}" in REFUSED:
            found.append(REFUSED[f"pipeline.{k}"])
    processors(pipeline.get("processors") or [], "pipeline.processors")
    for key, known in (("buffer", ("none", "memory")), ("metrics", ("none", "prometheus")), ("tracer", ("none",))):
        for kind in doc.get(key) or {}:
            if kind not in known:
                found.append(f"{key}: '{kind}' is not supported")
    policy = dict(((doc.get("buffer") or {}).get("memory") or {}).get("batch_policy") or {})
    if policy.pop("enabled", False):
        batching(policy, "buffer.memory.batch_policy")
    return found


# unit tests beside a pipeline
@dataclass
class Outcome:
    name: str
    problems: list[str] = field(default_factory=list)


def _pointer(doc: Any, path: str) -> Any:
    for part in path.strip("/").split("/") if path.strip("/") else []:
        part = part.replace("~1", "/").replace("~0", "~")
        doc = doc[int(part)] if isinstance(doc, list) else doc[part]
    return doc


def _placed(doc: Any, path: str, value: Any) -> None:
    parent, _, last = path.strip("/").rpartition("/")
    holder = _pointer(doc, parent)
    holder[int(last) if isinstance(holder, list) else last] = value


def _input(m: dict, folder: str) -> Message:
    if "json_content" in m:
        content = json.dumps(m["json_content"]).encode()
    elif "file_content" in m:
        with open(os.path.join(folder, m["file_content"]), "rb") as f:
            content = f.read()
    else:
        content = str(m.get("content", "")).encode()
    return Message(content, meta={k: str(v) for k, v in (m.get("metadata") or {}).items()})


def _problem(kind: str, want: Any, m: Message, batch: list[Message], k: int, folder: str) -> str | None:
    text = m.content.decode("utf-8", "replace")
    if kind == "content_equals":
        return None if text == want else f"content_equals: {text!r} is not {want!r}"
    if kind == "content_matches":
        return None if re.search(want, text) else f"content_matches: {text!r} doesn't match {want!r}"
    if kind in ("json_equals", "json_contains"):
        wanted = from_json(want) if isinstance(want, str) else want
        own = from_json(text)

        def holds(a: Any, b: Any) -> bool:
            if isinstance(b, dict):
                return isinstance(a, dict) and all(x in a and holds(a[x], y) for x, y in b.items())
            if isinstance(b, list):
                return isinstance(a, list) and len(a) == len(b) and all(map(holds, a, b))
            return equal(a, b)

        return None if (equal(own, wanted) if kind == "json_equals" else holds(own, wanted)) else f"{kind}: {text} is not {json.dumps(wanted)}"
    if kind == "bloblang":
        return None if evaluate(program(want), m, batch, k).root is True else f"bloblang: {want} doesn't hold"
    if kind == "file_equals":
        with open(os.path.join(folder, want), "rb") as f:
            return None if f.read() == m.content else "file_equals: the contents differ"
    if kind == "metadata_equals":
        bad = {n: v for n, v in want.items() if text_of(m.meta.get(n, "")) != str(v)}
        return f"metadata_equals: {bad}" if bad else None
    return f"condition '{kind}' is not known"


def run_tests(text: str, folder: str = ".") -> list[Outcome]:
    """Run the ``tests`` of a document over its processors."""
    out = []
    for test in (yaml.safe_load(text) or {}).get("tests") or []:
        outcome = Outcome(test["name"])
        out.append(outcome)
        doc = load(text, {**os.environ, **(test.get("environment") or {})})
        for path, config in (test.get("mocks") or {}).items():
            if path.startswith("/"):
                _placed(doc, path, config)
            else:
                _mocked(doc, path, config)
        if test.get("target_mapping"):
            with open(os.path.join(folder, test["target_mapping"])) as f:
                configs = [{"mapping": f.read()}]
        else:
            configs = _pointer(doc, test.get("target_processors", "/pipeline/processors"))
            configs = configs if isinstance(configs, list) else [configs]
        step = batches.chain(configs, resources_of(doc), ".pipeline.processors")
        inputs = test.get("input_batches") or [test.get("input_batch") or []]
        found = [b for one in inputs for b in step([_input(m, folder) for m in one])]
        wanted = test.get("output_batches") or []
        if len(found) != len(wanted):
            outcome.problems.append(f"{len(found)} batches, {len(wanted)} expected")
        for k, (batch, conditions) in enumerate(zip(found, wanted)):
            if len(batch) != len(conditions):
                outcome.problems.append(f"batch {k}: {len(batch)} messages, {len(conditions)} expected")
            for j, (m, condition) in enumerate(zip(batch, conditions)):
                for kind, want in condition.items():
                    if p := _problem(kind, want, m, batch, j, folder):
                        outcome.problems.append(f"batch {k} message {j}: {p}")
    return out


def _mocked(node: Any, label: str, config: dict) -> None:
    if isinstance(node, list):
        for k, x in enumerate(node):
            if isinstance(x, dict) and x.get("label") == label:
                node[k] = config
            else:
                _mocked(x, label, config)
    elif isinstance(node, dict):
        for x in node.values():
            _mocked(x, label, config)


__all__ = ["Outcome", "context_of", "lint", "load", "resources_of", "run_tests"]
