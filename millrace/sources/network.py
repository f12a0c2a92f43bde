"""Inputs and outputs over HTTP and sockets. Inputs that others push to are spooled to a folder that a stream or a batch then reads."""

from __future__ import annotations

import http.server
import json
import os
import socket
import threading
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from millrace.functions.times import duration
from millrace.operators.batches import ConfigError
from millrace.operators.flow import Flow, from_content
from millrace.plans.evaluator import Message, context_of, interpolate
from millrace.shipping import ship
from millrace.sources.scanners import pieces


def _plain(url: str) -> str:
    if url.startswith(("https://", "wss://")):
        raise ConfigError("https and wss are not supported")
    return url


def fetched(config: dict, body: bytes | None = None) -> bytes:
    """One request, again after a growing pause when it fails or the server says so."""
    context = context_of(Message(b"{}"))
    url = _plain(interpolate(config["url"])(context))
    headers = {k: interpolate(str(v))(context) for k, v in (config.get("headers") or {}).items()}
    wait, most = duration(config.get("retry_period", "1s")) / 1e9, duration(config.get("max_retry_backoff", "300s")) / 1e9
    for attempt in range(int(config.get("retries", 3)) + 1):
        try:
            request = urllib.request.Request(url, data=body, headers=headers, method=config.get("verb", "GET" if body is None else "POST"))
            with urllib.request.urlopen(request, timeout=duration(config.get("timeout", "5s")) / 1e9) as answer:
                return answer.read()
        except (urllib.error.URLError, OSError):
            if attempt == int(config.get("retries", 3)):
                raise
            time.sleep(wait)
            wait = min(most, wait * 2)
    raise AssertionError


def http_client_input(spark: SparkSession, config: dict, polls: int = 1) -> Flow:
    """``polls`` answers of a URL, each one message, or cut by the scanner of ``stream``."""
    stream = config.get("stream") or {}
    rows = []
    for _ in range(polls):
        payload = config.get("payload")
        raw = fetched(config, interpolate(payload)(context_of(Message(b"{}"))).encode() if payload else None)
        if not raw and config.get("drop_empty_bodies", True):
            continue
        found = pieces(raw, stream.get("scanner") or {"lines": {}}, config["url"]) if stream.get("enabled") else [(raw, {}, None)]
        rows += [(len(rows) + k, bytearray(c)) for k, (c, _, _) in enumerate(found)]
    return from_content(spark.createDataFrame(rows, "k long, content binary"), "content", ["k"])


def _sent(flow: Flow, send: Callable[[Iterator[bytes]], None], lines: bool) -> None:
    """Hand each partition's contents to ``send`` on the executors; with ``lines`` those of a batch as one."""
    ship(flow.df.sparkSession)
    rows = flow.raw().df
    if lines:
        rows = rows.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("ord", F.decode("content", "UTF-8").alias("c")))).alias("p")).select(F.array_join(F.transform("p", lambda x: x["c"]), "\n").cast("binary").alias("content"))
    rows.select("content").foreachPartition(lambda part: send(bytes(r.content) for r in part))


def http_client_output(config: dict) -> Callable[[Flow], None]:
    """A POST for each message, or for each batch with ``batch_as_lines``."""
    _plain(config["url"])

    def send(contents: Iterator[bytes]) -> None:
        for c in contents:
            fetched({"verb": "POST"} | config, c)

    return lambda flow: _sent(flow, send, bool(config.get("batch_as_lines")))


def _connected(network: str, address: str) -> socket.socket:
    if network == "unix":
        s = socket.socket(socket.AF_UNIX)
        s.connect(address)
        return s
    host, _, port = address.rpartition(":")
    return socket.create_connection((host or "127.0.0.1", int(port)), timeout=30)


def socket_output(config: dict) -> Callable[[Flow], None]:
    """Each message and a line end to a TCP or unix socket, one connection a partition."""
    network, address = config.get("network", "tcp"), config["address"]

    def send(contents: Iterator[bytes]) -> None:
        with _connected(network, address) as s:
            for c in contents:
                s.sendall(c.removesuffix(b"\n") + b"\n")

    return lambda flow: _sent(flow, send, False)


def socket_input(spark: SparkSession, config: dict) -> Flow:
    """All that a TCP or unix socket sends until it closes, cut by the scanner."""
    raw = b""
    with _connected(config.get("network", "tcp"), config["address"]) as s:
        while part := s.recv(1 << 16):
            raw += part
    rows = [(k, bytearray(c)) for k, (c, _, _) in enumerate(pieces(raw, config.get("scanner") or {"lines": {}}, config["address"]))]
    return from_content(spark.createDataFrame(rows, "k long, content binary"), "content", ["k"])


class Spool:
    """A server on the driver that writes each message it gets to a file of its own under a folder: the folder is a stream's source
    (``lines`` of the streaming runner). Stop it with ``close``."""

    def __init__(self, folder: str):
        self.folder = folder
        os.makedirs(folder, exist_ok=True)

    def keep(self, body: bytes) -> None:
        name = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
        hidden = os.path.join(self.folder, f".{name}")  # readers skip names that start with a dot
        with open(hidden, "wb") as f:
            f.write(body)
        os.rename(hidden, os.path.join(self.folder, name))


class HttpServerInput(Spool):
    """Listens for POSTs at ``path``; other paths and verbs are refused."""

    def __init__(self, config: dict, folder: str):
        super().__init__(folder)
        if config.get("ws_path"):
            raise ConfigError("http_server: ws_path is not supported")
        path, verbs, keep = config.get("path", "/post"), config.get("allowed_verbs", ["POST"]), self.keep

        class Handler(http.server.BaseHTTPRequestHandler):
            def answer(self) -> None:
                if self.path.partition("?")[0] != path:
                    return self.send_error(404)
                if self.command not in verbs:
                    return self.send_error(405)
                keep(self.rfile.read(int(self.headers.get("Content-Length") or 0)))
                self.send_response(200)
                self.end_headers()
                return None

            do_POST = do_PUT = do_GET = answer

            def log_message(self, *args: Any) -> None:
                pass

        host, _, port = config["address"].rpartition(":")
        self.server = http.server.ThreadingHTTPServer((host or "0.0.0.0", int(port)), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()

    @property
    def port(self) -> int:
        return self.server.server_address[1]

    def close(self) -> None:
        self.server.shutdown()
        self.server.server_close()


def stats(query: Any) -> dict:
    """Counters of a running stream: batches, rows in, rows a second."""
    last = query.lastProgress or {}
    last = json.loads(last.json) if hasattr(last, "json") else last
    return {"batch": last.get("batchId"), "input_received": last.get("numInputRows"), "per_second": last.get("processedRowsPerSecond")}
