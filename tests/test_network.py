import json
import socket
import threading

import pytest

from millrace.operators.batches import ConfigError
from millrace.sources.inputs import generate
from millrace.sources.network import HttpServerInput, http_client_input, http_client_output, socket_input, socket_output


def test_http(spark, tmp_path):
    server = HttpServerInput({"address": "127.0.0.1:0", "path": "/in", "allowed_verbs": ["POST", "GET"]}, str(tmp_path / "spool"))
    try:
        url = f"http://127.0.0.1:{server.port}/in"
        http_client_output({"url": url})(generate(spark, "root.n = this.id", 3, 1))
        assert sorted(json.loads(r.value)["n"] for r in spark.read.text(str(tmp_path / "spool")).collect()) == [0, 1, 2]
        assert http_client_input(spark, {"url": url, "drop_empty_bodies": False}).df.count() == 1
        with pytest.raises(Exception):
            http_client_input(spark, {"url": url.replace("/in", "/no"), "retries": 0})
    finally:
        server.close()
    with pytest.raises(ConfigError):
        http_client_output({"url": "https://example.org"})


def test_sockets(spark):
    got, listener = [], socket.create_server(("127.0.0.1", 0))

    def serve():
        a, _ = listener.accept()
        while part := a.recv(4096):
            got.append(part)
        b, _ = listener.accept()
        b.sendall(b"x\ny\n")
        b.close()

    thread = threading.Thread(target=serve, daemon=True)
    thread.start()
    address = "127.0.0.1:%d" % listener.getsockname()[1]
    socket_output({"address": address})(generate(spark, "root.n = this.id", 2, 1))
    assert sorted(r.content for r in socket_input(spark, {"address": address}).df.collect()) == [b"x", b"y"]
    thread.join(10)
    assert b"".join(got) == b'{"n":0}\n{"n":1}\n'
