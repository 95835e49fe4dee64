"""What clients may send to the servers, however odd, is answered and ends nothing."""

from __future__ import annotations

import json
import socket

from loomline.apps import http_store
from loomline.apps.tools import Tools


class Failing:
    latest: dict = {}

    def prompt(self, *a):
        raise RuntimeError("broken")

    def scan_summary(self, *a, **b):
        raise KeyError("inner")


def answers(*asked):
    return [json.loads(x) for x in Tools(Failing()).serve([x if isinstance(x, str) else json.dumps(x) for x in asked])]


def test_odd_requests():
    own = lambda method, params=None, i=1: {"jsonrpc": "2.0", "id": i, "method": method} | ({} if params is None else {"params": params})
    odd = ["5", "[1]", "null", "\"x\"", "{", {"id": 1}, {"id": [1], "method": "ping"}, {"id": True, "method": "ping"}, own(3), own("tools/list", [1]), own("tools/call", {"arguments": 3}), own("nothing"), {"method": "note"}, "", own("resources/list", i="a")]
    codes = [x.get("error", {}).get("code") for x in answers(*odd)]
    assert codes == [-32600, -32600, -32600, -32600, -32700, -32600, -32600, -32600, -32600, -32602, -32602, -32601, None]


def test_failing_handlers():
    call = {"jsonrpc": "2.0", "id": 7, "method": "prompts/get", "params": {"name": Tools(Failing()).answer("prompts/list", {})["prompts"][0]["name"]}}
    (told,) = answers(call)
    assert told["id"] == 7 and told["error"]["code"] == -32603 and "broken" in told["error"]["message"]


def test_lengths_of_uploads(tmp_path):
    with http_store.server(str(tmp_path), "secret") as http:
        import threading

        threading.Thread(target=http.serve_forever, daemon=True).start()
        for length, status in (("-1", b"400"), ("x", b"400"), ("1.5", b"400"), ("+1", b"400"), ("2", b"400")):
            with socket.create_connection(http.server_address, timeout=10) as s:
                s.sendall(f"POST /api/reports HTTP/1.1\r\nHost: x\r\nAuthorization: Bearer secret\r\nContent-Length: {length}\r\n\r\n{{}}".encode())
                assert s.recv(100).split(b" ")[1] == status, length
        http.shutdown()
