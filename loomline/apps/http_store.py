"""The store of reports over HTTP: list and read reports, add one, open and close a session.

Run: python -m loomline.apps.http_store folder [port]; the token is in LOOMLINE_TOKEN. Writing needs the bearer token, as
browsers send cookies by themselves; reading needs it or a session, unless it is made public.
"""

from __future__ import annotations

import hmac
import json
import os
import re
import sys
import time
import uuid
from http.cookies import SimpleCookie
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from loomline.sources.catalog import FEED_LIMIT, save_report

SECONDS, MOST_SESSIONS, COOKIE = 8 * 3600, 1000, "loomline_session"
SUMMARY = ("title", "generatedAt", "goal", "summary")


class Sessions:
    """Ids that live for SECONDS; the oldest go when there are too many."""

    def __init__(self) -> None:
        self.until: dict[str, float] = {}

    def open(self) -> str:
        self.prune()
        name = str(uuid.uuid4())
        self.until[name] = time.time() + SECONDS
        return name

    def prune(self) -> None:
        self.until = {i: t for i, t in self.until.items() if t > time.time()}
        for old in list(self.until)[: max(0, len(self.until) - MOST_SESSIONS + 1)]:
            del self.until[old]

    def has(self, name: str | None) -> bool:
        return name is not None and self.until.get(name, 0) > time.time()


def list_saved(folder: str) -> list[dict]:
    """Saved reports, newest first; files that aren't reports are passed over."""
    found = []
    for name in os.listdir(folder) if os.path.isdir(folder) else []:
        if m := re.fullmatch(r"([\w-]+)\.json", name):
            try:
                with open(os.path.join(folder, name), encoding="utf-8") as f:
                    told = json.load(f)
                found.append({"id": m[1]} | {k: told.get(k) for k in SUMMARY})
            except (ValueError, AttributeError):
                continue
    return sorted((r for r in found if r["generatedAt"]), key=lambda r: r["generatedAt"], reverse=True)


def handler(folder: str, token: str | None, public: bool, sessions: Sessions) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *a: object) -> None:
            """Nothing of a request is logged."""

        def say(self, status: int, told: object, **headers: str) -> None:
            body = json.dumps(told, ensure_ascii=False).encode()
            self.send_response(status)
            for k, v in {"Content-Type": "application/json; charset=utf-8", "Content-Length": str(len(body)), **{k.replace("_", "-"): v for k, v in headers.items()}}.items():
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(body)

        def bearer(self) -> bool:
            given = self.headers.get("Authorization", "")
            return bool(token) and hmac.compare_digest(given.encode(), f"Bearer {token}".encode())

        def session(self) -> str | None:
            found = SimpleCookie(self.headers.get("Cookie", "")).get(COOKIE)
            return found.value if found else None

        def may_read(self) -> bool:
            if public or self.bearer() or sessions.has(self.session()):
                return True
            self.say(401, {"error": "Unauthorized"}, WWW_Authenticate="Bearer") if token else self.say(503, {"error": "Report access is disabled until a token is set"})
            return False

        def cookie(self, value: str, seconds: int) -> str:
            secure = "; Secure" if self.headers.get("X-Forwarded-Proto", "").split(",")[0].strip() == "https" else ""
            return f"{COOKIE}={value}; Path=/; HttpOnly; SameSite=Strict; Max-Age={seconds}{secure}"

        def body(self) -> object:
            told = self.headers.get("Content-Length") or "0"
            if not (told.isascii() and told.isdigit()):
                self.close_connection = True  # where the body ends isn't known
                raise ValueError("Content-Length must be a whole number from 0")
            size = int(told)
            if size > FEED_LIMIT:
                left = min(size, 16 * FEED_LIMIT)  # what a client is still sending, so that it hears the answer
                while left > 0 and (got := self.rfile.read1(min(left, 65536))):
                    left -= len(got)
                self.close_connection = True
                raise OverflowError("Report is too large")
            return json.loads(self.rfile.read(size))

        def do_GET(self) -> None:
            one = re.fullmatch(r"/api/reports/([\w-]+)", self.path)
            if self.path == "/api/reports":
                if self.may_read():
                    self.say(200, list_saved(folder))
            elif one:
                if self.may_read():
                    place = os.path.join(folder, one[1] + ".json")
                    if os.path.exists(place):
                        with open(place, encoding="utf-8") as f:
                            self.say(200, json.load(f))
                    else:
                        self.say(404, {"error": "Report not found"})
            else:
                self.say(404, {"error": "Not found"})

        def do_POST(self) -> None:
            if self.path not in ("/api/session", "/api/reports"):
                return self.say(404, {"error": "Not found"})
            if not token:
                return self.say(503, {"error": "Disabled until a token is set"})
            if self.path == "/api/reports" and not self.bearer():
                return self.say(401, {"error": "Unauthorized"}, WWW_Authenticate="Bearer")
            try:
                told = self.body()
                if self.path == "/api/reports":
                    return self.say(201, {"id": save_report(told, folder)})
            except json.JSONDecodeError:
                return self.say(400, {"error": "The body must be valid JSON"})
            except OverflowError as error:
                return self.say(413, {"error": str(error)})
            except ValueError as error:
                return self.say(400, {"error": str(error)})
            given = told.get("token") if isinstance(told, dict) else None
            if not isinstance(given, str) or not hmac.compare_digest(given.encode(), token.encode()):
                return self.say(401, {"error": "Unauthorized"})
            return self.say(200, {"ok": True}, Set_Cookie=self.cookie(sessions.open(), SECONDS))

        def do_DELETE(self) -> None:
            if self.path != "/api/session":
                return self.say(404, {"error": "Not found"})
            sessions.until.pop(self.session() or "", None)
            return self.say(200, {"ok": True}, Set_Cookie=self.cookie("", 0))

    return Handler


def server(folder: str, token: str | None, port: int = 0, public: bool = False) -> ThreadingHTTPServer:
    return ThreadingHTTPServer(("127.0.0.1", port), handler(folder, token, public, Sessions()))


if __name__ == "__main__":
    server(sys.argv[1], os.environ.get("LOOMLINE_TOKEN"), int((sys.argv[2:] or ["4173"])[0])).serve_forever()
