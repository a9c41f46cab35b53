"""The HTTP service: five GET routes over an engine, JSON or markdown, standard library only."""

from __future__ import annotations

import json
import logging
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from .engine import Engine, NotFound

log = logging.getLogger(__name__)
NAME_BYTES, QUERY_BYTES = 200, 500
#: Seconds for reading a request, for writing an answer, between two requests of a connection, and for requests under way when the server stops.
READ_S, WRITE_S, IDLE_S, DRAIN_S = 15, 30, 60, 10
HEADERS = {"X-Content-Type-Options": "nosniff", "X-Frame-Options": "DENY"}


# The texts of errors and of an empty result are fixed values of the API.


class BadRequest(Exception):
    pass


def checked(name: str, what: str, query: str) -> None:
    """BadRequest unless both are there, in bounds (bytes), without NUL, and query has a letter or digit."""
    if not name or not query:
        raise BadRequest(f"{what} and query are required")
    for value, of, most in ((name, what, NAME_BYTES), (query, "query", QUERY_BYTES)):
        if len(value.encode()) > most:
            raise BadRequest(f"{of} must be 1-{most} characters")
    if "\0" in name + query:
        raise BadRequest("query contains invalid characters")
    if not any(c.isalpha() or c.isdecimal() for c in query):
        raise BadRequest("query must contain at least one alphanumeric character")


def rows(df) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.toLocalIterator()]


def respond(engine: Engine, path: str, query: dict[str, str]) -> tuple[int, str, str]:
    """(status, content type, body) of a GET."""
    get = lambda k: query.get(k, "").strip()
    try:
        if path == "/health":
            return _json(200, {"status": "ok"})
        if path == "/api/v1/libraries":
            return _json(200, {"libraries": rows(engine.libraries())})
        if path == "/api/v1/libraries/search":
            checked(get("libraryName"), "libraryName", get("query"))
            found = rows(engine.resolve(get("query"), get("libraryName")))
            return _json(200, {"results": found}) if found else _error(404, "no libraries found")
        if path == "/api/v1/entities":
            if not get("libraryId"):
                raise BadRequest("libraryId is required")
            if "\0" in get("libraryId"):
                raise BadRequest("libraryId contains invalid characters")
            return _json(200, {"entities": rows(engine.entities(get("libraryId")))})
        if path == "/api/v1/docs":
            checked(get("libraryId"), "libraryId", get("query"))
            mode = query.get("mode") or "all"
            if mode not in ("all", "any"):
                raise BadRequest("mode must be 'all' or 'any'")
            result = engine.query_docs(get("libraryId"), get("query"), mode)
            if query.get("format") == "json":
                return _json(200, {"library": result.library, "query": result.query, "snippets": rows(result.snippets), "text": result.text})
            empty = f"No results found for query '{get('query')}' in library '{get('libraryId')}'"
            return 200, "text/markdown; charset=utf-8", result.text if result.text.strip() else empty
        return _error(404, "not found")
    except BadRequest as e:
        return _error(400, str(e))
    except NotFound:
        return _error(404, "library not found")
    except Exception:
        log.exception("%s failed", path)
        return _error(500, "internal server error")


def _json(status: int, value) -> tuple[int, str, str]:
    return status, "application/json", json.dumps(value, ensure_ascii=False, default=str)


def _error(status: int, message: str) -> tuple[int, str, str]:
    return _json(status, {"error": message})


class Server(ThreadingHTTPServer):
    """Answers each connection in a thread of its own, and counts the requests under way."""

    def __init__(self, *args):
        super().__init__(*args)
        self.under_way, self.changed = 0, threading.Condition()

    def count(self, by: int) -> None:
        with self.changed:
            self.under_way += by
            self.changed.notify_all()

    def drain(self, seconds: float = DRAIN_S) -> bool:
        """Stop listening and let requests under way end, for so long at most; whether all did."""
        self.shutdown()
        with self.changed:
            done = self.changed.wait_for(lambda: not self.under_way, seconds)
        self.server_close()
        return done


def serve(engine: Engine, host: str = "", port: int = 8080, origin: str = "*") -> Server:
    """A server, not yet started: call serve_forever()."""

    class Handler(BaseHTTPRequestHandler):
        protocol_version, timeout = "HTTP/1.1", READ_S

        def _send(self, status: int, kind: str | None = None, body: str = "") -> None:
            data = body.encode()
            self.connection.settimeout(WRITE_S)
            self.send_response(status)
            for k, v in (HEADERS | {"Access-Control-Allow-Origin": origin, "Access-Control-Allow-Methods": "GET, OPTIONS", "Access-Control-Allow-Headers": "Content-Type"}).items():
                self.send_header(k, v)
            if kind:
                self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)
            self.wfile.flush()
            self.connection.settimeout(IDLE_S)

        def do_OPTIONS(self):
            self._send(204)

        def do_GET(self):
            self.server.count(1)
            try:
                at = urlsplit(self.path)
                self._send(*respond(engine, at.path, {k: v[0] for k, v in parse_qs(at.query, keep_blank_values=True).items()}))
            finally:
                self.server.count(-1)

        def log_message(self, form, *args):
            log.info(form, *args)

    return Server((host, port), Handler)
