"""HTTP service on the standard library."""

from __future__ import annotations

import json
import os
import re
import threading
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any

from ..session import Result, Session, SessionError
from .jobs import Jobs, Scheduler

#: Largest request body, and rows that one answer holds.
MAX_BODY = 16 * 1024
MAX_ROWS = 10_000
#: Seconds that a request may take; longer work goes to /jobs.
TIME_LIMIT = 30.0
#: The request header that names the database.
HEADER = "X-Database"
_FILES = ("manifest.json", "schema.json", "stats.json", "lineage.json", "metadata.json", "data.parquet")


def as_json(result: Result) -> dict[str, Any]:
    out: dict[str, Any] = {"message": result.message}
    if result.tensor is not None:
        out["tensor"] = {"shape": list(result.tensor.shape), "data": [float(x) for x in result.tensor.ravel()]}
    if result.frame is not None:
        rows = result.frame.limit(MAX_ROWS + 1).collect()
        out["columns"] = [{"name": f.name, "type": f.dataType.simpleString()} for f in result.frame.schema]
        out["rows"] = [list(r) for r in rows[:MAX_ROWS]]
        out["truncated"] = len(rows) > MAX_ROWS
    return out


def as_text(result: Result) -> str:
    """The compact tabular text form: a header line, then a line for each row."""
    d = as_json(result)
    lines = [d["message"]] if d["message"] else []
    if "tensor" in d:
        lines.append(f"tensor[{','.join(map(str, d['tensor']['shape']))}]: {','.join(f'{x:g}' for x in d['tensor']['data'])}")
    if "rows" in d:
        lines.append(f"rows[{len(d['rows'])}]{{{','.join(c['name'] for c in d['columns'])}}}:")
        lines += ["  " + ",".join(json.dumps(v, default=str, ensure_ascii=False) for v in r) for r in d["rows"]]
    return "\n".join(lines)


class Service:
    """One session behind a lock; a request's database holds for that request alone."""

    def __init__(self, session: Session, workers: int = 2):
        self.session, self.lock = session, threading.RLock()
        sc = session.spark.sparkContext
        self.jobs = Jobs(self.run, workers, lambda i: sc.setJobGroup(i, i, True), sc.cancelJobGroup)
        self.scheduler = Scheduler(self.run)
        self.requests = ThreadPoolExecutor(16)

    def execute(self, command: str, database: str | None = None) -> Result:
        with self.lock:
            before = self.session.active
            if database:
                if database not in self.session.databases:
                    raise SessionError(f"unknown database {database}")
                self.session.active = database
            try:
                return self.session.script(command)[-1] if command.strip() else Result()
            finally:
                if database and before in self.session.databases:
                    self.session.active = before

    def run(self, command: str, database: str | None = None) -> dict[str, Any]:
        return as_json(self.execute(command, database))

    def limited(self, work: Callable[[], Any], seconds: float) -> Any:
        """What `work` gives within the time; beyond it its Spark work is stopped and TimeoutError raised."""
        sc, group = self.session.spark.sparkContext, f"request-{uuid.uuid4().hex}"

        def grouped() -> Any:
            sc.setJobGroup(group, group, True)
            return work()

        done = self.requests.submit(grouped)
        try:
            return done.result(seconds)
        except TimeoutError:
            done.cancel()
            sc.cancelJobGroup(group)
            raise TimeoutError(f"the request took over {seconds:g} s; submit it to /jobs") from None


def _routes(service: Service) -> list[tuple[str, re.Pattern, Callable[..., tuple[int, Any]]]]:
    def execute(h: Handler, body: bytes) -> tuple[int, Any]:
        text = body.decode()
        if "json" in h.headers.get("Content-Type", ""):
            text = json.loads(text)["command"]
        shown = as_json if "format=json" in h.path or "json" in h.headers.get("Accept", "") else as_text
        database = h.headers.get(HEADER)
        try:
            return 200, service.limited(lambda: shown(service.execute(text, database)), TIME_LIMIT)
        except TimeoutError as e:
            return 408, {"error": str(e)}

    def submit(h: Handler, body: bytes) -> tuple[int, Any]:
        text = body.decode()
        command = json.loads(text)["command"] if text.lstrip().startswith("{") else text
        return 202, service.jobs.submit(command, h.headers.get(HEADER)).summary()

    def job(h: Handler, _: bytes, job_id: str) -> tuple[int, Any]:
        return (200, service.jobs.jobs[job_id].summary()) if job_id in service.jobs.jobs else (404, {"error": "no such job"})

    def job_result(h: Handler, _: bytes, job_id: str) -> tuple[int, Any]:
        found = service.jobs.jobs.get(job_id)
        if not found:
            return 404, {"error": "no such job"}
        return (200, found.result) if found.status == "Completed" else (409, found.summary())

    def cancel(h: Handler, _: bytes, job_id: str) -> tuple[int, Any]:
        if job_id not in service.jobs.jobs:
            return 404, {"error": "no such job"}
        return (200, {"cancelled": job_id}) if service.jobs.cancel(job_id) else (409, service.jobs.jobs[job_id].summary())

    def schedule(h: Handler, body: bytes) -> tuple[int, Any]:
        d = json.loads(body)
        return 201, service.scheduler.add(d["name"], d["command"], float(d["interval_secs"]), d.get("target_db")).summary()

    def create(h: Handler, _: bytes, name: str) -> tuple[int, Any]:
        service.execute(f"CREATE DATABASE {name}")
        return 201, {"created": name}

    def drop(h: Handler, _: bytes, name: str) -> tuple[int, Any]:
        service.execute(f"DROP DATABASE {name}")
        return 200, {"dropped": name}

    def deliver(h: Handler, _: bytes, name: str, file: str) -> tuple[int, Any]:
        if file not in _FILES or name in (".", ".."):
            return 404, {"error": "no such file"}
        path = os.path.join(service.session.root, h.headers.get(HEADER) or "default", "datasets", name, file)
        if os.path.isdir(path):  # a Parquet table is a folder; its only part, if it has one
            parts = sorted(x for x in os.listdir(path) if x.endswith(".parquet"))
            if len(parts) != 1:
                return 200, {"parts": parts}
            path = os.path.join(path, parts[0])
        if not os.path.isfile(path):
            return 404, {"error": "no such file"}
        with open(path, "rb") as f:
            return 200, f.read()

    name, ident = r"([A-Za-z0-9_]+)", r"([0-9a-f]+)"
    table = [
        ("GET", "/health", lambda h, b: (200, {"status": "ok"})),
        ("POST", "/execute", execute),
        ("GET", "/databases", lambda h, b: (200, sorted(service.session.databases))),
        ("POST", f"/databases/{name}", create),
        ("DELETE", f"/databases/{name}", drop),
        ("POST", "/jobs", submit),
        ("GET", "/jobs", lambda h, b: (200, [j.summary() for j in service.jobs.jobs.values()])),
        ("GET", f"/jobs/{ident}", job),
        ("GET", f"/jobs/{ident}/result", job_result),
        ("DELETE", f"/jobs/{ident}", cancel),
        ("POST", "/schedule", schedule),
        ("GET", "/schedule", lambda h, b: (200, [t.summary() for t in service.scheduler.tasks.values()])),
        ("DELETE", f"/schedule/{ident}", lambda h, b, i: (200, {"removed": i}) if service.scheduler.remove(i) else (404, {"error": "no such task"})),
        ("GET", r"/delivery/datasets/([^/]+)/([^/]+)", deliver),
    ]
    return [(m, re.compile(p), f) for m, p, f in table]


class Handler(BaseHTTPRequestHandler):
    routes: list

    def _answer(self) -> None:
        n = int(self.headers.get("Content-Length") or 0)
        if n > MAX_BODY:
            return self._send(413, {"error": f"over {MAX_BODY} bytes"})
        body, path = self.rfile.read(n), self.path.partition("?")[0]
        for method, pattern, f in self.routes:
            if method == self.command and (m := pattern.fullmatch(path)):
                try:
                    return self._send(*f(self, body, *m.groups()))
                except Exception as e:  # a request's error is its answer
                    return self._send(400, {"error": str(e)[:2000]})
        return self._send(404, {"error": "no such route"})

    do_GET = do_POST = do_DELETE = _answer

    def _send(self, code: int, value: Any) -> None:
        raw = value if isinstance(value, bytes) else value.encode() if isinstance(value, str) else json.dumps(value, default=str).encode()
        kind = "application/octet-stream" if isinstance(value, bytes) else "text/plain; charset=utf-8" if isinstance(value, str) else "application/json"
        self.send_response(code)
        self.send_header("Content-Type", kind)
        self.send_header("Content-Length", str(len(raw)))
        self.end_headers()
        self.wfile.write(raw)

    def log_message(self, *_: Any) -> None:
        pass


def serve(session: Session, port: int = 8080, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """A server, not yet serving: call serve_forever(), and shutdown() from elsewhere."""
    service = Service(session)
    handler = type("Bound", (Handler,), {"routes": _routes(service)})
    server = ThreadingHTTPServer((host, port), handler)
    server.service = service
    return server
