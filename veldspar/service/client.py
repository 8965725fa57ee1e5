"""A client of the HTTP service, on the standard library."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from typing import Any


class ServiceError(RuntimeError):
    """An answer other than success: its code and its text."""

    def __init__(self, code: int, text: str):
        super().__init__(f"{code}: {text}")
        self.code = code


class Client:
    def __init__(self, url: str = "http://127.0.0.1:8080", database: str | None = None, timeout: float = 60.0):
        self.url, self.timeout = url.rstrip("/"), timeout
        self.headers = {"X-Database": database} if database else {}

    def call(self, method: str, path: str, body: str | None = None) -> Any:
        r = urllib.request.Request(f"{self.url}{path}", data=body.encode() if body is not None else None, method=method, headers=self.headers)
        try:
            with urllib.request.urlopen(r, timeout=self.timeout) as f:
                return json.loads(f.read())
        except urllib.error.HTTPError as e:
            raise ServiceError(e.code, e.read().decode(errors="replace")) from None

    def execute(self, command: str) -> dict[str, Any]:
        """message, and columns and rows or a tensor."""
        return self.call("POST", "/execute?format=json", command)

    def databases(self) -> list[str]:
        return self.call("GET", "/databases")

    def submit(self, command: str) -> str:
        return self.call("POST", "/jobs", command)["job_id"]

    def jobs(self) -> list[dict[str, Any]]:
        return self.call("GET", "/jobs")

    def job(self, job_id: str) -> dict[str, Any]:
        return self.call("GET", f"/jobs/{job_id}")

    def result(self, job_id: str) -> dict[str, Any]:
        return self.call("GET", f"/jobs/{job_id}/result")

    def cancel(self, job_id: str) -> None:
        self.call("DELETE", f"/jobs/{job_id}")

    def schedule(self, name: str, command: str, interval: float) -> dict[str, Any]:
        return self.call("POST", "/schedule", json.dumps({"name": name, "command": command, "interval_secs": interval}))

    def schedules(self) -> list[dict[str, Any]]:
        return self.call("GET", "/schedule")

    def unschedule(self, task_id: str) -> None:
        self.call("DELETE", f"/schedule/{task_id}")
