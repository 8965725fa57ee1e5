"""Command line: python -m veldspar run FILE | exec STATEMENT | query STATEMENT | load FILE NAME | repl | serve | jobs .. | schedule .."""

from __future__ import annotations

import argparse
import os
import signal
import sys
import threading


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="veldspar")
    p.add_argument("--root", default="./veldspar-data", help="folder of databases")
    p.add_argument("--db", default="default")
    sub = p.add_subparsers(dest="command", required=True)
    for name, arg in (("run", "file"), ("exec", "statement"), ("query", "statement")):
        sub.add_parser(name).add_argument(arg)
    load = sub.add_parser("load")
    load.add_argument("file")
    load.add_argument("name")
    sub.add_parser("repl")
    sub.add_parser("init")
    serve_args = sub.add_parser("serve", aliases=["server"])
    serve_args.add_argument("--port", type=int, default=8080)
    db = sub.add_parser("db")
    db.add_argument("action", choices=["list", "create", "drop"])
    db.add_argument("name", nargs="?")
    jobs = sub.add_parser("jobs", help="jobs of a running service")
    jobs.add_argument("action", choices=["list", "submit", "status", "result", "cancel"])
    jobs.add_argument("what", nargs="?", help="a statement to submit, or a job's id")
    plan = sub.add_parser("schedule", help="recurring commands of a running service")
    plan.add_argument("action", choices=["list", "add", "remove"])
    plan.add_argument("what", nargs="*", help="a name, a statement and seconds to add; an id to remove")
    for x in (jobs, plan):
        x.add_argument("--url", default="http://127.0.0.1:8080")
    a = p.parse_args(argv)
    if a.command in ("jobs", "schedule"):
        return remote(a)
    if a.command == "init":
        os.makedirs(os.path.join(a.root, "default"), exist_ok=True)
        return 0

    from pyspark.sql import SparkSession

    from .service.server import as_text, serve
    from .session import Session

    session = Session(SparkSession.builder.appName("veldspar").getOrCreate(), a.root)
    if a.db != "default":
        session.execute(f"USE {a.db}")

    def show(statements: str) -> int:
        try:
            for r in session.script(statements):
                if text := as_text(r):
                    print(text)
            return 0
        except Exception as e:  # shown to the user, not raised at them
            print(f"error: {e}", file=sys.stderr)
            return 1

    if a.command == "run":
        with open(a.file) as f:
            return show(f.read())
    if a.command in ("exec", "query"):
        return show(a.statement)
    if a.command == "load":
        return show(f'USE DATASET FROM "{a.file}" AS {a.name}\nSAVE DATASET {a.name}')
    if a.command == "db":
        return show({"list": "SHOW DATABASES", "create": f"CREATE DATABASE {a.name}", "drop": f"DROP DATABASE {a.name}"}[a.action])
    if a.command == "repl":
        held = ""
        for line in sys.stdin:
            held += line
            if sum((c in "([") - (c in ")]") for c in held) <= 0:
                show(held)
                held = ""
        return 0
    server = serve(session, a.port)
    for s in (signal.SIGINT, signal.SIGTERM):
        signal.signal(s, lambda *_: threading.Thread(target=server.shutdown).start())
    server.serve_forever()
    return 0


def remote(a: argparse.Namespace) -> int:
    """The jobs and schedule commands, by the service at a.url."""
    import json

    from .service.client import Client, ServiceError

    c = Client(a.url, None if a.db == "default" else a.db)
    try:
        if a.command == "jobs":
            got = {"list": lambda _: c.jobs(), "submit": c.submit, "status": c.job, "result": c.result, "cancel": c.cancel}[a.action](a.what)
        elif a.action == "add":
            name, command, seconds = a.what
            got = c.schedule(name, command, float(seconds))
        else:
            got = c.schedules() if a.action == "list" else c.unschedule(a.what[0])
    except (ServiceError, OSError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    if got is not None:
        print(json.dumps(got))
    return 0


if __name__ == "__main__":
    sys.exit(main())
