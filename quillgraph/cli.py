"""Command line: discovery and runs, a JSON line for each row."""

from __future__ import annotations

import argparse
import json
import os
import sys
import threading

from quillgraph.plans.catalog import Catalog, recorded
from quillgraph.plans.graph import PlanError
from quillgraph.plans.live import Access
from quillgraph.sinks import cursor
from quillgraph.sources.auth import Secret
from quillgraph.sources.calls import Call
from quillgraph.sources.endpoints import Endpoints
from quillgraph.sources.retry import FAN_OUT, PER_HOST, TRIES, RetryPolicy


def session(app: str = "quillgraph"):
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").getOrCreate()


def access(a: argparse.Namespace) -> Access:
    """Addresses from the arguments, credentials from the usual environment variables."""
    given = lambda name: Secret(name, env=name)
    where = json.loads(a.endpoints) if (a.endpoints or "").startswith("{") else a.endpoints
    common = Call("", fan_out=a.fan_out, per_host=a.per_host, retry=RetryPolicy(a.tries))
    return Access(
        Endpoints(where), given("AWS_ACCESS_KEY_ID"), given("AWS_SECRET_ACCESS_KEY"), given("AWS_SESSION_TOKEN"), os.environ.get("AZURE_TENANT_ID", ""),
        given("AZURE_CLIENT_ID"), given("AZURE_CLIENT_SECRET"), given("GOOGLE_ASSERTION"), common,
    )


def main(argv: list[str] | None = None, out=sys.stdout, spark=None) -> int:
    parser = argparse.ArgumentParser(prog="quillgraph")
    verbs = parser.add_subparsers(dest="verb", required=True)
    verbs.add_parser("resources").add_argument("pattern", nargs="?", default="")
    verbs.add_parser("methods").add_argument("resource")
    verbs.add_parser("method").add_argument("path")
    run = verbs.add_parser("run")
    run.add_argument("path", nargs="+", help="one method, or several to merge")
    run.add_argument("--args", default="{}", help="JSON object of parameters")
    run.add_argument("--tables", help="folder of recorded responses, a JSON lines file for each table, instead of calls")
    run.add_argument("--endpoints", help="one address for all services, or a JSON object from service to address")
    run.add_argument("--fan-out", type=int, default=FAN_OUT, help="calls of a task at a time")
    run.add_argument("--per-host", type=int, default=PER_HOST, help="calls of a worker to a host at a time")
    run.add_argument("--tries", type=int, default=TRIES, help="tries of a call")
    run.add_argument("--limit", type=int, default=0)
    run.add_argument("--timeout", type=float, default=60.0)
    docs = verbs.add_parser("documents")
    docs.add_argument("folder")
    docs.add_argument("address", nargs="?")
    doc = verbs.add_parser("document-run")
    doc.add_argument("folder")
    doc.add_argument("address")
    doc.add_argument("--args", default="{}", help="JSON object of parameters")
    doc.add_argument("--schema", required=True, help="columns and types of the rows")
    doc.add_argument("--base", help="another address instead of the document's server")
    doc.add_argument("--recorded", help="recorded responses instead of the network")
    doc.add_argument("--paginate", action="store_true")
    a = parser.parse_args(argv)
    catalog = Catalog()
    say = lambda row: print(json.dumps(row, ensure_ascii=False), file=out)
    try:
        if a.verb == "resources":
            for r in catalog.resources(a.pattern):
                say({"path": r.path, "summary": r.summary})
        elif a.verb == "methods":
            for m in catalog.methods(catalog.resource(a.resource).path):
                say({"path": m.path, "summary": m.summary})
        elif a.verb == "method":
            m = catalog.method(a.path)
            say({"path": m.path, "params": [vars(p) for p in m.params], "schema": json.loads(m.published().json())})
        elif a.verb == "documents":
            from quillgraph.sources.bundle import Bundle

            bundle = Bundle(a.folder)
            for address in [a.address] if a.address else bundle.providers():
                for m in bundle.methods(address):
                    say({"address": m.address, "http": m.http, "path": m.path, "required": m.required})
        elif a.verb == "document-run":
            from quillgraph.sources.bundle import run as run_document

            rows = run_document(spark or session(), a.folder, a.address, json.loads(a.args), a.schema, a.base, paginate=a.paginate, recorded=a.recorded)
            for row in cursor(rows):
                say(row)
        else:
            spark = spark or session()
            group = "run"
            spark.sparkContext.setJobGroup(group, " ".join(a.path), interruptOnCancel=True)
            timer = threading.Timer(a.timeout, spark.sparkContext.cancelJobGroup, [group])
            timer.start()
            try:
                tables, args = recorded(spark, a.tables) if a.tables else access(a), json.loads(a.args)
                rows = catalog.new(spark, a.path[0], tables, args, a.limit) if len(a.path) == 1 else catalog.new_merged(spark, a.path, tables, args, a.limit)
                for row in cursor(rows):
                    say(row)
            finally:
                timer.cancel()
    except PlanError as e:
        print(e, file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
