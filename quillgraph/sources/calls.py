"""Calls: requests filled in from a row, continuation over pages, and three ways into a plan.

A root call is a Python data source (`spark.read.format("exchange")`), a call for each row is a map over Arrow batches, and both use the
same client, whose transport is HTTP or a table of recorded responses.
"""

from __future__ import annotations

import base64
import json
import logging
import pickle
import re
import threading
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import asdict, dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quillgraph.functions import documents
from quillgraph.functions.classify import redact_text
from quillgraph.sources.retry import FAN_OUT, PER_HOST, RetryPolicy, admission, host_key

log = logging.getLogger("quillgraph.calls")
RESPONSE = "status string, url string, raw string"


@dataclass(frozen=True)
class Continuation:
    """How a response leads to the next request.

    none: it does not. paginate: with the value at `path` as parameter `param`, until it is empty. follow: the address at `path`, verbatim.
    poll: the same request until the value at `path` is `done`, up to `attempts` times; only the last response counts.
    """

    kind: str = "none"
    path: str = ""
    param: str = ""
    location: str = "query"  # of `param`: query or body
    done: str = ""
    attempts: int = 60
    interval: float = 1.0
    media: str = "application/json"


@dataclass(frozen=True)
class Call:
    """A request whose texts are templates: `{name}` stands for a bound value, '' where there is none."""

    url: str
    method: str = "GET"
    query: Mapping[str, str] = field(default_factory=dict)
    headers: Mapping[str, str] = field(default_factory=dict)
    body: Any = None  # a mapping (form or JSON) or text
    media: str = "application/json"
    continuation: Continuation = Continuation()
    require_ok: bool = False
    retry: RetryPolicy | None = None
    per_host: int = PER_HOST
    fan_out: int = FAN_OUT  # calls of one task at a time
    sign: Any = None  # a signer with headers(method, url, headers, body); texts of its `region` are filled in too
    recorded: str | None = None  # responses instead of the network: JSON lines, or the path of some
    verify: bool = True
    timeout: float = 60.0


def fill(template: str, row: Mapping[str, Any]) -> str:
    return re.sub(r"\{([A-Za-z_][\w.]*)\}", lambda m: "" if row.get(m[1]) is None else str(row[m[1]]), template)


def fill_all(value: Any, row: Mapping[str, Any]) -> Any:
    """Texts filled in at any depth; other literals stay."""
    if isinstance(value, str):
        return fill(value, row)
    if isinstance(value, Mapping):
        return {k: fill_all(v, row) for k, v in value.items()}
    return [fill_all(v, row) for v in value] if isinstance(value, list) else value


@dataclass(frozen=True)
class Request:
    method: str
    url: str
    headers: dict[str, str]
    body: bytes | None = None


def build(call: Call, row: Mapping[str, Any], more: Mapping[str, str] | None = None) -> Request:
    """The request of a row; `more` is the continuation's parameter."""
    more = dict(more or {})
    in_body = call.continuation.location == "body"
    query = {k: v for k, v in fill_all(dict(call.query), row).items() if v != ""} | ({} if in_body else more)
    url = fill(call.url, row)
    if query:
        url += ("&" if "?" in url else "?") + urllib.parse.urlencode(query)
    headers, body = fill_all(dict(call.headers), row), fill_all(call.body, row)
    if in_body and more:
        body = {**(body or {}), **more}
    if isinstance(body, Mapping):
        form = "urlencoded" in call.media
        data = urllib.parse.urlencode(body).encode() if form else json.dumps(body).encode()
        headers.setdefault("Content-Type", call.media)
    else:
        data = body.encode() if isinstance(body, str) and body else None
    if call.sign is not None:
        signer = replace(call.sign, region=fill(call.sign.region, row)) if hasattr(call.sign, "region") else call.sign
        headers = signer.headers(call.method, url, headers, data or b"")
    return Request(call.method, url, headers, data)


@dataclass(frozen=True)
class Response:
    status: int
    url: str
    raw: str
    headers: Mapping[str, str] = field(default_factory=dict)


Transport = Callable[[Request], Response]


def http_transport(timeout: float = 60.0, verify: bool = True) -> Transport:
    import ssl

    context = None if verify else ssl._create_unverified_context()

    def send(request: Request) -> Response:
        wire = urllib.request.Request(request.url, request.body, request.headers, method=request.method)
        try:
            with urllib.request.urlopen(wire, timeout=timeout, context=context) as r:
                return Response(r.status, request.url, r.read().decode("utf-8", "replace"), dict(r.headers))
        except urllib.error.HTTPError as e:
            return Response(e.code, request.url, e.read().decode("utf-8", "replace"), dict(e.headers))

    return send


def recorded_transport(source: str) -> Transport:
    """Responses from JSON lines (method, url[, body], status, raw), given as text or as a path; an unknown request is 404. A request that is recorded
    several times gets its responses in order, and then the last one again. Small files of fixtures, read once a worker."""
    found: dict[tuple[str, str], list[dict]] = {}
    if not source.lstrip().startswith("{"):
        with open(source, encoding="utf-8") as f:
            source = f.read()
    for line in source.splitlines():
        r = json.loads(line)
        found.setdefault((r.get("method", "GET"), r["url"]), []).append(r)

    lock = threading.Lock()

    def send(request: Request) -> Response:
        with lock:
            rows = found.get((request.method, request.url), [])
            rows = [r for r in rows if "body" not in r or r["body"] == (request.body or b"").decode()]
            if not rows:
                return Response(404, request.url, "not recorded")
            r = rows[0]
            if len(rows) > 1:
                found[request.method, request.url].remove(r)
        return Response(int(r["status"]), request.url, r["raw"], r.get("headers", {}))

    return send


class Client:
    """Sends with admission by host and retries; one slot is held over all tries of a request."""

    def __init__(self, call: Call, transport: Transport | None = None, sleep: Callable[[float], None] = time.sleep):
        self.call, self.sleep = call, sleep
        self.transport = transport or (recorded_transport(call.recorded) if call.recorded else http_transport(call.timeout, call.verify))
        self.admission = admission(call.per_host)

    def send(self, request: Request) -> Response:
        policy, last = self.call.retry, 0.0
        with self.admission.slot(host_key(request.url)):
            for attempt in range(max(1, policy.tries if policy else 1)):
                final = not policy or attempt + 1 >= policy.tries
                try:
                    response = self.transport(request)
                except OSError as e:
                    log.info("http %s %s → %s", request.method, redact_text(request.url), redact_text(str(e)))
                    if final or not policy.retried(None):
                        raise
                    wait, last = policy.delay(attempt, last, None)
                else:
                    log.info("http %s %s → %s%s", request.method, redact_text(request.url), response.status, f" {redact_text(response.raw)}" if response.status >= 400 else "")
                    if final or not policy.retried(response.status):
                        return response
                    wait, last = policy.delay(attempt, last, next((v for k, v in response.headers.items() if k.lower() == "retry-after"), None))
                self.sleep(wait)
        raise AssertionError("unreachable")

    def responses(self, row: Mapping[str, Any]) -> Iterator[Response]:
        """All responses to a row's request."""
        c = self.call.continuation
        request, polled = build(self.call, row), 0
        while True:
            response = self.send(request)
            ok = 200 <= response.status < 300
            if (self.call.require_ok or c.kind == "poll") and not ok:
                raise RuntimeError(f"status {response.status} from {response.url}: {redact_text(response.raw[:500])}")
            if c.kind == "poll":
                polled += 1
                if documents.text_at(documents.decoder(c.media)(response.raw), c.path) == c.done:
                    yield response
                    return
                if polled >= c.attempts:
                    raise RuntimeError(f"not {c.done} after {polled} attempts: {response.url}")
                self.sleep(c.interval)
                continue
            yield response
            if c.kind == "none" or not ok:
                return
            following = documents.text_at(documents.decoder(c.media)(response.raw), c.path)
            if not following:
                return
            request = replace(request, url=following) if c.kind == "follow" else build(self.call, row, {c.param: following})


def mapped_calls(rows: DataFrame, call: Call, bound: Mapping[str, str], names: Sequence[str], expand: Callable[[list[Response]], list[tuple]], how: str = "left", delay: float = 0.0) -> DataFrame:
    """Each row with the text columns `names` that `expand` makes of the responses to its request; with 'left', rows without any stay.

    `bound` maps names in the templates to columns; all other columns can be named too. Calls run side by side in as many tasks as there are
    partitions, and up to `fan_out` at a time within a task, in the order of the rows; the worker admits `per_host` of them to a host.
    """
    import pyarrow as pa
    from concurrent.futures import ThreadPoolExecutor
    from pyspark.sql.types import StringType, StructType

    kept = [c for c in rows.columns if c not in names]
    schema = StructType([rows.schema[c] for c in kept])
    for name in names:
        schema = schema.add(name, StringType())

    def work(batches):
        client = Client(call)

        def one(row: dict) -> list[tuple]:
            if delay:
                time.sleep(delay)
            return expand(list(client.responses(row | {t: row.get(s) for t, s in bound.items()})))

        with ThreadPoolExecutor(max(1, call.fan_out)) as pool:
            for batch in batches:
                at, new = [], []
                for k, found in enumerate(pool.map(one, batch.to_pylist())):
                    found = found or ([(None,) * len(names)] if how == "left" else [])
                    at += [k] * len(found)
                    new += found
                taken = batch.take(pa.array(at, pa.int64()))
                columns = [taken.column(taken.schema.get_field_index(c)) for c in kept]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.array([x[i] for x in new], pa.string()) for i in range(len(names))]], names=[*kept, *names])

    return rows.mapInArrow(work, schema)


def call_rows(rows: DataFrame, call: Call, bound: Mapping[str, str], how: str = "left", delay: float = 0.0) -> DataFrame:
    """Each row with each response to its request (status, url, raw)."""
    return mapped_calls(rows, call, bound, ("status", "url", "raw"), lambda got: [(str(r.status), r.url, r.raw) for r in got], how, delay)


def call_items(rows: DataFrame, call: Call, row_path: str, columns: Mapping[str, str], how: str = "left", bound: Mapping[str, str] | None = None) -> DataFrame:
    """Each row with the items of all pages of its list call: the objects at the dotted `row_path`, their texts at dotted paths as columns,
    null where there is none. Any status but 2xx is an error."""
    media, names = call.continuation.media, tuple(columns)

    def expand(got: list[Response]) -> list[tuple]:
        items = [x for r in got for x in documents.items_at(documents.decoder(media)(r.raw), "$." + row_path if row_path else "")]
        return [tuple(documents.text_at(x, p) or None for p in columns.values()) for x in items]

    return mapped_calls(rows, replace(call, require_ok=True), bound or {}, names, expand, how)


def call_fields(rows: DataFrame, call: Call, cases: Mapping[str, Mapping[str, str]], literals: Mapping[str, Mapping[str, str]] | None = None, default: Mapping[str, str] | None = None, bound: Mapping[str, str] | None = None) -> DataFrame:
    """Each row with texts of the one response to its call, by status: `cases` gives dotted paths, `literals` values as they are.
    For any other status the values of `default`, or an error without one."""
    literals, media = literals or {}, call.continuation.media
    names = tuple(dict.fromkeys(c for case in (*cases.values(), *literals.values(), default or {}) for c in case))

    def expand(got: list[Response]) -> list[tuple]:
        r = got[-1]
        status = str(r.status)
        if status not in cases and status not in literals and default is None:
            raise RuntimeError(f"unexpected status {status} from {r.url}: {redact_text(r.raw[:500])}")
        found = dict(literals.get(status, {} if status in cases else default or {}))
        if status in cases:
            document = documents.decoder(media)(r.raw)
            found |= {c: documents.text_at(document, p) or None for c, p in cases[status].items()}
        return [tuple(found.get(c) for c in names)]

    return mapped_calls(rows, call, bound or {}, names, expand)


def send_requests(requests: DataFrame, call: Call) -> DataFrame:
    """One response for each request row (method, url, headers map, body text), pulled from upstream."""

    def work(batches):
        import pyarrow as pa

        client = Client(call)
        for batch in batches:
            got = [client.send(Request(r["method"], r["url"], dict(r.get("headers") or {}), (r.get("body") or "").encode() or None)) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_pydict({"status": [str(r.status) for r in got], "url": [r.url for r in got], "raw": [r.raw for r in got]})

    return requests.mapInArrow(work, RESPONSE)


class ExchangeSource(DataSource):
    """`spark.read.format("exchange")` with option `call`, the JSON of a Call, and `scopes`, a JSON list of rows to call for.

    The pages of a scope follow one another, so a scope is a partition.
    """

    @classmethod
    def name(cls) -> str:
        return "exchange"

    def schema(self) -> str:
        return "scope string, " + RESPONSE

    def reader(self, schema: Any) -> DataSourceReader:
        return ExchangeReader(self.options)


class ExchangeReader(DataSourceReader):
    def __init__(self, options: Mapping[str, str]):
        self.call, self.scopes = call_from_json(options["call"]), json.loads(options.get("scopes", "[{}]"))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(k) for k in range(len(self.scopes))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        scope = self.scopes[partition.value]
        for r in Client(self.call).responses(scope):
            yield json.dumps(scope, sort_keys=True), str(r.status), r.url, r.raw


def call_to_json(call: Call) -> str:
    """A call as options of a reader. A retry policy goes whole, as pickled by Spark's own pickler; signed calls hold secrets and do not go."""
    from pyspark import cloudpickle

    if call.sign is not None:
        raise ValueError("a signed call is sent for rows, not read: options of a reader are visible in plans")
    held = {k: getattr(call, k) for k in call.__dataclass_fields__ if k not in ("retry", "continuation", "sign")}
    held |= {"query": dict(call.query), "headers": dict(call.headers), "continuation": asdict(call.continuation)}
    if call.retry:
        held["policy"] = base64.b64encode(cloudpickle.dumps(call.retry)).decode()
    return json.dumps(held)


def call_from_json(text: str) -> Call:
    held = json.loads(text)
    policy = held.pop("policy", None)
    held["continuation"] = Continuation(**held.get("continuation", {}))
    return Call(**held, retry=pickle.loads(base64.b64decode(policy)) if policy else None)


def read_call(spark: SparkSession, call: Call, scopes: list[dict] | None = None) -> DataFrame:
    """A root call as a table: scope, status, url, raw."""
    spark.dataSource.register(ExchangeSource)
    return spark.read.format("exchange").option("call", call_to_json(call)).option("scopes", json.dumps(scopes or [{}])).load()


def list_rows(responses: DataFrame, row_path: str, columns: Mapping[str, str | tuple[str, str]], keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of JSON list responses: 2xx required, parsed, projected, exploded."""
    from quillgraph.operators.project import project, require_ok

    return project(require_ok(responses).withColumn("__doc", documents.json_document(F.col("raw"))), "__doc", row_path, columns, keep)
