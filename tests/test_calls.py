"""Calls over HTTP against an in-process server, retries, signatures, documents and the catalog."""

import io
import json
import threading
from datetime import UTC, datetime
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

import pytest
from pyspark.sql import functions as F

from quillgraph.cli import main
from quillgraph.functions import templates
from quillgraph.plans.catalog import Catalog, Method, recorded
from quillgraph.plans.graph import Beta, Exchange, Plan, PlanError
from quillgraph.plans.lower import compose
from quillgraph.sources import auth, bundle, endpoints, retry
from quillgraph.sources.calls import Call, Client, Continuation, Response, build, call_rows, list_rows, read_call, send_requests


class Server(BaseHTTPRequestHandler):
    polls = 0
    flaky = 0

    def do_GET(self):
        at = urlsplit(self.path)
        q = {k: v[0] for k, v in parse_qs(at.query).items()}
        status, body = 200, {}
        if at.path == "/pages":
            k = int(q.get("token") or 0)
            body = {"items": [{"id": f"{q.get('scope', '')}{k}"}], "next": str(k + 1) if k < 2 else ""}
        elif at.path == "/follow":
            k = int(q.get("k") or 0)
            body = {"value": [{"id": k}], "nextLink": f"http://{self.headers['Host']}/follow?k={k + 1}" if k < 2 else None}
        elif at.path == "/poll":
            Server.polls += 1
            body = {"status": "DONE" if Server.polls >= 3 else "RUNNING"}
        elif at.path == "/flaky":
            Server.flaky += 1
            status, body = (503, {}) if Server.flaky < 3 else (200, {"ok": True})
        elif at.path == "/none":
            status = 404
        data = json.dumps(body).encode()
        self.send_response(status)
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def base():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_continuations(base, spark):
    pages = Call(base + "/pages", query={"scope": "{scope}"}, continuation=Continuation("paginate", "next", "token"), require_ok=True)
    got = list_rows(read_call(spark, pages, [{"scope": "a"}, {"scope": "b"}]), "items", {"id": "id"})
    assert sorted(r[0] for r in got.collect()) == ["a0", "a1", "a2", "b0", "b1", "b2"]
    follow = Call(base + "/follow", continuation=Continuation("follow", "nextLink"))
    assert len(list(Client(follow).responses({}))) == 3
    waits = []
    Server.polls = 0
    poll = Call(base + "/poll", continuation=Continuation("poll", "status", done="DONE", attempts=5))
    assert [json.loads(r.raw) for r in Client(poll, sleep=waits.append).responses({})] == [{"status": "DONE"}] and waits == [1.0, 1.0]
    Server.polls = -100
    with pytest.raises(RuntimeError, match="not DONE"):
        list(Client(poll, sleep=waits.append).responses({}))
    with pytest.raises(RuntimeError, match="404"):
        list(Client(Call(base + "/none", require_ok=True)).responses({}))


def test_call_for_each_row(base, spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "scope string, k int")
    out = call_rows(rows, Call(base + "/pages", query={"scope": "{s}"}), {"s": "scope"})
    assert sorted((r["scope"], r["k"], json.loads(r["raw"])["items"][0]["id"]) for r in out.collect()) == [("a", 1, "a0"), ("b", 2, "b0")]
    table = Exchange("names", source=lambda s: s.createDataFrame([("x",)], "name string"))
    plan = Plan([table, Exchange("pages", ("s",), call=Call(base + "/pages", query={"scope": "{s}"}))], [Beta("names", "pages", "name", "s")])
    assert json.loads(compose(spark, plan).first()["raw"])["items"] == [{"id": "x0"}]
    requests = spark.createDataFrame([("GET", base + "/pages?scope=z", {}, None)], "method string, url string, headers map<string,string>, body string")
    assert send_requests(requests, Call("")).first()["status"] == "200"


def test_retry(base):
    Server.flaky = 0
    waits = []
    policy = retry.RetryPolicy(backoff=retry.constant(0.5))
    assert next(Client(Call(base + "/flaky", retry=policy), sleep=waits.append).responses({})).status == 200 and waits == [0.5, 0.5]
    Server.flaky = 0
    assert next(Client(Call(base + "/flaky")).responses({})).status == 503
    asked = Client(Call("http://h/", retry=retry.RetryPolicy(2)), transport=lambda r: Response(429, r.url, "", {"Retry-After": "7"}), sleep=waits.append)
    assert next(asked.responses({})).status == 429 and waits[-1] == 7
    assert retry.retry_after("-3") == 0 and retry.retry_after("x") is None and retry.retry_after("Thu, 01 Jan 1970 00:00:10 GMT", now=4) == 6
    assert not retry.RetryPolicy().retried(500) and retry.RetryPolicy().retried(None)
    for _ in range(50):
        assert 0.25 <= retry.decorrelated()(0, 4.0) <= 12 and 0 <= retry.full_jitter()(3, 0) <= 2
    now = [0.0]
    rate = retry.Rate(10, 2, lambda: now[0])
    assert [rate.wait() for _ in range(3)] == pytest.approx([0, 0, 0.1])
    held, most, gate = [0], [0], retry.Admission(2)

    def work():
        with gate.slot("h"):
            held[0] += 1
            most[0] = max(most[0], held[0])
            threading.Event().wait(0.02)
            held[0] -= 1

    threads = [threading.Thread(target=work) for _ in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert most[0] <= 2


def test_requests():
    call = Call("http://h/{a}", "POST", {"q": "{b}", "none": "{zz}"}, {"X": "{a}"}, {"n": 3, "deep": {"t": "{b}"}})
    r = build(call, {"a": "x y", "b": "1"})
    assert r.url == "http://h/x y?q=1" and json.loads(r.body) == {"n": 3, "deep": {"t": "1"}} and r.headers["X"] == "x y"
    body = Call("http://h/", "POST", body={"A": "1"}, media="application/x-www-form-urlencoded", continuation=Continuation("paginate", "t", "Marker", "body"))
    assert build(body, {}, {"Marker": "m"}).body == b"A=1&Marker=m"


def test_signature_of_the_published_suite():
    signer = auth.SignatureV4("us-east-1", "service", "AKIDEXAMPLE", "wJalrXUtnFEMI/K7MDENG+bPxRfiCYEXAMPLEKEY")
    got = signer.headers("GET", "https://example.amazonaws.com/", now=datetime(2015, 8, 30, 12, 36, tzinfo=UTC))
    assert got["X-Amz-Date"] == "20150830T123600Z"
    assert got["Authorization"].endswith("SignedHeaders=host;x-amz-date, Signature=5fa00fa31553b73ebf1942676e86291e8372ff2a2260956d9b8aae1d763fbf31")
    with pytest.raises(ValueError):
        auth.SignatureV4("r", "s", "", "").headers("GET", "http://h/")
    assert auth.static_headers("bearer", auth.Secret("t", "abc")) == {"Authorization": "Bearer abc"} and auth.static_headers("null") == {}


def test_endpoints():
    assert endpoints.Endpoints().url("aws.s3", region="eu-west-1") == "https://s3.eu-west-1.amazonaws.com"
    assert endpoints.Endpoints("http://m:1/").url("aws.ec2") == "http://m:1"
    assert endpoints.Endpoints({"aws.s3": {"scheme": "http", "host": "x", "port": "9"}}).url("aws.s3") == "http://x:9"
    with pytest.raises(ValueError):
        endpoints.Endpoints({"zz": "u"})
    with pytest.raises(ValueError):
        endpoints.Endpoints().url("zz")
    assert endpoints.bucket_url("https://s3.x.com", "b", False) == "https://b.s3.x.com" and endpoints.bucket_url("https://s3.x.com", "b", True) == "https://s3.x.com/b"
    assert endpoints.uri_encode("a b/~é") == "a%20b%2F~%C3%A9" and endpoints.retarget("https://a/b?c", "http://m:1/p") == "http://m:1/p/b?c"


PROGRAM = '{{- $lst := index . "Urls" -}}{{- $tok := index . "Next" -}}{"line_items": [{{- range $i, $v := $lst -}}{{- if $i }},{{ end }}{"url": {{ toJson $v }}}{{- end -}}]{{- if $tok }}, "Next": {{ toJson $tok }}{{- end }}}'


def test_templates():
    registry = templates.default_registry()
    run = registry.compile("golang_template_json_v0.3.0", PROGRAM)
    assert run('{"Urls": ["a", "b"], "Next": "t"}') == {"line_items": [{"url": "a"}, {"url": "b"}], "Next": "t"} and run("{}") == {"line_items": []}
    with pytest.raises(ValueError, match="supported"):
        registry.compile("other", "")
    with pytest.raises(ValueError, match="shape"):
        registry.compile("golang_template_json_v0.3.0", "{{ .x }}")
    with pytest.raises(ValueError):
        registry.register("golang_template_json_v0.3.0", None)
    assert templates.to_json({"b": "<&>"}) == '{"b":"<&>"}' and templates.json_map("") == {} and templates.plus1(2.0) == 3
    assert [templates.kind_of(x) for x in (None, [], {}, "", 1, 1.0, True)] == ["invalid", "slice", "map", "string", "int", "float64", "bool"]
    assert templates.index({"a": [{"b": 1}]}, "a", 0, "b") == 1 and templates.index({"a": 1}, "a", "b") is None
    comma = templates.separator(",")
    assert [comma(), comma(), comma()] == ["", ",", ","]


@pytest.fixture(scope="module")
def documents(tmp_path_factory):
    import yaml

    root = tmp_path_factory.mktemp("providers")
    method = {"operation": {"$ref": "#/paths/~1list~1{org}/get"}, "response": {"openAPIDocKey": "200", "mediaType": "application/json", "objectKey": "$.line_items", "transform": {"type": "golang_template_json_v0.3.0", "body": PROGRAM}}, "config": {"pagination": {"requestToken": {"key": "next", "location": "query"}, "responseToken": {"key": "$.Next", "location": "body"}}}}
    plain = {"operation": {"$ref": "#/paths/~1all/get"}, "response": {"mediaType": "application/json", "objectKey": "$.items"}}
    service = {
        "servers": [{"url": "http://{region}.host", "variables": {"region": {"default": "eu"}}}],
        "paths": {"/list/{org}": {"get": {"parameters": [{"name": "org", "in": "path", "required": True}, {"name": "q", "in": "query"}]}}, "/all": {"get": {}}},
        "components": {"x-any-resources": {"queues": {"methods": {"by_org": method, "every": plain}, "sqlVerbs": {"select": [{"$ref": "#/components/x-any-resources/queues/methods/by_org"}, {"$ref": "#/components/x-any-resources/queues/methods/every"}]}}}},
    }
    for version in ("v1", "v2"):
        (root / "dir" / version / "services").mkdir(parents=True)
        (root / "dir" / version / "provider.yaml").write_text(yaml.dump({"name": "cloud", "version": version, "providerServices": {"mq": {"service": {"$ref": "cloud/x/services/mq.yaml"}}, "gone": {"service": {"$ref": "cloud/x/services/gone.yaml"}}}}))
        (root / "dir" / version / "services" / "mq.yaml").write_text(yaml.dump(service))
    return str(root)


def test_bundle(documents, spark):
    b = bundle.Bundle(documents)
    assert b.providers() == ["cloud"] and b.folders["cloud"].endswith("v2")
    methods = b.methods("cloud.mq.queues")
    assert [m.address for m in methods] == ["cloud.mq.queues.by_org", "cloud.mq.queues.every"]
    assert bundle.choose(methods, {"org": "o"}).address.endswith("by_org") and bundle.choose(methods, {}).address.endswith("every")
    with pytest.raises(PlanError, match="ambiguous"):
        bundle.choose([methods[1], methods[1]], {})
    with pytest.raises(PlanError, match="needs org"):
        bundle.choose(methods[:1], {})
    call = bundle.compile_call(methods[0], {"org": "o", "q": "1"}, paginate=True)
    assert call.url == "http://eu.host/list/o" and call.query == {"q": "1"} and call.continuation.path == "Next"
    responses = spark.createDataFrame([("200", "u", '{"Urls": ["a", "b"]}')], "status string, url string, raw string")
    assert sorted(r[0] for r in bundle.item_rows(responses, methods[0], "url string").collect()) == ["a", "b"]
    assert b.listing(spark, "cloud").count() == 2
    pages = [{"url": f"http://eu.host/list/o?q=1{more}", "status": 200, "raw": raw} for more, raw in (("", '{"Urls": ["a"], "Next": "t"}'), ("&next=t", '{"Urls": ["b"]}'))]
    ran = bundle.run(spark, documents, "cloud.mq.queues", {"org": "o", "q": "1"}, "url string", paginate=True, recorded="\n".join(map(json.dumps, pages)))
    assert sorted((r["url"], r["org"], r["q"], r["region"]) for r in ran.collect()) == [("a", "o", "1", None), ("b", "o", "1", None)]
    for address in ("zz.x", "cloud.gone.x", "cloud.zz"):
        with pytest.raises(PlanError):
            b.methods(address)


TABLES = {
    "aws.buckets": [{"name": "b1", "created": "c", "arn": "a", "region": "r"}, {"name": "b2", "created": "c", "arn": "a", "region": "r"}],
    "aws.encryption": [{"name": "b1", "encryption_status": "aws:kms"}, {"name": "b2", "encryption_status": "none"}],
    "aws.versioning": [{"name": "b1", "versioning": "Enabled"}],
    "aws.logging": [{"name": "b1", "access_log_target": "logs"}],
    "aws.public_access": [{"name": "b1", "public": "true"}],
    "azure.subscriptions": [{"subscription_id": "s1"}, {"subscription_id": "s2"}],
    "azure.accounts": [{"subscription_id": "s1", "account_id": "x", "name": "acc", "encryption_status": "Microsoft.Storage", "public": False, "https": True}],
    "azure.diagnostics": [{"account_id": "other", "access_log_target": "t"}],
    "azure.containers": [{"account_id": "x", "container": "data", "container_public": "None"}, {"account_id": "x", "container": "open", "container_public": "Blob"}],
    "azure.vnets": [{"subscription_id": "s1", "vnet_id": "v", "vnet_name": "n"}],
    "azure.subnets": [{"vnet_id": "v", "subnet_id": "1", "subnet_name": "a", "address_prefix": "p"}, {"vnet_id": "v", "subnet_id": "2", "subnet_name": "b", "address_prefix": "p"}],
    "gcp.folders": [{"parent": "organizations/9", "folder": "folders/1"}, {"parent": "folders/1", "folder": "folders/2"}],
    "gcp.projects": [{"parent": "organizations/9", "project": "p0"}, {"parent": "folders/1", "project": "p1"}],
    "gcp.buckets": [{"project": "p0", "name": "g", "encryption_status": "k", "public": "enforced", "versioning": True}, {"project": "p1", "name": "h", "encryption_status": None, "public": "x", "versioning": False}],
    "gcp.policies": [{"project": p, "bindings": [{"role": "owner", "members": ["user:ann", "serviceAccount:bot"]}]} for p in ("p0", "p1")],
    "aws.users": [{"principal": "alice", "principal_id": "1", "arn": "arn:aws:iam::42:user/alice", "created": "t"}, {"principal": "bob", "principal_id": "2", "arn": "arn:aws:iam::42:user/bob", "created": "t"}],
    "aws.policies": [{"principal": "alice", "grant": "read"}, {"principal": "bob", "grant": "read"}, {"principal": "bob", "grant": "write"}],
    "aws.mfa_devices": [{"principal": "alice", "mfa_serial": "dev"}],
    "entra.users": [{"principal": "ada", "principal_id": "a", "enabled": True}, {"principal": "grace", "principal_id": "g", "enabled": False}],
    "entra.roles": [{"principal_id": "a", "grant": "admin"}],
    "aws.networks": [{"vpc_id": "v", "subnet_id": "s"}],
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("recorded")
    for name, rows in TABLES.items():
        (root / f"{name}.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
    return str(root)


def test_catalog(folder, spark):
    catalog, t = Catalog(), recorded(spark, folder)
    stores = catalog.new(spark, "all.storage.buckets.list", t, {"region": "eu", "google_org": "9"})
    got = {(r["provider"], r["name"]): r for r in stores.collect()}
    assert set(got) == {("aws", "b1"), ("aws", "b2"), ("azure", "acc/data"), ("azure", "acc/open"), ("gcp", "g"), ("gcp", "h")}
    assert got["aws", "b2"]["public"] is True and got["azure", "acc/open"]["public"] is True and got["azure", "acc/data"]["public"] is False
    assert got["gcp", "g"]["public"] is False and got["aws", "b1"]["region"] == "eu" and got["aws", "b1"]["google_project"] is None
    assert catalog.new(spark, "all.storage.buckets.list", t, {"region": "eu", "google_project": "p1"}, limit=4).count() == 4
    access = catalog.new(spark, "all.iam.principals.access", t, {"region": "eu", "google_org": "9"}).collect()
    assert len(access) == 3 + 2 + 4
    assert {(r["principal"], r["grant"], r["mfa"], r["scope"]) for r in access if r["provider"] == "aws"} == {("alice", "read", True, "42"), ("bob", "read", False, "42"), ("bob", "write", False, "42")}
    assert all(r["mfa"] is None for r in catalog.new(spark, "aws.iam.principals.list", t, {"region": "eu"}).collect())
    assert catalog.new(spark, "azure.network.subnets.list", t).count() == 3
    assert catalog.new_merged(spark, ["aws.s3.buckets.list", "azure.storage.containers.list"], t, {"region": "eu"}).count() == 4
    assert catalog.new(spark, "aws.s3.buckets.enumerate", t, {"region": "eu"}).count() == 2
    assert catalog.new(spark, "aws.ec2.networks.provision", t, {"region": "eu", "vpc_cidr": "1", "subnet_cidr": "2"}).first()["vpc_id"] == "v"


def test_catalog_checks(folder, spark):
    catalog, t = Catalog(), recorded(spark, folder)
    for path, args, message in (("aws.s3.buckets.list", {}, "needs region"), ("google.storage.buckets.list", {}, "exactly one"), ("google.storage.buckets.list", {"google_org": "1", "google_project": "2"}, "exactly one"), ("zz", {}, "no method")):
        with pytest.raises(PlanError, match=message):
            catalog.new(spark, path, t, args)
    catalog.method_map["x.y"] = Method("x.y", "x", "", catalog.method("aws.s3.buckets.list").schema, members=("x.z",))
    catalog.method_map["x.z"] = Method("x.z", "x", "", catalog.method("aws.s3.buckets.list").schema, members=("x.y",))
    with pytest.raises(PlanError, match="contain each other"):
        catalog.new(spark, "x.y", t)
    published = catalog.method("aws.s3.buckets.list").published()
    assert not published["region"].nullable and published["region"].metadata == {"input": True}
    assert [r.path for r in catalog.resources("iam")] == ["all.iam.principals", "aws.iam.principals", "gcp.iam.principals"] and Catalog().listing(spark).count() == 16


def test_command_line(folder, documents, spark):
    out = io.StringIO()
    assert main(["run", "aws.s3.buckets.list", "--args", '{"region": "eu"}', "--tables", folder], out, spark) == 0
    assert sorted(json.loads(x)["name"] for x in out.getvalue().splitlines()) == ["b1", "b2"]
    for argv in (["resources"], ["methods", "aws.s3.buckets"], ["method", "aws.s3.buckets.list"], ["documents", documents]):
        out = io.StringIO()
        assert main(argv, out) == 0 and out.getvalue()
    assert main(["run", "aws.s3.buckets.list", "--tables", folder], io.StringIO(), spark) == 2


def test_column_order_does_not_matter(spark):
    a = spark.createDataFrame([("1", "2")], "a string, b string")
    from quillgraph.operators.combine import merge

    assert merge([a, a.select("b", "a").withColumn("c", F.lit("3"))]).collect()[1]["a"] == "1"
