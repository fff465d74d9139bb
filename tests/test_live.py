"""The catalog's methods by calls, against an in-process server of three providers."""

import io
import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

import pytest

from quillgraph.cli import main
from quillgraph.plans.catalog import Catalog
from quillgraph.plans.graph import PlanError
from quillgraph.plans.live import Access
from quillgraph.sources.auth import Secret
from quillgraph.sources.calls import Call, call_from_json, call_rows, call_to_json
from quillgraph.sources.endpoints import Endpoints
from quillgraph.sources.retry import RetryPolicy, Rate, constant

BUCKETS = [f"bucket-{k}" for k in range(5)]
FOLDERS = {"organizations/9": ["folders/1"], "folders/1": ["folders/2"]}
PROJECTS = {"organizations/9": ["p0"], "folders/1": ["p1"]}
LOG = {"seen": [], "now": 0, "most": 0, "failed": set()}
LOCK = threading.Lock()


def members(outer: str, inner: list[str]) -> str:
    return f"<{outer}Response xmlns='urn:x'><{outer}Result>{''.join(inner)}</{outer}Result></{outer}Response>"


def answer(method: str, path: str, query: dict, body: dict, headers: dict, base: str):
    """(status, text) of a request."""
    if path == "/slow":
        time.sleep(0.05)
        return 200, "{}"
    if path == "/flaky" and query["n"] not in LOG["failed"]:
        LOG["failed"].add(query["n"])
        return 418, '{"client_secret": "s3cr3t"}'
    if path == "/flaky":
        return 200, "{}"
    signed = headers.get("Authorization", "").startswith("AWS4-HMAC-SHA256 Credential=key/")
    if path == "/" and method == "GET":
        if not signed:
            return 403, "unsigned"
        low = int(query.get("continuation-token", 0))
        rows = "".join(f"<Bucket><Name>{b}</Name><CreationDate>t</CreationDate><BucketRegion>{'eu' if k % 2 else ''}</BucketRegion></Bucket>" for k, b in list(enumerate(BUCKETS))[low : low + 3])
        more = "<ContinuationToken>3</ContinuationToken>" if low == 0 else ""
        return 200, f"<?xml version='1.0'?><ListAllMyBucketsResult xmlns='urn:s3'><Buckets>{rows}</Buckets>{more}</ListAllMyBucketsResult>"
    if path.startswith("/bucket-"):
        k = int(path[8:])
        region = headers["Authorization"].split("/")[2]
        if region != ("eu" if k % 2 else "us"):
            return 403, "another region"
        if "encryption" in query:
            rule = f"<Rule><BucketKeyEnabled>true</BucketKeyEnabled><ApplyServerSideEncryptionByDefault><SSEAlgorithm>{'aws:kms' if k == 1 else 'AES256'}</SSEAlgorithm></ApplyServerSideEncryptionByDefault></Rule>"
            return (404, "<Error/>") if k == 2 else (200, f"<ServerSideEncryptionConfiguration>{rule}</ServerSideEncryptionConfiguration>")
        if "versioning" in query:
            return 200, "<VersioningConfiguration><Status>Enabled</Status></VersioningConfiguration>"
        if "logging" in query:
            return 200, "<BucketLoggingStatus><LoggingEnabled><TargetBucket>logs</TargetBucket></LoggingEnabled></BucketLoggingStatus>" if k % 2 else "<BucketLoggingStatus xmlns='urn:s3'/>"
        return (404, "<Error/>") if k == 3 else (200, "<PublicAccessBlockConfiguration><RestrictPublicBuckets>true</RestrictPublicBuckets></PublicAccessBlockConfiguration>")
    if path == "/" and method == "POST":
        action, user = body["Action"], body.get("UserName", "")
        if not signed:
            return 403, "unsigned"
        if action == "ListUsers":
            name = "bob" if body.get("Marker") else "alice"
            return 200, members(action, [f"<Users><member><UserName>{name}</UserName><UserId>{name}-id</UserId><Arn>arn:aws:iam::42:user/{name}</Arn></member></Users>", "" if body.get("Marker") else "<Marker>m</Marker>"])
        if action == "ListAttachedUserPolicies":
            return 200, members(action, ["<AttachedPolicies>", *[f"<member><PolicyName>{p}</PolicyName></member>" for p in (["admin"] if user == "alice" else ["read", "write"])], "</AttachedPolicies>"])
        return 200, members(action, ["<MFADevices><member><SerialNumber>d</SerialNumber></member></MFADevices>" if user == "alice" else "<MFADevices/>"])
    if path.endswith("/oauth2/v2.0/token") or path == "/token":
        return 200, json.dumps({"access_token": "tok"} if body.get("client_secret") == "sec" or body.get("assertion") == "signed" else {})
    if headers.get("Authorization") != "Bearer tok":
        return 401, "no token"
    if path == "/subscriptions":
        return 200, json.dumps({"value": [{"subscriptionId": "s2"}]} if query.get("_page") else {"value": [{"subscriptionId": "s1"}], "nextLink": f"{base}/subscriptions?_page=2"})
    if path.endswith("/storageAccounts"):
        sub = path.split("/")[2]
        return 200, json.dumps({"value": [] if sub == "s2" else [{"name": a, "id": f"/accounts/{a}", "properties": {"encryption": {"keySource": "Microsoft.Keyvault"}, "allowBlobPublicAccess": True, "supportsHttpsTrafficOnly": True}} for a in ("acca", "accb")]})
    if path.endswith("/diagnosticSettings"):
        return 200, json.dumps({"value": [{"properties": {"storageAccountId": "/sink"}}] if path.startswith("/accounts/acca") else []})
    if path.endswith("/containers"):
        return 200, json.dumps({"value": [{"name": "data", "properties": {"publicAccess": "None"}}, {"name": "open", "properties": {"publicAccess": "Blob"}}]})
    if path.endswith("/virtualNetworks"):
        return 200, json.dumps({"value": [{"id": f"/v/{path.split('/')[2]}", "name": "net"}]})
    if path.endswith("/subnets"):
        return 200, json.dumps({"value": [{"id": f"{path}/{n}", "name": n, "properties": {"addressPrefix": "10.0.0.0/24"}} for n in "ab"]})
    if path == "/v3/folders":
        return 200, json.dumps({"folders": [{"name": f} for f in FOLDERS.get(query["parent"], [])]})
    if path == "/v3/projects":
        return 200, json.dumps({"projects": [{"projectId": p} for p in PROJECTS.get(query["parent"], [])]})
    if path == "/storage/v1/b":
        return 200, json.dumps({"items": [{"name": "plain", "versioning": {"enabled": False}}, {"name": "keyed", "encryption": {"defaultKmsKeyName": "k"}, "iamConfiguration": {"publicAccessPrevention": "enforced"}, "versioning": {"enabled": True}}]})
    if path.endswith(":getIamPolicy"):
        return 200, json.dumps({"bindings": [{"role": "owner", "members": ["user:carol"]}, {"role": "viewer", "members": ["serviceAccount:bot", "allUsers"]}]})
    if path == "/v1.0/users":
        return 200, json.dumps({"value": [{"id": i, "userPrincipalName": f"{i}@x", "accountEnabled": True} for i in ("ada", "grace")]})
    if path.endswith("/memberOf"):
        return 200, json.dumps({"value": [{"displayName": "Admin"}] if "/ada/" in path else []})
    return 404, "not here"


class Handler(BaseHTTPRequestHandler):
    def do_GET(self):
        at = urlsplit(self.path)
        query = {k: v[0] for k, v in parse_qs(at.query, keep_blank_values=True).items()}
        raw = self.rfile.read(int(self.headers.get("Content-Length") or 0)).decode()
        body = {k: v[0] for k, v in parse_qs(raw).items()}
        with LOCK:
            LOG["seen"].append(at.path)
            LOG["now"] += 1
            LOG["most"] = max(LOG["most"], LOG["now"])
        status, text = answer(self.command, at.path, query, body, dict(self.headers), f"http://{self.headers['Host']}")
        with LOCK:
            LOG["now"] -= 1
        self.send_response(status)
        self.end_headers()
        self.wfile.write(text.encode())

    do_POST = do_GET

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def base():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


@pytest.fixture(scope="module")
def access(base):
    given = lambda v: Secret(v, literal=v)
    return Access(Endpoints(base), given("key"), given("secret"), None, "ten", given("cid"), given("sec"), given("signed"))


def test_stores_of_every_provider(spark, access):
    rows = Catalog().new(spark, "all.storage.buckets.list", access, {"region": "us", "google_org": "9"}).collect()
    got = {(r["provider"], r["name"]): r for r in rows}
    assert len(rows) == len(got) + 2 == 5 + 4 + 4 and {r["region"] for r in rows} == {"us"}
    assert [got["aws", b]["encryption_class"] for b in BUCKETS] == ["provider-managed", "customer-managed", "provider-managed", "provider-managed", "provider-managed"]
    assert got["aws", "bucket-2"]["encryption_status"] == "none" and [got["aws", b]["public"] for b in BUCKETS] == [False, False, False, True, False]
    assert got["aws", "bucket-1"]["access_log_target"] == "logs" and got["aws", "bucket-0"]["access_logging"] is False and got["aws", "bucket-0"]["versioning"] is True
    assert got["azure", "acca/data"]["public"] is False and got["azure", "accb/open"]["public"] is True and got["azure", "acca/data"]["access_logging"] and not got["azure", "accb/open"]["access_logging"]
    assert got["gcp", "plain"]["public"] is True and got["gcp", "keyed"]["encryption_class"] == "customer-managed" and got["gcp", "keyed"]["public"] is False
    assert Catalog().new(spark, "google.storage.buckets.list", access, {"google_project": "p0"}, limit=1).count() == 1


def test_principals_of_every_source(spark, access):
    rows = Catalog().new(spark, "all.iam.principals.access", access, {"region": "us", "google_org": "9"}).collect()
    got = sorted((r["provider"], r["principal"], r["grant"] or "", r["scope"], r["mfa"]) for r in rows)
    assert got == sorted([
        ("aws", "alice", "admin", "42", True), ("aws", "bob", "read", "42", False), ("aws", "bob", "write", "42", False),
        ("entra", "ada@x", "Admin", "ten", None), ("entra", "grace@x", "", "ten", None),
        *[("gcp", n, g, p, None) for p in ("p0", "p1") for n, g in (("carol", "owner"), ("bot", "viewer"), ("allUsers", "viewer"))],
    ])
    kinds = {r["principal"]: (r["principal_type"], r["principal_id"]) for r in rows}
    assert kinds["bot"] == ("service_principal", "serviceAccount:bot") and kinds["allUsers"] == ("unknown", "allUsers") and kinds["alice"] == ("user", "alice-id")
    assert Catalog().new(spark, "aws.iam.principals.list", access, {"region": "us"}).count() == 2


def test_other_methods(spark, access):
    subnets = Catalog().new(spark, "azure.network.subnets.list", access).collect()
    assert len(subnets) == 4 and {r["subscription_id"] for r in subnets} == {"s1", "s2"} and subnets[0]["address_prefix"] == "10.0.0.0/24"
    detailed = {r["name"]: r for r in Catalog().new(spark, "aws.s3.buckets.encryption", access, {"region": "us"}).collect()}
    assert detailed["bucket-1"]["encryption"]["algorithm"] == "aws:kms" and detailed["bucket-2"]["encryption"] is None and detailed["bucket-2"]["encryption_status"] == "none"
    with pytest.raises(PlanError, match="recorded by the driver"):
        Catalog().new(spark, "aws.ec2.networks.provision", access, {"region": "us", "vpc_cidr": "1", "subnet_cidr": "2"})
    with pytest.raises(PlanError, match="no aws key"):
        Catalog().new(spark, "aws.s3.buckets.list", Access(), {"region": "us"})


def test_failures_are_errors(spark, access, base):
    wrong = Access(Endpoints(base), azure_tenant="t", azure_client=Secret("c", literal="c"), azure_secret=Secret("s", literal="wrong"))
    with pytest.raises(Exception, match="gave no token"):
        Catalog().new(spark, "azure.storage.containers.list", wrong).collect()


def test_calls_of_a_task_run_side_by_side(spark, base):
    rows = spark.createDataFrame([(str(k),) for k in range(48)], "n string").coalesce(1)
    LOG["most"] = 0
    got = call_rows(rows, Call(base + "/slow", query={"n": "{n}"}, per_host=4), {}).collect()
    assert [r["n"] for r in got] == [str(k) for k in range(48)] and 1 < LOG["most"] <= 4
    LOG["most"] = 0
    call_rows(rows, Call(base + "/slow", query={"n": "{n}"}, per_host=40, fan_out=1), {}).collect()
    assert LOG["most"] == 1


def test_readers_keep_the_whole_retry_policy(spark, base, caplog):
    from quillgraph.sources.calls import Client, read_call

    LOG["failed"].clear()
    call = Call(base + "/flaky", query={"n": "{n}"}, retry=RetryPolicy(2, (418,), constant(0.01), Rate(1000.0, 5)))
    again = call_from_json(call_to_json(call))
    assert again.retry.statuses == (418,) and again.retry.backoff(0, 0.0) == 0.01 and again.retry.governor.rate == 1000.0
    assert [r["status"] for r in read_call(spark, call, [{"n": "a"}, {"n": "b"}]).collect()] == ["200", "200"]
    with caplog.at_level("INFO", "quillgraph.calls"):
        assert [r.status for r in Client(call).responses({"n": "c"})] == [200]
    assert "s3cr3t" not in caplog.text and "418" in caplog.text


def test_command_line_with_calls(spark, base, monkeypatch):
    for name, value in {"AWS_ACCESS_KEY_ID": "key", "AWS_SECRET_ACCESS_KEY": "secret"}.items():
        monkeypatch.setenv(name, value)
    out = io.StringIO()
    assert main(["run", "aws.s3.buckets.list", "--args", '{"region": "us"}', "--endpoints", base, "--fan-out", "2", "--tries", "2"], out, spark) == 0
    assert sorted(json.loads(x)["name"] for x in out.getvalue().splitlines()) == BUCKETS
