"""The catalog's methods over calls: each is a chain of calls, every one filled in from the rows of the one before.

A token is fetched by the first call of a chain and is a column until the rows are conformed to their schema, so it is bound like any other value.
Lists are read to their last page; a list whose status is not 2xx is an error, a sub-resource branches by status.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import classify
from quillgraph.functions.documents import decode_json
from quillgraph.operators.fixpoint import fixpoint, max_iterations
from quillgraph.operators.project import const_columns
from quillgraph.plans.graph import PlanError
from quillgraph.sources.auth import Secret, SignatureV4, client_credentials, service_account
from quillgraph.sources.calls import Call, Continuation, call_fields, call_items, mapped_calls
from quillgraph.sources.endpoints import Endpoints, bucket_url
from quillgraph.sources.retry import RetryPolicy

# Versions, scopes and page sizes of the services.
SUBSCRIPTIONS, NETWORKS, DIAGNOSTICS, STORAGE = "2020-01-01", "2023-09-01", "2021-05-01-preview", "2023-01-01"
MANAGEMENT_SCOPE, GRAPH_SCOPE = "https://management.azure.com/.default", "https://graph.microsoft.com/.default"
IDENTITY_VERSION, BUCKETS_A_PAGE = "2010-05-08", 1000
BEARER = {"Authorization": "Bearer {token}"}
FOLLOW, GRAPH = Continuation("follow", "nextLink"), Continuation("follow", "@odata.nextLink")
PAGES = Continuation("paginate", "nextPageToken", "pageToken")
RULE = "ServerSideEncryptionConfiguration.Rule"


@dataclass(frozen=True)
class Access:
    """How methods reach their services: addresses, credentials, and what every call has in common (a template of Call)."""

    endpoints: Endpoints = field(default_factory=Endpoints)
    aws_key: Secret | None = None
    aws_secret: Secret | None = None
    aws_token: Secret | None = None
    azure_tenant: str = ""
    azure_client: Secret | None = None
    azure_secret: Secret | None = None
    google_assertion: Secret | None = None
    common: Call = Call("", retry=RetryPolicy())

    def call(self, url: str, **rest) -> Call:
        return replace(self.common, url=url, **rest)

    def needed(self, name: str) -> Secret:
        secret = getattr(self, name)
        if secret is None:
            raise PlanError(f"no {name.replace('_', ' ')} is given")
        return secret

    def signer(self, service: str, region: str, payload_header: bool = False) -> SignatureV4:
        session = self.aws_token.resolve(required=False) if self.aws_token else ""
        return SignatureV4(region, service, self.needed("aws_key").resolve(), self.needed("aws_secret").resolve(), session, payload_header)


def seed(spark: SparkSession, **values: str) -> DataFrame:
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.lit(True).alias("seed")])


def with_token(rows: DataFrame, a: Access, exchange: Call) -> DataFrame:
    """The rows with the token that an exchange of credentials gives."""
    call = a.call(exchange.url, method=exchange.method, body=exchange.body, media=exchange.media)
    return call_fields(rows, call, {"200": {"token": "access_token"}}).where(F.when(F.col("token").isNull(), F.raise_error(F.lit("the exchange gave no token"))).otherwise(True))


def azure_rows(spark: SparkSession, a: Access, scope: str = MANAGEMENT_SCOPE) -> DataFrame:
    url = f"{a.endpoints.url('azure.login')}/{a.azure_tenant}/oauth2/v2.0/token"
    return with_token(seed(spark), a, client_credentials(url, a.needed("azure_client"), a.needed("azure_secret"), scope))


def google_rows(spark: SparkSession, a: Access) -> DataFrame:
    return with_token(seed(spark), a, service_account(f"{a.endpoints.url('gcp.token')}/token", a.needed("google_assertion")))


def azure_list(rows: DataFrame, a: Access, path: str, version: str, columns: Mapping[str, str], how: str = "left") -> DataFrame:
    """A list of the management service, for every row; `path` is a template."""
    return call_items(rows, a.call(f"{a.endpoints.url('azure.management')}{path}?api-version={version}", headers=BEARER, continuation=FOLLOW), "value", columns, how)


def aws_buckets(spark: SparkSession, a: Access, args: Mapping[str, str]) -> DataFrame:
    region = args["region"]
    pages = Continuation("paginate", "ListAllMyBucketsResult.ContinuationToken", "continuation-token", media="application/xml")
    call = a.call(a.endpoints.url("aws.s3", region=region) + "/", query={"max-buckets": str(BUCKETS_A_PAGE)}, continuation=pages, sign=a.signer("s3", region, True))
    fields = {"name": "Name", "created": "CreationDate", "arn": "BucketArn", "region": "BucketRegion"}
    rows = call_items(seed(spark), call, "ListAllMyBucketsResult.Buckets.Bucket", fields, "inner").drop("seed")
    return rows.withColumn("region", F.coalesce("region", F.lit(region)))


def bucket_detail(rows: DataFrame, a: Access, detail: str, cases: dict, literals: dict | None = None, default: dict | None = None) -> DataFrame:
    """A sub-resource of each bucket, at the bucket's own region."""
    overridden = a.endpoints.overridden("aws.s3")
    base = a.endpoints.url("aws.s3", region="{region}")
    url = bucket_url(base, "{name}", overridden) + ("" if overridden else "/") + f"?{detail}"
    call = a.call(url, continuation=Continuation(media="application/xml"), sign=a.signer("s3", "{region}", True))
    return call_fields(rows, call, cases, literals, default)


def aws_encryption(spark: SparkSession, a: Access, args: Mapping[str, str]) -> DataFrame:
    at = f"{RULE}.ApplyServerSideEncryptionByDefault"
    found = {"encryption_status": f"{at}.SSEAlgorithm", "algorithm": f"{at}.SSEAlgorithm", "kms_key_id": f"{at}.KMSMasterKeyID", "bucket_key_enabled": f"{RULE}.BucketKeyEnabled"}
    rows = bucket_detail(aws_buckets(spark, a, args), a, "encryption", {"200": found}, {"404": {"encryption_status": "none"}}, {"encryption_status": "error"})
    nested = F.when(F.coalesce("algorithm", "kms_key_id", "bucket_key_enabled").isNotNull(), F.struct("algorithm", "bucket_key_enabled", "kms_key_id"))
    return rows.withColumn("encryption", nested).drop("algorithm", "kms_key_id", "bucket_key_enabled")


def aws_stores(spark: SparkSession, a: Access, args: Mapping[str, str]) -> DataFrame:
    rows = aws_encryption(spark, a, args).drop("encryption")
    rows = bucket_detail(rows, a, "versioning", {"200": {"versioning": "VersioningConfiguration.Status"}})
    rows = bucket_detail(rows, a, "logging", {"200": {"access_log_target": "BucketLoggingStatus.LoggingEnabled.TargetBucket"}})
    rows = bucket_detail(rows, a, "publicAccessBlock", {"200": {"public": "PublicAccessBlockConfiguration.RestrictPublicBuckets"}}, {"404": {"public": "open"}})
    return stores(rows, "aws")


def stores(rows: DataFrame, provider: str) -> DataFrame:
    return classify.conform(classify.normalise_stores(const_columns(rows, {"provider": provider})), classify.STORE_SCHEMA)


def principals(rows: DataFrame, provider: str) -> DataFrame:
    return classify.conform(classify.normalise_principals(const_columns(rows, {"provider": provider})), classify.PRINCIPAL_SCHEMA)


def azure_stores(spark: SparkSession, a: Access, args: Mapping[str, str]) -> DataFrame:
    rows = azure_list(azure_rows(spark, a), a, "/subscriptions", SUBSCRIPTIONS, {"subscription_id": "subscriptionId"})
    account = {"name": "name", "account_id": "id", "encryption_status": "properties.encryption.keySource", "public": "properties.allowBlobPublicAccess", "https": "properties.supportsHttpsTrafficOnly"}
    rows = azure_list(rows, a, "/subscriptions/{subscription_id}/providers/Microsoft.Storage/storageAccounts", STORAGE, account, "inner")
    rows = azure_list(rows, a, "{account_id}/blobServices/default/providers/Microsoft.Insights/diagnosticSettings", DIAGNOSTICS, {"access_log_target": "properties.storageAccountId"})
    rows = azure_list(rows, a, "{account_id}/blobServices/default/containers", STORAGE, {"container": "name", "container_public": "properties.publicAccess"})
    return stores(rows, "azure")


def azure_subnets(spark: SparkSession, a: Access, args: Mapping[str, str]) -> DataFrame:
    rows = azure_list(azure_rows(spark, a), a, "/subscriptions", SUBSCRIPTIONS, {"subscription_id": "subscriptionId"})
    rows = azure_list(rows, a, "/subscriptions/{subscription_id}/providers/Microsoft.Network/virtualNetworks", NETWORKS, {"vnet_id": "id", "vnet_name": "name"})
    return azure_list(rows, a, "{vnet_id}/subnets", NETWORKS, {"subnet_id": "id", "subnet_name": "name", "address_prefix": "properties.addressPrefix"})


def google_projects(spark: SparkSession, a: Access, args: Mapping[str, str]) -> DataFrame:
    """(token, project): the one given, or all below an organisation, whose folders are descended to."""
    rows = google_rows(spark, a)
    if args.get("google_project"):
        return rows.withColumn("project", F.lit(args["google_project"]))
    base = f"{a.endpoints.url('gcp.resourcemanager')}/v3"
    folders = a.call(f"{base}/folders", query={"parent": "{node}"}, headers=BEARER, continuation=PAGES)
    top = rows.withColumn("node", F.lit(f"organizations/{args['google_org']}")).select("token", "node")
    tree = fixpoint(top, lambda frontier: call_items(frontier.withColumnRenamed("node", "parent"), replace(folders, query={"parent": "{parent}"}), "folders", {"node": "name"}, "inner"), ["node"], max_iterations(64))
    return call_items(tree.rows, a.call(f"{base}/projects", query={"parent": "{node}"}, headers=BEARER, continuation=PAGES), "projects", {"project": "projectId"}, "inner").drop("node")


def google_stores(spark: SparkSession, a: Access, args: Mapping[str, str]) -> DataFrame:
    bucket = {"name": "name", "encryption_status": "encryption.defaultKmsKeyName", "public": "iamConfiguration.publicAccessPrevention", "versioning": "versioning.enabled", "access_log_target": "logging.logBucket"}
    call = a.call(f"{a.endpoints.url('gcp.storage')}/storage/v1/b", query={"project": "{project}"}, headers=BEARER, continuation=PAGES)
    return stores(call_items(google_projects(spark, a, args), call, "items", bucket, "inner"), "gcp")


def google_principals(spark: SparkSession, a: Access, args: Mapping[str, str]) -> DataFrame:
    call = a.call(f"{a.endpoints.url('gcp.resourcemanager')}/v3/projects/{{project}}:getIamPolicy", method="POST", body={}, headers=BEARER)
    return principals(call_bindings(google_projects(spark, a, args), call), "gcp")


def call_bindings(rows: DataFrame, call: Call) -> DataFrame:
    """A row for each member of each binding of a policy."""

    def expand(got):
        members = [(b.get("role"), m) for r in got for b in (decode_json(r.raw) or {}).get("bindings") or [] if isinstance(b, dict) for m in b.get("members") or [] if isinstance(m, str)]
        return [(role, m, *(m.split(":", 1) if ":" in m else ("unknown", m))) for role, m in members]

    found = mapped_calls(rows, replace(call, require_ok=True), {}, ("grant", "principal_id", "kind", "principal"), expand, "inner")
    return found.withColumn("principal_type", classify.principal_kind(F.col("kind"))).drop("kind")


def identity_list(rows: DataFrame, a: Access, region: str, action: str, items: str, columns: Mapping[str, str], how: str, **body: str) -> DataFrame:
    """A list of the identity service: a signed form, paged by a marker in the body."""
    pages = Continuation("paginate", f"{action}Response.{action}Result.Marker", "Marker", "body", media="application/xml")
    call = a.call(a.endpoints.url("aws.iam") + "/", method="POST", body={"Action": action, "Version": IDENTITY_VERSION, **body}, media="application/x-www-form-urlencoded", continuation=pages, sign=a.signer("iam", region))
    return call_items(rows, call, f"{action}Response.{action}Result.{items}.member", columns, how)


def aws_principals(spark: SparkSession, a: Access, args: Mapping[str, str], access: bool = False) -> DataFrame:
    region = args["region"]
    user = {"principal": "UserName", "principal_id": "UserId", "created": "CreateDate", "arn": "Arn"}
    rows = identity_list(seed(spark), a, region, "ListUsers", "Users", user, "inner")
    if access:
        rows = identity_list(rows, a, region, "ListAttachedUserPolicies", "AttachedPolicies", {"grant": "PolicyName"}, "left", UserName="{principal}")
        rows = identity_list(rows, a, region, "ListMFADevices", "MFADevices", {"mfa_serial": "SerialNumber"}, "left", UserName="{principal}")
        rows = const_columns(rows, {"mfa_checked": "true"})
    return principals(const_columns(rows, {"principal_type": "user"}), "aws")


def entra_identities(spark: SparkSession, a: Access, args: Mapping[str, str], access: bool = False) -> DataFrame:
    base = f"{a.endpoints.url('azure.graph')}/v1.0/users"
    users = a.call(base, query={"$select": "id,userPrincipalName,displayName,accountEnabled,createdDateTime"}, headers=BEARER, continuation=GRAPH)
    user = {"principal": "userPrincipalName", "principal_id": "id", "enabled": "accountEnabled", "created": "createdDateTime"}
    rows = call_items(azure_rows(spark, a, GRAPH_SCOPE), users, "value", user, "inner")
    if access:
        rows = call_items(rows, a.call(base + "/{principal_id}/memberOf", headers=BEARER, continuation=GRAPH), "value", {"grant": "displayName"}, "left")
        rows = rows.withColumn("scope", F.lit(a.azure_tenant))
    return principals(const_columns(rows, {"principal_type": "user"}), "entra")


#: Methods by address; the composites of the catalog follow from them.
LIVE = {
    "aws.s3.buckets.list": aws_stores,
    "aws.s3.buckets.enumerate": aws_buckets,
    "aws.s3.buckets.encryption": aws_encryption,
    "google.storage.buckets.list": google_stores,
    "gcp.iam.principals.list": google_principals,
    "azure.storage.containers.list": azure_stores,
    "azure.network.subnets.list": azure_subnets,
    "aws.iam.principals.list": aws_principals,
    "aws.iam.principals.access": lambda s, a, g: aws_principals(s, a, g, True),
    "entra.identities.list": entra_identities,
    "entra.identities.access": lambda s, a, g: entra_identities(s, a, g, True),
}
