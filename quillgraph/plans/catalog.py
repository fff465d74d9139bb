"""Resources and methods by dotted address: discovery, validation, composites, and runs over any source of responses.

A method's legs read tables by name from a `Tables` provider of recorded responses, or, given an `Access`, make the calls themselves.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quillgraph.functions import classify
from quillgraph.operators.combine import budget, merge
from quillgraph.operators.fixpoint import descend, max_iterations
from quillgraph.operators.joins import bind_flatten, inner_flatten
from quillgraph.operators.project import const_columns, echo_inputs
from quillgraph.operators.unnest import member_rows
from quillgraph.plans.graph import FormClass, PlanError
from quillgraph.plans.live import LIVE, Access

#: table(name) gives the rows of one kind of response.
Tables = Callable[[str], DataFrame]


@dataclass(frozen=True)
class Param:
    name: str
    required: bool = False
    description: str = ""


@dataclass(frozen=True)
class Resource:
    path: str
    summary: str
    schema: StructType


@dataclass(frozen=True)
class Method:
    path: str
    resource: str
    summary: str
    schema: StructType
    params: Sequence[Param] = ()
    exactly_one: Sequence[Sequence[str]] = ()
    build: Callable[[SparkSession, Tables, Mapping[str, str]], DataFrame] | None = None
    members: Sequence[str] = ()
    form: FormClass = FormClass.READ
    live: Callable[[SparkSession, Access, Mapping[str, str]], DataFrame] | None = None  # by calls; those of the catalog are in plans/live.py

    def published(self) -> StructType:
        """The schema with the inputs as columns: required ones not null, marked as inputs."""
        extra = [StructField(p.name, StringType(), not p.required, {"input": True}) for p in self.params if p.name not in self.schema.names]
        return StructType([*self.schema.fields, *extra])


def _strings(*names: str) -> StructType:
    return StructType([StructField(n, StringType()) for n in names])


BUCKETS = _strings("name", "created", "arn", "region")
SUBNETS = _strings("subscription_id", "vnet_name", "vnet_id", "subnet_name", "subnet_id", "address_prefix")
NETWORKS = _strings("vpc_id", "subnet_id")
GCP_NETWORKS = _strings("network", "subnetwork")


def aws_stores(spark: SparkSession, t: Tables, args: Mapping[str, str]) -> DataFrame:
    rows = t("aws.buckets").select("name")
    for detail in ("encryption", "versioning", "logging", "public_access"):
        rows = bind_flatten(rows, t(f"aws.{detail}"), {"name": "name"}, keys=False)
    return classify.conform(classify.normalise_stores(const_columns(rows, {"provider": "aws"})), classify.STORE_SCHEMA)


def aws_encryption(spark: SparkSession, t: Tables, args: Mapping[str, str]) -> DataFrame:
    return bind_flatten(t("aws.buckets"), t("aws.encryption_detail"), {"name": "name"}, keys=False)


def azure_stores(spark: SparkSession, t: Tables, args: Mapping[str, str]) -> DataFrame:
    rows = inner_flatten(t("azure.subscriptions"), t("azure.accounts"), {"subscription_id": "subscription_id"}, keys=False)
    rows = bind_flatten(rows, t("azure.diagnostics"), {"account_id": "account_id"}, keys=False)
    rows = bind_flatten(rows, t("azure.containers"), {"account_id": "account_id"}, keys=False)
    return classify.conform(classify.normalise_stores(const_columns(rows, {"provider": "azure"})), classify.STORE_SCHEMA)


def azure_subnets(spark: SparkSession, t: Tables, args: Mapping[str, str]) -> DataFrame:
    rows = bind_flatten(t("azure.subscriptions"), t("azure.vnets"), {"subscription_id": "subscription_id"}, keys=False)
    return classify.conform(bind_flatten(rows, t("azure.subnets"), {"vnet_id": "vnet_id"}, keys=False), SUBNETS)


def gcp_projects(spark: SparkSession, t: Tables, args: Mapping[str, str]) -> DataFrame:
    """The one project given, or all projects below an organisation, by descent over its folders."""
    if args.get("google_project"):
        return spark.range(1).select(F.lit(args["google_project"]).alias("project"))
    top = spark.range(1).select(F.lit(f"organizations/{args['google_org']}").alias("node"))
    tree = descend(top, t("gcp.folders").select("parent", F.col("folder").alias("node")), ("parent", "node"), "node", policy=max_iterations(64))
    return inner_flatten(tree.rows, t("gcp.projects"), {"parent": "node"}, keys=False).select("project")


def gcp_stores(spark: SparkSession, t: Tables, args: Mapping[str, str]) -> DataFrame:
    rows = inner_flatten(gcp_projects(spark, t, args), t("gcp.buckets"), {"project": "project"}, keys=False)
    return classify.conform(classify.normalise_stores(const_columns(rows, {"provider": "gcp"})), classify.STORE_SCHEMA)


def aws_principals(spark: SparkSession, t: Tables, args: Mapping[str, str], access: bool = False) -> DataFrame:
    rows = const_columns(t("aws.users"), {"provider": "aws", "principal_type": "user"})
    if access:
        rows = bind_flatten(rows, t("aws.policies"), {"principal": "principal"}, keys=False)
        rows = const_columns(bind_flatten(rows, t("aws.mfa_devices"), {"principal": "principal"}, keys=False), {"mfa_checked": "true"})
    return classify.conform(classify.normalise_principals(rows), classify.PRINCIPAL_SCHEMA)


def entra_identities(spark: SparkSession, t: Tables, args: Mapping[str, str], access: bool = False) -> DataFrame:
    rows = const_columns(t("entra.users"), {"provider": "entra", "principal_type": "user"})
    if access:
        rows = bind_flatten(rows, t("entra.roles"), {"principal_id": "principal_id"}, keys=False)
        rows = rows.withColumn("scope", F.coalesce(F.col("scope") if "scope" in rows.columns else F.lit(None), F.lit(args.get("tenant")).cast("string")))
    return classify.conform(classify.normalise_principals(rows), classify.PRINCIPAL_SCHEMA)


def gcp_principals(spark: SparkSession, t: Tables, args: Mapping[str, str]) -> DataFrame:
    rows = inner_flatten(gcp_projects(spark, t, args), t("gcp.policies"), {"project": "project"}, keys=False)
    rows = member_rows(rows).select("project", F.lit("gcp").alias("provider"), classify.principal_kind(F.col("kind")).alias("principal_type"), F.col("name").alias("principal"), F.when(F.col("kind") == "unknown", F.col("name")).otherwise(F.concat("kind", F.lit(":"), "name")).alias("principal_id"), F.col("role").alias("grant"))
    return classify.conform(classify.normalise_principals(rows), classify.PRINCIPAL_SCHEMA)


def provisioned(kind: str, schema: StructType) -> Callable[[SparkSession, Tables, Mapping[str, str]], DataFrame]:
    """Results of creating calls, which a driver-side function has made and recorded (tasks may run twice, so they create nothing)."""
    return lambda spark, t, args: classify.conform(t(kind), schema)


REGION = Param("region", True, "region of the account")
GOOGLE = (Param("google_project", False, "one project (exclusive with google_org)"), Param("google_org", False, "all projects of an organisation (exclusive with google_project)"))
EITHER = (("google_project", "google_org"),)
STORES, PRINCIPALS = classify.STORE_SCHEMA, classify.PRINCIPAL_SCHEMA


def _resources() -> list[Resource]:
    return [
        Resource("aws.s3.buckets", "object stores of an account", STORES),
        Resource("google.storage.buckets", "object stores of a project or an organisation", STORES),
        Resource("azure.storage.containers", "containers of all accounts of all subscriptions", STORES),
        Resource("aws.iam.principals", "users of an account", PRINCIPALS),
        Resource("gcp.iam.principals", "members with a role in a project or an organisation", PRINCIPALS),
        Resource("entra.identities", "users of a directory", PRINCIPALS),
        Resource("all.iam.principals", "principals of every identity source", PRINCIPALS),
        Resource("all.storage.buckets", "object stores of every provider", STORES),
        Resource("aws.ec2.networks", "networks", NETWORKS),
        Resource("gcp.compute.networks", "networks", GCP_NETWORKS),
        Resource("azure.network.subnets", "subnets of virtual networks", SUBNETS),
    ]


def _methods() -> list[Method]:
    return [
        Method("aws.s3.buckets.list", "aws.s3.buckets", "stores with their settings", STORES, (REGION,), build=aws_stores),
        Method("aws.s3.buckets.enumerate", "aws.s3.buckets", "stores by name", BUCKETS, (REGION,), build=lambda s, t, a: classify.conform(t("aws.buckets"), BUCKETS)),
        Method("aws.s3.buckets.encryption", "aws.s3.buckets", "stores with their encryption", BUCKETS, (REGION,), build=aws_encryption),
        Method("aws.ec2.networks.provision", "aws.ec2.networks", "create a network and a subnet", NETWORKS, (REGION, Param("vpc_cidr", True), Param("subnet_cidr", True)), build=provisioned("aws.networks", NETWORKS), form=FormClass.CREATE),
        Method("google.storage.buckets.list", "google.storage.buckets", "stores with their settings", STORES, GOOGLE, EITHER, gcp_stores),
        Method("gcp.compute.networks.provision", "gcp.compute.networks", "create a network and a subnetwork", GCP_NETWORKS, (Param("project", True), Param("region")), build=provisioned("gcp.networks", GCP_NETWORKS), form=FormClass.CREATE),
        Method("gcp.iam.principals.list", "gcp.iam.principals", "members with their roles", PRINCIPALS, GOOGLE, EITHER, gcp_principals),
        Method("azure.storage.containers.list", "azure.storage.containers", "containers with their settings", STORES, build=azure_stores),
        Method("azure.network.subnets.list", "azure.network.subnets", "subnets", SUBNETS, build=azure_subnets),
        Method("aws.iam.principals.list", "aws.iam.principals", "users", PRINCIPALS, (REGION,), build=aws_principals),
        Method("aws.iam.principals.access", "aws.iam.principals", "users with policies and second factors", PRINCIPALS, (REGION,), build=lambda s, t, a: aws_principals(s, t, a, True)),
        Method("entra.identities.list", "entra.identities", "users", PRINCIPALS, build=entra_identities),
        Method("entra.identities.access", "entra.identities", "users with roles", PRINCIPALS, build=lambda s, t, a: entra_identities(s, t, a, True)),
        Method("all.storage.buckets.list", "all.storage.buckets", "stores of every provider", STORES, (REGION, *GOOGLE), EITHER, members=("aws.s3.buckets.list", "azure.storage.containers.list", "google.storage.buckets.list")),
        Method("all.iam.principals.list", "all.iam.principals", "principals of every source", PRINCIPALS, (REGION, *GOOGLE), EITHER, members=("aws.iam.principals.list", "entra.identities.list", "gcp.iam.principals.list")),
        Method("all.iam.principals.access", "all.iam.principals", "principals of every source with grants", PRINCIPALS, (REGION, *GOOGLE), EITHER, members=("aws.iam.principals.access", "entra.identities.access", "gcp.iam.principals.list")),
    ]


@dataclass
class Catalog:
    """Addresses, and how to run them. Further resources and methods may be added."""

    resource_map: dict[str, Resource] = field(default_factory=lambda: {r.path: r for r in _resources()})
    method_map: dict[str, Method] = field(default_factory=lambda: {m.path: m for m in _methods()})

    def resources(self, pattern: str = "") -> list[Resource]:
        return [self.resource_map[p] for p in sorted(self.resource_map) if re.search(pattern, p)]

    def methods(self, resource: str) -> list[Method]:
        return [self.method_map[p] for p in sorted(self.method_map) if self.method_map[p].resource == resource]

    def resource(self, path: str) -> Resource:
        if path not in self.resource_map:
            raise PlanError(f"no resource {path!r}")
        return self.resource_map[path]

    def method(self, path: str) -> Method:
        if path not in self.method_map:
            raise PlanError(f"no method {path!r}")
        return self.method_map[path]

    def listing(self, spark: SparkSession) -> DataFrame:
        rows = [(m.path, m.resource, m.summary, [p.name for p in m.params if p.required], list(m.published().names)) for _, m in sorted(self.method_map.items())]
        return spark.createDataFrame(rows, "path string, resource string, summary string, required array<string>, columns array<string>")

    def check(self, method: Method, args: Mapping[str, str]) -> None:
        if missing := [p.name for p in method.params if p.required and not args.get(p.name)]:
            raise PlanError(f"{method.path} needs {', '.join(missing)}")
        for group in method.exactly_one:
            if sum(bool(args.get(g)) for g in group) != 1:
                raise PlanError(f"{method.path} needs exactly one of {', '.join(group)}")

    def _legs(self, spark: SparkSession, path: str, tables: Tables | Access, args: Mapping[str, str], above: tuple[str, ...] = ()) -> list[DataFrame]:
        if path in above:
            raise PlanError(f"composites contain each other: {' → '.join([*above, path])}")
        method = self.method(path)
        self.check(method, args)
        if not method.members:
            return [self._leg(spark, method, tables, args)]
        own = {p.name: args[p.name] for p in method.params if args.get(p.name)}
        return [leg for m in method.members for leg in self._legs(spark, m, tables, own, (*above, path))]

    def _leg(self, spark: SparkSession, method: Method, tables: Tables | Access, args: Mapping[str, str]) -> DataFrame:
        if not isinstance(tables, Access):
            return method.build(spark, tables, args)
        live = method.live or LIVE.get(method.path)
        if live is None:
            raise PlanError(f"{method.path} is not made of reading calls; its results are recorded by the driver")
        rows = live(spark, tables, args)
        return classify.conform(rows, method.schema) if set(method.schema.names) <= set(rows.columns) and method.path != "aws.s3.buckets.encryption" else rows

    def new(self, spark: SparkSession, path: str, tables: Tables | Access, args: Mapping[str, Any] | None = None, limit: int | None = None) -> DataFrame:
        """Rows of a method: all legs, one budget, then the inputs as columns."""
        args = {k: str(v) for k, v in (args or {}).items() if v is not None}
        rows = budget(merge(self._legs(spark, path, tables, args)), limit)
        return echo_inputs(rows, {p.name: args.get(p.name) for p in self.method(path).params})

    def new_merged(self, spark: SparkSession, paths: Sequence[str], tables: Tables | Access, args: Mapping[str, Any] | None = None, limit: int | None = None) -> DataFrame:
        """The named methods as one run, under one budget, with the inputs of all of them."""
        args = {k: str(v) for k, v in (args or {}).items() if v is not None}
        rows = budget(merge([leg for p in paths for leg in self._legs(spark, p, tables, args)]), limit)
        names = dict.fromkeys(p.name for path in paths for p in self.method(path).params)
        return echo_inputs(rows, {n: args.get(n) for n in names})


def recorded(spark: SparkSession, folder: str) -> Tables:
    """Tables from JSON lines files <name>.jsonl of a folder that Spark can read."""
    return lambda name: spark.read.json(f"{folder}/{name}.jsonl")
