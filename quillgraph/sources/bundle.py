"""Provider documents: a folder of YAML as addressable exchanges. Files are parsed when asked for and not kept."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from typing import Any
from urllib.parse import urljoin

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import documents, templates
from quillgraph.operators.project import echo_inputs
from quillgraph.plans.graph import PlanError
from quillgraph.sources.calls import Call, Continuation, read_call


def unescape(part: str) -> str:
    return part.replace("~1", "/").replace("~0", "~")


def resolve(root: Any, pointer: str) -> Any:
    """A JSON pointer of the form `#/a/b` into the same document."""
    for part in pointer.removeprefix("#").strip("/").split("/"):
        if not isinstance(root, Mapping) or unescape(part) not in root:
            raise PlanError(f"dangling reference {pointer!r}")
        root = root[unescape(part)]
    return root


def last_segment(pointer: str) -> str:
    return unescape(pointer.rsplit("/", 1)[-1])


@dataclass(frozen=True)
class Method:
    """A call as a document describes it."""

    address: str
    verb: str
    http: str
    path: str
    server: str
    params: Mapping[str, Mapping[str, Any]] = field(default_factory=dict)
    media: str = "application/json"
    request_media: str = "application/json"
    item_path: str = ""
    language: str = ""
    program: str = ""
    pagination: Mapping[str, Any] = field(default_factory=dict)

    @property
    def required(self) -> list[str]:
        return [n for n, p in self.params.items() if p.get("required")]


class Provider:
    """One version folder with a provider.yaml and its service documents."""

    def __init__(self, folder: str):
        self.folder = folder
        self.document = self._load(os.path.join(folder, "provider.yaml"))
        self.name = self.document.get("name") or os.path.basename(os.path.dirname(folder))
        self.services = {n: s.get("service", {}).get("$ref", "") for n, s in (self.document.get("providerServices") or {}).items()}

    @staticmethod
    def _load(path: str) -> dict:
        import yaml

        with open(path, encoding="utf-8") as f:
            return yaml.load(f, getattr(yaml, "CSafeLoader", yaml.SafeLoader)) or {}

    def service(self, name: str) -> dict:
        if name not in self.services:
            raise PlanError(f"{self.name} has no service {name!r}")
        path = os.path.join(self.folder, "services", os.path.basename(self.services[name]))
        if not os.path.exists(path):
            raise PlanError(f"no document for service {name!r}")
        return self._load(path)

    @staticmethod
    def resources(document: Mapping[str, Any]) -> Mapping[str, Any]:
        """The resource extension of a service document (`x-...-resources` below components)."""
        for holder in (document.get("components") or {}, document):
            for key, value in holder.items():
                if re.fullmatch(r"x-\w+-resources", key, re.I):
                    return value or {}
        return {}

    def methods(self, service: str, verb: str = "select") -> list[Method]:
        document = self.service(service)
        out = []
        for name, resource in self.resources(document).items():
            for ref in (resource.get("sqlVerbs") or {}).get(verb) or []:
                out.append(self._method(document, service, name, last_segment(ref["$ref"]), resolve(document, ref["$ref"]), verb))
        return sorted(out, key=lambda m: m.address)

    def _method(self, document: Mapping[str, Any], service: str, resource: str, name: str, method: Mapping[str, Any], verb: str) -> Method:
        pointer = method["operation"]["$ref"]
        operation = resolve(document, pointer)
        path, http = (unescape(p) for p in pointer.rsplit("/", 2)[-2:])
        response, request, config = method.get("response") or {}, method.get("request") or {}, method.get("config") or {}
        params = {}
        for p in [*(resolve(document, pointer.rsplit("/", 1)[0]).get("parameters") or []), *(operation.get("parameters") or [])]:
            p = resolve(document, p["$ref"]) if "$ref" in p else p
            params[p["name"]] = {"in": p.get("in", "query"), "required": bool(p.get("required"))}
        servers = operation.get("servers") or document.get("servers") or [{"url": ""}]
        for variable, how in (servers[0].get("variables") or {}).items():
            params.setdefault(variable, {"in": "server", "required": "default" not in how, "default": how.get("default", "")})
        program = response.get("transform") or {}
        return Method(f"{self.name}.{service}.{resource}.{name}", verb, http.upper(), path, servers[0].get("url", ""), params, response.get("overrideMediaType") or response.get("mediaType") or "application/json", request.get("mediaType") or "application/json", response.get("objectKey") or "", program.get("type", ""), program.get("body", ""), config.get("pagination") or {})


class Bundle:
    """Providers of a registry folder (<provider>/<version>/provider.yaml, newest version) or of one version folder."""

    def __init__(self, folder: str):
        self.folders: dict[str, str] = {}
        if os.path.exists(os.path.join(folder, "provider.yaml")):
            self.folders[Provider(folder).name] = folder
        else:
            for entry in sorted(os.listdir(folder)):
                versions = [v for v in sorted(os.listdir(os.path.join(folder, entry))) if os.path.exists(os.path.join(folder, entry, v, "provider.yaml"))] if os.path.isdir(os.path.join(folder, entry)) else []
                if versions:
                    newest = os.path.join(folder, entry, versions[-1])
                    self.folders[Provider(newest).name] = newest
        if not self.folders:
            raise PlanError(f"no providers below {folder}")

    def providers(self) -> list[str]:
        return sorted(self.folders)

    def provider_of(self, address: str) -> Provider:
        """The provider with the longest name that the address begins with."""
        fits = [n for n in self.folders if address == n or address.startswith(n + ".")]
        if not fits:
            raise PlanError(f"no provider for {address!r}; known: {', '.join(self.providers())}")
        return Provider(self.folders[max(fits, key=len)])

    def methods(self, address: str, verb: str = "select") -> list[Method]:
        """Methods of a provider, service or resource address, or one method's."""
        provider = self.provider_of(address)
        rest = address[len(provider.name) + 1 :].split(".") if address != provider.name else []
        found = [m for s in ([rest[0]] if rest else sorted(provider.services)) if rest or os.path.exists(os.path.join(provider.folder, "services", os.path.basename(provider.services[s]))) for m in provider.methods(s, verb)]
        return [m for m in found if m.address == address or m.address.startswith(address + ".")]

    def listing(self, spark: SparkSession, address: str, verb: str = "select") -> DataFrame:
        rows = [(m.address, m.verb, m.http, m.path, m.required, m.item_path) for m in self.methods(address, verb)]
        return spark.createDataFrame(rows, "address string, verb string, http string, path string, required array<string>, item_path string")


def choose(methods: list[Method], given: Mapping[str, str]) -> Method:
    """The method whose required parameters are all given and most; none and a tie are errors."""
    fits = [m for m in methods if all(given.get(p) for p in m.required)]
    if not fits:
        wanted = "; ".join(f"{m.address} needs {', '.join(m.required) or 'nothing'}" for m in methods)
        raise PlanError(f"no method fits the parameters: {wanted or 'there is none'}")
    most = max(len(m.required) for m in fits)
    best = [m for m in fits if len(m.required) == most]
    if len(best) > 1:
        raise PlanError(f"ambiguous: {', '.join(m.address for m in best)}")
    return best[0]


def compile_call(method: Method, given: Mapping[str, str], base: str | None = None, headers: Mapping[str, str] | None = None, paginate: bool = False) -> Call:
    """The request of a method: parameters in path, query, header and server; the rest in the body of a call that has one."""
    values = {n: p.get("default", "") for n, p in method.params.items()} | dict(given)
    server = base or re.sub(r"\{(\w+)\}", lambda m: str(values.get(m[1], "")), method.server)
    path = re.sub(r"\{(\w+)\}", lambda m: str(values.get(m[1], "")), method.path)
    place = lambda where: {n: str(values[n]) for n, p in method.params.items() if p["in"] == where and values.get(n)}
    body = {n: v for n, v in given.items() if n not in method.params} if method.http in ("POST", "PUT", "PATCH") else None
    continuation, pages = Continuation(), method.pagination
    if paginate and pages:
        token = pages["requestToken"]
        continuation = Continuation("paginate", pages["responseToken"]["key"].removeprefix("$."), token["key"], token.get("location", "query"), media=method.media)
    return Call(urljoin(server.rstrip("/") + "/", path.lstrip("/")), method.http, place("query"), {**place("header"), **(headers or {})}, body, method.request_media, continuation, require_ok=True)


def item_rows(responses: DataFrame, method: Method, schema: str) -> DataFrame:
    """Rows of a method's responses: program if there is one, then decoding, item list, and the columns of `schema`."""
    import json

    import pyarrow as pa
    from pyspark.sql.types import StructType

    decode = templates.default_registry().compile(method.language, method.program) if method.language else documents.decoder(method.media)

    def work(batches):
        for batch in batches:
            rows = [json.dumps(item) for raw in batch.column(0).to_pylist() for item in documents.items_at(decode(raw or ""), method.item_path)]
            yield pa.RecordBatch.from_pydict({"item": pa.array(rows, pa.string())})

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in StructType.fromDDL(schema))
    return responses.select("raw").mapInArrow(work, "item string").select(F.from_json("item", ddl).alias("r")).select("r.*")


def run(spark: SparkSession, folder: str, address: str, given: Mapping[str, str], schema: str, base: str | None = None, headers: Mapping[str, str] | None = None, paginate: bool = False, recorded: str | None = None) -> DataFrame:
    """Rows of an address: the method that fits the parameters, its calls, its program and items, and the parameters as columns."""
    method = choose(Bundle(folder).methods(address), given)
    call = replace(compile_call(method, given, base, headers, paginate), recorded=recorded)
    return echo_inputs(item_rows(read_call(spark, call), method, schema), {n: given.get(n) for n in method.params})
