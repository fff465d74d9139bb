"""Addresses of services, with overrides, and the helpers that take addresses apart."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from urllib.parse import quote, urlsplit, urlunsplit

# Address templates of the services.
SERVICES = {
    "aws.s3": "https://s3.{region}.amazonaws.com",
    "aws.ec2": "https://ec2.{region}.amazonaws.com",
    "aws.iam": "https://iam.amazonaws.com",
    "azure.management": "https://management.azure.com",
    "azure.login": "https://login.microsoftonline.com",
    "azure.graph": "https://graph.microsoft.com",
    "gcp.storage": "https://storage.googleapis.com",
    "gcp.compute": "https://compute.googleapis.com",
    "gcp.resourcemanager": "https://cloudresourcemanager.googleapis.com",
    "gcp.token": "https://oauth2.googleapis.com",
}


@dataclass(frozen=True)
class Endpoints:
    """`override` is one address for every service, or a mapping from service to an address, or to parts (scheme, host, port, path)."""

    override: str | Mapping[str, str | Mapping[str, str]] | None = None
    services: Mapping[str, str] = field(default_factory=lambda: SERVICES)

    def __post_init__(self) -> None:
        if isinstance(self.override, Mapping) and (unknown := sorted(set(self.override) - set(self.services))):
            raise ValueError(f"unknown services: {', '.join(unknown)}")

    def overridden(self, service: str) -> bool:
        """Whether the service has another address than its usual one."""
        return isinstance(self.override, str) or bool(self.override) and service in self.override

    def url(self, service: str, **values: str) -> str:
        if service not in self.services:
            raise ValueError(f"unknown service {service!r}; known: {', '.join(sorted(self.services))}")
        usual = re.sub(r"\{(\w+)\}", lambda m: values.get(m[1], ""), self.services[service])
        if self.override is None:
            return usual
        if isinstance(self.override, str):
            return self.override.rstrip("/")
        own = self.override.get(service)
        if own is None or isinstance(own, str):
            return (own or usual).rstrip("/")
        at = urlsplit(usual)
        host = own.get("host", at.hostname or "")
        port = own.get("port", at.port)
        return urlunsplit((own.get("scheme", at.scheme), f"{host}:{port}" if port else host, own.get("path", at.path), "", "")).rstrip("/")


def retarget(url: str, base: str) -> str:
    """The same path and query at another base address."""
    at, to = urlsplit(url), urlsplit(base)
    return urlunsplit((to.scheme, to.netloc, to.path.rstrip("/") + at.path, at.query, ""))


def bucket_url(base: str, bucket: str, path_style: bool) -> str:
    """A bucket's address: as a path below the service's, or as a host of its own."""
    at = urlsplit(base)
    return f"{base.rstrip('/')}/{bucket}" if path_style else urlunsplit((at.scheme, f"{bucket}.{at.netloc}", at.path, "", ""))


def placeholders(template: str) -> list[str]:
    return re.findall(r"\{([^{}]+)\}", template)


def service_of(host: str) -> str:
    """First label of a host name."""
    return host.split(":")[0].split(".")[0]


def uri_encode(text: str, slash: bool = True) -> str:
    """Percent-encoding of all but the unreserved characters (and '/' unless `slash`)."""
    return quote(text, safe="-_.~" if slash else "-_.~/")
