"""Credentials for calls: static headers, token exchanges, and version 4 request signatures. Nothing here is logged or written."""

from __future__ import annotations

import hashlib
import hmac
import os
from collections.abc import Mapping
from dataclasses import dataclass
from datetime import UTC, datetime
from urllib.parse import parse_qsl, urlsplit

from quillgraph.sources.calls import Call
from quillgraph.sources.endpoints import uri_encode


@dataclass(frozen=True)
class Secret:
    """A value given as it is, by the name of an environment variable, or by the path of a file, tried in this order."""

    label: str
    literal: str = ""
    env: str = ""
    file: str = ""

    def resolve(self, required: bool = True) -> str:
        value = self.literal or (os.environ.get(self.env, "") if self.env else "")
        if not value and self.file and os.path.exists(self.file):
            with open(self.file, encoding="utf-8") as f:
                value = f.read().strip()
        if required and not value:
            raise ValueError(f"no value for {self.label}")
        return value


def static_headers(kind: str, secret: Secret | None = None, header: str = "Authorization", prefix: str = "") -> dict[str, str]:
    """Headers of the kinds null, bearer and api_key."""
    if kind == "null":
        return {}
    if secret is None:
        raise ValueError(f"auth kind {kind!r} needs a secret")
    if kind == "bearer":
        return {"Authorization": f"Bearer {secret.resolve()}"}
    if kind == "api_key":
        return {header: f"{prefix}{secret.resolve()}"}
    raise ValueError(f"unknown auth kind {kind!r}")


def client_credentials(token_url: str, client_id: Secret, client_secret: Secret, scope: str) -> Call:
    """The call that exchanges client credentials for a token (`access_token` of its JSON response)."""
    body = {"grant_type": "client_credentials", "client_id": client_id.resolve(), "client_secret": client_secret.resolve(), "scope": scope}
    return Call(token_url, "POST", body=body, media="application/x-www-form-urlencoded", require_ok=True)


def service_account(token_url: str, assertion: Secret) -> Call:
    """The call that exchanges a signed assertion for a token. Signing the assertion needs RSA, which is outside the standard library."""
    return Call(token_url, "POST", body={"grant_type": "urn:ietf:params:oauth:grant-type:jwt-bearer", "assertion": assertion.resolve()}, media="application/x-www-form-urlencoded", require_ok=True)


@dataclass(frozen=True)
class SignatureV4:
    """Signs requests as the published version 4 scheme asks."""

    region: str
    service: str
    key_id: str
    secret: str
    token: str = ""
    payload_header: bool = False

    def headers(self, method: str, url: str, headers: Mapping[str, str] | None = None, body: bytes = b"", now: datetime | None = None) -> dict[str, str]:
        if not self.key_id or not self.secret:
            raise ValueError("missing credentials")
        stamp = (now or datetime.now(UTC)).astimezone(UTC).strftime("%Y%m%dT%H%M%SZ")
        payload = hashlib.sha256(body).hexdigest()
        out = dict(headers or {}) | {"X-Amz-Date": stamp}
        if self.token:
            out["X-Amz-Security-Token"] = self.token
        if self.payload_header:
            out["X-Amz-Content-Sha256"] = payload
        at = urlsplit(url)
        signed = sorted({"host": at.netloc, **{k.lower(): v.strip() for k, v in out.items()}}.items())
        names = ";".join(k for k, _ in signed)
        query = "&".join(f"{uri_encode(k)}={uri_encode(v)}" for k, v in sorted(parse_qsl(at.query, keep_blank_values=True)))
        canonical = f"{method}\n{at.path or '/'}\n{query}\n{''.join(f'{k}:{v}\n' for k, v in signed)}\n{names}\n{payload}"
        scope = f"{stamp[:8]}/{self.region}/{self.service}/aws4_request"
        to_sign = f"AWS4-HMAC-SHA256\n{stamp}\n{scope}\n{hashlib.sha256(canonical.encode()).hexdigest()}"
        key = f"AWS4{self.secret}".encode()
        for part in scope.split("/"):
            key = hmac.digest(key, part.encode(), "sha256")
        signature = hmac.digest(key, to_sign.encode(), "sha256").hex()
        return out | {"Authorization": f"AWS4-HMAC-SHA256 Credential={self.key_id}/{scope}, SignedHeaders={names}, Signature={signature}"}
