"""One meaning across providers: column expressions that turn raw signals of each provider into comparable ones.

Unknown is null, never false.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

STORE_SCHEMA = StructType(
    [StructField("provider", StringType(), False), StructField("name", StringType()), StructField("encryption_status", StringType()), StructField("encryption_class", StringType())]
    + [StructField(c, BooleanType()) for c in ("public", "versioning", "https", "access_logging")]
    + [StructField("access_log_target", StringType())]
)
PRINCIPAL_SCHEMA = StructType(
    [StructField(c, StringType(), False) for c in ("provider", "principal_type", "principal", "principal_id")]
    + [StructField("scope", StringType()), StructField("enabled", BooleanType()), StructField("grant", StringType()), StructField("mfa", BooleanType()), StructField("created", StringType())]
)


def text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def truthy(c: Column) -> Column:
    """True for true and the word true in any case."""
    return F.lower(text(c)) == "true"


def key_class(provider: Column, status: Column) -> Column:
    """Who holds the encryption key."""
    s = text(status)
    return (
        F.when((provider == "aws") & s.isin("", "none", "AES256"), "provider-managed")
        .when((provider == "aws") & s.startswith("aws:kms"), "customer-managed")
        .when((provider == "azure") & (s == "Microsoft.Storage"), "provider-managed")
        .when((provider == "azure") & (s == "Microsoft.Keyvault"), "customer-managed")
        .when(provider == "gcp", F.when(s == "", "provider-managed").otherwise("customer-managed"))
        .otherwise("unknown")
    )


def is_public(provider: Column, signal: Column) -> Column:
    """Reachable by anyone: two providers state the opposite, one states it and may leave it open."""
    return F.when(provider == "aws", text(signal) != "true").when(provider == "azure", F.when(signal.isNotNull(), truthy(signal))).when(provider == "gcp", text(signal) != "enforced")


def has_versioning(provider: Column, signal: Column) -> Column:
    return F.when(provider == "aws", text(signal) == "Enabled").when(provider == "gcp", truthy(signal))


def only_https(provider: Column, signal: Column) -> Column:
    return F.when(provider == "azure", F.when(signal.isNotNull(), truthy(signal))).when(provider == "gcp", F.lit(True))


def has_logging(provider: Column, target: Column) -> Column:
    return F.when(provider.isin("aws", "azure", "gcp"), text(target) != "")


def _col(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def normalise_stores(df: DataFrame) -> DataFrame:
    """Rows of any provider with the classified columns; all of them null where the scope holds no store."""
    provider, container, open_to = F.col("provider"), text(_col(df, "container")), text(_col(df, "container_public"))
    azure = provider == "azure"
    name = F.when(azure, F.when(container != "", F.concat(text(_col(df, "name")), F.lit("/"), container))).otherwise(_col(df, "name"))
    public = F.when(azure & (container != "") & (open_to != ""), (F.lower(open_to) != "none").cast("string")).otherwise(_col(df, "public").cast("string"))
    held = name.isNotNull()
    return df.withColumns({
        "name": name,
        "encryption_status": _col(df, "encryption_status"),
        "encryption_class": F.when(held, key_class(provider, _col(df, "encryption_status"))),
        "public": F.when(held, is_public(provider, public)),
        "versioning": F.when(held, has_versioning(provider, _col(df, "versioning"))),
        "https": F.when(held, only_https(provider, _col(df, "https"))),
        "access_logging": F.when(held, has_logging(provider, _col(df, "access_log_target"))),
        "access_log_target": F.when(held, _col(df, "access_log_target")),
    })


def principal_kind(prefix: Column) -> Column:
    """Kind of a member by its prefix; of one without a prefix, unknown."""
    return F.when(prefix == "serviceAccount", "service_principal").when(prefix == "", "unknown").otherwise(prefix)


def normalise_principals(df: DataFrame) -> DataFrame:
    """All principal columns, absent ones null; scope from the fifth part of an ARN, else from the project."""
    arn, project = text(_col(df, "arn")), text(_col(df, "project"))
    parts = F.split(arn, ":")
    derived = F.when(arn != "", F.when(F.size(parts) > 4, F.get(parts, F.lit(4)))).when(project != "", project)
    enabled = _col(df, "enabled")
    enabled = enabled if dict(df.dtypes).get("enabled") == "boolean" else F.when(enabled.isNotNull(), enabled == "true")
    mfa = F.when(truthy(_col(df, "mfa_checked")), text(_col(df, "mfa_serial")) != "").otherwise(_col(df, "mfa").cast("boolean"))
    fixed = {"scope": F.coalesce(_col(df, "scope"), derived), "enabled": enabled, "mfa": mfa}
    return df.withColumns(fixed | {f.name: F.lit(None).cast(f.dataType) for f in PRINCIPAL_SCHEMA if f.name not in df.columns and f.name not in fixed})


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """Exactly the columns of a schema, in order; absent ones null."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def word_count(line: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(line, F.lit("")), r"\s+"), lambda w: w != "")).cast("long")


def resource_name(label: Column) -> Column:
    """Lower case, with anything but letters and digits replaced by '-'."""
    return F.regexp_replace(F.lower(label), "[^a-z0-9]", "-")


# What is blanked in logs, and by what.
SECRET_FIELD = r'(?i)("[a-z0-9_]*(?:secret|token|password|assertion|credential|private_key)[a-z0-9_]*"\s*:\s*)"[^"]*"'
ASSERTION = r'assertion=[^&\s"]+'
BEARER = r"Bearer [A-Za-z0-9._\-]+"
BLANK = "«redacted»"


def redact(line: Column) -> Column:
    line = F.regexp_replace(line, SECRET_FIELD, f'$1"{BLANK}"')
    return F.regexp_replace(F.regexp_replace(line, ASSERTION, f"assertion={BLANK}"), BEARER, f"Bearer {BLANK}")


def redact_text(line: str) -> str:
    """Like redact, for a text."""
    line = re.sub(SECRET_FIELD, lambda m: f'{m[1]}"{BLANK}"', line)
    return re.sub(BEARER, f"Bearer {BLANK}", re.sub(ASSERTION, f"assertion={BLANK}", line))
