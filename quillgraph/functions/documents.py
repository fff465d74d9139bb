"""Values inside JSON and XML documents: column expressions, and the same rules in Python for code that runs in readers."""

from __future__ import annotations

import json
import re
from itertools import product
from typing import Any
from xml.etree import ElementTree

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType


def json_document(raw: Column) -> Column:
    """A variant; empty text gives null, malformed text is an error."""
    return F.parse_json(F.when(F.length(raw) > 0, raw))


def xml_document(raw: Column, schema: StructType | str) -> Column:
    """A struct by an explicit schema: elements declared as arrays are arrays however often they occur. Empty text gives null."""
    ddl = schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return F.from_xml(F.when(F.length(raw) > 0, raw), ddl, {"mode": "FAILFAST"})


def path_text(document: Column, path: str) -> Column:
    """Text at a dotted path of a variant; a list is descended at its first element; '' where nothing is found."""
    steps = path.split(".")
    tries = []
    for firsts in product(("[0]", ""), repeat=len(steps)):
        full = "$" + "".join(f"['{s}']{f}" for s, f in zip(steps, firsts, strict=True))
        tries.append(F.try_variant_get(document, full, "string"))
    return F.coalesce(*tries, F.lit(""))


def path_value(document: Column, path: str, kind: str | DataType = "string") -> Column:
    """Value at a dotted path with its type kept; null where it is absent."""
    kind = kind if isinstance(kind, str) else kind.simpleString()
    return F.try_variant_get(document, "$" + "".join(f"['{s}']" for s in path.split(".")), kind)


def is_list(document: Column) -> Column:
    return F.schema_of_variant(document).startswith("ARRAY")


def rows_at(document: Column, path: str) -> Column:
    """The list of row documents at a dotted path ('' is the document): a list as it is, an object as one row, anything else none."""
    at = path_value(document, path, "variant") if path else document
    listed = F.try_variant_get(at, "$", "array<variant>")
    single = F.when(F.schema_of_variant(at).startswith("OBJECT"), F.array(at))
    return F.coalesce(F.when(is_list(at), listed), single, F.array().cast("array<variant>"))


def parse_item_path(text: str) -> list[str]:
    """Steps of `$.a.b` or `/*/a/b`; '*' stands for the only key of an object."""
    if text in ("", "$", "/"):
        return []
    if text.startswith("$."):
        return text[2:].split(".")
    if text.startswith("/"):
        return [s for s in text.split("/") if s]
    raise ValueError(f"not an item path: {text!r}")


def items_at(document: Any, path: str) -> list[dict]:
    """Row objects at an item path of a decoded document: lists give their objects, an object itself, anything else nothing."""
    for step in parse_item_path(path):
        if not isinstance(document, dict):
            return []
        if step == "*":
            if len(document) != 1:
                return []
            document = next(iter(document.values()))
        else:
            document = document.get(step)
    if isinstance(document, dict):
        return [document]
    return [x for x in document if isinstance(x, dict)] if isinstance(document, list) else []


def text_at(document: Any, path: str) -> str:
    """Like path_text, for a decoded document."""
    for step in path.split("."):
        if isinstance(document, list):
            document = document[0] if document else None
        if not isinstance(document, dict) or step not in document:
            return ""
        document = document[step]
    if isinstance(document, list):
        document = document[0] if document else None
    if document is None:
        return ""
    if isinstance(document, bool):
        return "true" if document else "false"
    if isinstance(document, float) and document.is_integer() and abs(document) < 1e21:
        return str(int(document))
    return document if isinstance(document, str) else json.dumps(document) if isinstance(document, dict | list) else str(document)


def put_at(row: dict, path: str, value: Any) -> None:
    """Set a dotted key, building nested objects."""
    *parents, last = path.split(".")
    for step in parents:
        row = row.setdefault(step, {})
    row[last] = value


def decode_xml(raw: bytes | str) -> Any:
    """Nested dicts of an XML text: repeated elements become lists, leaf elements text, namespaces are dropped, attributes get a '-'."""

    def value(node: ElementTree.Element) -> Any:
        out: dict[str, Any] = {f"-{k.rpartition('}')[2]}": v for k, v in node.attrib.items()}
        for child in node:
            name, inner = child.tag.rpartition("}")[2], value(child)
            if name in out:
                out[name] = [*(out[name] if isinstance(out[name], list) else [out[name]]), inner]
            else:
                out[name] = inner
        text = (node.text or "").strip()
        if not out:
            return text
        return out | ({"#text": text} if text else {})

    if not raw:
        return None
    root = ElementTree.fromstring(raw)
    return {root.tag.rpartition("}")[2]: value(root)}


def decode_json(raw: bytes | str) -> Any:
    return json.loads(raw) if raw else None


def decoder(media_type: str):
    """The decoder of a media type; an unknown one is an error."""
    kind = media_type.split(";")[0].strip().lower()
    if re.search(r"(^|[/+])json$|x-amz-json", kind):
        return decode_json
    if re.search(r"(^|[/+])xml$", kind):
        return decode_xml
    raise ValueError(f"no decoder for media type {media_type!r}")
