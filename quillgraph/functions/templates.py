"""Programs embedded in provider documents, by their declared language.

Template text is not run as code. The one shape that documents use is understood: a list under some keys of the response, turned into
`line_items`. Any other program, and any other language, is refused when the plan is made.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from typing import Any

from quillgraph.functions import documents


def to_json(value: Any) -> str:
    """Compact JSON; '<', '>' and '&' stay as they are."""
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"), sort_keys=True)


def json_map(text: str) -> dict:
    value = json.loads(text) if text else {}
    if not isinstance(value, dict):
        raise ValueError("not a JSON object")
    return value


def plus1(value: Any) -> int:
    if isinstance(value, bool) or not isinstance(value, int | float):
        raise ValueError(f"not a number: {value!r}")
    return int(value) + 1


def kind_of(value: Any) -> str:
    for kind, types in (("bool", bool), ("string", str), ("map", dict), ("slice", list), ("int", int), ("float64", float)):
        if isinstance(value, types):
            return kind
    return "invalid" if value is None else type(value).__name__


def index(item: Any, *keys: Any) -> Any:
    """A value deep inside; None at the first miss."""
    for key in keys:
        if isinstance(item, dict):
            item = item.get(key)
        elif isinstance(item, list) and isinstance(key, int | float) and 0 <= int(key) < len(item):
            item = item[int(key)]
        else:
            return None
    return item


def separator(text: str) -> Callable[[], str]:
    """'' at the first call and the text from then on."""
    state = iter([""])
    return lambda: next(state, text)


class Registry:
    """Evaluators by language name: a compiler from program text to a function from the raw body to a document."""

    def __init__(self) -> None:
        self.known: dict[str, Callable[[str], Callable[[str], Any]]] = {}

    def register(self, language: str, compiler: Callable[[str], Callable[[str], Any]]) -> None:
        if language in self.known:
            raise ValueError(f"registered twice: {language}")
        self.known[language] = compiler

    def compile(self, language: str, program: str) -> Callable[[str], Any]:
        if language not in self.known:
            raise ValueError(f"unsupported language {language!r}; supported: {', '.join(sorted(self.known))}")
        return self.known[language](program)


_LIST = re.compile(r"\{\{-?\s*\$(\w+)\s*:=\s*(?:index|safeIndex)\s+\.\s*((?:\"[^\"]+\"\s*)+)-?\}\}")
_ITEM = re.compile(r"\{\s*\"(\w+)\"\s*:\s*\{\{-?\s*toJson\s+\$\w+\s*-?\}\}\s*\}")
_WHOLE = re.compile(r"\{\{-?\s*toJson\s+\$v\s*-?\}\}")
_RANGE = re.compile(r"\{\{-?\s*range\s+\$\w+\s*,\s*\$v\s*:=\s*\$(\w+)\s*-?\}\}")


def _listing(decode: Callable[[str], Any]) -> Callable[[str], Callable[[str], Any]]:
    def compiler(program: str) -> Callable[[str], Any]:
        paths = {name: re.findall(r'"([^"]+)"', keys) for name, keys in _LIST.findall(program)}
        ranged, wrapped = _RANGE.search(program), _ITEM.search(program)
        if '"line_items"' not in program or not ranged or ranged[1] not in paths or not (wrapped or _WHOLE.search(program)):
            raise ValueError("a program of an unknown shape")
        listed, column = paths[ranged[1]], wrapped[1] if wrapped else None
        passed = {keys[-1]: keys for name, keys in paths.items() if name != ranged[1] and f'"{keys[-1]}": {{{{ toJson ${name}' in program}

        def run(raw: str) -> Any:
            found = decode(raw)
            items = index(found, *listed)
            items = items if isinstance(items, list) else [items] if isinstance(items, dict) else []
            out = {"line_items": [{column: x} for x in items] if column else items}
            return out | {k: v for k, keys in passed.items() if (v := index(found, *keys))}

        return run

    return compiler


def default_registry() -> Registry:
    # The declared languages.
    languages = {
        "golang_template_text_v0.3.0": documents.decode_json,
        "golang_template_mxj_v0.2.0": documents.decode_xml,
        "golang_template_mxj_v0.3.0": documents.decode_xml,
        "golang_template_json_v0.1.0": documents.decode_json,
        "golang_template_json_v0.3.0": documents.decode_json,
    }
    out = Registry()
    for language, decode in languages.items():
        out.register(language, _listing(decode))
    return out
