"""JSONPath beyond what get_json_object knows: negative indices, slices, wildcards and recursive descent; no filters."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

from ..errors import InvalidArgumentError

_STEP = re.compile(r"\.\.(?P<deep>[A-Za-z_]\w*|\*)|\.(?P<key>[A-Za-z_]\w*|\*)|\[(?:'(?P<quoted>[^']*)'|\"(?P<double>[^\"]*)\"|(?P<star>\*)|(?P<slice>-?\d*:-?\d*(?::-?\d*)?)|(?P<index>-?\d+))\]")


def steps(path: str) -> list[tuple[str, Any]]:
    if not path.startswith("$"):
        raise InvalidArgumentError(f"a path begins with $: {path}")
    at, out = 1, []
    while at < len(path):
        m = _STEP.match(path, at)
        if not m:
            raise InvalidArgumentError(f"can't read {path[at:]} in {path}")
        kind = m.lastgroup
        value: Any = m[kind]
        if kind in ("quoted", "double"):
            kind = "name"
        elif kind == "key":
            kind = "star" if value == "*" else "name"
        elif kind == "index":
            value = int(value)
        elif kind == "slice":
            value = slice(*(int(x) if x else None for x in value.split(":")))
        out.append((kind, value))
        at = m.end()
    return out


def _children(node: Any) -> Iterator[Any]:
    yield from node.values() if isinstance(node, dict) else node if isinstance(node, list) else ()


def _walk(node: Any, todo: list[tuple[str, Any]]) -> Iterator[Any]:
    if not todo:
        yield node
        return
    (kind, value), rest = todo[0], todo[1:]
    if kind == "name":
        if isinstance(node, dict) and value in node:
            yield from _walk(node[value], rest)
    elif kind == "index":
        if isinstance(node, list) and -len(node) <= value < len(node):
            yield from _walk(node[value], rest)
    elif kind == "slice":
        for child in node[value] if isinstance(node, list) else ():
            yield from _walk(child, rest)
    elif kind == "star":
        for child in _children(node):
            yield from _walk(child, rest)
    else:  # deep
        here = [("star", "*")] if value == "*" else [("name", value)]
        yield from _walk(node, here + rest)
        for child in _children(node):
            yield from _walk(child, todo)


def first_match(text: str, path: str) -> str | None:
    """The first match as text: strings bare, everything else as JSON; null if none."""
    found = next(_walk(json.loads(text), steps(path)), None)
    return found if found is None or isinstance(found, str) else json.dumps(found, separators=(",", ":"), ensure_ascii=False)
