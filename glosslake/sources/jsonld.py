"""The strings of a page's JSON-LD that may name a work."""

from __future__ import annotations

import json
from collections.abc import Iterator

# The keys that are looked at, in order.
JSONLD_KEYS = ("identifier", "doi", "sameAs", "url", "description")


def jsonld_strings(node: object) -> Iterator[str]:
    """The strings that may name a work: identifier-like keys in a fixed order, nested objects, then the graph."""
    if isinstance(node, list):
        for item in node:
            yield from jsonld_strings(item)
    elif isinstance(node, dict):
        for key in JSONLD_KEYS:
            value = node.get(key)
            if isinstance(value, dict) and isinstance(value.get("value"), str):
                yield value["value"]
                continue
            for item in value if isinstance(value, list) else [value]:
                if isinstance(item, str):
                    yield item
                elif isinstance(item, dict):
                    yield from jsonld_strings(item)
        if isinstance(node.get("@graph"), list):
            yield from jsonld_strings(node["@graph"])


def jsonld_values(script: str) -> list[str]:
    """All of them in order; malformed or too deeply nested JSON has none."""
    try:
        return list(jsonld_strings(json.loads(script)))
    except (ValueError, RecursionError):
        return []
