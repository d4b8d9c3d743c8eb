"""RFC 6901 pointers, and sets of them as tries."""

from __future__ import annotations

import re

_BAD = re.compile(r"~(?![01])")


def parse(text: str) -> tuple[str, ...]:
    if not isinstance(text, str) or not text.startswith("/"):
        raise ValueError("ignore paths must be non-empty RFC 6901 JSON Pointers")
    if _BAD.search(text):
        raise ValueError(f"invalid JSON Pointer escape in {text!r}")
    return tuple(part.replace("~1", "/").replace("~0", "~") for part in text[1:].split("/"))


def child(parent: str, name: str) -> str:
    return f"{parent}/{name.replace('~', '~0').replace('/', '~1')}"


class CrossesArray(ValueError):
    """A pointer leads into an array."""


def trie(pointers: tuple[str, ...]) -> dict:
    """Nested names; a name that ends a pointer leads to None, whatever lies below it."""
    root: dict = {}
    for text in pointers:
        *front, last = parse(text)
        node: dict | None = root
        for name in front:
            node = node.setdefault(name, {})
            if node is None:
                break
        if node is not None:
            node[last] = None
    return root


def without(record: dict, ignored: dict, message: str = "ignore paths may not traverse arrays") -> dict:
    """A copy of record without what the trie covers. Untouched parts are shared."""
    if not ignored:
        return record
    result = dict(record)
    todo = [(result, ignored)]
    while todo:
        target, node = todo.pop()
        for name, below in node.items():
            if name not in target:
                continue
            if below is None:
                del target[name]
            elif isinstance(value := target[name], dict):
                target[name] = value = dict(value)
                todo.append((value, below))
            elif isinstance(value, list):
                raise CrossesArray(message)
    return result
