"""Field-level patches after RFC 6902: add, remove and replace."""

from __future__ import annotations

from typing import Any

from spindle.functions import pointer
from spindle.functions.canonical import encode


def patch(old: dict, new: dict) -> list[tuple[str, str, str | None, str | None]]:
    """(op, path, old, value) with values as canonical text, in the order of member names, depth first.

    Objects on both sides are compared by member; whatever else differs is replaced as a whole.
    """
    out = []
    todo: list[tuple[str, Any, Any]] = [("", old, new)]
    while todo:
        path, a, b = todo.pop()
        if a is _NONE:
            out.append(("add", path, None, encode(b)))
        elif b is _NONE:
            out.append(("remove", path, encode(a), None))
        elif isinstance(a, dict) and isinstance(b, dict):
            names = sorted({*a, *b}, key=lambda n: n.encode("utf-8", "surrogatepass"), reverse=True)
            todo += [(pointer.child(path, n), a.get(n, _NONE), b.get(n, _NONE)) for n in names]
        elif (x := encode(a)) != (y := encode(b)):
            out.append(("replace", path, x, y))
    return out


_NONE = object()
