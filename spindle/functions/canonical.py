"""JSON that keeps numbers as they are written: strict decoding, and one text for each value.

Integers become int, other numbers Decimal. Canonical text has sorted member names and no blanks; a Decimal
is written as str() writes it. Both walks are iterative where depth is the data's.
"""

from __future__ import annotations

import hashlib
import json
import re
from decimal import Decimal
from typing import Any


def _refuse(name: str) -> Any:
    raise ValueError(f"{name} is not JSON")


_DECODER = json.JSONDecoder(parse_float=Decimal, parse_constant=_refuse)
_BLANK = " \t\n\r"


def decode(raw: bytes) -> Any:
    """The value of strict UTF-8 JSON. Of repeated member names the last counts."""
    return _DECODER.decode(raw.decode("utf-8"))


def decode_at(text: str, at: int) -> tuple[Any, int]:
    return _DECODER.raw_decode(text, at)


# Strings that need no escapes can be quoted as they are.
_ESCAPED = re.compile(r'[\x00-\x1f"\\]')
_SHORT = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}


def quoted(text: str) -> str:
    return '"' + _ESCAPED.sub(lambda m: _SHORT.get(m[0]) or f"\\u{ord(m[0]):04x}", text) + '"'


#: Stands before a number that the quick encoder writes as a string. No text that can be written holds it, as it has no UTF-8.
_MARK = "\udfff"
_MARKED = re.compile(f'"{_MARK}([^"]*)"')


class _Quick(json.JSONEncoder):
    """The standard encoder; it knows no Decimal, so these pass through default()."""

    def __init__(self) -> None:
        super().__init__(sort_keys=True, ensure_ascii=False, separators=(",", ":"), check_circular=False)
        self.numbers = 0

    def default(self, o: Any) -> str:
        if type(o) is not Decimal:
            return super().default(o)
        self.numbers += 1
        return _MARK + str(o)


def encode(value: Any, ordered: bool = True) -> str:
    """JSON of a value. Quick where the standard encoder will do, else by the walk below, which gives the same text."""
    if ordered:
        quick = _Quick()
        try:
            text = quick.encode(value)
        except RecursionError:
            return walk(value, True)
        if not quick.numbers and _MARK not in text:
            return text
        if text.count(_MARK) == quick.numbers:
            return _MARKED.sub(r"\1", text)
    return walk(value, ordered)


def walk(value: Any, ordered: bool) -> str:
    out: list[str] = []
    todo: list[Any] = [value]
    text = out.append
    while todo:
        x = todo.pop()
        kind = type(x)
        if kind is _Text:
            text(x.text)
        elif kind is str:
            text(quoted(x))
        elif x is None:
            text("null")
        elif kind is bool:
            text("true" if x else "false")
        elif kind is int or kind is Decimal:
            text(str(x))
        elif kind is dict:
            names = sorted(x, key=_bytes) if ordered else list(x)
            todo.append(_CLOSE)
            for i in range(len(names) - 1, -1, -1):
                todo.append(x[names[i]])
                todo.append(_Text(("," if i else "") + quoted(names[i]) + ":"))
            text("{")
        elif isinstance(x, list | tuple):
            todo.append(_END)
            for i in range(len(x) - 1, -1, -1):
                todo.append(x[i])
                if i:
                    todo.append(_COMMA)
            text("[")
        else:
            raise TypeError(f"{kind.__name__} is not JSON")
    return "".join(out)


class _Text:
    __slots__ = ("text",)

    def __init__(self, text: str):
        self.text = text


_CLOSE, _END, _COMMA = _Text("}"), _Text("]"), _Text(",")


def _bytes(name: str) -> bytes:
    return name.encode("utf-8", "surrogatepass")


def canonical(value: Any) -> bytes:
    return encode(value).encode("utf-8")


def fingerprint(raw: bytes) -> tuple[int, bytes]:
    return len(raw), hashlib.sha256(raw).digest()


def kind_of(value: Any) -> str | None:
    """The type's name; a number without a fraction is an integer, however it is written. None for null."""
    if value is None:
        return None
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int):
        return "integer"
    if isinstance(value, Decimal):
        return "integer" if is_whole(value) else "number"
    return {str: "string", dict: "object"}.get(type(value), "array")


def is_whole(number: Decimal) -> bool:
    _, digits, exponent = number.as_tuple()
    if exponent >= 0 or not any(digits):
        return True
    return len(digits) > -exponent and not any(digits[exponent:])


def elements(text: str):
    """(value, text) of each element of one top-level array."""
    at = _skip(text, 0)
    if text[at : at + 1] != "[":
        raise ValueError("expected a top-level JSON array")
    at = _skip(text, at + 1)
    if text[at : at + 1] == "]":
        at += 1
    else:
        while True:
            value, end = decode_at(text, at)
            yield value, text[at:end]
            at = _skip(text, end)
            mark = text[at : at + 1]
            at = _skip(text, at + 1)
            if mark == "]":
                break
            if mark != ",":
                raise json.JSONDecodeError("expected , or ]", text, at)
    if _skip(text, at) != len(text):
        raise json.JSONDecodeError("extra data", text, at)


def _skip(text: str, at: int) -> int:
    while text[at : at + 1] and text[at] in _BLANK:
        at += 1
    return at
