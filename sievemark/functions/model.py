"""The JSON value model: types, equality, canonical keys, exact multiples, pointers, previews."""

from __future__ import annotations

import json
from decimal import Decimal, localcontext
from fractions import Fraction
from typing import Any


class DuplicateSafeDecoder(json.JSONDecoder):
    """Rejects the non-JSON constants; the last of duplicate members counts."""

    def __init__(self) -> None:
        super().__init__(parse_constant=self._refuse)

    @staticmethod
    def _refuse(name: str) -> Any:
        raise ValueError(f"{name} is not JSON")


_decoder = DuplicateSafeDecoder()


def parse(text: str) -> Any:
    """The value of a JSON text; ValueError for anything else, numbers beyond a double included."""
    value = _decoder.decode(text)
    if "e" in text or "E" in text:
        _finite(value)
    return value


def _finite(value: Any) -> None:
    stack = [value]
    while stack:
        v = stack.pop()
        if isinstance(v, float) and v in (float("inf"), float("-inf")):
            raise ValueError("number out of range")
        if isinstance(v, dict):
            stack.extend(v.values())
        elif isinstance(v, list):
            stack.extend(v)


def kind(x: Any) -> str:
    t = type(x)
    if t is str:
        return "string"
    if t is bool:
        return "boolean"
    if t is int or t is float:
        return "number"
    if t is dict:
        return "object"
    if t is list:
        return "array"
    if x is None:
        return "null"
    raise TypeError(f"not a JSON value: {t.__name__}")


def is_number(x: Any) -> bool:
    return type(x) in (int, float)


def is_integer(x: Any) -> bool:
    return type(x) is int or (type(x) is float and x.is_integer())


def equal(a: Any, b: Any) -> bool:
    """JSON equality: numbers by value, booleans never numbers, members in any order."""
    ka = kind(a)
    if ka != kind(b):
        return False
    if ka == "object":
        return a.keys() == b.keys() and all(equal(v, b[k]) for k, v in a.items())
    if ka == "array":
        return len(a) == len(b) and all(map(equal, a, b))
    return a == b


def canonical(x: Any) -> str:
    """A text that equal values share, and no others."""
    k = kind(x)
    if k == "object":
        return "{" + ",".join(f"{json.dumps(n)}:{canonical(x[n])}" for n in sorted(x)) + "}"
    if k == "array":
        return "[" + ",".join(map(canonical, x)) + "]"
    if k == "number":
        return f"n{int(x)}" if is_integer(x) else f"n{x!r}"
    return json.dumps(x)


def is_multiple(x: int | float, of: int | float) -> bool:
    """Whether x / of is whole, in exact arithmetic over the numbers as they are written."""
    if of == 0:
        return False
    if type(x) is int and type(of) is int:
        return x % of == 0
    with localcontext() as exact:
        exact.prec = 60
        return (Fraction(Decimal(repr(x))) / Fraction(Decimal(repr(of)))).denominator == 1


def escape(segment: str) -> str:
    return segment.replace("~", "~0").replace("/", "~1")


def unescape(segment: str) -> str:
    return segment.replace("~1", "/").replace("~0", "~")


def segments(pointer: str) -> list[str]:
    return [unescape(s) for s in pointer.split("/")[1:]]


def preview(x: Any, most: int = 64) -> str:
    text = json.dumps(x, ensure_ascii=False, separators=(",", ":"))
    return text if len(text) <= most else text[: most - 1] + "…"


def quoted(names: list, most: int = 10) -> str:
    shown = ", ".join(json.dumps(n, ensure_ascii=False) for n in names[:most])
    return shown + (f", and {len(names) - most} more" if len(names) > most else "")


def ranges(numbers: list[int], most: int = 10) -> str:
    """Runs of following numbers as a-b."""
    runs: list[list[int]] = []
    for n in numbers:
        if runs and n == runs[-1][1] + 1:
            runs[-1][1] = n
        else:
            runs.append([n, n])
    return ", ".join(str(a) if a == b else f"{a}-{b}" for a, b in runs[:most]) + (", …" if len(runs) > most else "")
