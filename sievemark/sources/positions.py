"""A JSON parser that reports where every value and member name stands."""

from __future__ import annotations

import json
import re
from typing import Any

from sievemark.functions.model import escape
from sievemark.plans.errors import JsonSyntaxError

_SPACE = re.compile(r"[ \t\n\r]*")
_STRING = re.compile(r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9A-Fa-f]{4}))*"')
_NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")
_WORDS = {"true": True, "false": False, "null": None}

Span = tuple[int, int]


class Ranges:
    """Spans of values (``values``) and of member names (``keys``) by pointer; ``place`` turns an offset into line and column."""

    def __init__(self, text: str) -> None:
        self.values: dict[str, Span] = {}
        self.keys: dict[str, Span] = {}
        self._starts = [0] + [m.end() for m in re.finditer(r"\r\n|\n|\r", text)]

    def place(self, offset: int) -> tuple[int, int, int]:
        """(line, column, offset), the first two from 1."""
        from bisect import bisect_right

        line = bisect_right(self._starts, offset)
        return line, offset - self._starts[line - 1] + 1, offset


def parse_with_ranges(text: str) -> tuple[Any, Ranges]:
    found = Ranges(text)

    def stop(what: str, at: int) -> JsonSyntaxError:
        line, column, _ = found.place(at)
        return JsonSyntaxError(f"{what} in line {line}, column {column}")

    def skip(at: int) -> int:
        return _SPACE.match(text, at).end()

    def string(at: int) -> tuple[str, int]:
        m = _STRING.match(text, at)
        if not m:
            raise stop("bad string", at)
        return json.loads(m[0]), m.end()

    def value(at: int, pointer: str) -> tuple[Any, int]:
        start = at = skip(at)
        c = text[at : at + 1]
        if c == "{":
            out: Any = {}
            at = skip(at + 1)
            while text[at : at + 1] != "}" or (out and text[at - 1 : at] == ","):
                if out:
                    if text[at : at + 1] != ",":
                        raise stop("expected , or }", at)
                    at = skip(at + 1)
                name_at = at
                name, at = string(at)
                below = f"{pointer}/{escape(name)}"
                found.keys[below] = (name_at, at)
                at = skip(at)
                if text[at : at + 1] != ":":
                    raise stop("expected :", at)
                out[name], at = value(at + 1, below)
                at = skip(at)
            at += 1
        elif c == "[":
            out = []
            at = skip(at + 1)
            while text[at : at + 1] != "]":
                if out:
                    if text[at : at + 1] != ",":
                        raise stop("expected , or ]", at)
                    at += 1
                item, at = value(at, f"{pointer}/{len(out)}")
                out.append(item)
                at = skip(at)
            at += 1
        elif c == '"':
            out, at = string(at)
        elif m := _NUMBER.match(text, at):
            out, at = json.loads(m[0]), m.end()
        else:
            word = next((w for w in _WORDS if text.startswith(w, at)), None)
            if word is None:
                raise stop("expected a value", at)
            out, at = _WORDS[word], at + len(word)
        found.values[pointer] = (start, at)
        return out, at

    whole, end = value(0, "")
    if skip(end) != len(text):
        raise stop("trailing content", skip(end))
    return whole, found
