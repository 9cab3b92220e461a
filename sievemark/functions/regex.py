"""ECMA-262 regular expressions (unicode mode): one parser, back-ends for Java and for Python.

Classes and escapes become explicit code-point ranges and anchors become absolute, so neither host's
own reading of ``\\s``, ``\\b``, ``.`` or ``$`` is ever used.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

MOST = 0x10FFFF
# White space and line terminators of ECMA-262.
SPACE = ((0x09, 0x0D), (0x20, 0x20), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000), (0xFEFF, 0xFEFF))
LINE_ENDS = ((0x0A, 0x0A), (0x0D, 0x0D), (0x2028, 0x2029))
DIGITS = ((0x30, 0x39),)
WORDS = ((0x30, 0x39), (0x41, 0x5A), (0x5F, 0x5F), (0x61, 0x7A))
Ranges = tuple[tuple[int, int], ...]

# Long names of general categories.
CATEGORY_NAMES = {
    "Letter": "L", "Cased_Letter": "LC", "Uppercase_Letter": "Lu", "Lowercase_Letter": "Ll", "Titlecase_Letter": "Lt", "Modifier_Letter": "Lm", "Other_Letter": "Lo",
    "Mark": "M", "Combining_Mark": "M", "Nonspacing_Mark": "Mn", "Spacing_Mark": "Mc", "Enclosing_Mark": "Me",
    "Number": "N", "Decimal_Number": "Nd", "digit": "Nd", "Letter_Number": "Nl", "Other_Number": "No",
    "Punctuation": "P", "punct": "P", "Connector_Punctuation": "Pc", "Dash_Punctuation": "Pd", "Open_Punctuation": "Ps", "Close_Punctuation": "Pe", "Initial_Punctuation": "Pi", "Final_Punctuation": "Pf", "Other_Punctuation": "Po",
    "Symbol": "S", "Math_Symbol": "Sm", "Currency_Symbol": "Sc", "Modifier_Symbol": "Sk", "Other_Symbol": "So",
    "Separator": "Z", "Space_Separator": "Zs", "Line_Separator": "Zl", "Paragraph_Separator": "Zp",
    "Other": "C", "Control": "Cc", "cntrl": "Cc", "Format": "Cf", "Surrogate": "Cs", "Private_Use": "Co", "Unassigned": "Cn",
}


class RegexSyntaxError(ValueError):
    pass


class RegexUnsupportedError(ValueError):
    """Valid, but without a form on the host that was asked for."""


def merged(ranges) -> Ranges:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return tuple((a, b) for a, b in out)


def inverted(ranges: Ranges) -> Ranges:
    out, at = [], 0
    for a, b in merged(ranges):
        if a > at:
            out.append((at, a - 1))
        at = b + 1
    if at <= MOST:
        out.append((at, MOST))
    return tuple(out)


@lru_cache(maxsize=64)
def property_ranges(name: str) -> Ranges:
    """Code points of a general category or of a binary property that follows from categories."""
    key, _, value = name.partition("=")
    if value:
        if key not in ("General_Category", "gc"):
            raise RegexUnsupportedError(f"property {name}")
        key = value
    short = CATEGORY_NAMES.get(key, key)
    tests = {
        "Any": lambda c: True,
        "ASCII": lambda c: c < 128,
        "Assigned": lambda c: unicodedata.category(chr(c)) != "Cn",
        "Alphabetic": lambda c: chr(c).isalpha() or unicodedata.category(chr(c)) == "Nl",
        "Alpha": lambda c: chr(c).isalpha() or unicodedata.category(chr(c)) == "Nl",
        "Uppercase": lambda c: chr(c).isupper(),
        "Upper": lambda c: chr(c).isupper(),
        "Lowercase": lambda c: chr(c).islower(),
        "Lower": lambda c: chr(c).islower(),
        "White_Space": lambda c: any(a <= c <= b for a, b in SPACE if a != 0xFEFF) or c == 0x85,
        "ASCII_Hex_Digit": lambda c: c < 128 and chr(c) in "0123456789abcdefABCDEF",
        "AHex": lambda c: c < 128 and chr(c) in "0123456789abcdefABCDEF",
    }
    if short in tests:
        test = tests[short]
    elif short == "LC":
        test = lambda c: unicodedata.category(chr(c)) in ("Lu", "Ll", "Lt")
    elif short in {v for v in CATEGORY_NAMES.values()}:
        test = lambda c: unicodedata.category(chr(c)).startswith(short)
    else:
        raise RegexSyntaxError(f"unknown property {name}")
    out, start = [], None
    for c in range(MOST + 2):
        inside = c <= MOST and test(c)
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append((start, c - 1))
            start = None
    return tuple(out)


@dataclass
class Node:
    kind: str  # set, cat, alt, rep, group, look, back, bol, eol, edge, empty
    items: list = None
    ranges: Ranges = ()
    low: int = 0
    high: int | None = None
    lazy: bool = False
    name: str | None = None
    ahead: bool = True
    negative: bool = False
    number: int = 0


class _Parser:
    def __init__(self, text: str) -> None:
        self.s, self.i, self.groups, self.names, self.refs = text, 0, 0, {}, []

    def error(self, what: str) -> RegexSyntaxError:
        return RegexSyntaxError(f"{what} at {self.i} in {self.s!r}")

    def peek(self, n: int = 1) -> str:
        return self.s[self.i : self.i + n]

    def eat(self, what: str) -> bool:
        if self.s.startswith(what, self.i):
            self.i += len(what)
            return True
        return False

    def parse(self) -> Node:
        node = self.alternatives()
        if self.i < len(self.s):
            raise self.error("unmatched )")
        for ref in self.refs:
            if isinstance(ref.name, str):
                if ref.name not in self.names:
                    raise self.error(f"no group {ref.name}")
                ref.number = self.names[ref.name]
            elif ref.number > self.groups:
                raise self.error("no such group")
        return node

    def alternatives(self) -> Node:
        found = [self.sequence()]
        while self.eat("|"):
            found.append(self.sequence())
        return found[0] if len(found) == 1 else Node("alt", found)

    def sequence(self) -> Node:
        items = []
        while self.i < len(self.s) and self.peek() not in ("|", ")"):
            items.append(self.term())
        return Node("cat", items)

    def term(self) -> Node:
        c = self.peek()
        if c in "*+?{":
            raise self.error("nothing to repeat")
        if c == "^":
            self.i += 1
            return Node("bol")
        if c == "$":
            self.i += 1
            return Node("eol")
        if self.eat("\\b"):
            return Node("edge")
        if self.eat("\\B"):
            return Node("edge", negative=True)
        if c == "(":
            node = self.group()
            if node.kind == "look":
                return node
        elif c == "[":
            node = Node("set", ranges=self.klass())
        elif c == ".":
            self.i += 1
            node = Node("set", ranges=inverted(LINE_ENDS))
        elif c == "\\":
            node = self.escape()
        elif c in "]}":
            raise self.error(f"lone {c}")
        else:
            self.i += 1
            node = Node("set", ranges=((ord(c), ord(c)),))
        return self.repeated(node)

    def repeated(self, node: Node) -> Node:
        if self.eat("*"):
            low, high = 0, None
        elif self.eat("+"):
            low, high = 1, None
        elif self.eat("?"):
            low, high = 0, 1
        elif self.peek() == "{":
            m = re.compile(r"\{(\d+)(?:(,)(\d*))?\}").match(self.s, self.i)
            if not m:
                raise self.error("bad repeat")
            low = int(m[1])
            high = low if m[2] is None else int(m[3]) if m[3] else None
            if high is not None and high < low:
                raise self.error("repeat out of order")
            self.i = m.end()
        else:
            return node
        return Node("rep", [node], low=low, high=high, lazy=self.eat("?"))

    def group(self) -> Node:
        for mark, ahead, negative in (("(?=", True, False), ("(?!", True, True), ("(?<=", False, False), ("(?<!", False, True)):
            if self.eat(mark):
                node = Node("look", [self.alternatives()], ahead=ahead, negative=negative)
                break
        else:
            if self.eat("(?:"):
                node = Node("group", [self.alternatives()])
            elif self.peek(3)[:3] == "(?<":
                m = re.compile(r"\(\?<([^\W\d][\w$]*|\$[\w$]*)>").match(self.s, self.i)
                if not m:
                    raise self.error("bad group name")
                self.i = m.end()
                self.groups += 1
                if m[1] in self.names:
                    raise self.error("group name twice")
                self.names[m[1]] = number = self.groups
                node = Node("group", [self.alternatives()], number=number, name=m[1])
            elif self.peek(2) == "(?":
                raise self.error("bad group")
            else:
                self.i += 1
                self.groups += 1
                number = self.groups
                node = Node("group", [self.alternatives()], number=number)
        if not self.eat(")"):
            raise self.error("missing )")
        return node

    def class_escape(self) -> Ranges | None:
        """The set of \\d, \\w, \\s, \\p and their complements, if one follows the backslash."""
        c = self.peek()
        sets = {"d": DIGITS, "w": WORDS, "s": SPACE}
        if c.lower() in sets and c:
            self.i += 1
            return sets[c.lower()] if c.islower() else inverted(sets[c.lower()])
        if c in ("p", "P"):
            m = re.compile(r"[pP]\{([A-Za-z_]+(?:=[A-Za-z0-9_]+)?)\}").match(self.s, self.i)
            if not m:
                raise self.error("bad property")
            self.i = m.end()
            own = property_ranges(m[1])
            return own if c == "p" else inverted(own)
        return None

    def character(self, in_class: bool) -> int:
        """The code point of a character escape, after its backslash."""
        c = self.peek()
        if not c:
            raise self.error("trailing backslash")
        self.i += 1
        plain = {"t": 9, "n": 10, "v": 11, "f": 12, "r": 13}
        if c in plain:
            return plain[c]
        if c == "b" and in_class:
            return 8
        if c == "-" and in_class:
            return 45
        if c == "0":
            if self.peek().isdigit():
                raise self.error("octal escape")
            return 0
        if c == "c":
            if re.fullmatch("[A-Za-z]", self.peek()):
                self.i += 1
                return ord(self.s[self.i - 1]) % 32
            raise self.error("bad control escape")
        if c == "x":
            m = re.compile("[0-9A-Fa-f]{2}").match(self.s, self.i)
        elif c == "u":
            m = re.compile(r"\{([0-9A-Fa-f]+)\}|[0-9A-Fa-f]{4}").match(self.s, self.i)
        elif c in "^$\\.*+?()[]{}|/":
            return ord(c)
        else:
            raise self.error(f"bad escape \\{c}")
        if not m:
            raise self.error(f"bad \\{c} escape")
        self.i = m.end()
        value = int(m[0].strip("{}"), 16)
        if c == "u" and 0xD800 <= value <= 0xDBFF and (low := re.compile(r"\\u([Dd][C-Fc-f][0-9A-Fa-f]{2})").match(self.s, self.i)):
            self.i = low.end()
            value = 0x10000 + ((value - 0xD800) << 10) + int(low[1], 16) - 0xDC00
        if value > MOST:
            raise self.error("code point out of range")
        return value

    def escape(self) -> Node:
        self.i += 1
        if (own := self.class_escape()) is not None:
            return Node("set", ranges=own)
        if self.peek() == "k":
            m = re.compile(r"k<([^>]+)>").match(self.s, self.i)
            if not m:
                raise self.error("bad back-reference")
            self.i = m.end()
            node = Node("back", name=m[1])
            self.refs.append(node)
            return node
        if m := re.compile("[1-9][0-9]*").match(self.s, self.i):
            self.i = m.end()
            node = Node("back", number=int(m[0]))
            self.refs.append(node)
            return node
        c = self.character(False)
        return Node("set", ranges=((c, c),))

    def klass(self) -> Ranges:
        self.i += 1
        negative, found = self.eat("^"), []
        while not self.eat("]"):
            if self.i >= len(self.s):
                raise self.error("missing ]")
            first = self.atom()
            if self.peek() == "-" and self.peek(2) != "-]":
                self.i += 1
                if self.i >= len(self.s):
                    raise self.error("missing ]")
                last = self.atom()
                if isinstance(first, tuple) or isinstance(last, tuple):
                    raise self.error("class in a range")
                if last < first:
                    raise self.error("range out of order")
                found.append((first, last))
            elif isinstance(first, tuple):
                found += first
            else:
                found.append((first, first))
        return inverted(tuple(found)) if negative else merged(found)

    def atom(self) -> int | Ranges:
        c = self.peek()
        self.i += 1
        if c != "\\":
            return ord(c)
        own = self.class_escape()
        return own if own is not None else self.character(True)


@lru_cache(maxsize=1024)
def parse(pattern: str) -> Node:
    return _Parser(pattern).parse()


def star_height(node: Node) -> int:
    """How deeply unbounded repeats are nested; two or more can take exponential time."""
    below = max((star_height(n) for n in node.items or ()), default=0)
    return below + (node.kind == "rep" and node.high is None)


def is_unsafe(pattern: str) -> bool:
    return star_height(parse(pattern)) >= 2


def _width(node: Node) -> tuple[int, int | None]:
    if node.kind == "set":
        return 1, 1
    if node.kind in ("cat", "group", "alt"):
        each = [_width(n) for n in node.items]
        if node.kind == "alt":
            return min(a for a, _ in each), None if any(b is None for _, b in each) else max(b for _, b in each)
        return sum(a for a, _ in each), None if any(b is None for _, b in each) else sum(b for _, b in each)
    if node.kind == "rep":
        a, b = _width(node.items[0])
        return a * node.low, None if node.high is None or b is None else b * node.high
    return (0, None) if node.kind == "back" else (0, 0)


class _Writer:
    def __init__(self, java: bool, free: bool = False) -> None:
        self.java, self.free = java, free  # free: look-behinds may be of any width

    def point(self, c: int) -> str:
        if chr(c).isascii() and chr(c).isalnum():
            return chr(c)
        return f"\\x{{{c:X}}}" if self.java else f"\\U{c:08X}"

    def members(self, ranges: Ranges) -> str:
        return "".join(self.point(a) if a == b else f"{self.point(a)}-{self.point(b)}" for a, b in ranges)

    def write(self, n: Node) -> str:
        if n.kind == "set":
            if not n.ranges:
                return "(?!)"
            if n.ranges == ((0, MOST),):
                return "[\\s\\S]"
            if len(n.ranges) == 1 and n.ranges[0][0] == n.ranges[0][1]:
                return self.point(n.ranges[0][0])
            turned = inverted(n.ranges)
            return f"[^{self.members(turned)}]" if len(turned) < len(n.ranges) else f"[{self.members(n.ranges)}]"
        if n.kind == "cat":
            return "".join(f"(?:{self.write(x)})" if x.kind == "alt" else self.write(x) for x in n.items)
        if n.kind == "alt":
            return "|".join(map(self.write, n.items))
        if n.kind == "rep":
            most = "" if n.high is None else n.high
            mark = {(0, None): "*", (1, None): "+", (0, 1): "?"}.get((n.low, n.high), f"{{{n.low}}}" if n.low == n.high else f"{{{n.low},{most}}}")
            return f"(?:{self.write(n.items[0])}){mark}{'?' if n.lazy else ''}"
        if n.kind == "group":
            return f"({'' if n.number else '?:'}{self.write(n.items[0])})"
        if n.kind == "look":
            least, most = _width(n.items[0])
            if not n.ahead and not self.free and (most is None or (not self.java and least != most)):
                raise RegexUnsupportedError("look-behind of variable width")
            return f"(?{'' if n.ahead else '<'}{'!' if n.negative else '='}{self.write(n.items[0])})"
        if n.kind == "back":
            # A group that took no part matches empty in ECMA-262.
            return f"(?:\\{n.number}|(?!\\{n.number}))" if self.java else f"(?({n.number})\\{n.number})"
        if n.kind == "bol":
            return "\\A"
        if n.kind == "eol":
            return "\\z" if self.java else "\\Z"
        w = "[0-9A-Z_a-z]"
        return f"(?:(?<={w})(?={w})|(?<!{w})(?!{w}))" if n.negative else f"(?:(?<={w})(?!{w})|(?<!{w})(?={w}))"


@lru_cache(maxsize=1024)
def to_java(pattern: str) -> str:
    """A java.util.regex pattern of the same meaning, for ``rlike``."""
    return _Writer(True).write(parse(pattern))


@lru_cache(maxsize=1024)
def matcher(pattern: str, backend: str = "re"):
    """A compiled Python pattern of the same meaning; use its ``search``.

    The ``regex`` backend also takes look-behinds of variable width.
    """
    if backend == "regex":
        import regex

        return regex.compile(_Writer(False, True).write(parse(pattern)))
    return re.compile(_Writer(False).write(parse(pattern)))


assert sys.maxunicode == MOST
