"""Column builders: schemas as Spark expressions, over typed columns or VARIANT.

``compile_columns`` turns a schema into one boolean Column. Each keyword is written once against a
small accessor; a typed accessor folds kind tests at plan time, a VARIANT one tests per row. What has
no faithful Column form (recursion through data, dynamic references, container constants, formats
beyond patterns) raises ``NeedsKernel``, and the planner sends the schema to the kernel.

All tiers read the same value from a row, the one of its JSON text (``json_ready`` says what that is
for typed columns), and compare numbers exactly: whole ones (integers, decimals without a fraction)
as such, others as the double nearest to their text.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from decimal import Decimal
from fractions import Fraction
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievemark.functions import formats, model
from sievemark.functions.regex import RegexUnsupportedError, to_java
from sievemark.operators.kernel import BEHAVIOURS
from sievemark.plans.catalog import SchemaCatalog, Target
from sievemark.plans.errors import NeedsKernel

NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
STRINGS = (T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType)
FRACTIONS = (T.FloatType, T.DoubleType)


def yes() -> Column:
    return F.lit(True)


def no() -> Column:
    return F.lit(False)


def every(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, yes())


def some(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts, no())


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def finite(column: Column) -> Column:
    """The number, or NULL where it is none of JSON's."""
    return F.when(~F.isnan(column) & (F.abs(column) != F.lit(math.inf)), column)


def _no_fraction(column: Column) -> Column:
    """Doubles from 2^53 on have none, and are beyond what floor() gives."""
    return (F.abs(column) >= F.lit(2.0**53)) | (column == F.floor(column))


def time_text(column: Column, kind: T.DataType) -> Column:
    """Dates and times as texts, whatever the session's zone: instants in UTC, local ones without a zone."""
    if isinstance(kind, T.DateType):
        return column.cast("string")
    if isinstance(kind, T.TimestampType):
        seconds = (F.unix_micros(column) / F.lit(1000000).cast("decimal(7,0)")).cast("decimal(18,6)")
        column = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)
    text = F.regexp_replace(column.cast("string"), " ", "T")
    whole = F.rpad(F.when(F.contains(text, F.lit(".")), text).otherwise(F.concat(text, F.lit("."))), F.length(F.substring_index(text, ".", 1)) + 7, "0")
    return F.concat(whole, F.lit("Z")) if isinstance(kind, T.TimestampType) else whole


def json_ready(column: Column, kind: T.DataType) -> Column:
    """The column as its JSON text has it: times as texts, numbers that JSON lacks as NULL."""
    if isinstance(kind, FRACTIONS):
        return finite(column)
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return time_text(column, kind)
    if not _has_times_or_fractions(kind):
        return column
    if isinstance(kind, T.StructType):
        return F.when(column.isNotNull(), F.struct(*[json_ready(column.getField(f.name), f.dataType).alias(f.name) for f in kind.fields]))
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda e: json_ready(e, kind.elementType))
    return F.transform_values(column, lambda k, v: json_ready(v, kind.valueType)) if isinstance(kind, T.MapType) else column


def _has_times_or_fractions(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_times_or_fractions(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _has_times_or_fractions(kind.elementType)
    return _has_times_or_fractions(kind.valueType) if isinstance(kind, T.MapType) else isinstance(kind, (*FRACTIONS, T.DateType, T.TimestampType, T.TimestampNTZType))


class Typed:
    """A value in a column of a known type. A NULL inside is JSON null, or absent where ``nulls`` is omit."""

    def __init__(self, column: Column, kind: T.DataType, nulls: str = "omit") -> None:
        self.column, self.type, self.nulls = finite(column) if isinstance(kind, FRACTIONS) else column, kind, nulls
        if isinstance(kind, T.MapType) and not isinstance(kind.keyType, T.StringType):
            raise NeedsKernel("a map whose keys aren't strings")

    def is_kind(self, name: str) -> Column:
        """Whether the value is of a JSON kind; never NULL."""
        t = self.type
        own = "object" if isinstance(t, (T.StructType, T.MapType)) else "array" if isinstance(t, T.ArrayType) else "boolean" if isinstance(t, T.BooleanType) else "number" if isinstance(t, NUMBERS) else "string" if isinstance(t, STRINGS) else None
        if own is None and not isinstance(t, T.NullType):
            raise NeedsKernel(f"no JSON kind for {t.simpleString()}")
        if name == "null":
            return self.column.isNull()
        if name == "integer":
            if self._whole():
                return self.column.isNotNull()
            return F.coalesce(_no_fraction(self.column), no()) if own == "number" else no()
        return self.column.isNotNull() if name == own else no()

    def _whole(self) -> bool:
        return isinstance(self.type, WHOLE) or (isinstance(self.type, T.DecimalType) and self.type.scale == 0)

    def numbers(self) -> list[tuple[Column | None, bool, Column]]:
        """(when, is whole, the number): the last case holds otherwise."""
        if not isinstance(self.type, NUMBERS):
            return []
        if self._whole():
            return [(None, True, self.column)]
        # A float is the number that its shortest text names.
        return [(None, False, (self.column.cast("string") if isinstance(self.type, T.FloatType) else self.column).cast("double"))]

    def number(self) -> Column:
        """The number, NULL for other kinds: for custom keywords."""
        return self.numbers()[0][2] if self.numbers() else F.lit(None).cast("double")

    def string(self) -> Column:
        return self.column if isinstance(self.type, T.StringType) else time_text(self.column, self.type)

    def boolean(self) -> Column:
        return self.column

    def has(self, name: str) -> Column:
        if isinstance(self.type, T.StructType):
            if name not in self.type.names:
                return no()
            return F.coalesce(self.column.isNotNull() & self.member(name).column.isNotNull(), no()) if self.nulls == "omit" else self.column.isNotNull()
        return F.coalesce(F.map_contains_key(self.column, F.lit(name)), no()) if isinstance(self.type, T.MapType) else no()

    def member(self, name: str) -> Typed | Variant | None:
        if isinstance(self.type, T.StructType):
            return accessor(self.column.getField(name), self.type[name].dataType, self.nulls) if name in self.type.names else None
        return accessor(F.element_at(self.column, F.lit(name)), self.type.valueType, self.nulls) if isinstance(self.type, T.MapType) else None

    def names(self) -> Column:
        if isinstance(self.type, T.StructType):
            if self.nulls != "omit":
                return F.array(*[F.lit(n) for n in self.type.names]).cast("array<string>")
            return F.filter(F.array(*[F.when(self.member(n).column.isNotNull(), F.lit(n)) for n in self.type.names]).cast("array<string>"), lambda x: x.isNotNull())
        if isinstance(self.type, T.MapType):
            return F.map_keys(self.column)
        return F.array().cast("array<string>")

    def sweep(self, names: list[str], patterns: list[str], rule) -> Column:
        """Whether ``rule(member)`` holds for members outside names and patterns."""
        outside = lambda k: ~some([k.isin(names)] if names else []) & ~some([k.rlike(p) for p in patterns])
        if isinstance(self.type, T.StructType):
            return every([~self.has(n) | ~outside(F.lit(n)) | rule(self.member(n)) for n in self.type.names if n not in names])
        if isinstance(self.type, T.MapType):
            return F.forall(F.map_entries(self.column), lambda e: ~outside(e["key"]) | rule(accessor(e["value"], self.type.valueType, self.nulls)))
        return yes()

    def matching(self, pattern: str, rule) -> Column:
        if isinstance(self.type, T.StructType):
            return every([~self.has(n) | ~F.lit(n).rlike(pattern) | rule(self.member(n)) for n in self.type.names])
        if isinstance(self.type, T.MapType):
            return F.forall(F.map_entries(self.column), lambda e: ~e["key"].rlike(pattern) | rule(accessor(e["value"], self.type.valueType, self.nulls)))
        return yes()

    def elements(self) -> tuple[Column, Any]:
        """The array column, and a function from an element to its accessor."""
        inner = self.type.elementType if isinstance(self.type, T.ArrayType) else T.NullType()
        return self.column, lambda x: accessor(x, inner, self.nulls)

    def item_keys(self) -> Column:
        """The elements by a key that equal ones share."""
        inner = self.type.elementType if isinstance(self.type, T.ArrayType) else T.NullType()
        if isinstance(inner, (T.StructType, T.MapType, T.ArrayType, T.VariantType)):
            raise NeedsKernel("uniqueItems over containers")
        if not isinstance(inner, NUMBERS) or isinstance(inner, WHOLE):
            return self.column
        return F.transform(self.column, lambda e: accessor(e, inner).numbers()[0][2] + F.lit(0))


_OBJECT, _ARRAY = "map<string,variant>", "array<variant>"
#: Kinds of VARIANT, besides strings, that are strings in JSON.
_TEXTS = ("DATE", "TIMESTAMP", "TIMESTAMP_NTZ", "BINARY", "UUID")
#: Keywords that look at a scalar's kind.
_SCALAR = frozenset("enum const multipleOf maximum exclusiveMaximum minimum exclusiveMinimum maxLength minLength pattern format".split())


def _needs_kind(node: dict) -> bool:
    names = node.get("type", [])
    return not _SCALAR.isdisjoint(node) or not {"object", "array"}.issuperset([names] if isinstance(names, str) else names if isinstance(names, list) and all(isinstance(n, str) for n in names) else [])


class Variant:
    """A VARIANT value; SQL NULL is absent, a JSON null is a value.

    ``cheap`` says that the column is a name, not an expression to compute; ``kind`` is the column's
    schema where that is known.
    """

    def __init__(self, column: Column, cheap: bool = False, kind: Column | None = None) -> None:
        self.column, self.cheap, self.kind = column, cheap, kind

    def _get(self, kind: str) -> Column:
        return F.try_variant_get(self.column, "$", kind)

    def _kind(self) -> Column:
        return F.schema_of_variant(self.column) if self.kind is None else self.kind

    def is_kind(self, name: str) -> Column:
        if name == "object":
            return self._get("struct<>").isNotNull()
        if name == "array":
            return self._get(_ARRAY).isNotNull()
        k = self._kind()
        if name == "number":
            found = k.isin("BIGINT", "DOUBLE", "FLOAT") & self._finite() | k.startswith("DECIMAL")
        elif name == "integer":
            found = (k == "BIGINT") | k.rlike(r"^DECIMAL\(\d+,0\)") | (k.isin("DOUBLE", "FLOAT") | k.startswith("DECIMAL")) & self._finite() & _no_fraction(self._double())
        else:
            found = k.isin("STRING", *_TEXTS) if name == "string" else k == {"boolean": "BOOLEAN", "null": "VOID"}[name]
        return F.coalesce(found, no())

    def _finite(self) -> Column:
        return F.coalesce(finite(self._get("double")).isNotNull(), no())

    def _double(self) -> Column:
        return F.when(self._kind() == "FLOAT", self._get("float").cast("string").cast("double")).otherwise(self._get("double"))

    def numbers(self) -> list[tuple[Column | None, bool, Column]]:
        k = self._kind()
        return [(k == "BIGINT", True, self._get("bigint")), (k.rlike(r"^DECIMAL\(\d+,0\)"), True, self._get("decimal(38,0)")), (None, False, self._double())]

    def number(self) -> Column:
        """The number as a double, NULL for other kinds: for custom keywords."""
        return self._double()

    def string(self) -> Column:
        return F.when(self._kind().isin(*_TEXTS), F.regexp_replace(F.to_json(self.column), '^"|"$', "")).otherwise(self._get("string"))

    def boolean(self) -> Column:
        return self._get("boolean")

    @staticmethod
    def _path(name: str) -> str:
        if '"' in name or "\\" in name or "'" in name or "]" in name:
            raise NeedsKernel(f"member name {name!r} in a path")
        return f'$["{name}"]'

    def has(self, name: str) -> Column:
        return F.try_variant_get(self.column, self._path(name), "variant").isNotNull()

    def member(self, name: str) -> Variant:
        return Variant(F.try_variant_get(self.column, self._path(name), "variant"))

    def names(self) -> Column:
        return F.map_keys(self._get(_OBJECT))

    def sweep(self, names: list[str], patterns: list[str], rule) -> Column:
        outside = lambda k: ~some([k.isin(names)] if names else []) & ~some([k.rlike(p) for p in patterns])
        return F.coalesce(F.forall(F.map_entries(self._get(_OBJECT)), lambda e: ~outside(e["key"]) | rule(Variant(e["value"], True))), yes())

    def matching(self, pattern: str, rule) -> Column:
        return F.coalesce(F.forall(F.map_entries(self._get(_OBJECT)), lambda e: ~e["key"].rlike(pattern) | rule(Variant(e["value"], True))), yes())

    def elements(self) -> tuple[Column, Any]:
        return self._get(_ARRAY), lambda e: Variant(e, True)

    def item_keys(self) -> Column:
        raise NeedsKernel("uniqueItems over VARIANT")


#: Custom behaviours as Columns: name to a function (value, accessor) -> Column, never NULL.
COLUMN_BEHAVIOURS: dict[str, Any] = {}


class Builder:
    """Compiles schemas of a catalog; ``stack`` holds the positions being compiled, to find recursion."""

    def __init__(self, catalog: SchemaCatalog, most: int = 400) -> None:
        self.catalog, self.budget, self.stack = catalog, most, []

    def schema(self, target: Target, x, covered: list | None = None) -> Column:
        """Whether ``x`` is valid; appends what it covers on success to ``covered``."""
        node = self.catalog.node(target)
        if isinstance(node, bool):
            return yes() if node else no()
        if not isinstance(node, dict):
            raise NeedsKernel("not a schema", target.location)
        if isinstance(x, Variant) and covered is None:
            if not x.cheap:
                return let(x.column, lambda v: self.schema(target, Variant(v, True)))
            if x.kind is None and _needs_kind(node):
                return let(F.schema_of_variant(x.column), lambda k: self.schema(target, Variant(x.column, True, k)))
        place = (target.resource.uri, target.pointer)
        if place in self.stack:
            raise NeedsKernel("a recursive schema", target.location)
        self.budget -= 1
        if self.budget < 0:
            raise NeedsKernel("too large for one expression", target.location)
        self.stack.append(place)
        try:
            return self._keywords(node, target, x, covered)
        finally:
            self.stack.pop()

    def _keywords(self, node: dict, target: Target, x, covered: list | None) -> Column:
        dialect = target.resource.dialect
        if dialect.legacy and isinstance(node.get("$ref"), str):
            return self.schema(self.catalog.resolve(target.resource, node["$ref"]), x, covered)
        inner: list = []
        track = covered is not None or any(k in node for k in ("unevaluatedProperties", "unevaluatedItems"))
        parts = []
        for keyword, (behaviour, _) in dialect.keywords.items():
            if keyword in node and (build := getattr(self, "k_" + behaviour.lstrip("$"), None)):
                found = build(node[keyword], node, target, x, inner if track else None)
                if found is not None:
                    parts.append(found)
            elif keyword in node and behaviour in COLUMN_BEHAVIOURS:
                parts.append(COLUMN_BEHAVIOURS[behaviour](node[keyword], x))
            elif keyword in node and (behaviour in ("$dynamicRef", "$recursiveRef") or behaviour in BEHAVIOURS):
                raise NeedsKernel(behaviour, target.location)
        good = every(parts)
        if covered is not None:
            covered += [(good if when is None else good & when, *what) for when, *what in inner]
        return good

    def at(self, target: Target, *segments: str) -> Target:
        return self.catalog.at(target.resource, target.pointer + "".join("/" + model.escape(s) for s in segments))

    @staticmethod
    def guard(kind: Column, rule: Column) -> Column:
        """Vacuously true for other kinds; never NULL: a rule that can't tell fails."""
        return ~kind | F.coalesce(rule, no())

    def java(self, pattern: str) -> str:
        try:
            return to_java(pattern)
        except RegexUnsupportedError as e:
            raise NeedsKernel(str(e)) from e

    # -- assertions --

    def k_type(self, v, node, target, x, cover):
        names = [v] if isinstance(v, str) else v if isinstance(v, list) else []
        known = ("null", "boolean", "number", "integer", "string", "array", "object")
        return some([x.is_kind(n) for n in names if n in known])

    def _equals(self, v: Any, x) -> Column:
        if isinstance(v, (dict, list)):
            raise NeedsKernel("a container constant")
        if v is None:
            return x.is_kind("null")
        if isinstance(v, bool):
            return x.is_kind("boolean") & F.coalesce(x.boolean() == F.lit(v), no())
        if isinstance(v, str):
            return x.is_kind("string") & F.coalesce(x.string() == F.lit(v), no()) if not isinstance(x, Typed) or isinstance(x.type, STRINGS) else no()
        return x.is_kind("number") & F.coalesce(self._number(x, lambda whole, n: self._against("==", whole, n, v)), no())

    @staticmethod
    def _number(x, rule: Callable[[bool, Column], Column]) -> Column:
        """``rule(is whole, number)`` of whichever case the value is."""
        cases = x.numbers()
        if not cases:
            return yes()
        out = rule(*cases[-1][1:])
        for when, whole, n in reversed(cases[:-1]):
            out = F.when(when, rule(whole, n)).otherwise(out)
        return out

    @staticmethod
    def _against(sign: str, whole: bool, n: Column, v: int | float) -> Column:
        """Exact comparison: by the whole numbers, or the doubles, next to the limit on either side."""
        if whole:
            low, high = math.floor(v), math.ceil(v)
        else:
            low, high = _doubles_around(v)
        if sign == "==":
            return n == _literal(low) if low == high and _literal(low) is not None else no()
        limit = low if sign in ("<=", ">") else high
        lit = _literal(limit)
        if lit is None:  # beyond every whole number of SQL
            return yes() if (limit > 0) == (sign in ("<=", "<")) else no()
        return {"<=": n <= lit, "<": n < lit, ">=": n >= lit, ">": n > lit}[sign]

    def k_enum(self, v, node, target, x, cover):
        if isinstance(v, list) and v and all(isinstance(e, str) for e in v) and (not isinstance(x, Typed) or isinstance(x.type, STRINGS)):
            return x.is_kind("string") & F.coalesce(x.string().isin(v), no())
        return some([self._equals(e, x) for e in (v if isinstance(v, list) else [])])

    def k_const(self, v, node, target, x, cover):
        return self._equals(v, x)

    def k_multipleOf(self, v, node, target, x, cover):
        """Exact: v is m / 10^q, and a double counts as the decimal of its shortest text."""
        if not model.is_number(v):
            return None
        if v == 0:
            return ~x.is_kind("number")
        _, digits, power = Decimal(repr(v)).normalize().as_tuple()
        m, q = int("".join(map(str, digits))), -power
        if q < 0 and m * 10**-q < 10**17:
            m, q = m * 10**-q, 0
        if m >= 10**17 or q > 30:
            raise NeedsKernel("a fine or long multipleOf")
        return self.guard(x.is_kind("number"), self._number(x, lambda whole, n: _multiple_of_whole(n, m, q) if whole else _multiple_of_double(n, m, q)))

    def _compare(self, v, x, sign):
        if model.is_number(v) and isinstance(x, Variant):
            k = x._kind()
            (first, _, whole), (second, _, wide), (_, _, double) = x.numbers()
            out = F.when(first, self._against(sign, True, whole, v)).when(second, self._against(sign, True, wide, v))
            return out.when(k.rlike("^(DOUBLE|FLOAT|DECIMAL)"), F.coalesce(self._against(sign, False, finite(double), v), yes())).otherwise(yes())
        return self.guard(x.is_kind("number"), self._number(x, lambda whole, n: self._against(sign, whole, n, v))) if model.is_number(v) else None

    def k_maximum(self, v, node, target, x, cover):
        return self._compare(v, x, "<=")

    def k_exclusiveMaximum(self, v, node, target, x, cover):
        return self._compare(v, x, "<")

    def k_minimum(self, v, node, target, x, cover):
        return self._compare(v, x, ">=")

    def k_exclusiveMinimum(self, v, node, target, x, cover):
        return self._compare(v, x, ">")

    def k_maxLength(self, v, node, target, x, cover):
        return self.guard(x.is_kind("string"), F.length(x.string()) <= int(v)) if model.is_number(v) else None

    def k_minLength(self, v, node, target, x, cover):
        return self.guard(x.is_kind("string"), F.length(x.string()) >= int(v)) if model.is_number(v) else None

    def k_pattern(self, v, node, target, x, cover):
        return self.guard(x.is_kind("string"), x.string().rlike(self.java(v))) if isinstance(v, str) else None

    def k_maxItems(self, v, node, target, x, cover):
        return self._items_size(v, x, lambda n: n <= int(v))

    def k_minItems(self, v, node, target, x, cover):
        return self._items_size(v, x, lambda n: n >= int(v))

    def _items_size(self, v, x, rule):
        return self._if_array(x, lambda array, _: rule(F.size(array))) if model.is_number(v) else None

    def _if_array(self, x, rule) -> Column:
        kind = x.is_kind("array")
        if isinstance(x, Typed) and not isinstance(x.type, T.ArrayType):
            return yes()
        return self.guard(kind, rule(*x.elements()))

    def k_uniqueItems(self, v, node, target, x, cover):
        if v is not True:
            return None
        return self._if_array(x, lambda array, _: F.size(F.array_distinct(x.item_keys())) == F.size(array))

    def k_maxProperties(self, v, node, target, x, cover):
        return self.guard(x.is_kind("object"), F.size(x.names()) <= int(v)) if model.is_number(v) else None

    def k_minProperties(self, v, node, target, x, cover):
        return self.guard(x.is_kind("object"), F.size(x.names()) >= int(v)) if model.is_number(v) else None

    def k_required(self, v, node, target, x, cover):
        return self.guard(x.is_kind("object"), every([x.has(n) for n in v if isinstance(n, str)])) if isinstance(v, list) else None

    def k_dependentRequired(self, v, node, target, x, cover):
        if not isinstance(v, dict):
            return None
        rules = [~x.has(k) | every([x.has(n) for n in names if isinstance(n, str)]) for k, names in v.items() if isinstance(names, list)]
        return self.guard(x.is_kind("object"), every(rules))

    def k_format(self, v, node, target, x, cover):
        dialect = target.resource.dialect
        if not (dialect.asserts_format or self.catalog.options["assert_formats"]) or not isinstance(v, str):
            return None
        if v in self.catalog.custom_formats:
            raise NeedsKernel(f"custom format {v}")
        if v not in formats.NAMES[dialect.draft]:
            return None
        s = x.string() if not isinstance(x, Typed) or isinstance(x.type, STRINGS) else F.lit(None).cast("string")
        if v == "date":
            return self.guard(x.is_kind("string"), s.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z") & F.try_to_date(s, "yyyy-MM-dd").isNotNull())
        if v not in formats.PATTERNS:
            raise NeedsKernel(f"format {v}")
        return self.guard(x.is_kind("string"), s.rlike(rf"\A(?s:{formats.PATTERNS[v]})\z"))

    # -- in place --

    def _list(self, keyword, v, target):
        return [self.at(target, keyword, str(i)) for i in range(len(v))] if isinstance(v, list) else []

    def k_allOf(self, v, node, target, x, cover):
        return every([self.schema(t, x, cover) for t in self._list("allOf", v, target)])

    def k_anyOf(self, v, node, target, x, cover):
        return some([self.schema(t, x, cover) for t in self._list("anyOf", v, target)])

    def k_oneOf(self, v, node, target, x, cover):
        own = [self.schema(t, x, cover) for t in self._list("oneOf", v, target)]
        return reduce(lambda a, b: a + b, [c.cast("int") for c in own], F.lit(0)) == 1

    def k_not(self, v, node, target, x, cover):
        return ~self.schema(self.at(target, "not"), x)

    def k_if(self, v, node, target, x, cover):
        own: list | None = [] if cover is not None else None
        test = self.schema(self.at(target, "if"), x, own)
        parts = []
        if own is not None:
            cover += own
        for keyword, when in (("then", test), ("else", ~test)):
            if keyword in node:
                inner: list | None = [] if cover is not None else None
                parts.append(~when | self.schema(self.at(target, keyword), x, inner))
                if inner is not None:
                    cover += [(when & w if w is not None else when, *what) for w, *what in inner]
        return every(parts)

    def k_dependentSchemas(self, v, node, target, x, cover, keyword="dependentSchemas"):
        if not isinstance(v, dict):
            return None
        parts = []
        for k, s in v.items():
            if isinstance(s, list) and keyword == "dependencies":
                parts.append(~x.has(k) | every([x.has(n) for n in s if isinstance(n, str)]))
            if not isinstance(s, (dict, bool)):
                continue
            inner: list | None = [] if cover is not None else None
            parts.append(~x.has(k) | self.schema(self.at(target, keyword, k), x, inner))
            if inner is not None:
                cover += [(x.has(k) & w if w is not None else x.has(k), *what) for w, *what in inner]
        return self.guard(x.is_kind("object"), every(parts))

    def k_dependencies(self, v, node, target, x, cover):
        return self.k_dependentSchemas(v, node, target, x, cover, "dependencies")

    def k_ref(self, v, node, target, x, cover):
        if not isinstance(v, str):
            return None
        return self.schema(self.catalog.resolve(target.resource, v), x, cover)

    # -- objects --

    def k_properties(self, v, node, target, x, cover):
        if not isinstance(v, dict):
            return None
        if cover is not None:
            cover.append((None, "names", [*v], []))
        inner = [(k, self.at(target, "properties", k)) for k in v]
        if isinstance(x, Variant):  # of what is no object, every member is absent
            return self._members(x, [(k, t) for k, t in inner if self.catalog.node(t) is not True])
        parts = [~x.has(k) | self.schema(t, member) for k, t in inner if (member := x.member(k)) is not None]
        return self.guard(x.is_kind("object"), every(parts))

    def _members(self, x: Variant, inner: list[tuple[str, Target]]) -> Column:
        """Every member that is there by its schema; members and their kinds are each computed once, together."""
        if not inner:
            return yes()
        scalar = [n for n, (_, t) in enumerate(inner) if isinstance(node := self.catalog.node(t), dict) and _needs_kind(node)]

        def rules(members: Column, kinds: Column | None) -> Column:
            one = lambda n: Variant(members[f"m{n}"], True, kinds[f"k{n}"] if kinds is not None and n in scalar else None)
            return every([members[f"m{n}"].isNull() | self.schema(t, one(n)) for n, (_, t) in enumerate(inner)])

        def bound(members: Column) -> Column:
            if not scalar:
                return rules(members, None)
            return let(F.struct(*[F.schema_of_variant(members[f"m{n}"]).alias(f"k{n}") for n in scalar]), lambda kinds: rules(members, kinds))

        return let(F.struct(*[x.member(k).column.alias(f"m{n}") for n, (k, _) in enumerate(inner)]), bound)

    def k_patternProperties(self, v, node, target, x, cover):
        if not isinstance(v, dict):
            return None
        parts = [x.matching(self.java(p), lambda m, p=p: self.schema(self.at(target, "patternProperties", p), m)) for p in v]
        if cover is not None:
            cover.append((None, "names", [], [self.java(p) for p in v]))
        return self.guard(x.is_kind("object"), every(parts))

    def k_additionalProperties(self, v, node, target, x, cover):
        names = [*node["properties"]] if isinstance(node.get("properties"), dict) else []
        patterns = [self.java(p) for p in node["patternProperties"]] if isinstance(node.get("patternProperties"), dict) else []
        if cover is not None:
            cover.append((None, "all names"))
        return self.guard(x.is_kind("object"), x.sweep(names, patterns, lambda m: self.schema(self.at(target, "additionalProperties"), m)))

    def k_propertyNames(self, v, node, target, x, cover):
        rule = lambda k: self.schema(self.at(target, "propertyNames"), Typed(k, T.StringType()))
        return self.guard(x.is_kind("object"), F.forall(x.names(), rule))

    def k_unevaluatedProperties(self, v, node, target, x, cover):
        whole = [when for when, what, *_ in cover if what == "all names"]
        if any(w is None for w in whole):
            return None
        sure, maybe = set(), []
        patterns = []
        for when, what, *rest in cover:
            if what != "names":
                continue
            names, own = rest
            if when is None:
                sure |= set(names)
                patterns += own
            elif own:
                raise NeedsKernel("conditional patterns before unevaluatedProperties")
            else:
                maybe.append((when, names))
        rest = F.filter(x.names(), lambda k: ~some(([k.isin(sorted(sure))] if sure else []) + [k.rlike(p) for p in patterns]))
        for when, names in maybe:
            if names:
                rest = F.when(F.coalesce(when, no()), F.array_except(rest, F.array(*map(F.lit, names)))).otherwise(rest)
        if v is True:
            cover.append((None, "all names"))
            return None
        if v is not False:
            raise NeedsKernel("unevaluatedProperties with a schema")
        return self.guard(x.is_kind("object"), some([F.coalesce(w, no()) for w in whole]) | (F.size(rest) == 0))

    # -- arrays --

    def k_prefixItems(self, v, node, target, x, cover, keyword="prefixItems"):
        if not isinstance(v, list):
            return None
        if cover is not None:
            cover.append((None, "prefix", len(v)))

        def rule(array, wrap):
            return every([(F.size(array) <= i) | self.schema(self.at(target, keyword, str(i)), wrap(F.get(array, F.lit(i)))) for i in range(len(v))])

        return self._if_array(x, rule)

    def k_items(self, v, node, target, x, cover):
        if isinstance(v, list):
            return self.k_prefixItems(v, node, target, x, cover, "items") if target.resource.dialect.draft != "2020-12" else None
        prefix = node.get("prefixItems")
        start = len(prefix) if target.resource.dialect.draft == "2020-12" and isinstance(prefix, list) else 0
        return self._sweep("items", start, target, x, cover)

    def _sweep(self, keyword, start, target, x, cover):
        if cover is not None:
            cover.append((None, "prefix", 1 << 30))

        def rule(array, wrap):
            if self.catalog.node(self.at(target, keyword)) is False:
                return F.size(array) <= start
            part = F.slice(array, F.lit(start + 1), F.greatest(F.size(array) - start, F.lit(0))) if start else array
            return F.forall(part, lambda e: self.schema(self.at(target, keyword), wrap(e)))

        return self._if_array(x, rule)

    def k_additionalItems(self, v, node, target, x, cover):
        return self._sweep("additionalItems", len(node["items"]), target, x, cover) if isinstance(node.get("items"), list) else None

    def k_contains(self, v, node, target, x, cover):
        bounded = target.resource.dialect.draft in ("2020-12", "2019-09")
        low = node["minContains"] if bounded and model.is_number(node.get("minContains")) else 1
        high = node["maxContains"] if bounded and model.is_number(node.get("maxContains")) else None
        if cover is not None and bounded:
            cover.append((None, "contains", self.at(target, "contains")))

        def rule(array, wrap):
            if low == 1 and high is None:
                return F.exists(array, lambda e: self.schema(self.at(target, "contains"), wrap(e)))
            n = F.size(F.filter(array, lambda e: self.schema(self.at(target, "contains"), wrap(e))))
            return (n >= F.lit(low)) & (n <= F.lit(high) if high is not None else yes())

        return self._if_array(x, rule)

    def k_unevaluatedItems(self, v, node, target, x, cover):
        marks = [(w, what, rest) for w, what, *rest in cover if what in ("prefix", "contains")]
        sure = max([r[0] for w, what, r in marks if what == "prefix" and w is None], default=0)
        if v is True or sure >= 1 << 30:
            cover.append((None, "prefix", 1 << 30))
            return None
        if v is not False:
            raise NeedsKernel("unevaluatedItems with a schema")
        least = F.lit(sure)
        for w, what, r in marks:
            if what == "prefix" and w is not None:
                least = F.greatest(least, F.when(F.coalesce(w, no()), F.lit(r[0])).otherwise(F.lit(0)))

        def rule(array, wrap):
            left = F.slice(array, least + 1, F.greatest(F.size(array) - least, F.lit(0)))
            by = [(w, r[0]) for w, what, r in marks if what == "contains"]
            if not by:
                return F.size(left) == 0
            return F.forall(left, lambda e: some([(yes() if w is None else F.coalesce(w, no())) & self.schema(t, wrap(e)) for w, t in by]))

        return self._if_array(x, rule)


def _doubles_around(v: int | float) -> tuple[float, float]:
    """The greatest double up to v and the least one from v on."""
    try:
        near = float(v)
    except OverflowError:
        near = math.inf if v > 0 else -math.inf
    if math.isinf(near):
        return (math.nextafter(math.inf, 0), math.inf) if near > 0 else (-math.inf, math.nextafter(-math.inf, 0))
    if Fraction(near) == Fraction(v):
        return near, near
    return (math.nextafter(near, -math.inf), near) if Fraction(near) > Fraction(v) else (near, math.nextafter(near, math.inf))


def _literal(v: int | float) -> Column | None:
    if isinstance(v, float):
        return F.lit(v)
    if abs(v) < 1 << 63:
        return F.lit(v)
    return F.lit(str(v)).cast("decimal(38,0)") if abs(v) < 10**38 else None


def _whole(v: int) -> Column:
    return F.lit(str(v)).cast("decimal(38,0)")


def _multiple_of_whole(n: Column, m: int, q: int) -> Column:
    """Whether n * 10^q is a multiple of m."""
    if q < 0:
        return n % _whole(m * 10**-q) == 0 if m * 10**-q < 10**38 else n == 0
    if q == 0:
        return n % (F.lit(m) if m < 1 << 31 else _whole(m)) == 0
    left = n.cast("decimal(38,0)") % _whole(m)
    return (left.cast("decimal(19,0)") * F.lit(str(10**q % m)).cast("decimal(18,0)")) % _whole(m) == 0


def _shortest(written: Column, power: Column, x: Column) -> Column:
    """``written`` * 10^power, a text of x that may have a digit too many, cut to the fewest that still read as x."""
    size = F.length(written.cast("string"))
    out = written
    for most in (17, 16, 15):
        step = F.element_at(F.array(*[F.lit(10**k) for k in range(6)]), F.least(F.greatest(size - most, F.lit(0)), F.lit(5)) + 1)
        cut = let(step, lambda s: written + F.floor(s / 2) - (written + F.floor(s / 2)) % s)
        out = F.when(F.concat(cut.cast("string"), F.lit("E"), power.cast("string")).try_cast("double") == x, cut).otherwise(out)
    return out


def _multiple_of_double(x: Column, m: int, q: int) -> Column:
    """Whether the decimal that x's shortest text names is a multiple of m / 10^q.

    Of at most 15 digits, a decimal that reads as x is that one: so where x has no more before its q-th
    digit, it is compared with itself cut to q digits. Longer ones go by the digits and the exponent of
    their shortest text: D * 10^e is a multiple if the part of m prime to 10 divides D and the powers of
    ten bring what twos and fives are left.
    """
    if q < 0:  # far above every number of 15 digits
        few = x == 0
    else:
        cut = x.try_cast(f"decimal(38,{q})")
        few = (cut.cast("double") == x) & (cut % F.lit(str(Decimal(m).scaleb(-q))).cast(f"decimal(38,{q})") == 0)
    twos_and_fives, rest = 1, m
    for prime in (2, 5):
        while rest % prime == 0:
            rest //= prime
            twos_and_fives *= prime
    most = max(1, twos_and_fives.bit_length())

    def by_digits(w: Column) -> Column:
        return let(F.struct(_shortest(w["n"], w["p"], w["x"]).cast("decimal(38,0)").alias("d"), (w["p"] + q).alias("p")), divides)

    def divides(w: Column) -> Column:
        digits, power = w["d"], w["p"]
        raised = F.element_at(F.array(*[F.lit(str(10**k % twos_and_fives)).cast("decimal(18,0)") for k in range(most + 1)]), F.least(F.greatest(power, F.lit(0)), F.lit(most)) + 1)
        grown = (digits % _whole(rest) == 0) & (((digits % _whole(twos_and_fives)).cast("decimal(18,0)") * raised) % _whole(twos_and_fives) == 0)
        shrunk = F.element_at(F.array(*[_whole(m * 10**k) for k in range(20)]), F.least(F.greatest(-power, F.lit(0)), F.lit(19)) + 1)
        return F.when(power >= 0, grown).otherwise(digits % shrunk == 0)

    def of_text(text: Column) -> Column:
        mantissa = F.substring_index(text, "E", 1)
        after = F.when(F.contains(mantissa, F.lit(".")), F.length(F.substring_index(mantissa, ".", -1))).otherwise(F.lit(0))
        power = F.when(F.contains(text, F.lit("E")), F.substring_index(text, "E", -1).try_cast("int")).otherwise(F.lit(0)) - after
        return let(F.struct(F.regexp_replace(mantissa, "[.-]", "").try_cast("bigint").alias("n"), power.alias("p"), F.abs(x).alias("x")), by_digits)

    # The long way is bound piece by piece, so its code stays small; few numbers take it.
    return F.when(F.abs(x) < F.lit(10.0 ** (15 - max(q, 0))), few).otherwise(let(F.upper(x.cast("string")), of_text))


def accessor(column: Column, kind: T.DataType, nulls: str = "omit"):
    return Variant(column) if isinstance(kind, T.VariantType) else Typed(column, kind, nulls)


def compile_columns(catalog: SchemaCatalog, uri: str, x, most: int = 400) -> Column:
    """The verdict Column of a schema over an accessor; NeedsKernel if there is none."""
    from sievemark.functions.uri import defragged

    head, fragment = defragged(uri)
    target = catalog.resolve(catalog.resource(head), uri if fragment else head)
    return Builder(catalog, most).schema(target, x)
