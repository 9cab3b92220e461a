"""Registered queries of reports, rules and relations: messages, output documents, annotations, options,
registration, failures, joins and streams, with the DuckDB SQL of each.

What a report says is in the SQL as text, from the specification of the report.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import functions as F

from sievemark import engine as E
from sievemark.functions import model
from sievemark.functions.regex import is_unsafe
from sievemark.operators import joins
from sievemark.operators import output as O
from sievemark.operators.output import Selection
from sievemark.plans.catalog import SchemaCatalog
from sievemark.plans.errors import NeedsKernel, SchemaError
from sievemark.queries import OLD, PROPS, RECORD, _errors, catalog_of, register, table, talks, verdicts
from sievemark.sources.documents import as_documents, parquet_stream, write_split
from sievemark.streaming import validation as streams

K = "CAST(props->>'k' AS BIGINT)"
HOME = "https://queries.example/schema#"
Y2019, D06 = "https://json-schema.org/draft/2019-09/schema", "http://json-schema.org/draft-06/schema#"


def text(x: Any) -> str:
    return json.dumps(x, ensure_ascii=False, separators=(",", ":"))


def quoted(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


# ---- numbers ----
@register("multiple_of_fine", "SELECT l_orderkey, l_linenumber, l_linenumber % 2 = 1 AS valid FROM lineitem")
def multiple_of_fine(spark, sf_dir):
    """Doubles a little off a multiple are none, however little."""
    c, u = catalog_of({"properties": {"v": {"multipleOf": 0.01}}})
    off = F.when(F.col("l_linenumber") % 2 == 0, F.lit(1e-11)).otherwise(F.lit(0.0))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.struct((F.col("l_discount") + off).alias("v")).alias("doc"))
    return E.validate(rows, c, u, "doc", tier="typed").select("l_orderkey", "l_linenumber", "valid")


@register("multiple_of_huge", "SELECT o_orderkey, o_orderkey % 3 = 0 AS valid FROM orders")
def multiple_of_huge(spark, sf_dir):
    """Doubles beyond whole numbers of 64 bits: 10^25 times the key, by 3 * 10^24."""
    c, u = catalog_of({"properties": {"v": {"multipleOf": 3e24}}})
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.struct(F.concat(F.col("o_orderkey").cast("string"), F.lit("e25")).cast("double").alias("v")).alias("doc"))
    return E.validate(rows, c, u, "doc").select("o_orderkey", "valid")


@register("variant_big_ints", "SELECT event_id, event_id % 3 = 0 AS small, event_id % 3 = 0 AS large, event_id % 3 = 0 AS kernel FROM events")
def variant_big_ints(spark, sf_dir):
    """Whole numbers next to 2^53, in a schema of one property, one of 80, and by the kernel."""
    rule = {"v": {"maximum": 9007199254740992}}
    c, u = catalog_of({"properties": rule})
    d, w = catalog_of({"properties": rule | {f"p{k}": {"type": "string"} for k in range(80)}})
    doc = F.parse_json(F.concat(F.lit('{"v": '), (F.lit(9007199254740992) + F.col("event_id") % 3).cast("string"), F.lit("}")))
    rows = table(spark, sf_dir, "events").select("event_id", doc.alias("doc"))
    return rows.select("event_id", E.predicate(c, u, rows, "doc").alias("small"), E.predicate(d, w, rows, "doc").alias("large"), E.predicate(c, u, rows, "doc", tier="kernel").alias("kernel"))


# ---- maps, names, patterns, legacy arrays ----
def maps(name: str, schema: Any, rule: str) -> None:
    @register(name, f"SELECT p_partkey, ({rule}) AS valid FROM part")
    def run(spark, sf_dir):
        c, u = catalog_of(schema)
        rows = table(spark, sf_dir, "part").select("p_partkey", F.create_map("p_brand", "p_size", "p_type", F.lit(7)).alias("doc"))
        return E.validate(rows, c, u, "doc", tier="typed").select("p_partkey", "valid")


maps("map_values", {"additionalProperties": {"maximum": 30}, "minProperties": 2}, "p_size <= 30")
maps("map_patterns", {"patternProperties": {"^Brand": {"minimum": 20}}, "maxProperties": 2}, "p_size >= 20")
maps("prop_names", {"propertyNames": {"pattern": "#1|^[A-Z]+$", "maxLength": 9}}, "contains(p_brand, '#1') AND length(p_type) <= 9")
verdicts("unicode_pattern", "part", ["p_partkey"], ["p_name", "p_type"], {"properties": {"p_name": {"pattern": "^\\p{Ll}+\\s\\p{L}+$"}, "p_type": {"pattern": "^\\p{Lu}"}}}, "regexp_matches(p_name, '^[a-z]+ [A-Za-z]+$') AND regexp_matches(p_type, '^[A-Z]')")
verdicts("regex_backend", "part", ["p_partkey"], ["p_name"], {"properties": {"p_name": {"pattern": "(?<=^\\w+\\s)\\w{4,}$"}}}, "regexp_matches(p_name, '^[A-Za-z0-9_]+ [A-Za-z0-9_]{4,}$')", "kernel", regex_backend="regex")

USER, ASSISTANT = {"const": "user"}, {"const": "assistant"}
for _name, _dialect in (("2019", Y2019), ("07", OLD), ("06", D06)):
    talks(f"items_list_{_name}", {"$schema": _dialect, "items": [{"enum": ["system", "user"]}, ASSISTANT], "additionalItems": {"not": {"const": "system"}}}, "r[1] IN ('system', 'user') AND (len(r) < 2 OR r[2] = 'assistant') AND len(list_filter(r[3:], lambda x: x = 'system')) = 0", dialect=_dialect)
    talks(f"additional_items_{_name}", {"items": [True], "additionalItems": False}, "len(r) <= 1", dialect=_dialect)
    talks(f"contains_{_name}", {"contains": USER, "minContains": 2}, "len(list_filter(r, lambda x: x = 'user')) >= " + ("2" if _name == "2019" else "1"), dialect=_dialect)
talks("unevaluated_items_2019", {"items": [True], "anyOf": [{"items": [True, ASSISTANT]}, True], "unevaluatedItems": False}, "len(r) <= 1 OR (len(r) = 2 AND r[2] = 'assistant')", "kernel", dialect=Y2019)
verdicts("unevaluated_props_2019", "orders", ["o_orderkey"], ["o_orderkey", "o_orderstatus"], {"properties": {"o_orderkey": True}, "anyOf": [{"properties": {"o_orderstatus": {"const": "F"}}}, True], "unevaluatedProperties": False}, "o_orderstatus = 'F'", dialect=Y2019)

# ---- annotations ----
NOTES = {"description": "a number", "default": 3, "deprecated": True, "readOnly": True, "writeOnly": False, "examples": [1, {"a": None}], "contentMediaType": "text/plain", "contentEncoding": "base64", "contentSchema": {"type": "string"}, "format": "uuid"}


def annotation(keyword: str, value: Any) -> None:
    beside = {"contentMediaType": "application/json"} if keyword == "contentSchema" else {}

    @register(f"annotation_{keyword}", f"SELECT event_id, '/k' AS input, '/properties/k/{keyword}' AS path, {quoted(text(value))} AS annotation FROM events WHERE {K} <= 80")
    def run(spark, sf_dir):
        c, u = catalog_of({"title": "left out", "properties": {"k": {"maximum": 80, **beside, keyword: value}}})
        notes = E.annotations(table(spark, sf_dir, "events"), c, u, "props", ["event_id"], Selection(keywords=(keyword,)))
        return notes.select("event_id", F.col("inputLocation").alias("input"), F.col("evaluationPath").alias("path"), "annotation")


for _keyword, _value in NOTES.items():
    annotation(_keyword, _value)

# ---- messages ----
#: keyword, the schema of one member, its value, the message, the parameters; all as the catalogue has them.
MESSAGES: list[tuple[str, Any, Any, str, dict]] = [
    ("type", {"type": ["string", "null"]}, 5, "expected string, null, got 5 (integer)", {"expected": ["string", "null"], "actual": "integer", "value": 5}),
    ("required", {"required": ["b", "c"]}, {"b": 1}, 'missing required property "c"', {"missing": ["c"]}),
    ("enum", {"enum": [1, "a"]}, 2, 'must be one of [1,"a"], got 2', {"allowedValues": [1, "a"], "value": 2}),
    ("const", {"const": "x"}, "y", 'must equal "x", got "y"', {"allowedValue": "x", "value": "y"}),
    ("multipleOf", {"multipleOf": 3}, 7, "must be a multiple of 3, got 7", {"multipleOf": 3, "value": 7}),
    ("maximum", {"maximum": 3}, 7, "must be <= 3, got 7", {"limit": 3, "value": 7}),
    ("exclusiveMaximum", {"exclusiveMaximum": 7}, 7, "must be < 7, got 7", {"limit": 7, "value": 7}),
    ("minimum", {"minimum": 3}, 2.5, "must be >= 3, got 2.5", {"limit": 3, "value": 2.5}),
    ("exclusiveMinimum", {"exclusiveMinimum": 3}, 3, "must be > 3, got 3", {"limit": 3, "value": 3}),
    ("maxLength", {"maxLength": 2}, "abc", 'must be at most 2 characters, got "abc" (3)', {"limit": 2, "value": "abc", "length": 3}),
    ("minLength", {"minLength": 4}, "abc", 'must be at least 4 characters, got "abc" (3)', {"limit": 4, "value": "abc", "length": 3}),
    ("maxItems", {"maxItems": 1}, [1, 2], "must have at most 1 items, got 2", {"limit": 1, "count": 2}),
    ("minItems", {"minItems": 3}, [1, 2], "must have at least 3 items, got 2", {"limit": 3, "count": 2}),
    ("maxProperties", {"maxProperties": 0}, {"a": 1}, "must have at most 0 properties, got 1", {"limit": 0, "count": 1}),
    ("minProperties", {"minProperties": 2}, {"a": 1}, "must have at least 2 properties, got 1", {"limit": 2, "count": 1}),
    ("uniqueItems", {"uniqueItems": True}, [1, 2, 1.0], "items are not unique: [0, 2] are equal", {"duplicates": [[0, 2]]}),
    ("pattern", {"pattern": "^a"}, "b", 'must match pattern "^a", got "b"', {"pattern": "^a", "value": "b"}),
    ("format", {"format": "ipv4"}, "b", 'must match format ipv4, got "b"', {"format": "ipv4", "value": "b"}),
    ("dependentRequired", {"dependentRequired": {"a": ["b", "c"]}}, {"a": 1}, '"a" requires "b", "c"', {"missing": {"a": ["b", "c"]}}),
    ("anyOf", {"anyOf": [{"type": "null"}, {"type": "array"}]}, 1, "does not match any of the 2 anyOf branches", {}),
    ("oneOf", {"oneOf": [True, {"minimum": 0}]}, 1, "matched 2 branches (0, 1), expected exactly 1 of 2", {"passing": [0, 1]}),
    ("allOf", {"allOf": [True, False]}, 1, "allOf branch 1 is false", {"failed": [1]}),
    ("not", {"not": True}, 1, "must not match the subschema", {}),
    ("properties", {"properties": {"a": False}}, {"a": 1}, 'property "a" not allowed', {"properties": ["a"]}),
    ("additionalProperties", {"additionalProperties": False}, {"b": 1}, 'additional property "b" not allowed', {"properties": ["b"]}),
    ("patternProperties", {"patternProperties": {"^x": False}}, {"x1": 1}, 'property "x1" matching "^x" not allowed', {"properties": ["x1"], "patterns": ["^x"]}),
    ("propertyNames", {"propertyNames": False}, {"a": 1}, 'no property names allowed, got "a"', {"properties": ["a"]}),
    ("items", {"prefixItems": [True], "items": False}, [1, 2, 3], "items not allowed from index 1: 1-2", {"start": 1, "failed": [1, 2]}),
    ("prefixItems", {"prefixItems": [True, False]}, [1, 2], "items not allowed at 1", {"failed": [1]}),
    ("contains", {"contains": {"const": 4}, "minContains": 2}, [1, 4], "the contains subschema matched 1 item (1), expected at least 2", {"count": 1, "matched": [1], "minContains": 2}),
    ("unevaluatedProperties", {"unevaluatedProperties": False}, {"x": 1}, 'unevaluated property "x" not allowed', {"properties": ["x"]}),
    ("unevaluatedItems", {"prefixItems": [True], "unevaluatedItems": False}, [1, 2, 3], "unevaluated items not allowed, first at index 1: 1-2", {"start": 1, "failed": [1, 2]}),
    ("dependentSchemas", {"dependentSchemas": {"a": False}}, {"a": 1}, 'property "a" present, which dependentSchemas forbids', {"properties": ["a"]}),
]


def _message_sql() -> str:
    rows = ", ".join(f"({quoted(k)}, {quoted(f'/properties/{k}/{k}')}, {quoted(f'/{k}')}, {quoted(m)}, {quoted(text(p))})" for k, _, _, m, p in MESSAGES)
    return f"SELECT r_regionkey, v.* FROM region, (VALUES {rows}) v(keyword, path, input, error, params)"


@register("error_messages", _message_sql())
def error_messages(spark, sf_dir):
    """Every keyword's message and parameters, on a document that breaks each rule once."""
    c, u = catalog_of({"properties": {k: s for k, s, *_ in MESSAGES}}, assert_formats=True)
    rows = table(spark, sf_dir, "region").select("r_regionkey", F.lit(text({k: v for k, _, v, *_ in MESSAGES})).alias("doc"))
    found = E.errors(rows, c, u, "doc", ["r_regionkey"]).where("keyword is not null and evaluationPath = concat('/properties/', keyword, '/', keyword)")
    return found.select("r_regionkey", "keyword", F.col("evaluationPath").alias("path"), F.col("inputLocation").alias("input"), "error", "params")


@register("false_schemas", "SELECT r_regionkey, v.* FROM region, (VALUES ('/properties/a', '/a', 'schema is false'), ('/properties/b/$ref', '/b', 'schema is false')) v(path, input, error)")
def false_schemas(spark, sf_dir):
    c, u = catalog_of({"$defs": {"no": False}, "properties": {"a": False, "b": {"$ref": "#/$defs/no"}}})
    rows = table(spark, sf_dir, "region").select("r_regionkey", F.lit('{"a":1,"b":2}').alias("doc"))
    found = E.errors(rows, c, u, "doc", ["r_regionkey"]).where("keyword is null")
    return found.select("r_regionkey", F.col("evaluationPath").alias("path"), F.col("inputLocation").alias("input"), "error")


# ---- output documents ----
_AT, _KEY = {"keywordLocation": "", "absoluteKeywordLocation": HOME, "instanceLocation": ""}, {"keywordLocation": "/properties/k/maximum", "absoluteKeywordLocation": HOME + "/properties/k/maximum", "instanceLocation": "/k"}
_K_AT = {"keywordLocation": "/properties/k", "absoluteKeywordLocation": HOME + "/properties/k", "instanceLocation": "/k"}
_P_AT = {"keywordLocation": "/properties", "absoluteKeywordLocation": HOME + "/properties", "instanceLocation": ""}
_UNIT, _K_UNIT = {"evaluationPath": "", "schemaLocation": HOME, "instanceLocation": ""}, {"evaluationPath": "/properties/k", "schemaLocation": HOME + "/properties/k", "instanceLocation": "/k"}
_SAYS = "must be <= 80, got @"
#: The whole documents of a number up to 80, and of one above it, which stands for @.
DOCUMENTS: dict[str, tuple[Any, Any]] = {
    "flag": ({"valid": True}, {"valid": False}),
    "basic": ({"valid": True, **_AT}, {"valid": False, **_AT, "errors": [{**_KEY, "error": _SAYS}]}),
    "list": ({"valid": True, "details": []}, {"valid": False, "details": [{"valid": False, **_K_UNIT, "errors": {"maximum": _SAYS}}]}),
    "hierarchical": ({"valid": True, **_UNIT}, {"valid": False, **_UNIT, "details": [{"valid": False, **_K_UNIT, "errors": {"maximum": _SAYS}}]}),
    "detailed": ({"valid": True, **_AT}, {"valid": False, **_AT, "errors": [{"valid": False, **_KEY, "error": _SAYS}]}),
    "verbose": (
        {"valid": True, **_AT, "annotations": [{"valid": True, **_P_AT, "annotations": [{"valid": True, **_K_AT, "annotations": [{"valid": True, **_KEY}]}]}]},
        {"valid": False, **_AT, "errors": [{"valid": False, **_P_AT, "errors": [{"valid": False, **_K_AT, "errors": [{"valid": False, **_KEY, "error": _SAYS}]}]}]},
    ),
}


def _either(good: Any, bad: Any) -> str:
    return f"CASE WHEN {K} <= 80 THEN {quoted(text(good))} ELSE replace({quoted(text(bad))}, '@', props->>'k') END"


def whole_document(output: str) -> None:
    @register(f"document_{output}", f"SELECT event_id, {_either(*DOCUMENTS[output])} AS document FROM events")
    def run(spark, sf_dir):
        c, u = catalog_of({"properties": {"k": {"maximum": 80}}})
        return E.evaluate(table(spark, sf_dir, "events"), c, u, "props", output=output).select("event_id", F.col("result.output_document").alias("document"))


for _output in DOCUMENTS:
    whole_document(_output)


def _trace(valid: bool) -> dict:
    inner = {"valid": valid, "evaluationPath": "/properties/k", "schemaLocation": HOME + "/properties/k", "inputLocation": "/k", "keywords": [{"keyword": "maximum", "valid": valid}], "children": []}
    return {"valid": valid, "evaluationPath": "", "schemaLocation": HOME, "inputLocation": "", "keywords": [{"keyword": "properties", "valid": valid}], "children": [inner]}


@register("trace", f"SELECT event_id, {_either(_trace(True), _trace(False))} AS trace FROM events")
def trace(spark, sf_dir):
    c, u = catalog_of({"properties": {"k": {"maximum": 80}}})
    return E.evaluate(table(spark, sf_dir, "events"), c, u, "props", trace=True).select("event_id", F.col("result.trace").alias("trace"))


@register("positions", f"SELECT event_id, 1 AS line, strpos(props, ':') + 2 AS col, strpos(props, ':') + 1 AS first, strpos(props, ':') + 1 + length(props->>'k') AS last FROM events WHERE {K} > 80")
def positions(spark, sf_dir):
    """Where in its text each wrong value stands."""
    c, u = catalog_of({"properties": {"k": {"maximum": 80}}})
    found = E.evaluate(table(spark, sf_dir, "events"), c, u, "props", positions=True).select("event_id", F.element_at("result.positions", "/k").alias("p")).where("p is not null")
    return found.select("event_id", F.col("p.line").alias("line"), F.col("p.column").cast("long").alias("col"), F.col("p.start").cast("long").alias("first"), F.col("p.end").cast("long").alias("last"))


@register("dropped_errors", f"SELECT event_id, CASE WHEN {K} <= 50 THEN 1 ELSE 0 END AS n FROM events WHERE {K} <= 80")
def dropped_errors(spark, sf_dir):
    """Errors of branches that a valid document didn't need."""
    c, u = catalog_of({"properties": {"k": {"maximum": 80, "anyOf": [{"minimum": 51}, True]}}})
    found = E.evaluate(table(spark, sf_dir, "events"), c, u, "props", output="list", verbose=True).where("result.valid")
    return found.select("event_id", F.size(F.coalesce("result.dropped_errors", F.array())).alias("n"))


# ---- options and rules ----
def _outcome(f: Callable[[], Any]) -> str:
    try:
        return str(f())
    except (SchemaError, NeedsKernel) as e:
        return type(e).__name__


def facts(name: str, rows: list[tuple[str, Callable[[], Any], str]]) -> None:
    """What the driver's side does, case by case, against what the rules say."""

    @register(name, f"SELECT * FROM (VALUES {', '.join(f'({quoted(case)}, {quoted(wanted)})' for case, _, wanted in rows)}) v(rule, outcome)")
    def run(spark, sf_dir):
        return spark.createDataFrame([(case, _outcome(f)) for case, f, _ in rows], "rule string, outcome string")


def _admits(output: str, **options) -> Callable[[], str]:
    return lambda: O.admit(output, **options) or "ok"


_OPTIONS: list[tuple[str, dict, tuple[str, ...]]] = [  # option, its value, the outputs that refuse it
    ("annotations", {"annotations": True}, ("flag",)), ("error_params", {"error_params": True}, ("flag",)), ("trace", {"trace": True}, ("flag",)), ("positions", {"positions": True}, ("flag",)),
    ("verbose", {"verbose": True}, ("flag", "basic", "detailed")), ("not verbose", {"verbose": False}, ("verbose",)),
]
facts("option_matrix", [(f"{output} {name}", _admits(output, **given), "OutputOptionsError" if output in refused else "ok") for output in DOCUMENTS for name, given, refused in _OPTIONS] + [("unknown output", _admits("other"), "OutputOptionsError")])


def _reg(schema: Any, uri: str | None = "https://r.example/a", dialect: str | None = None, **options) -> tuple[SchemaCatalog, str]:
    c = SchemaCatalog(**options)
    return c, c.register(schema, uri, dialect)


def _twice(a: Any, b: Any) -> str:
    c, u = _reg(a)
    return "same" if c.register(b, u) == u else "other"


def _after_failure() -> int:
    c = SchemaCatalog()
    try:
        c.register({"$defs": {"a": {"$id": "https://r.example/in"}, "b": {"type": 1, "not": 5}}}, "https://r.example/a")
    except SchemaError:
        pass
    return len(c.resources) + len(c.documents)


def _unregistered(uri: str) -> str:
    c, _ = _reg({"$defs": {"a": {"$id": "https://r.example/in"}}})
    c.unregister(uri)
    return f"{len(c.resources)} left"


def _valid(schema: Any, value: Any, dialect: str | None = None, **options) -> bool:
    from sievemark.operators.kernel import Evaluator

    c, u = _reg(schema, dialect=dialect, **options)
    return Evaluator(c).is_valid(u, value)


_DIALECT = {"$id": "https://r.example/d", "$schema": "https://json-schema.org/draft/2020-12/schema", "$vocabulary": {"https://json-schema.org/draft/2020-12/vocab/core": True, "https://json-schema.org/draft/2020-12/vocab/applicator": True}}


def _assembled(extra: dict) -> str:
    """With the applicators alone, ``type`` is unknown and asserts nothing."""
    from sievemark.operators.kernel import Evaluator

    c = SchemaCatalog()
    c.register(_DIALECT | {"$vocabulary": _DIALECT["$vocabulary"] | extra})
    u = c.register({"$schema": _DIALECT["$id"], "type": "string", "not": False}, "https://r.example/u")
    return str(Evaluator(c).is_valid(u, 5))


_DEEP: dict = {}
for _ in range(40):
    _DEEP = {"not": _DEEP}
facts(
    "registration_rules",
    [
        ("dialect by argument", lambda: (lambda c, u: c.resources[u].dialect.draft)(*_reg({}, dialect=OLD)), "draft-07"),
        ("dialect by $schema", lambda: (lambda c, u: c.resources[u].dialect.draft)(*_reg({"$schema": Y2019 + "#"}, dialect=OLD)), "2019-09"),
        ("unknown dialect", lambda: _reg({"$schema": "https://r.example/none"}), "UnknownDialectError"),
        ("$id inside data", lambda: len(_reg({"enum": [{"$id": "https://r.example/in"}]})[0].resources), "1"),
        ("no schema in a schema's place", lambda: _reg({"properties": {"a": 5}}), "InvalidSchemaError"),
        ("a number as a schema", lambda: _reg(5), "InvalidSchemaError"),
        ("embedded resource", lambda: sorted(_reg({"$defs": {"a": {"$id": "in", "$schema": OLD}}})[0].resources), "['https://r.example/a', 'https://r.example/in']"),
        ("embedded dialect", lambda: _reg({"$defs": {"a": {"$id": "in", "$schema": OLD}}})[0].resources["https://r.example/in"].dialect.draft, "draft-07"),
        ("empty $id", lambda: _reg({"$defs": {"a": {"$id": ""}}}), "InvalidIdentifierError"),
        ("$id with a fragment", lambda: _reg({"$defs": {"a": {"$id": "x#y"}}}), "InvalidIdentifierError"),
        ("old $id as an anchor", lambda: _reg({"definitions": {"a": {"$id": "#y"}}}, dialect=OLD)[0].resources["https://r.example/a"].anchors, "{'y': '/definitions/a'}"),
        ("empty fragment", lambda: _reg({"$id": "https://r.example/b#"})[1], "https://r.example/b"),
        ("empty fragment refused", lambda: _reg({"$id": "https://r.example/b#"}, reject_id_fragments=True), "InvalidIdentifierError"),
        ("equal again", lambda: _twice({"minimum": 1}, {"minimum": 1.0}), "same"),
        ("other content", lambda: _twice({"minimum": 1}, {"minimum": 2}), "DuplicateResourceError"),
        ("one URI twice in a document", lambda: _reg({"$defs": {"a": {"$id": "in"}, "b": {"$id": "in"}}}), "DuplicateResourceError"),
        ("a bundled URI", lambda: _reg({}, "https://json-schema.org/draft/2020-12/schema"), "DuplicateResourceError"),
        ("one anchor twice", lambda: _reg({"$defs": {"a": {"$anchor": "x"}, "b": {"$anchor": "x"}}}), "DuplicateAnchorError"),
        ("nothing stays of a failure", _after_failure, "0"),
        ("unregister a document", lambda: _unregistered("https://r.example/a"), "0 left"),
        ("unregister a part", lambda: _unregistered("https://r.example/in"), "UnregisterError"),
        ("a reference to nothing", lambda: _reg({"$ref": "https://r.example/none"})[1], "https://r.example/a"),
        ("following it", lambda: _valid({"$ref": "https://r.example/none"}, 1), "ResourceNotFoundError"),
        ("a pointer to nothing", lambda: _valid({"$ref": "#/$defs/none"}, 1), "PointerNotFoundError"),
        ("an anchor that isn't", lambda: _valid({"$ref": "#none"}, 1), "AnchorNotFoundError"),
        ("a loop", lambda: _valid({"$ref": "#"}, 1), "InfiniteLoopError"),
        ("a wrong pattern", lambda: _reg({"pattern": "("}), "InvalidRegexError"),
        ("an unsafe pattern", lambda: _reg({"pattern": "(a+)+"}, reject_unsafe_regex=True), "UnsafeRegexError"),
        ("nested too deep", lambda: _reg(_DEEP, max_depth=20), "MaxDepthExceededError"),
        ("encoded pointer", lambda: _valid({"$defs": {"a b/c": {"type": "null"}}, "$ref": "#/$defs/a%20b~1c"}, None), "True"),
        ("a bundled reference", lambda: _valid({"$ref": "https://json-schema.org/draft/2020-12/schema"}, {"type": "null"}), "True"),
        ("against its dialect's schema", lambda: _reg({"type": "text"}, validate_schemas=True), "MetaschemaValidationError"),
        ("a dialect of some vocabularies", lambda: _assembled({}), "True"),
        ("a vocabulary that must be known", lambda: _assembled({"https://r.example/v": True}), "UnknownVocabularyError"),
        ("a vocabulary that needn't be", lambda: _assembled({"https://r.example/v": False}), "True"),
        ("an unknown keyword refused", lambda: _reg({"x-y": 1}, refuse_unknown=True), "UnknownKeywordError"),
        ("items as a list in 2020-12", lambda: _reg({"items": [True]}), "InvalidSchemaError"),
    ],
)
facts("json_equality", [(f"{text(a)} {text(b)}", lambda a=a, b=b: model.equal(a, b), str(wanted)) for a, b, wanted in [(1, 1.0, True), (True, 1, False), ({"a": 1, "b": 2}, {"b": 2, "a": 1}, True), ([1, 2], [2, 1], False), ("1", 1, False), (None, False, False), (2**53, 2**53 + 1, False), ([{"a": [1.0]}], [{"a": [1]}], True)]])
facts("unsafe_patterns", [(p, lambda p=p: is_unsafe(p), str(wanted)) for p, wanted in [("(a+)+", True), ("(a*b)*", True), ("a+b+", False), ("(a{1,3})+", False), ("((ab)*c?)*", True), ("^[a-z]+$", False)]])


def _forms(schema: Any) -> Callable[[], str]:
    return lambda: ",".join(form + location.partition("#")[2] for location, form, _ in E.census(*_reg(schema)))


facts("plan_census", [(text(schema), _forms(schema), wanted) for schema, wanted in [({"properties": {"a": {"minimum": 1}}}, "column,column/properties/a"), ({"items": {"$ref": "#"}}, "kernel,kernel/items"), ({"enum": [[1]], "not": {"type": "null"}}, "kernel,column/not")]])


# ---- failures ----
@register(
    "engine_errors",
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'JSONDecodeError' WHEN 2 THEN 'MaxDepthExceededError' ELSE 'InfiniteLoopError' END AS failure,
    CASE WHEN event_id % 4 = 0 THEN 'maximum' END AS keyword, CASE WHEN event_id % 4 = 0 THEN FALSE END AS valid FROM events""",
)
def engine_errors(spark, sf_dir):
    """Texts that are no JSON, too deep, or send the schema round in circles: rows of their own, never valid."""
    c = SchemaCatalog()
    u = c.register({"$id": "https://q.example/loops", "$defs": {"loop": {"$ref": "#/$defs/loop"}}, "properties": {"next": {"$ref": "#"}, "x": {"$ref": "#/$defs/loop"}, "k": {"maximum": 0}}})
    deep = '{"next":' * 700 + "{}" + "}" * 700
    bad = F.element_at(F.array(F.lit('{"k":1}'), F.lit("{bad"), F.lit(deep), F.lit('{"x":1}')), (F.col("event_id") % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select("event_id", bad.alias("doc"))
    checked = E.validate(rows, c, u, "doc", errors_into="why").select("event_id", "valid", F.col("why.class").alias("failure"))
    return E.errors(rows, c, u, "doc", ["event_id"]).select("event_id", "keyword", F.col("engine_error").alias("_seen")).join(checked, "event_id").where("_seen <=> failure").select("event_id", "failure", "keyword", "valid")


@register("custom_keyword", f"SELECT event_id, {K} % 2 = 0 AS valid, {K} % 2 = 0 AS by_column FROM events")
def custom_keyword(spark, sf_dir):
    """A keyword of one's own, in the kernel and as a Column."""
    E.register_keyword("queries-even", lambda v, unit: lambda x, f: not v or type(x) is not int or x % 2 == 0, lambda v, x: F.coalesce(~x.is_kind("integer") | (x.number() % 2 == 0), F.lit(True)) if v else F.lit(True))
    c = SchemaCatalog()
    core = "https://json-schema.org/draft/2020-12/vocab/"
    c.register_vocabulary("https://q.example/v", {"even": "queries-even"})
    c.register_dialect("https://q.example/dialect", [core + "core", core + "applicator", "https://q.example/v"])
    u = c.register({"$schema": "https://q.example/dialect", "properties": {"k": {"even": True}}}, "https://q.example/even")
    events = table(spark, sf_dir, "events")
    return E.validate(E.validate(events, c, u, "props"), c, u, "props", "by_column", tier="variant", well_formed=True).select("event_id", "valid", "by_column")


# ---- relations ----
@register("schemas_by_row", "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN o_totalprice >= 100000 WHEN 'F' THEN o_totalprice <= 200000 END AS valid FROM orders")
def schemas_by_row(spark, sf_dir):
    """Each row names its schema, by a join with a small table of schemas; P has none."""
    c = SchemaCatalog()
    uris = [("O", c.register({"properties": {"o_totalprice": {"minimum": 100000}}}, "https://q.example/o")), ("F", c.register({"properties": {"o_totalprice": {"maximum": 200000}}}, "https://q.example/f"))]
    docs = as_documents(table(spark, sf_dir, "orders"), ["o_orderkey", "o_orderstatus"], ["o_totalprice"])
    named = docs.join(spark.createDataFrame(uris, "o_orderstatus string, schema_uri string"), "o_orderstatus", "left")
    return E.validate_by_uri(named, c, "doc", "schema_uri").select("o_orderkey", "valid")


@register("schemas_by_row_kernel", f"SELECT event_id, CASE WHEN event_type = 'click' THEN {K} <= 40 WHEN event_type = 'view' THEN {K} >= 20 END AS valid FROM events")
def schemas_by_row_kernel(spark, sf_dir):
    c = SchemaCatalog()
    c.register({"properties": {"k": {"maximum": 40}}}, "https://q.example/click")
    c.register({"properties": {"k": {"minimum": 20}}}, "https://q.example/view")
    events = table(spark, sf_dir, "events").withColumn("schema_uri", F.concat(F.lit("https://q.example/"), F.col("event_type")))
    return E.validate_by_uri(events, c, "props", "schema_uri").select("event_id", "valid")


def _checked(spark, sf_dir):
    c, u = catalog_of(PROPS)
    return E.validate(table(spark, sf_dir, "events"), c, u, "props")


@register("errors_as_of", f"SELECT a.event_id, b.event_id AS last_valid, b.ts AS seen FROM (SELECT * FROM events WHERE {K} > 80) a ASOF LEFT JOIN (SELECT * FROM events WHERE {K} <= 80) b ON a.user_id = b.user_id AND a.ts >= b.ts")
def errors_as_of(spark, sf_dir):
    """Each invalid event with the user's last valid one before it."""
    checked = _checked(spark, sf_dir)
    bad, good = checked.where("not valid").select("event_id", "user_id", "ts"), checked.where("valid").select("user_id", F.col("ts").alias("seen"), F.col("event_id").alias("last_valid"))
    return joins.as_of_join(bad, good, ["user_id"], "ts", "seen", ["last_valid", "seen"], 86400).select("event_id", "last_valid", "seen")


_BANDS = [("low", 0, 81), ("near", 81, 90), ("far", 88, 120)]


@register("errors_by_range", f"SELECT band, count(*) AS n FROM events JOIN (VALUES {', '.join(f'({quoted(n)}, {a}, {b})' for n, a, b in _BANDS)}) v(band, low, high) ON {K} >= low AND {K} < high WHERE {K} > 80 GROUP BY band")
def errors_by_range(spark, sf_dir):
    """Invalid values by the bands, which overlap, that they lie in."""
    bad = _checked(spark, sf_dir).where("not valid").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return joins.range_join(bad, spark.createDataFrame(_BANDS, "band string, low long, high long"), "k", "low", "high", 10).groupBy("band").agg(F.count(F.lit(1)).alias("n"))


@register("errors_within_interval", f"SELECT a.event_id, count(*) AS n FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 6 HOUR AND CAST(b.props->>'k' AS BIGINT) <= 80 WHERE CAST(a.props->>'k' AS BIGINT) > 80 GROUP BY a.event_id")
def errors_within_interval(spark, sf_dir):
    """Valid events of a user within six hours after an invalid one."""
    checked = _checked(spark, sf_dir)
    bad, good = checked.where("not valid").select("event_id", "user_id", "ts"), checked.where("valid").select("user_id", F.col("ts").alias("later"))
    return joins.interval_join(bad, good, ["user_id"], "ts", "later", 6 * 3600).groupBy("event_id").agg(F.count(F.lit(1)).alias("n"))


@register("limits_theta_join", f"SELECT most, count(*) AS n FROM events JOIN (VALUES (20), (50), (90)) v(most) ON {K} > most GROUP BY most")
def limits_theta_join(spark, sf_dir):
    """Values with every limit that they pass: a join by inequality with a small table."""
    k = table(spark, sf_dir, "events").select(F.get_json_object("props", "$.k").cast("long").alias("k"))
    limits = spark.createDataFrame([(20,), (50,), (90,)], "most int")
    return k.join(limits, k["k"] > limits["most"]).groupBy("most").agg(F.count(F.lit(1)).alias("n"))


_FAILS = f"SELECT event_id, event_type, 'required' AS keyword FROM events UNION ALL SELECT event_id, event_type, 'maximum' FROM events WHERE {K} > 80 UNION ALL SELECT event_id, event_type, 'not' FROM events WHERE {K} % 7 = 0"


@register("errors_grouping_sets", f"SELECT keyword, event_type, count(*) AS n FROM ({_FAILS}) GROUP BY GROUPING SETS ((keyword), (event_type), ())")
def errors_grouping_sets(spark, sf_dir):
    found = _errors(spark, sf_dir)
    k, t = F.col("keyword"), F.col("event_type")
    return found.groupingSets([[k], [t], []], k, t).agg(F.count(F.lit(1)).alias("n"))


# ---- streams and sinks ----
_EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _stream(spark, sf_dir):
    c, u = catalog_of(PROPS)
    events = parquet_stream(spark, f"{sf_dir}/events.parquet", _EVENTS).withColumn("ts", F.col("ts").cast("timestamp"))
    return E.validate(events, c, u, "props")


_HOURS = f"SELECT date_trunc('hour', ts) AS start, count(*) AS n_docs, count(*) FILTER (WHERE {K} <= 80) AS n_valid FROM events GROUP BY 1"


@register("stream_rates", _HOURS)
def stream_rates(spark, sf_dir):
    rates = streams.validity_rates(_stream(spark, sf_dir), "ts", width="1 hour")
    return streams.drained(rates, "complete").select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n_docs", "n_valid")


@register("stream_closed_windows", f"SELECT * FROM ({_HOURS}) WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 3 HOUR")
def stream_closed_windows(spark, sf_dir):
    """The windows that the watermark, three hours behind, has closed."""
    rates = streams.validity_rates(_stream(spark, sf_dir), "ts", width="1 hour", late="3 hours")
    return streams.drained(rates, "append").select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n_docs", "n_valid")


@register(
    "stream_sessions",
    f"""WITH e AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS nr FROM e)
    SELECT user_id, min(ts) AS start, count(*) AS n_docs, count(*) FILTER (WHERE {K} <= 80) AS n_valid FROM s GROUP BY user_id, nr""",
)
def stream_sessions(spark, sf_dir):
    found = streams.session_rates(_stream(spark, sf_dir), "ts", "user_id", "2 hours")
    return streams.drained(found, "complete").select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n_docs", "n_valid")


_SPLIT = f"SELECT CASE WHEN {K} <= 80 THEN 'good' ELSE 'bad' END AS place, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY 1"


def _places(spark, good: str, bad: str):
    read = lambda path, name: spark.read.parquet(path).groupBy().agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids")).select(F.lit(name).alias("place"), "n", "ids")
    return read(good, "good").union(read(bad, "bad"))


@register("split_sink", _SPLIT)
def split_sink(spark, sf_dir):
    good, bad = streams.shared_folder(spark, "good"), streams.shared_folder(spark, "bad")
    write_split(_checked(spark, sf_dir), "valid", good, bad)
    return _places(spark, good, bad)


@register("quarantine_sink", _SPLIT)
def quarantine_sink(spark, sf_dir):
    c, u = catalog_of(PROPS)
    good, bad = streams.shared_folder(spark, "good"), streams.shared_folder(spark, "bad")
    source = parquet_stream(spark, f"{sf_dir}/events.parquet", _EVENTS)
    streams.quarantine(source, c, u, "props", good, bad, streams.shared_folder(spark, "stream")).awaitTermination()
    return _places(spark, good, bad)


@register("first_records", f"SELECT event_id, CASE WHEN {K} % 7 = 0 THEN 'must not match the subschema' WHEN {K} > 80 THEN 'must be <= 80, got ' || (props->>'k') ELSE 'missing required property \"z\"' END AS error FROM events")
def first_records(spark, sf_dir):
    c, u = catalog_of(RECORD)
    return E.first_errors(table(spark, sf_dir, "events"), c, u, "props", ["event_id"]).select("event_id", "error")
