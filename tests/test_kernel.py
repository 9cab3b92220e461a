"""Keyword tables: every case by the kernel in both modes, in the dialect that is named."""

import json

import pytest

from sievemark.functions import model
from sievemark.operators import output as O
from sievemark.operators.kernel import Evaluator
from sievemark.plans import errors as E
from sievemark.plans.catalog import SchemaCatalog
from sievemark.plans.dialects import URIS

D7, D6, D19 = URIS["draft-07"], URIS["draft-06"], URIS["2019-09"]

CASES = [
    # schema, valid instances, invalid ones, dialect
    ({"type": "integer"}, [1, 1.0, 10**40], [1.5, True, "1", None, [], {}], None),
    ({"type": ["null", "string"]}, [None, "x"], [0, False, [], {}], None),
    ({"type": "unheard"}, [], [None, 1, "unheard"], None),
    ({"enum": [1, [1, {"a": None}], "x"]}, [1.0, [1.0, {"a": None}], "x"], [True, [1], "1", None], None),
    ({"const": {"a": 1, "b": [0]}}, [{"b": [0.0], "a": 1.0}], [{"a": 1}, {"a": True, "b": [0]}, None], None),
    ({"const": False}, [False], [0, None, ""], None),
    ({"multipleOf": 0.0001}, [0.0075, 1, "x", None], [0.00751], None),
    ({"multipleOf": 3}, [9, 0, -3, 3.0, 10**30 * 3, True], [1, 10**30, 1.5], None),
    ({"maximum": 3}, [3, 2.9, "4", None, True], [3.0001, 4, 10**30], None),
    ({"exclusiveMaximum": 3}, [2.999], [3, 3.0], None),
    ({"minimum": -1}, [-1, 0, False], [-1.1], None),
    ({"exclusiveMinimum": 0}, [0.1, "0"], [0, -1], None),
    ({"maxLength": 2, "minLength": 2}, ["ab", "\U0001f600\U0001f600", 5, None], ["a", "abc", ""], None),
    ({"pattern": "^a.c$"}, ["abc", 1, None], ["abc\n", "xabc", "a\nc"], None),
    ({"pattern": "\\s"}, ["﻿", " "], ["x"], None),
    ({"pattern": "\\bx\\b"}, ["éx", "x"], ["xx"], None),
    ({"pattern": "(?<y>\\d)\\k<y>"}, ["11"], ["12", "٣٣"], None),
    ({"minItems": 1, "maxItems": 2}, [[1], [1, 2], {}, "x"], [[], [1, 2, 3]], None),
    ({"uniqueItems": True}, [[1, True, "1", [1], {"a": 1}], [], {}], [[1, 1.0], [{"a": 1, "b": 2}, {"b": 2, "a": 1}], [[0], [0]]], None),
    ({"uniqueItems": False}, [[1, 1]], [], None),
    ({"minProperties": 1, "maxProperties": 1}, [{"a": 1}, [], 3], [{}, {"a": 1, "b": 2}], None),
    ({"required": ["__proto__", "constructor"]}, [{"__proto__": 1, "constructor": None}, []], [{}, {"constructor": 1}], None),
    ({"dependentRequired": {"a": ["b", "c"]}}, [{}, {"a": 1, "b": 1, "c": 1}, 1], [{"a": 1, "b": 2}], None),
    ({"allOf": [{"minimum": 1}, {"maximum": 2}]}, [1, 2, "x"], [0, 3], None),
    ({"anyOf": [{"type": "string"}, {"minimum": 5}]}, ["x", 5], [4], None),
    ({"oneOf": [{"type": "integer"}, {"minimum": 2}]}, [1, 2.5], [3, 1.5], None),
    ({"not": {"type": "integer"}}, ["x", 1.5], [1], None),
    ({"if": {"const": 1}, "then": False}, [2], [1], None),
    ({"then": False, "else": False}, [1], [], None),
    ({"if": {"minimum": 0}, "then": {"multipleOf": 2}, "else": {"multipleOf": 3}}, [4, -3], [3, -2], None),
    ({"dependentSchemas": {"a": {"required": ["b"]}, "c": False}}, [{"a": 1, "b": 1}, {}, 1], [{"a": 1}, {"c": 1}], None),
    ({"properties": {"a": {"type": "integer"}, "b": False}}, [{"a": 1}, {}, []], [{"a": "x"}, {"b": 1}], None),
    ({"patternProperties": {"^a": {"type": "integer"}, "b$": {"minimum": 5}}}, [{"ab": 5, "x": 1}], [{"ab": 4}, {"a": "x"}], None),
    ({"properties": {"a": True}, "patternProperties": {"^b": True}, "additionalProperties": False}, [{"a": 1, "bb": 1}], [{"c": 1}], None),
    ({"propertyNames": {"maxLength": 2}}, [{"ab": 1}, {}, "abc"], [{"abc": 1}], None),
    ({"propertyNames": False}, [{}], [{"a": 1}], None),
    ({"prefixItems": [{"type": "integer"}], "items": {"type": "string"}}, [[1, "a"], [1], []], [["a"], [1, 2]], None),
    ({"contains": {"const": 1}, "minContains": 2, "maxContains": 3}, [[1, 1], [1, 1, 1, 0]], [[1], [1, 1, 1, 1], []], None),
    ({"contains": {"const": 1}, "minContains": 0}, [[], [0]], [], None),
    ({"allOf": [{"properties": {"a": True}}], "unevaluatedProperties": False}, [{"a": 1}], [{"b": 1}], None),
    ({"not": {"not": {"properties": {"a": True}}}, "unevaluatedProperties": False}, [{}], [{"a": 1}], None),
    ({"if": {"properties": {"a": {"const": 1}}, "required": ["a"]}, "unevaluatedProperties": False}, [{"a": 1}, {}], [{"a": 2}], None),
    ({"properties": {"x": {"unevaluatedProperties": False, "allOf": [{"properties": {"a": True}}]}}, "unevaluatedProperties": False}, [{"x": {"a": 1}}], [{"x": {"b": 1}}, {"y": 1}], None),
    ({"prefixItems": [True], "unevaluatedItems": False}, [[1], []], [[1, 2]], None),
    ({"contains": {"type": "integer"}, "unevaluatedItems": {"type": "string"}}, [[1, "a"]], [[1, None]], None),
    ({"contains": {"minimum": 0}}, [[1, 2]], [[], [-1]], D7),
    ({"contains": {"minimum": 0}, "minContains": 2}, [[1]], [[]], D7),
    ({"items": [{"type": "integer"}], "additionalItems": {"type": "string"}}, [[1, "a"], [1]], [["a"], [1, 2]], D7),
    ({"additionalItems": False}, [[1, 2]], [], D7),
    ({"dependencies": {"a": ["b"], "c": {"required": ["d"]}}}, [{"a": 1, "b": 1}, {"c": 1, "d": 1}], [{"a": 1}, {"c": 1}], D6),
    ({"definitions": {"x": {"minimum": 1}}, "$ref": "#/definitions/x", "maximum": 0}, [5], [0], D7),
    ({"if": False, "else": False}, [1], [], D6),
    ({"$recursiveAnchor": True, "type": "object", "additionalProperties": {"$recursiveRef": "#"}}, [{"a": {}}], [{"a": 1}], D19),
    ({"items": [{"type": "integer"}], "unevaluatedItems": False}, [[1]], [[1, 2]], D19),
    (True, [1, None], [], None),
    (False, [], [1, None], None),
]


@pytest.mark.parametrize("schema, good, bad, dialect", CASES, ids=[json.dumps(c[0])[:60] for c in CASES])
def test_keywords(schema, good, bad, dialect):
    catalog = SchemaCatalog()
    uri = catalog.register(schema, "https://t.example/s", dialect)
    engine = Evaluator(SchemaCatalog.from_spec(catalog.spec()))
    for value, wanted in [(v, True) for v in good] + [(v, False) for v in bad]:
        assert engine.is_valid(uri, value) is wanted, value
        root = engine.record(uri, value)
        assert root.valid is wanted
        assert bool(O.errors(root)) is not wanted


def test_dynamic_reference_rebinds_to_the_outermost():
    c = SchemaCatalog()
    c.register({"$id": "https://t.example/tree", "$dynamicAnchor": "node", "type": "object", "properties": {"data": True, "children": {"items": {"$dynamicRef": "#node"}}}})
    strict = c.register({"$id": "https://t.example/strict", "$dynamicAnchor": "node", "$ref": "tree", "unevaluatedProperties": False})
    engine = Evaluator(c)
    wrong = {"children": [{"daat": 1}]}
    assert not engine.is_valid(strict, wrong)
    assert engine.is_valid("https://t.example/tree", wrong)
    assert engine.is_valid(strict, {"children": [{"data": 1}]})


def test_registration_rules():
    c = SchemaCatalog()
    for schema, kind in [
        ({"properties": {"a": 1}}, E.InvalidSchemaError),
        ({"$id": "https://t.example/a#x"}, E.InvalidIdentifierError),
        ({"$defs": {"a": {"$id": "#"}}}, E.InvalidIdentifierError),
        ({"$defs": {"a": {"$anchor": "x"}, "b": {"$anchor": "x"}}}, E.DuplicateAnchorError),
        ({"$defs": {"a": {"$id": "x"}, "b": {"$id": "x"}}}, E.DuplicateResourceError),
        ({"pattern": "("}, E.InvalidRegexError),
        ({"$schema": "https://t.example/none"}, E.UnknownDialectError),
    ]:
        with pytest.raises(kind):
            c.register(schema, "https://t.example/bad")
        assert not c.resources
    uri = c.register({"const": {"$id": "https://t.example/data"}}, "https://t.example/ok")
    assert c.register({"const": {"$id": "https://t.example/data"}}, "https://t.example/ok") == uri
    assert [*c.resources] == ["https://t.example/ok"]
    with pytest.raises(E.DuplicateResourceError):
        c.register({}, uri)
    c.unregister(uri)
    assert not c.resources
    with pytest.raises(E.UnsafeRegexError):
        SchemaCatalog(reject_unsafe_regex=True).register({"pattern": "(a+)+"}, "https://t.example/x")


def test_references_and_failures():
    c = SchemaCatalog()
    u = c.register({"$ref": "#/$defs/none"}, "https://t.example/a")
    with pytest.raises(E.PointerNotFoundError):
        Evaluator(c).is_valid(u, 1)
    u = c.register({"$ref": "#"}, "https://t.example/b")
    with pytest.raises(E.InfiniteLoopError):
        Evaluator(c).is_valid(u, 1)
    u = c.register({"additionalProperties": {"$ref": "#"}}, "https://t.example/c")
    deep: dict = {}
    for _ in range(600):
        deep = {"a": deep}
    with pytest.raises(E.MaxDepthExceededError):
        Evaluator(c).is_valid(u, deep)
    u = c.register({"$defs": {"e": {"$id": "inner/", "$defs": {"t": {"$id": "leaf", "minimum": 3}}}}, "$ref": "inner/leaf"}, "https://t.example/d")
    assert Evaluator(c).is_valid(u, 3) and not Evaluator(c).is_valid(u, 2)


def test_loaders_drain_references():
    store = {"https://t.example/a": {"$ref": "b"}, "https://t.example/b": {"items": {"$ref": "c#/$defs/x"}}, "https://t.example/c": {"$defs": {"x": {"type": "null"}}}}
    c = SchemaCatalog(loaders=[store.get])
    assert c.load("https://t.example/a") == "https://t.example/a"
    assert {*c.documents} == {*store}
    assert Evaluator(SchemaCatalog.from_spec(c.spec())).is_valid("https://t.example/a", [None])


def test_vocabulary_dialects():
    c = SchemaCatalog()
    core = "https://json-schema.org/draft/2020-12/vocab/core"
    c.register({"$id": "https://t.example/meta", "$vocabulary": {core: True, core[:-4] + "applicator": True}})
    u = c.register({"$schema": "https://t.example/meta", "properties": {"a": {"minimum": 5}}}, "https://t.example/s")
    assert Evaluator(c).is_valid(u, {"a": 1})
    c.register({"$id": "https://t.example/meta2", "$vocabulary": {core: True, "https://t.example/unknown": True}})
    with pytest.raises(E.UnknownVocabularyError):
        c.register({"$schema": "https://t.example/meta2"}, "https://t.example/s2")


FIXED = {"$id": "https://t.example/o", "title": "root", "required": ["a"], "properties": {"a": {"anyOf": [{"type": "string"}, {"minimum": 5}]}}}


def test_output_documents():
    c = SchemaCatalog()
    u = c.register(FIXED)
    bad = Evaluator(c).record(u, {"a": 1})
    assert [e["evaluationPath"] for e in O.errors(bad)] == ["/properties/a/anyOf/0/type", "/properties/a/anyOf/1/minimum", "/properties/a/anyOf"]
    assert O.document(bad, "flag") == {"valid": False}
    assert [d["schemaLocation"] for d in O.document(bad, "list")["details"]] == ["https://t.example/o#/properties/a", "https://t.example/o#/properties/a/anyOf/0", "https://t.example/o#/properties/a/anyOf/1"]
    good = Evaluator(c).record(u, {"a": 7})
    assert O.annotations(good)[0]["annotation"] == "root"
    assert O.errors(good) == [] and [e["error"] for e in O.errors(good, dropped=True)] == ["expected string, got 7 (integer)"]
    assert O.document(good, "verbose")["valid"]
    for options in ({"output": "flag", "annotations": True}, {"output": "basic", "verbose": True}, {"output": "verbose", "verbose": False}, {"output": "odd"}):
        with pytest.raises(E.OutputOptionsError):
            O.admit(**options)


def test_selection():
    c = SchemaCatalog()
    u = c.register({"title": "t", "description": "d", "x-own": 1}, "https://t.example/n")
    root = Evaluator(c).record(u, 0)
    names = lambda s: [a["keyword"] for a in O.annotations(root, s)]
    assert names(O.EVERYTHING) == ["title", "description", "x-own"]
    assert names(O.Selection(keywords=("title",))) == ["title"]
    assert names(O.Selection(not_keywords=("title",))) == ["description", "x-own"]
    assert names(O.Selection(keep=lambda k, v, a: v is None)) == ["x-own"]


def test_model():
    assert model.is_multiple(0.0075, 0.0001) and not model.is_multiple(1, 0)
    assert model.canonical({"b": 1.0, "a": [True]}) == model.canonical({"a": [True], "b": 1})
    assert model.canonical(1) != model.canonical(True)
    for text in ("NaN", "1e400", "{", "[1] x", '{"a":1} x'):
        with pytest.raises(ValueError):
            model.parse(text)
    assert model.parse('{"a":1,"a":2}') == {"a": 2}
