"""Dialects: which keywords each draft has, in which vocabulary, and how it names schemas."""

from __future__ import annotations

from dataclasses import dataclass, field

_2020 = "https://json-schema.org/draft/2020-12/vocab/"
_2019 = "https://json-schema.org/draft/2019-09/vocab/"
_META = ("title", "description", "default", "deprecated", "readOnly", "writeOnly", "examples")
_CONTENT = ("contentMediaType", "contentEncoding", "contentSchema")
_ASSERTIONS = ("type", "enum", "const", "multipleOf", "maximum", "exclusiveMaximum", "minimum", "exclusiveMinimum", "maxLength", "minLength", "pattern", "maxItems", "minItems", "uniqueItems", "maxContains", "minContains", "maxProperties", "minProperties", "required", "dependentRequired")
_OBJECT = ("properties", "patternProperties", "additionalProperties", "propertyNames")
_IN_PLACE = ("allOf", "anyOf", "oneOf", "not", "if", "then", "else", "dependentSchemas")
_LATER = ("unevaluatedItems", "unevaluatedProperties")

# Keywords of the vocabularies, in the order of evaluation.
VOCABULARIES: dict[str, tuple[str, ...]] = {
    _2020 + "core": ("$id", "$schema", "$ref", "$anchor", "$dynamicRef", "$dynamicAnchor", "$vocabulary", "$comment", "$defs"),
    _2020 + "applicator": ("prefixItems", "items", "contains", *_OBJECT, *_IN_PLACE),
    _2020 + "unevaluated": _LATER,
    _2020 + "validation": _ASSERTIONS,
    _2020 + "meta-data": _META,
    _2020 + "format-annotation": ("format",),
    _2020 + "format-assertion": ("format",),
    _2020 + "content": _CONTENT,
    _2019 + "core": ("$id", "$schema", "$ref", "$anchor", "$recursiveRef", "$recursiveAnchor", "$vocabulary", "$comment", "$defs"),
    _2019 + "applicator": ("items", "additionalItems", "contains", *_OBJECT, *_IN_PLACE, *_LATER),
    _2019 + "validation": _ASSERTIONS,
    _2019 + "meta-data": _META,
    _2019 + "format": ("format",),
    _2019 + "content": _CONTENT,
}
# What draft-07 and draft-06 have of them.
_OLD = ("$id", "$schema", "$ref", "definitions", "items", "additionalItems", "contains", *_OBJECT, "allOf", "anyOf", "oneOf", "not", "dependencies", *(k for k in _ASSERTIONS if k not in ("maxContains", "minContains", "dependentRequired")))
_DRAFT6 = (*_OLD, "title", "description", "default", "examples", "format")
_DRAFT7 = (*_OLD, "if", "then", "else", "$comment", *(k for k in _META if k != "deprecated"), "format", "contentMediaType", "contentEncoding")


@dataclass(frozen=True)
class Dialect:
    """keywords: name to (behaviour, vocabulary), in order of evaluation."""

    uri: str
    draft: str
    keywords: dict[str, tuple[str, str | None]] = field(hash=False)
    asserts_format: bool = False
    refuse_unknown: bool = False

    @property
    def legacy(self) -> bool:
        return self.draft in ("draft-07", "draft-06")


def assemble(uri: str, draft: str, vocabularies: list[str], extra: dict[str, dict[str, str]] | None = None) -> Dialect:
    """A dialect of known vocabularies; ``extra`` holds custom ones: uri to {keyword: behaviour}."""
    found: dict[str, tuple[str, str | None]] = {}
    for v in vocabularies:
        names = VOCABULARIES.get(v)
        pairs = extra[v].items() if names is None else ((k, k) for k in names)
        for keyword, behaviour in pairs:
            found[keyword] = (behaviour, v)
    later = [k for k in found if found[k][0] in _LATER]
    order = [k for k in found if k not in later] + later
    return Dialect(uri, draft, {k: found[k] for k in order}, _2020 + "format-assertion" in vocabularies)


def _legacy(uri: str, draft: str, names: tuple[str, ...]) -> Dialect:
    return Dialect(uri, draft, {k: (k, None) for k in names})


URIS = {"2020-12": "https://json-schema.org/draft/2020-12/schema", "2019-09": "https://json-schema.org/draft/2019-09/schema", "draft-07": "http://json-schema.org/draft-07/schema", "draft-06": "http://json-schema.org/draft-06/schema"}


def built_in() -> dict[str, Dialect]:
    standard = [v for v in VOCABULARIES if v.startswith(_2020) and not v.endswith("format-assertion")]
    return {
        d.uri: d
        for d in (
            assemble(URIS["2020-12"], "2020-12", standard),
            assemble(URIS["2019-09"], "2019-09", [v for v in VOCABULARIES if v.startswith(_2019)]),
            _legacy(URIS["draft-07"], "draft-07", _DRAFT7),
            _legacy(URIS["draft-06"], "draft-06", _DRAFT6),
        )
    }


#: Where keywords hold schemas, which is one, a list, or a map of them.
ONE = frozenset(("additionalProperties", "unevaluatedProperties", "unevaluatedItems", "propertyNames", "not", "if", "then", "else", "contains", "additionalItems", "contentSchema"))
MANY = frozenset(("allOf", "anyOf", "oneOf", "prefixItems"))
MAPPED = frozenset(("properties", "patternProperties", "$defs", "definitions", "dependentSchemas", "dependencies"))


def subschemas(keyword: str, value) -> list[tuple[tuple[str, ...], object]]:
    """(segments, schema) of the schemas that a keyword's value holds."""
    is_schema = lambda v: isinstance(v, (dict, bool))
    if keyword == "items":
        return [((str(i),), v) for i, v in enumerate(value)] if isinstance(value, list) else [((), value)]
    if keyword in ONE:
        return [((), value)]
    if keyword in MANY:
        return [((str(i),), v) for i, v in enumerate(value)] if isinstance(value, list) else []
    if keyword in MAPPED and isinstance(value, dict):
        return [((k,), v) for k, v in value.items() if keyword != "dependencies" or is_schema(v)]
    return []
