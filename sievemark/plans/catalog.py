"""The schema catalog: documents, resources, anchors and references, all on the driver.

A catalog is plain data besides its loaders, so it is shipped to executors as the texts of its
documents and built again there once per worker.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from sievemark.functions import model, uri as uris
from sievemark.functions.regex import RegexSyntaxError, RegexUnsupportedError, is_unsafe, matcher
from sievemark.plans import dialects as D
from sievemark.plans import errors as E
from sievemark.plans.metaschemas import texts


@dataclass
class Resource:
    """A schema with a URI of its own; pointers within it are relative to its root."""

    uri: str
    root: Any
    dialect: D.Dialect
    document: str
    pointer: str  # of its root within the document
    anchors: dict[str, str] = field(default_factory=dict)
    dynamic: dict[str, str] = field(default_factory=dict)
    recursive: bool = False


@dataclass(frozen=True)
class Target:
    """What a reference means: a resource and a pointer within it."""

    resource: Resource = field(hash=False)
    pointer: str = ""
    anchor: str | None = None

    @property
    def location(self) -> str:
        return f"{self.resource.uri}#{uris.encoded(self.pointer)}"


class SchemaCatalog:
    """Registers schemas and resolves references; options hold for all of its schemas."""

    def __init__(
        self,
        default_dialect: str = D.URIS["2020-12"],
        loaders: list[Callable[[str], Any]] | None = None,
        reject_unsafe_regex: bool = False,
        max_depth: int = 512,
        assert_formats: bool = False,
        validate_schemas: bool = False,
        regex_dialect: str = "ecma262",
        vocabularies: dict[str, dict[str, str]] | None = None,
        refuse_unknown: bool = False,
        regex_backend: str = "re",
        reject_id_fragments: bool = False,
    ) -> None:
        if regex_backend not in ("re", "regex"):
            raise ValueError(f"unknown regex backend {regex_backend!r}")
        self.default_dialect = default_dialect.rstrip("#")
        self.loaders = list(loaders or ())
        self.options = {"default_dialect": self.default_dialect, "reject_unsafe_regex": reject_unsafe_regex, "max_depth": max_depth, "assert_formats": assert_formats, "regex_dialect": regex_dialect, "vocabularies": vocabularies or {}, "refuse_unknown": refuse_unknown, "regex_backend": regex_backend, "reject_id_fragments": reject_id_fragments}
        self.validate_schemas = validate_schemas
        self.vocabularies = vocabularies or {}
        self.dialects: dict[str, D.Dialect] = D.built_in()
        self.documents: dict[str, Any] = {}
        self.given: dict[str, tuple[str, str | None]] = {}
        self.resources: dict[str, Resource] = {}
        self.aliases: dict[str, str] = {}
        self.custom_formats: dict[str, Callable[[Any], bool]] = {}
        self.own_dialects: list[tuple[str, list[str], str]] = []

    # -- shipping ------------------------------------------------------------------------------

    def spec(self) -> str:
        """The catalog as text: options and documents in order of registration."""
        return json.dumps({"options": self.options, "dialects": self.own_dialects, "documents": [[u, d, self.documents[u]] for u, (_, d) in self.given.items()]})

    @classmethod
    def from_spec(cls, text: str, formats: dict[str, Callable[[Any], bool]] | None = None) -> SchemaCatalog:
        data = json.loads(text)
        out = cls(**data["options"])
        out.custom_formats.update(formats or {})
        for uri, vocabularies, draft in data["dialects"]:
            out.register_dialect(uri, vocabularies, draft)
        for uri, dialect, schema in data["documents"]:
            out.register(schema, uri, dialect)
        return out

    # -- extension -----------------------------------------------------------------------------

    def register_dialect(self, uri: str, vocabularies: list[str], draft: str = "2020-12") -> None:
        unknown = [v for v in vocabularies if v not in D.VOCABULARIES and v not in self.vocabularies]
        if unknown:
            raise E.UnknownVocabularyError(f"unknown vocabularies {unknown}")
        self.dialects[uri.rstrip("#")] = D.assemble(uri.rstrip("#"), draft, vocabularies, self.vocabularies)
        self.own_dialects.append((uri, vocabularies, draft))

    def register_format(self, name: str, test: Callable[[str], bool]) -> None:
        """A format of one's own, asserted where formats are; it goes to executors with the schema."""
        self.custom_formats[name] = test

    def register_vocabulary(self, uri: str, keywords: dict[str, str]) -> None:
        """Custom keywords by name of a behaviour that ``operators.kernel.register_behaviour`` knows."""
        self.vocabularies[uri] = dict(keywords)
        self.options["vocabularies"] = self.vocabularies

    def dialect(self, uri: str) -> D.Dialect:
        uri = uri.rstrip("#")
        if uri not in self.dialects:
            self._assemble(uri)
        return self.dialects[uri]

    def _assemble(self, uri: str) -> None:
        schema = self.resources[uri].root if uri in self.resources else self._load(uri)
        if not isinstance(schema, dict):
            raise E.UnknownDialectError(f"unknown dialect {uri}")
        wanted = schema.get("$vocabulary")
        if not isinstance(wanted, dict):
            parent = str(schema.get("$schema", self.default_dialect)).rstrip("#")
            if parent == uri:
                raise E.UnknownDialectError(f"{uri} names no vocabularies")
            base = self.dialect(parent)
            self.dialects[uri] = D.Dialect(uri, base.draft, base.keywords, base.asserts_format)
            return
        for v, required in wanted.items():
            if required and v not in D.VOCABULARIES and v not in self.vocabularies:
                raise E.UnknownVocabularyError(f"{uri} requires the unknown vocabulary {v}")
        known = [v for v in wanted if v in D.VOCABULARIES or v in self.vocabularies]
        draft = "2019-09" if any("2019-09" in v for v in known) else "2020-12"
        self.dialects[uri] = D.assemble(uri, draft, known, self.vocabularies)

    # -- registration --------------------------------------------------------------------------

    def register(self, schema: Any, uri: str | None = None, dialect: str | None = None) -> str:
        """Index a schema document; returns its URI. On an error nothing of it stays."""
        if not isinstance(schema, (dict, bool)):
            raise E.InvalidSchemaError("a schema is an object or a boolean")
        named = schema.get("$schema") if isinstance(schema, dict) else None
        own = self.dialect(str(named or dialect or self.default_dialect))
        base = uris.defragged(uri)[0] if uri else ""
        home = base
        if isinstance(schema, dict) and isinstance(schema.get("$id"), str) and not (own.legacy and "$ref" in schema):
            target, fragment = uris.defragged(uris.resolve(base, schema["$id"]))
            self._refuse_empty_fragment(schema["$id"])
            if fragment and not own.legacy:
                raise E.InvalidIdentifierError(f"$id {schema['$id']!r} has a fragment")
            home = target or base
        if home in self.documents:
            if model.equal(self.documents[home], schema):
                if base and base != home:
                    self.aliases.setdefault(base, home)
                return home
            raise E.DuplicateResourceError(f"{home} is registered with other content")
        if home in self.resources or home in self.aliases or home in texts():
            raise E.DuplicateResourceError(f"{home} is taken")
        saved = dict(self.resources), dict(self.aliases)
        try:
            root = self._open(home, schema, own, home, "")
            self._walk(schema, root, "", "", 0)
            if self.validate_schemas:
                self._check_against_metaschema(schema, own)
        except Exception:
            self.resources, self.aliases = saved
            raise
        self.documents[home] = schema
        self.given[home] = (home, own.uri)
        if base and base != home:
            self.aliases.setdefault(base, home)
        return home

    def unregister(self, uri: str) -> None:
        uri = self.aliases.get(uri, uri)
        if uri not in self.documents:
            raise E.UnregisterError(f"{uri} is no document of this catalog")
        del self.documents[uri], self.given[uri]
        self.resources = {u: r for u, r in self.resources.items() if r.document != uri}
        self.aliases = {a: u for a, u in self.aliases.items() if u != uri}

    def _check_against_metaschema(self, schema: Any, dialect: D.Dialect) -> None:
        from sievemark.operators.kernel import Evaluator

        if not Evaluator(self).is_valid(dialect.uri, schema):
            raise E.MetaschemaValidationError("the schema doesn't follow its dialect's schema")

    def _open(self, uri: str, node: Any, dialect: D.Dialect, document: str, pointer: str) -> Resource:
        if uri in self.resources:
            raise E.DuplicateResourceError(f"{uri} is defined twice")
        out = Resource(uri, node, dialect, document, pointer)
        self.resources[uri] = out
        if isinstance(node, dict) and dialect.draft == "2019-09":
            out.recursive = node.get("$recursiveAnchor") is True
        return out

    def _walk(self, node: Any, resource: Resource, pointer: str, in_document: str, depth: int) -> None:
        """Index the schema positions below a schema."""
        if isinstance(node, bool):
            return
        if not isinstance(node, dict):
            raise E.InvalidSchemaError("not a schema", f"{resource.uri}#{uris.encoded(pointer)}")
        if depth > self.options["max_depth"]:
            raise E.MaxDepthExceededError("schemas are nested too deeply", resource.uri)
        own = resource.dialect
        hidden = own.legacy and "$ref" in node
        name = node.get("$id")
        if isinstance(name, str) and not hidden and pointer:
            if own.legacy and name.startswith("#"):
                self._anchor(resource, name[1:], pointer, False)
            else:
                if name in ("", "#"):
                    raise E.InvalidIdentifierError(f"$id {name!r} names nothing", f"{resource.uri}#{pointer}")
                target, fragment = uris.defragged(uris.resolve(resource.uri, name))
                self._refuse_empty_fragment(name)
                if fragment:
                    raise E.InvalidIdentifierError(f"$id {name!r} has a fragment")
                dialect = self.dialect(node["$schema"]) if isinstance(node.get("$schema"), str) else own
                resource = self._open(target, node, dialect, resource.document, in_document)
                own, pointer = dialect, ""
        elif own.legacy and isinstance(name, str) and not hidden and name.startswith("#") and not pointer:
            self._anchor(resource, name[1:], pointer, False)
        if not own.legacy:
            for keyword, dynamic in (("$anchor", False), ("$dynamicAnchor", True)):
                if isinstance(node.get(keyword), str) and keyword in own.keywords:
                    self._anchor(resource, node[keyword], pointer, dynamic)
        for keyword, value in node.items():
            behaviour = own.keywords.get(keyword, (None,))[0]
            if behaviour is None:
                if self.options["refuse_unknown"]:
                    raise E.UnknownKeywordError(f"unknown keyword {keyword}", f"{resource.uri}#{pointer}")
                continue
            if hidden and keyword not in ("$ref", "definitions"):
                continue
            if behaviour == "pattern" and isinstance(value, str):
                self.regex(value)
            if behaviour == "patternProperties" and isinstance(value, dict):
                for p in value:
                    self.regex(p)
            if behaviour == "format" and own.asserts_format and isinstance(value, str):
                from sievemark.functions.formats import NAMES

                if value not in NAMES["2020-12"] and value not in self.custom_formats:
                    raise E.UnknownFormatError(f"unknown format {value}")
            if behaviour == "items" and own.draft == "2020-12" and isinstance(value, list):
                raise E.InvalidSchemaError("items is no list in this dialect", f"{resource.uri}#{pointer}/items")
            for segments, child in D.subschemas(behaviour, value):
                step = "".join("/" + model.escape(s) for s in (keyword, *segments))
                self._walk(child, resource, pointer + step, in_document + step, depth + 1)

    def _refuse_empty_fragment(self, name: str) -> None:
        if self.options["reject_id_fragments"] and name.endswith("#"):
            raise E.InvalidIdentifierError(f"$id {name!r} has an empty fragment, which reject_id_fragments forbids")

    def _anchor(self, resource: Resource, name: str, pointer: str, dynamic: bool) -> None:
        if resource.anchors.get(name, pointer) != pointer:
            raise E.DuplicateAnchorError(f"{resource.uri} has two anchors {name!r}")
        resource.anchors[name] = pointer
        if dynamic:
            resource.dynamic[name] = pointer

    def regex(self, pattern: str):
        """The compiled matcher of a pattern of a schema."""
        try:
            if self.options["regex_dialect"] == "python":
                from importlib import import_module

                return import_module(self.options["regex_backend"]).compile(pattern)
            if self.options["reject_unsafe_regex"] and is_unsafe(pattern):
                raise E.UnsafeRegexError(f"{pattern!r} nests unbounded repeats")
            return matcher(pattern, self.options["regex_backend"])
        except (RegexSyntaxError, RegexUnsupportedError) as x:
            raise E.InvalidRegexError(str(x)) from x

    # -- references ----------------------------------------------------------------------------

    def _load(self, uri: str) -> Any:
        if uri in texts():
            if uri not in self.resources:
                # A bundled document is indexed on demand, is no document of the user's and isn't shipped.
                self._walk(texts()[uri], self._open(uri, texts()[uri], self.dialect(texts()[uri]["$schema"]), uri, ""), "", "", 0)
            return texts()[uri]
        for loader in self.loaders:
            try:
                found = loader(uri)
            except Exception as x:
                raise E.LoaderError(f"loading {uri}: {x}") from x
            if found is not None:
                if uri not in self.resources:
                    self.register(found, uri)
                return found
        return None

    def load(self, uri: str) -> str:
        """Register a document by URI and, until nothing is missing, those that it refers to."""
        head = uris.defragged(uri)[0]
        if head not in self.resources and head not in self.aliases and self._load(head) is None:
            raise E.ResourceNotFoundError(f"no loader has {head}")
        done: set[str] = set()
        while True:
            missing = {t for t in self.references() if t not in self.resources and t not in self.aliases} - done
            if not missing:
                return self.aliases.get(head, head)
            for t in sorted(missing):
                done.add(t)
                if t not in self.resources and t not in self.aliases:
                    self._load(t)

    def references(self) -> set[str]:
        """The documents that registered schemas refer to."""
        out = set()
        for r in list(self.resources.values()):
            stack = [r.root]
            while stack:
                node = stack.pop()
                if isinstance(node, dict):
                    for k in ("$ref", "$dynamicRef", "$recursiveRef"):
                        if isinstance(node.get(k), str):
                            out.add(uris.defragged(uris.resolve(r.uri, node[k]))[0])
                    stack.extend(v for k, v in node.items() if k not in ("enum", "const") and not (v is not r.root and isinstance(v, dict) and isinstance(v.get("$id"), str)))
                elif isinstance(node, list):
                    stack.extend(node)
        return out

    def resource(self, uri: str) -> Resource:
        uri = self.aliases.get(uri, uri)
        if uri not in self.resources:
            self._load(uri)
            uri = self.aliases.get(uri, uri)
        if uri not in self.resources:
            raise E.ResourceNotFoundError(f"no schema {uri!r}")
        return self.resources[uri]

    def resolve(self, base: Resource, reference: str) -> Target:
        head, fragment = uris.defragged(uris.resolve(base.uri, reference))
        resource = base if head == base.uri else self.resource(head)
        if not fragment:
            return Target(resource)
        fragment = uris.decoded(fragment)
        if fragment.startswith("/"):
            return self.at(resource, fragment)
        if fragment not in resource.anchors:
            raise E.AnchorNotFoundError(f"{resource.uri} has no anchor {fragment!r}")
        return Target(resource, resource.anchors[fragment], fragment)

    def positions(self, uri: str) -> list[Target]:
        """The schema positions that an evaluation of ``uri`` can reach by subschemas and static references."""
        head, fragment = uris.defragged(uri)
        first = self.resolve(self.resource(head), uri if fragment else head)
        seen, queue = {first.location: first}, [first]
        while queue:
            here = queue.pop()
            node = self.node(here)
            if not isinstance(node, dict):
                continue
            own, found = here.resource.dialect, []
            hidden = own.legacy and isinstance(node.get("$ref"), str)
            for keyword, value in node.items():
                behaviour = own.keywords.get(keyword, (None,))[0]
                if behaviour in ("$ref", "$dynamicRef", "$recursiveRef") and isinstance(value, str):
                    found.append(self.resolve(here.resource, value))
                elif behaviour not in (None, "$defs", "definitions") and not hidden:
                    found += [self.at(here.resource, here.pointer + "".join("/" + model.escape(s) for s in (keyword, *path))) for path, _ in D.subschemas(behaviour, value)]
            for t in found:
                if t.location not in seen:
                    seen[t.location] = t
                    queue.append(t)
        return list(seen.values())

    def at(self, resource: Resource, pointer: str) -> Target:
        """A pointer from a resource's root; it passes into embedded resources that are registered."""
        node, here = resource.root, ""
        for s in model.segments(pointer):
            try:
                node = node[int(s)] if isinstance(node, list) and s.isascii() and s.isdigit() and (s == "0" or s[0] != "0") else node[s]
            except (KeyError, IndexError, TypeError):
                raise E.PointerNotFoundError(f"{resource.uri} has nothing at {pointer!r}") from None
            here += "/" + model.escape(s)
            if isinstance(node, dict) and isinstance(node.get("$id"), str):
                inner = next((r for r in self.resources.values() if r.root is node), None)
                if inner is not None and inner is not resource:
                    resource, here = inner, ""
        if not isinstance(node, (dict, bool)):
            raise E.PointerNotFoundError(f"{pointer!r} is no schema in {resource.uri}")
        return Target(resource, here)

    def node(self, target: Target) -> Any:
        node = target.resource.root
        for s in model.segments(target.pointer):
            node = node[int(s)] if isinstance(node, list) else node[s]
        return node
