"""The kernel as Arrow UDFs over JSON text; a worker builds each catalog once."""

import json
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from sievemark.functions import model
from sievemark.operators import output as O
from sievemark.operators.kernel import BEHAVIOURS, Evaluator
from sievemark.plans.catalog import SchemaCatalog
from sievemark.plans.errors import SchemaError
from sievemark.sources.positions import parse_with_ranges

UNIT = "struct<evaluationPath:string,schemaLocation:string,inputLocation:string,{}>"
ERROR = UNIT.format("error:string,keyword:string,vocabulary:string,params:string")
ANNOTATION = UNIT.format("keyword:string,vocabulary:string,annotation:string")
FAILURE = "struct<class:string,message:string,schemaLocation:string>"
RESULT = f"struct<valid:boolean,errors:array<{ERROR}>,annotations:array<{ANNOTATION}>,dropped_errors:array<{ERROR}>,dropped_annotations:array<{ANNOTATION}>,output_document:string,trace:string,positions:map<string,struct<line:int,column:int,start:int,end:int>>,engine_error:{FAILURE}>"


def _unit(*names: str) -> pa.DataType:
    return pa.list_(pa.struct([(n, pa.string()) for n in ("evaluationPath", "schemaLocation", "inputLocation", *names)]))


_ERRORS, _NOTES = _unit("error", "keyword", "vocabulary", "params"), _unit("keyword", "vocabulary", "annotation")
_RESULT = pa.struct(
    [("valid", pa.bool_()), ("errors", _ERRORS), ("annotations", _NOTES), ("dropped_errors", _ERRORS), ("dropped_annotations", _NOTES), ("output_document", pa.string()), ("trace", pa.string()), ("positions", pa.map_(pa.string(), pa.struct([("line", pa.int32()), ("column", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))), ("engine_error", pa.struct([(n, pa.string()) for n in ("class", "message", "schemaLocation")]))]
)


@lru_cache(maxsize=32)
def evaluator(spec: str) -> Evaluator:
    return Evaluator(SchemaCatalog.from_spec(spec))


class Shipped:
    """A catalog on its way to executors: its spec, and the functions that users gave."""

    def __init__(self, catalog: SchemaCatalog) -> None:
        self.spec, self.formats, self.behaviours = catalog.spec(), dict(catalog.custom_formats), dict(BEHAVIOURS)
        self.engine = None

    def get(self) -> Evaluator:
        if not self.formats and not self.behaviours:
            return evaluator(self.spec)
        if self.engine is None:
            BEHAVIOURS.update(self.behaviours)
            self.engine = Evaluator(SchemaCatalog.from_spec(self.spec, self.formats))
        return self.engine

    def __getstate__(self) -> dict:
        return self.__dict__ | {"engine": None}


def _once(texts: pa.Array) -> tuple[list, pa.Array]:
    """The distinct texts of a batch, and for each row the place of its own (null for null).

    What a text comes to depends on nothing else, so equal texts of a batch are evaluated once.
    """
    coded = (texts.cast(pa.string()) if pa.types.is_null(texts.type) else texts).dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices


def _dump(x) -> str:
    return json.dumps(x, ensure_ascii=False, separators=(",", ":"))


#: What a document or a schema can do to an evaluation; each is a row's own failure.
FAILURES = (SchemaError, ValueError, RecursionError)
_FAILURE = pa.struct([(n, pa.string()) for n in ("class", "message", "schemaLocation")])


def _failure(e: Exception) -> dict:
    return {"class": type(e).__name__, "message": str(e), "schemaLocation": getattr(e, "location", None)}


def verdict_udf(catalog: SchemaCatalog, uri: str, explained: bool = False, once: bool = False):
    """text -> boolean: NULL for NULL and for what can't be evaluated.

    explained: the result is a struct of ``valid`` and ``engine_error``. once: the optimizer must not
    evaluate it again in a filter that it moves.
    """
    shipped = Shipped(catalog)

    def judge(texts: list) -> tuple[list, list]:
        engine = shipped.get()
        unit, enter, parse = engine.entry(uri), engine.enter, model.parse
        out, failed = [], []
        for t in texts:
            verdict = why = None
            try:
                verdict = enter(unit, parse(t), None, False, None)
            except FAILURES as e:
                why = _failure(e) if explained else None
            out.append(verdict)
            if explained:
                failed.append(why)
        return out, failed

    if explained:

        @F.arrow_udf(f"struct<valid:boolean,engine_error:{FAILURE}>")
        def kernel(texts: pa.Array) -> pa.Array:
            own, places = _once(texts)
            out, failed = judge(own)
            return pa.StructArray.from_arrays([pa.array(out, pa.bool_()).take(places), pa.array(failed, _FAILURE).take(places)], names=["valid", "engine_error"])

    else:

        @F.arrow_udf("boolean")
        def kernel(texts: pa.Array) -> pa.Array:
            own, places = _once(texts)
            return pa.array(judge(own)[0], pa.bool_()).take(places)

    return kernel.asNondeterministic() if once else kernel


def result_udf(catalog: SchemaCatalog, uri: str, output: str | None, selection: O.Selection | None, params: bool, trace: bool, verbose: bool, fail_fast: bool, positions: bool = False):
    """text -> result struct. A row that can't be evaluated has ``engine_error``, or raises with fail_fast."""
    shipped = Shipped(catalog)

    def units(found: list, value: str) -> list:
        return [u | {value: _dump(u[value])} if value in u else u for u in found]

    def one(engine: Evaluator, text: str) -> dict:
        try:
            root = engine.record(uri, model.parse(text))
        except FAILURES as e:
            if fail_fast:
                raise
            return {"engine_error": _failure(e)}
        row: dict = {"valid": root.valid}
        if not root.valid:
            row["errors"] = units(O.errors(root, params), "params")
        elif selection is not None:
            row["annotations"] = units(O.annotations(root, selection), "annotation")
        if verbose:
            row["dropped_errors"] = units(O.errors(root, params, True), "params")
            if selection is not None:
                row["dropped_annotations"] = units(O.annotations(root, selection, True), "annotation")
        if output is not None:
            row["output_document"] = _dump(O.document(root, output, selection, verbose))
        if positions:
            _, found = parse_with_ranges(text)
            pointers = {u["inputLocation"] for k in ("errors", "annotations", "dropped_errors", "dropped_annotations") for u in row.get(k, ())}
            row["positions"] = [(p, dict(zip(("line", "column", "start"), found.place(found.values[p][0])), end=found.values[p][1])) for p in sorted(pointers) if p in found.values]
        if trace:
            row["trace"] = _dump(O.trace(root))
        return row

    @F.arrow_udf(RESULT)
    def kernel(texts: pa.Array) -> pa.Array:
        engine = shipped.get()
        own, places = _once(texts)
        return pa.array([one(engine, t) for t in own], _RESULT).take(places)

    # Else a filter on the result, given or inferred from a generator, would run the kernel again.
    return kernel.asNondeterministic()


def verdict(catalog: SchemaCatalog, uri: str, text: Column, explained: bool = False, once: bool = False) -> Column:
    return verdict_udf(catalog, uri, explained, once)(text)


def verdict_by_uri(catalog: SchemaCatalog):
    """(schema's URI, text) -> boolean; NULL for NULL and for a URI that the catalog lacks."""
    shipped = Shipped(catalog)

    @F.arrow_udf("boolean")
    def kernel(uris: pa.Array, texts: pa.Array) -> pa.Array:
        engine = shipped.get()
        units: dict[str, object] = {}
        out = []
        for u, t in zip(uris.to_pylist(), texts.to_pylist()):
            verdict = None
            if u is not None and t is not None:
                try:
                    unit = units.get(u) or units.setdefault(u, engine.entry(u))
                    verdict = engine.enter(unit, model.parse(t), None, False, None)
                except FAILURES:
                    pass
            out.append(verdict)
        return pa.array(out, pa.bool_())

    return kernel.asNondeterministic()
