"""The DataFrame interface: verdicts, errors, annotations and output documents of documents in a column.

Documents are typed columns (structs, maps, arrays, scalars), VARIANT, or JSON text. The planner picks
the tier for each schema and input: Column expressions over typed columns or VARIANT where they are
faithful, else the Arrow kernel over JSON text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievemark.functions import model
from sievemark.functions import uri as uris
from sievemark.operators import output as O
from sievemark.operators import udf
from sievemark.operators.columns import COLUMN_BEHAVIOURS, Builder, Variant, accessor, compile_columns, json_ready, let
from sievemark.operators.kernel import register_behaviour
from sievemark.plans.catalog import SchemaCatalog
from sievemark.plans.errors import NeedsKernel


#: Schema positions of one expression; larger schemas go to the kernel, with the same verdicts.
MOST_UNITS = 400


@dataclass(frozen=True)
class Plan:
    """The tier of a schema over an input (typed, variant or kernel), and why it isn't a lower one."""

    tier: str
    reason: str | None
    column: Column | None


def _as_text(column: Column, kind: T.DataType, nulls: str) -> Column:
    """The JSON text of a typed or VARIANT value; it says what every tier takes the value for."""
    if isinstance(kind, T.StringType):
        return column
    if isinstance(kind, T.VariantType):
        return F.to_json(column)
    ready = json_ready(column, kind)
    if isinstance(kind, (T.StructType, T.MapType, T.ArrayType)):
        return F.to_json(ready, {"ignoreNullFields": "true" if nulls == "omit" else "false"})
    return F.when(column.isNotNull(), F.regexp_replace(F.to_json(F.struct(ready.alias("v")), {"ignoreNullFields": "false"}), r'^\{"v":|\}$', ""))


def plan(catalog: SchemaCatalog, uri: str, column: Column, kind: T.DataType, text: bool = True, well_formed: bool = False, nulls: str = "omit", tier: str = "auto") -> Plan:
    """Chooses the tier.

    text: a string column holds JSON text (else it is a JSON string itself). well_formed: the text is
    known to be JSON without repeated members and with numbers of 38 digits at most, so VARIANT may be
    used for it. tier: auto, or one that must be used. The tiers agree; they differ in speed only.
    """
    is_text = isinstance(kind, T.StringType) and text
    reason = None
    if tier != "kernel":
        try:
            if is_text and not well_formed:
                raise NeedsKernel("text that isn't known to be well formed")
            if is_text or isinstance(kind, T.VariantType):
                value = F.try_parse_json(column) if is_text else column
                return Plan("variant", None, let(value, lambda v: F.when(v.isNotNull(), compile_columns(catalog, uri, Variant(v, True), most=MOST_UNITS))))
            return Plan("typed", None, F.when(column.isNotNull(), compile_columns(catalog, uri, accessor(column, kind, nulls), most=MOST_UNITS)))
        except NeedsKernel as e:
            if tier != "auto":
                raise
            reason = str(e)
    return Plan("kernel", reason, udf.verdict(catalog, uri, column if is_text else _as_text(column, kind, nulls)))


def predicate(catalog: SchemaCatalog, uri: str, df: DataFrame, doc: str, **options) -> Column:
    """The verdict of the schema over column ``doc`` of ``df``: usable in filters, NULL for NULL."""
    return plan(catalog, uri, F.col(doc), df.schema[doc].dataType, **options).column


def explain(catalog: SchemaCatalog, uri: str, df: DataFrame, doc: str, **options) -> str:
    """The tier of the schema over a column, with the reason where it is the kernel."""
    found = plan(catalog, uri, F.col(doc), df.schema[doc].dataType, **options)
    return found.tier + (f": {found.reason}" if found.reason else "")


def census(catalog: SchemaCatalog, uri: str) -> list[tuple[str, str, str | None]]:
    """(location, form, reason) of every schema position that ``uri`` reaches: column, or kernel and why.

    A position has a form of its own: it is a column if it could be one as a schema over VARIANT.
    """
    out = []
    for target in catalog.positions(uri):
        try:
            Builder(catalog, MOST_UNITS).schema(target, Variant(F.col("doc"), True))
            out.append((target.location, "column", None))
        except NeedsKernel as e:
            out.append((target.location, "kernel", str(e)))
    return sorted(out)


def validate(df: DataFrame, catalog: SchemaCatalog, uri: str, doc: str, into: str = "valid", errors_into: str | None = None, **options) -> DataFrame:
    """``df`` with the verdict; NULL for NULL, and for what can't be evaluated.

    ``errors_into`` names a column for why a document can't be (class, message, schemaLocation). Text that
    VARIANT refuses goes to the kernel, row by row in the same pass: a table is read once, each text is
    parsed once for VARIANT, and the kernel runs once.
    """
    kind = df.schema[doc].dataType
    found = plan(catalog, uri, F.col(doc), kind, **options)
    is_text = isinstance(kind, T.StringType) and options.get("text", True)
    if found.tier == "typed" or (found.tier == "variant" and not is_text):
        out = df.withColumn(into, found.column)
        return out.withColumn(errors_into, F.lit(None).cast(udf.FAILURE)) if errors_into else out
    (held,) = _unused(df, "_verdict")
    if found.tier == "variant":
        rest = F.when(F.col(held).isNull(), F.col(doc))
        own, base = udf.verdict(catalog, uri, rest, explained=bool(errors_into), once=True), df.withColumn(held, found.column)
        (kept,) = _unused(base, "_kernel")
        base = base.withColumn(kept, own)
        valid = F.coalesce(held, F.col(f"{kept}.valid") if errors_into else F.col(kept))
    else:
        text = F.col(doc) if is_text else _as_text(F.col(doc), kind, options.get("nulls", "omit"))
        kept, base = held, df.withColumn(held, udf.verdict(catalog, uri, text, explained=bool(errors_into), once=True))
        valid = F.col(f"{kept}.valid") if errors_into else F.col(kept)
    out = base.withColumn(into, valid)
    return (out.withColumn(errors_into, F.col(f"{kept}.engine_error")) if errors_into else out).drop(held, kept)


def _unused(df: DataFrame, stem: str) -> list[str]:
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem = "_" + stem
    return [stem]


def evaluate(
    df: DataFrame, catalog: SchemaCatalog, uri: str, doc: str, into: str = "result", output: str | None = None, annotations: bool | O.Selection = False, error_params: bool = False, trace: bool = False, verbose: bool | None = None, fail_fast: bool = False, nulls: str = "omit", text: bool = True, positions: bool = False
) -> DataFrame:
    """``df`` with the whole result; options that the output can't honour are refused here.

    ``positions`` maps the input locations of the result's units to places in the document's text.
    """
    O.admit(output or "basic", bool(annotations), error_params, trace, verbose, positions)
    selection = annotations if isinstance(annotations, O.Selection) else O.EVERYTHING if annotations else None
    kind = df.schema[doc].dataType
    column = F.col(doc) if text or not isinstance(kind, T.StringType) else F.to_json(F.col(doc))
    run = udf.result_udf(catalog, uri, output, selection, error_params, trace, bool(verbose), fail_fast, positions)
    return df.withColumn(into, run(_as_text(column, kind, nulls)))


def errors(df: DataFrame, catalog: SchemaCatalog, uri: str, doc: str, keys: list[str], **options) -> DataFrame:
    """One row per error: ``keys`` and the error unit's fields. Only invalid documents reach the kernel's records.

    A document that can't be evaluated has one row too, with its failure's class in ``engine_error`` and
    its message in ``error``; no keyword found it.
    """
    known = plan(catalog, uri, F.col(doc), df.schema[doc].dataType, nulls=options.get("nulls", "omit"))
    bad = df if known.tier == "kernel" else df.where(F.col(doc).isNotNull() & ~F.coalesce(known.column, F.lit(False)))
    found = evaluate(bad.select(*keys, doc), catalog, uri, doc, "_r", error_params=True, **options)
    names = ["evaluationPath", "schemaLocation", "inputLocation", "error", "keyword", "vocabulary", "params"]
    none = F.lit(None).cast("string")
    own = F.transform("_r.errors", lambda e: F.struct(*[e[n].alias(n) for n in names], none.alias("engine_error")))
    broken = F.col("_r.engine_error")
    failed = F.array(F.struct(F.lit("").alias("evaluationPath"), broken["schemaLocation"].alias("schemaLocation"), F.lit("").alias("inputLocation"), broken["message"].alias("error"), none.alias("keyword"), none.alias("vocabulary"), none.alias("params"), broken["class"].alias("engine_error")))
    every = F.when(broken.isNotNull(), failed).otherwise(own)
    return found.select(*keys, F.posexplode(every).alias("error_index", "_e")).select(*keys, "error_index", "_e.*")


def first_errors(df: DataFrame, catalog: SchemaCatalog, uri: str, doc: str, keys: list[str], **options) -> DataFrame:
    """The first error of each invalid document, without an exchange: it is the head of the document's own list."""
    found = evaluate(df.select(*keys, doc), catalog, uri, doc, "_r", error_params=True, **options)
    return found.select(*keys, F.get("_r.errors", F.lit(0)).alias("_e")).where("_e is not null").select(*keys, "_e.*")


def annotations(df: DataFrame, catalog: SchemaCatalog, uri: str, doc: str, keys: list[str], selection: O.Selection = O.EVERYTHING, **options) -> DataFrame:
    """One row per annotation of valid documents."""
    found = evaluate(df.select(*keys, doc), catalog, uri, doc, "_r", annotations=selection, **options)
    return found.select(*keys, F.posexplode("_r.annotations").alias("annotation_index", "_a")).select(*keys, "annotation_index", "_a.*")


def validate_by_uri(df: DataFrame, catalog: SchemaCatalog, doc: str, uri_col: str, into: str = "valid", **options) -> DataFrame:
    """``df`` with the verdict of the schema that each row names; NULL where the catalog has no such schema.

    One pass: each row's schema is chosen by a conditional over the catalog's documents, all of which are
    on the driver, so rows of many schemas need no split and no shuffle.
    """
    kind = df.schema[doc].dataType
    plans = {u: plan(catalog, u, F.col(doc), kind, **options) for u in sorted(catalog.documents)}
    verdict = F.lit(None).cast("boolean")
    kernel = [u for u, p in plans.items() if p.tier == "kernel"]
    if kernel:
        text = F.col(doc) if isinstance(kind, T.StringType) and options.get("text", True) else _as_text(F.col(doc), kind, options.get("nulls", "omit"))
        named = F.when(F.col(uri_col).isin(kernel), text)
        verdict = udf.verdict_by_uri(catalog)(F.col(uri_col), named)
    for u, p in plans.items():
        if p.tier != "kernel":
            verdict = F.when(F.col(uri_col) == u, p.column).otherwise(verdict)
    return df.withColumn(into, verdict)


def locations(spark: SparkSession, catalog: SchemaCatalog) -> DataFrame:
    """A dimension of schema locations: schemaLocation, document, resource, pointer, keyword."""
    rows = []
    for r in catalog.resources.values():
        stack: list[tuple[str, object]] = [("", r.root)]
        while stack:
            pointer, node = stack.pop()
            rows.append((f"{r.uri}#{uris.encoded(pointer)}", r.document, r.uri, r.pointer + pointer, pointer.rsplit("/", 1)[-1] if pointer else None))
            items = node.items() if isinstance(node, dict) else enumerate(node) if isinstance(node, list) else ()
            stack += [(f"{pointer}/{model.escape(str(k))}", v) for k, v in items if not (isinstance(v, dict) and isinstance(v.get("$id"), str) and v is not r.root)]
    return spark.createDataFrame(rows, "schemaLocation string, document string, resource string, pointer string, keyword string")


def to_sql(catalog: SchemaCatalog, uri: str, df: DataFrame, doc: str, **options) -> str:
    """The verdict as a Spark SQL expression over ``df``'s columns; refuses what needs the kernel."""
    found = plan(catalog, uri, F.col(doc), df.schema[doc].dataType, **options)
    if found.tier == "kernel":
        raise NeedsKernel(found.reason or "the kernel was asked for", uri)
    return df.select(found.column)._jdf.queryExecution().analyzed().expressions().head().sql()


def register_keyword(name: str, kernel_fn, column_fn=None) -> None:
    """A custom keyword behaviour for vocabularies: ``kernel_fn(value, unit)`` returns ``check(instance, frame)``;
    ``column_fn(value, accessor)`` returns a Column that is never NULL, for schemas that stay Columns."""
    register_behaviour(name, kernel_fn)
    if column_fn is not None:
        COLUMN_BEHAVIOURS[name] = column_fn


def register_sql(spark: SparkSession, catalog: SchemaCatalog, uri: str, name: str) -> None:
    """``name(text)`` is the verdict and ``name_errors(text)`` a table function of errors, in SQL."""
    spark.udf.register(name, udf.verdict_udf(catalog, uri))
    spec = catalog.spec()

    @F.udtf(returnType="evaluationPath string, schemaLocation string, inputLocation string, error string")
    class Errors:
        def eval(self, text: str):
            if text is not None:
                try:
                    found = O.errors(udf.evaluator(spec).record(uri, model.parse(text)))
                except udf.FAILURES as e:
                    found = [{"evaluationPath": "", "schemaLocation": getattr(e, "location", None), "inputLocation": "", "error": str(e)}]
                for u in found:
                    yield u["evaluationPath"], u["schemaLocation"], u["inputLocation"], u["error"]

    spark.udtf.register(f"{name}_errors", Errors)
