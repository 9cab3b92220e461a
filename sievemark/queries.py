"""The registered queries of the engine's own operators, and the DuckDB SQL of each."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemark import engine as E
from sievemark.operators.joins import rolling
from sievemark.operators.output import Selection
from sievemark.plans.catalog import SchemaCatalog
from sievemark.sources.documents import as_documents

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
OLD = "http://json-schema.org/draft-07/schema#"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalog_of(schema: Any, dialect: str | None = None, **options) -> tuple[SchemaCatalog, str]:
    catalog = SchemaCatalog(**options)
    return catalog, catalog.register(schema, "https://queries.example/schema", dialect)


def register(name: str, sql: str | None):
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def verdicts(name: str, source: str, keys: list[str], columns: list[str], schema: Any, rule: str, tier: str = "typed", dialect: str | None = None, nulls: str = "omit", **options) -> None:
    """A query of keys and verdict over rows as documents; ``rule`` is the SQL of the verdict."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        catalog, uri = catalog_of(schema, dialect, **options)
        docs = as_documents(table(spark, sf_dir, source), keys, columns)
        if tier == "variant":
            docs = docs.withColumn("doc", F.to_variant_object("doc"))
        return E.validate(docs, catalog, uri, "doc", tier=tier, nulls=nulls).select(*keys, "valid")

    register(name, f"SELECT {', '.join(keys)}, ({rule}) AS valid FROM {source}")(run)


# ---- assertions ----
KEY = ["l_orderkey", "l_linenumber"]
verdicts("type_integer", "lineitem", KEY, ["l_quantity", "l_discount"], {"properties": {"l_quantity": {"type": "integer"}, "l_discount": {"type": ["integer", "string"]}}}, "l_discount = floor(l_discount)")
verdicts("orders_enum", "orders", ["o_orderkey"], ["o_orderstatus"], {"properties": {"o_orderstatus": {"enum": ["F", "O"]}}}, "o_orderstatus IN ('F', 'O')")
verdicts("nation_const", "nation", ["n_nationkey"], ["n_regionkey"], {"properties": {"n_regionkey": {"const": 1}}}, "n_regionkey = 1")
verdicts("qty_multiple_of", "lineitem", KEY, ["l_quantity"], {"properties": {"l_quantity": {"multipleOf": 5}}}, "l_quantity % 5 = 0")
verdicts("disc_bounds", "lineitem", KEY, ["l_discount", "l_quantity"], {"properties": {"l_discount": {"minimum": 0.02, "maximum": 0.07}, "l_quantity": {"exclusiveMinimum": 5, "exclusiveMaximum": 45}}}, "l_discount >= 0.02::DOUBLE AND l_discount <= 0.07::DOUBLE AND l_quantity > 5 AND l_quantity < 45")
verdicts("name_length", "part", ["p_partkey"], ["p_name"], {"properties": {"p_name": {"minLength": 8, "maxLength": 14}}}, "length(p_name) BETWEEN 8 AND 14")
verdicts("brand_pattern", "part", ["p_partkey"], ["p_brand"], {"properties": {"p_brand": {"pattern": "#[12]\\d$"}}}, "regexp_matches(p_brand, '#[12][0-9]$')")
verdicts("type_variant", "part", ["p_partkey"], ["p_partkey", "p_name", "p_size"], {"type": "object", "properties": {"p_name": {"type": "string"}, "p_size": {"type": "integer", "minimum": 10}}}, "p_size >= 10", "variant")
verdicts("bounds_kernel", "part", ["p_partkey"], ["p_name", "p_size", "p_retailprice"], {"properties": {"p_size": {"maximum": 25}, "p_name": {"maxLength": 14}}}, "p_size <= 25 AND length(p_name) <= 14", "kernel")
verdicts("min_max_properties", "part", ["p_partkey"], ["p_name", "p_size", "p_brand"], {"minProperties": 3, "maxProperties": 3}, "p_name IS NOT NULL AND p_size IS NOT NULL AND p_brand IS NOT NULL")

# ---- in place ----
SEGMENT = lambda *s: {"properties": {"c_mktsegment": {"enum": [*s]}}}
verdicts("one_of_segments", "customer", ["c_custkey"], ["c_mktsegment", "c_acctbal"], {"oneOf": [SEGMENT("BUILDING", "MACHINERY"), {"properties": {"c_acctbal": {"minimum": 0}}}]}, "(CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 1 ELSE 0 END + CASE WHEN c_acctbal >= 0 THEN 1 ELSE 0 END) = 1")
PRICE, OPEN = {"properties": {"o_totalprice": {"minimum": 100000}}}, {"properties": {"o_orderstatus": {"const": "O"}}}
verdicts("any_of", "orders", ["o_orderkey"], ["o_totalprice", "o_orderstatus"], {"anyOf": [PRICE, OPEN]}, "o_totalprice >= 100000 OR o_orderstatus = 'O'")
verdicts("all_of", "orders", ["o_orderkey"], ["o_totalprice", "o_orderstatus"], {"allOf": [PRICE, OPEN]}, "o_totalprice >= 100000 AND o_orderstatus = 'O'")
verdicts("not_of", "orders", ["o_orderkey"], ["o_totalprice", "o_orderstatus"], {"not": OPEN}, "o_orderstatus <> 'O'")
verdicts("if_then_else", "orders", ["o_orderkey"], ["o_totalprice", "o_orderstatus"], {"if": OPEN, "then": PRICE, "else": {"properties": {"o_totalprice": {"maximum": 200000}}}}, "CASE WHEN o_orderstatus = 'O' THEN o_totalprice >= 100000 ELSE o_totalprice <= 200000 END")
verdicts("boolean_schema", "region", ["r_regionkey"], ["r_name", "r_regionkey"], {"properties": {"r_name": True, "absent": False}, "if": {"properties": {"r_regionkey": {"maximum": 2}}}, "then": {"properties": {"r_name": False}}}, "r_regionkey > 2")
verdicts("ref_defs", "lineitem", KEY, ["l_tax", "l_discount"], {"$defs": {"rate": {"minimum": 0, "maximum": 0.05}}, "properties": {"l_tax": {"$ref": "#/$defs/rate"}, "l_discount": {"$ref": "#/$defs/rate"}}}, "l_tax BETWEEN 0 AND 0.05::DOUBLE AND l_discount BETWEEN 0 AND 0.05::DOUBLE")
verdicts("anchor_ref", "nation", ["n_nationkey"], ["n_name", "n_regionkey"], {"$defs": {"r": {"$anchor": "low", "maximum": 2}}, "properties": {"n_regionkey": {"$ref": "#low"}}}, "n_regionkey <= 2")
verdicts("dynamic_ref", "nation", ["n_nationkey"], ["n_regionkey"], {"$dynamicAnchor": "n", "$defs": {"x": {"$dynamicAnchor": "v", "minimum": 1}}, "properties": {"n_regionkey": {"$dynamicRef": "#v"}}}, "n_regionkey >= 1", "auto")
verdicts("recursive_ref", "nation", ["n_nationkey"], ["n_regionkey"], {"$schema": "https://json-schema.org/draft/2019-09/schema", "$recursiveAnchor": True, "type": ["object", "integer"], "maximum": 3, "properties": {"n_regionkey": {"$recursiveRef": "#"}}}, "n_regionkey <= 3", "auto")

# ---- objects ----
verdicts("pattern_props", "part", ["p_partkey"], ["p_name", "p_size", "p_brand"], {"patternProperties": {"^p_s": {"minimum": 20}, "d$": {"pattern": "3"}}}, "p_size >= 20 AND contains(p_brand, '3')")
verdicts("additional_props", "part", ["p_partkey"], ["p_name", "p_size", "p_brand"], {"properties": {"p_name": True}, "patternProperties": {"^p_b": True}, "additionalProperties": {"maximum": 30}}, "p_size <= 30")
verdicts("unevaluated_props", "orders", ["o_orderkey"], ["o_orderkey", "o_orderstatus"], {"properties": {"o_orderkey": True}, "anyOf": [{"properties": {"o_orderstatus": {"const": "F"}}}, {"properties": {"o_orderkey": {"minimum": 0}}}], "unevaluatedProperties": False}, "o_orderstatus = 'F'")
verdicts("unevaluated_props_kernel", "orders", ["o_orderkey"], ["o_orderkey", "o_orderstatus"], {"properties": {"o_orderkey": True}, "anyOf": [{"properties": {"o_orderstatus": {"const": "F"}}}, {"properties": {"o_orderkey": {"minimum": 0}}}], "unevaluatedProperties": False}, "o_orderstatus = 'F'", "kernel")
verdicts("dependencies_old", "customer", ["c_custkey"], ["c_acctbal", "c_mktsegment"], {"dependencies": {"c_acctbal": ["c_mktsegment"], "c_mktsegment": {"properties": {"c_acctbal": {"minimum": 1000}}}}}, "c_acctbal >= 1000", dialect=OLD)
verdicts("definitions_old", "nation", ["n_nationkey"], ["n_regionkey"], {"definitions": {"low": {"exclusiveMaximum": 3}}, "properties": {"n_regionkey": {"$ref": "#/definitions/low", "minimum": 99}}}, "n_regionkey < 3", dialect="http://json-schema.org/draft-06/schema#")

LABELS = "documents LEFT JOIN labels USING (doc_id)"


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return docs.join(table(spark, sf_dir, "labels"), "doc_id", "left")


@register("row_required", f"SELECT doc_id, quality IS NOT NULL AS valid FROM {LABELS}")
def row_required(spark, sf_dir):
    c, u = catalog_of({"required": ["lang", "quality"]})
    return E.validate(as_documents(_labelled(spark, sf_dir), ["doc_id"]), c, u, "doc", tier="typed").select("doc_id", "valid")


@register("row_dependent", f"SELECT doc_id, (quality IS NULL OR toxic IS NOT NULL) AND (toxic IS NULL OR quality = 1) AS valid FROM {LABELS}")
def row_dependent(spark, sf_dir):
    c, u = catalog_of({"dependentRequired": {"quality": ["toxic"]}, "dependentSchemas": {"toxic": {"properties": {"quality": {"const": 1}}}}})
    return E.validate(as_documents(_labelled(spark, sf_dir), ["doc_id"]), c, u, "doc", tier="typed").select("doc_id", "valid")


# ---- arrays ----
def _talks(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("t"))
    return turns.select("conv_id", F.struct(F.transform("t", lambda x: x["role"]).alias("roles")).alias("doc"))


def talks(name: str, schema: Any, rule: str, tier: str = "typed", dialect: str | None = None) -> None:
    def run(spark, sf_dir):
        c, u = catalog_of({"properties": {"roles": {k: v for k, v in schema.items() if k != "$schema"}}}, dialect)
        return E.validate(_talks(spark, sf_dir), c, u, "doc", tier=tier).select("conv_id", "valid")

    register(name, f"WITH t AS (SELECT conv_id, list(role ORDER BY turn, role) AS r FROM conversations GROUP BY conv_id) SELECT conv_id, ({rule}) AS valid FROM t")(run)


ROLE = lambda r: {"const": r}
talks("conv_items", {"items": {"enum": ["user", "assistant"]}, "minItems": 2, "maxItems": 6}, "len(list_filter(r, lambda x: x NOT IN ('user', 'assistant'))) = 0 AND len(r) BETWEEN 2 AND 6")
talks("conv_contains", {"contains": ROLE("user"), "minContains": 2, "maxContains": 3}, "len(list_filter(r, lambda x: x = 'user')) BETWEEN 2 AND 3")
talks("conv_unique", {"uniqueItems": True}, "len(list_distinct(r)) = len(r)")
talks("conv_prefix", {"prefixItems": [{"enum": ["system", "user"]}, ROLE("assistant")], "items": {"not": ROLE("system")}}, "r[1] IN ('system', 'user') AND (len(r) < 2 OR r[2] = 'assistant') AND len(list_filter(r[3:], lambda x: x = 'system')) = 0")
talks("unevaluated_items", {"prefixItems": [True], "contains": ROLE("assistant"), "unevaluatedItems": False}, "len(list_filter(r, lambda x: x = 'assistant')) >= 1 AND len(list_filter(r[2:], lambda x: x <> 'assistant')) = 0")
talks("unevaluated_items_kernel", {"prefixItems": [True], "contains": ROLE("assistant"), "unevaluatedItems": False}, "len(list_filter(r, lambda x: x = 'assistant')) >= 1 AND len(list_filter(r[2:], lambda x: x <> 'assistant')) = 0", "kernel")
talks("conv_unique_kernel", {"uniqueItems": True}, "len(list_distinct(r)) = len(r)", "kernel")

# ---- JSON text ----
PROPS = {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer", "maximum": 80}}}


def _props(tier: str, schema: Any = PROPS):
    def run(spark, sf_dir):
        c, u = catalog_of(schema)
        events = table(spark, sf_dir, "events")
        return E.validate(events, c, u, "props", tier=tier, well_formed=tier == "variant").select("event_id", "valid")

    return run


register("props_flag_kernel", "SELECT event_id, CAST(props->>'k' AS BIGINT) <= 80 AS valid FROM events")(_props("kernel"))
register("props_flag_variant", "SELECT event_id, CAST(props->>'k' AS BIGINT) <= 80 AS valid FROM events")(_props("variant"))
register("props_type_string", "SELECT event_id, json_type(props, '$.k') = 'VARCHAR' AS valid FROM events")(_props("variant", {"properties": {"k": {"type": "string"}}}))


@register("props_flag", "SELECT event_type, count(*) AS n_docs, count(*) FILTER (WHERE CAST(props->>'k' AS BIGINT) <= 80) AS n_valid FROM events GROUP BY event_type")
def props_flag(spark, sf_dir):
    c, u = catalog_of(PROPS)
    checked = E.validate(table(spark, sf_dir, "events"), c, u, "props", well_formed=True)
    return checked.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_docs"), F.count_if("valid").alias("n_valid"))


# ---- formats ----
def formats(name: str, source: str, key: str, value: Callable[[], Any], form: str, rule: str, tier: str = "typed") -> None:
    def run(spark, sf_dir):
        c, u = catalog_of({"properties": {"v": {"format": form}}}, assert_formats=True)
        docs = table(spark, sf_dir, source).select(key, F.struct(value().alias("v")).alias("doc"))
        return E.validate(docs, c, u, "doc", tier=tier).select(key, "valid")

    register(name, f"SELECT {key}, ({rule}) AS valid FROM {source}")(run)


formats("format_date", "orders", "o_orderkey", lambda: F.concat(F.lit("19"), F.lpad((F.col("o_orderkey") % 100).cast("string"), 2, "0"), F.lit("-02-"), F.lpad((F.col("o_orderkey") % 31).cast("string"), 2, "0")), "date", "o_orderkey % 31 BETWEEN 1 AND 28 OR (o_orderkey % 31 = 29 AND o_orderkey % 100 % 4 = 0 AND o_orderkey % 100 > 0)")
def examples(form: str, cases: dict[str, bool], tier: str = "auto") -> None:
    """A format over given texts, dealt to the orders in turn; which of them are valid is in the SQL."""
    texts = list(cases)
    good = ", ".join(str(n) for n, t in enumerate(texts) if cases[t])
    formats("format_" + form.replace("-", "_"), "orders", "o_orderkey", lambda: F.element_at(F.array(*map(F.lit, texts)), (F.col("o_orderkey") % len(texts) + 1).cast("int")), form, f"o_orderkey % {len(texts)} IN ({good})", tier)


examples("time", {"12:00:00Z": True, "24:00:00Z": False, "12:00:00": False, "23:59:60Z": True, "22:59:60Z": False, "12:00:00+01:30": True, "12:60:00Z": False, "01:02:03.5z": True, "1:02:03Z": False})
examples("hostname", {"example.com": True, "a-b.c1": True, "-a.com": False, "a-.com": False, "a" * 63: True, "a" * 64: False, "": False, "a..b": False, "a_b": False, "localhost": True})
examples("idn-hostname", {"münchen.de": True, "例え.テスト": True, "a b": False, "-é": False, "example.com": True, "〮a": False})
examples("idn-email", {"ü@exämple.de": True, "a@b.c": True, "a.b": False, "@b.c": False, "a b@c.d": False, '"a b"@c.d': True})
examples("ipv6", {"::1": True, "1::2::3": False, "12345::": False, "::ffff:10.0.0.1": True, "1:2:3:4:5:6:7:8": True, "1:2:3:4:5:6:7": False, "fe80::1%eth0": False, "::ffff:10.0.0.256": False})
examples("uri-reference", {"/a/b?c#d": True, "a b": False, "#x": True, "\\\\host": False, "": True, "http://[::1]/": True, "%zz": False, "a:b/c": True})
examples("iri", {"http://ƒøø.ßår/?∂=π#ƒ": True, "/a": False, "http://a b": False, "urn:ä": True})
examples("iri-reference", {"/ä/b": True, "ä#ö": True, "a b": False, "<": False})
examples("uri-template", {"/a/{b}": True, "{": False, "{+a,b*}": True, "{a:3}": True, "{a:0}": False, "{a": False, "x{?q,r}": True, "{!}": False})
examples("json-pointer", {"": True, "/a/~0~1": True, "a": False, "/a~2": False, "/": True, "/~": False})
examples("relative-json-pointer", {"0": True, "1/a": True, "01/a": False, "2#": True, "/a": False, "-1/a": False, "0##": False})
examples("regex", {"^a+$": True, "(": False, "[a-": False, "\\d{2}": True, "a**": False, "(?<n>x)\\k<n>": True})
formats("format_date_time", "orders", "o_orderkey", lambda: F.concat(F.lit("2020-01-01T"), F.lpad((F.col("o_orderkey") % 30).cast("string"), 2, "0"), F.lit(":00:00Z")), "date-time", "o_orderkey % 30 <= 23", "kernel")
formats("format_uri", "pages", "page_id", lambda: F.col("url"), "uri", "regexp_matches(url, '^https?://[A-Za-z0-9.-]+(:[0-9]+)?([/?#][^ ]*)?$')")
formats("format_uuid", "orders", "o_orderkey", lambda: F.concat(F.lit("00000000-0000-0000-0000-"), F.lpad(F.col("o_orderkey").cast("string"), 6, "0"), F.when(F.col("o_orderkey") % 2 == 0, "abcdef").otherwise("abcde")), "uuid", "o_orderkey % 2 = 0")
formats("format_ipv4", "orders", "o_orderkey", lambda: F.concat(F.lit("10.0.1."), (F.col("o_orderkey") % 400).cast("string")), "ipv4", "o_orderkey % 400 <= 255")
formats("format_email", "customer", "c_custkey", lambda: F.concat(F.lit("u"), F.col("c_custkey").cast("string"), F.when(F.col("c_custkey") % 3 == 0, "@").otherwise("."), F.lit("example.com")), "email", "c_custkey % 3 = 0", "kernel")
formats("format_duration", "orders", "o_orderkey", lambda: F.concat(F.lit("P"), F.when(F.col("o_orderkey") % 2 == 0, "").otherwise("T"), (F.col("o_orderkey") % 9).cast("string"), F.lit("D")), "duration", "o_orderkey % 2 = 0")

# ---- records ----
RECORD = {"title": "an event", "required": ["k", "z"], "properties": {"k": {"type": "integer", "maximum": 80, "not": {"multipleOf": 7}}}}
FAILS = "SELECT event_id, 'required' AS keyword FROM events UNION ALL SELECT event_id, 'maximum' FROM events WHERE CAST(props->>'k' AS BIGINT) > 80 UNION ALL SELECT event_id, 'not' FROM events WHERE CAST(props->>'k' AS BIGINT) % 7 = 0"


def _errors(spark, sf_dir) -> DataFrame:
    c, u = catalog_of(RECORD)
    return E.errors(table(spark, sf_dir, "events"), c, u, "props", ["event_id", "event_type", "user_id"])


@register("errors_by_keyword", f"SELECT keyword, count(*) AS n FROM ({FAILS}) GROUP BY keyword")
def errors_by_keyword(spark, sf_dir):
    return _errors(spark, sf_dir).groupBy("keyword").agg(F.count(F.lit(1)).alias("n"))


@register("errors_cube", f"SELECT keyword, event_type, count(*) AS n FROM ({FAILS}) JOIN events USING (event_id) GROUP BY CUBE (keyword, event_type)")
def errors_cube(spark, sf_dir):
    return _errors(spark, sf_dir).cube("keyword", "event_type").agg(F.count(F.lit(1)).alias("n"))


@register("errors_rollup", f"SELECT keyword, event_type, count(*) AS n FROM ({FAILS}) JOIN events USING (event_id) GROUP BY ROLLUP (keyword, event_type)")
def errors_rollup(spark, sf_dir):
    return _errors(spark, sf_dir).rollup("keyword", "event_type").agg(F.count(F.lit(1)).alias("n"))


@register("errors_distinct", f"SELECT event_type, count(DISTINCT keyword) AS n_keywords, count(DISTINCT event_id) AS n_docs FROM ({FAILS}) JOIN events USING (event_id) GROUP BY event_type")
def errors_distinct(spark, sf_dir):
    return _errors(spark, sf_dir).groupBy("event_type").agg(F.count_distinct("keyword").alias("n_keywords"), F.count_distinct("event_id").alias("n_docs"))


@register("first_error_per_doc", "SELECT event_id, CASE WHEN CAST(props->>'k' AS BIGINT) % 7 = 0 THEN 'not' WHEN CAST(props->>'k' AS BIGINT) > 80 THEN 'maximum' ELSE 'required' END AS keyword FROM events")
def first_error_per_doc(spark, sf_dir):
    c, u = catalog_of(RECORD)
    return E.first_errors(table(spark, sf_dir, "events"), c, u, "props", ["event_id"]).select("event_id", "keyword")


@register("error_units", f"SELECT event_id, CASE WHEN keyword = 'required' THEN '' ELSE '/k' END AS input, CASE WHEN keyword = 'required' THEN '/required' ELSE '/properties/k/' || keyword END AS path FROM ({FAILS})")
def error_units(spark, sf_dir):
    return _errors(spark, sf_dir).select("event_id", F.col("inputLocation").alias("input"), F.col("evaluationPath").alias("path"))


@register("error_locations", f"SELECT '/' || keyword AS last, count(*) AS n FROM ({FAILS}) GROUP BY keyword")
def error_locations(spark, sf_dir):
    c, u = catalog_of(RECORD)
    found = _errors(spark, sf_dir).join(E.locations(spark, c).withColumnRenamed("keyword", "named"), "schemaLocation")
    return found.groupBy(F.concat(F.lit("/"), "named").alias("last")).agg(F.count(F.lit(1)).alias("n"))


@register("top_offenders", "SELECT user_id, count(*) AS n FROM events WHERE CAST(props->>'k' AS BIGINT) > 80 GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10")
def top_offenders(spark, sf_dir):
    c, u = catalog_of(PROPS)
    bad = E.validate(table(spark, sf_dir, "events"), c, u, "props", well_formed=True).where(~F.col("valid"))
    return bad.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "user_id").limit(10)


@register("valid_anti_join", "SELECT event_id FROM events WHERE CAST(props->>'k' AS BIGINT) <= 80")
def valid_anti_join(spark, sf_dir):
    c, u = catalog_of(PROPS)
    events = table(spark, sf_dir, "events")
    return events.join(E.errors(events, c, u, "props", ["event_id"]), "event_id", "left_anti").select("event_id")


@register("invalid_semi_join", "SELECT event_id FROM events WHERE CAST(props->>'k' AS BIGINT) > 80")
def invalid_semi_join(spark, sf_dir):
    c, u = catalog_of(PROPS)
    events = table(spark, sf_dir, "events")
    return events.join(E.errors(events, c, u, "props", ["event_id"]), "event_id", "left_semi").select("event_id")


@register("annotations_by_title", "SELECT 'title' AS keyword, '\"an event\"' AS annotation, count(*) AS n FROM events WHERE CAST(props->>'k' AS BIGINT) <= 80")
def annotations_by_title(spark, sf_dir):
    c, u = catalog_of({"title": "an event", "description": "left out", "properties": {"k": {"maximum": 80}}})
    notes = E.annotations(table(spark, sf_dir, "events"), c, u, "props", ["event_id"], Selection(keywords=("title",)))
    return notes.groupBy("keyword", "annotation").agg(F.count(F.lit(1)).alias("n"))


@register("unknown_keyword_annotation", "SELECT event_id, '7' AS annotation FROM events")
def unknown_keyword_annotation(spark, sf_dir):
    c, u = catalog_of({"x-rank": 7})
    return E.annotations(table(spark, sf_dir, "events"), c, u, "props", ["event_id"]).select("event_id", "annotation")


# ---- sets, windows, SQL, plans ----
@register("schema_union", "SELECT o_orderkey FROM orders WHERE (o_totalprice >= 100000 OR o_orderstatus = 'O') AND NOT (o_totalprice >= 100000 AND o_orderstatus = 'O')")
def schema_union(spark, sf_dir):
    docs = as_documents(table(spark, sf_dir, "orders"), ["o_orderkey"], ["o_totalprice", "o_orderstatus"])
    found = []
    for s in (PRICE, OPEN):
        c, u = catalog_of(s)
        found.append(docs.where(E.predicate(c, u, docs, "doc")).select("o_orderkey"))
    return found[0].union(found[1]).distinct().exceptAll(found[0].intersect(found[1]))


@register("validity_by_window", "SELECT date_trunc('hour', ts) AS start, count(*) AS n_docs, count(*) FILTER (WHERE CAST(props->>'k' AS BIGINT) <= 80) AS n_valid FROM events GROUP BY 1")
def validity_by_window(spark, sf_dir):
    from sievemark.streaming.validation import validity_rates

    c, u = catalog_of(PROPS)
    checked = E.validate(table(spark, sf_dir, "events"), c, u, "props", well_formed=True)
    return validity_rates(checked, "ts", width="1 hour").select(F.col("window.start").alias("start"), "n_docs", "n_valid")


@register("validity_drift", "SELECT event_id, avg(CASE WHEN CAST(props->>'k' AS BIGINT) <= 80 THEN 4 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS rate FROM events")
def validity_drift(spark, sf_dir):
    c, u = catalog_of(PROPS)
    checked = E.validate(table(spark, sf_dir, "events"), c, u, "props", well_formed=True)
    return rolling(checked, ["event_type"], "ts", ["event_id"], F.when(F.col("valid"), 4).otherwise(0), 3, "rate").select("event_id", "rate")


@register("sql_function", "SELECT event_type, count(*) AS n FROM events WHERE CAST(props->>'k' AS BIGINT) <= 80 GROUP BY event_type")
def sql_function(spark, sf_dir):
    c, u = catalog_of(PROPS)
    E.register_sql(spark, c, u, "props_valid")
    table(spark, sf_dir, "events").createOrReplaceTempView("sievemark_events")
    return spark.sql("SELECT event_type, count(*) AS n FROM sievemark_events WHERE props_valid(props) GROUP BY event_type")


@register("sql_errors_function", "SELECT event_id, '/k' AS input FROM events WHERE CAST(props->>'k' AS BIGINT) > 80")
def sql_errors_function(spark, sf_dir):
    c, u = catalog_of(PROPS)
    E.register_sql(spark, c, u, "props_valid")
    table(spark, sf_dir, "events").createOrReplaceTempView("sievemark_events")
    return spark.sql("SELECT e.event_id, x.inputLocation AS input FROM sievemark_events e, LATERAL props_valid_errors(e.props) x")


@register("emitted_sql", "SELECT o_orderkey FROM orders WHERE o_totalprice >= 100000")
def emitted_sql(spark, sf_dir):
    c, u = catalog_of({"properties": {"o_totalprice": {"minimum": 100000}}})
    docs = table(spark, sf_dir, "orders").select("o_orderkey", F.struct("o_totalprice").alias("doc"))
    return docs.where(F.expr(E.to_sql(c, u, docs, "doc"))).select("o_orderkey")


@register("schemas_by_uri", "SELECT o_orderkey, o_orderstatus = 'O' AS is_open, o_totalprice >= 100000 AS is_large FROM orders")
def schemas_by_uri(spark, sf_dir):
    """Two documents of one catalog, one referring to the other, over the same rows."""
    from sievemark.sources.loaders import from_dict

    c = SchemaCatalog(loaders=[from_dict({"https://q.example/open": OPEN, "https://q.example/large": {"$ref": "price"}, "https://q.example/price": PRICE})])
    is_open, large = c.load("https://q.example/open"), c.load("https://q.example/large")
    docs = as_documents(table(spark, sf_dir, "orders"), ["o_orderkey"], ["o_totalprice", "o_orderstatus"])
    return docs.select("o_orderkey", E.predicate(c, is_open, docs, "doc").alias("is_open"), E.predicate(c, large, docs, "doc").alias("is_large"))


RECURSIVE = {"$id": "https://q.example/tree", "$dynamicAnchor": "node", "properties": {"k": {"maximum": 40}, "next": {"$dynamicRef": "#node"}}}


@register("recursive_documents", "SELECT event_id, CAST(props->>'k' AS BIGINT) <= 40 AS valid FROM events")
def recursive_documents(spark, sf_dir):
    c = SchemaCatalog()
    u = c.register(RECURSIVE)
    events = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit('{"next":{"next":'), "props", F.lit("}}")).alias("doc"))
    return E.validate(events, c, u, "doc").select("event_id", "valid")


@register("null_policy", f"SELECT doc_id, TRUE AS with_nulls, quality IS NOT NULL AS without FROM {LABELS}")
def null_policy(spark, sf_dir):
    c, u = catalog_of({"required": ["quality"]})
    docs = as_documents(_labelled(spark, sf_dir), ["doc_id"])
    return docs.select("doc_id", E.predicate(c, u, docs, "doc", nulls="null").alias("with_nulls"), E.predicate(c, u, docs, "doc", nulls="omit").alias("without"))


@register("exact_multiples", "SELECT p_partkey, p_partkey % 3 = 0 AS valid FROM part")
def exact_multiples(spark, sf_dir):
    """multipleOf beyond doubles: 0.0003 into n ten-thousandths, as JSON text."""
    c, u = catalog_of({"multipleOf": 0.0003})
    part = table(spark, sf_dir, "part").select("p_partkey", F.concat((F.col("p_partkey") / 10000).cast("decimal(20,4)").cast("string")).alias("doc"))
    return E.validate(part, c, u, "doc").select("p_partkey", "valid")
