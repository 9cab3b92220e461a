"""The DataFrame interface: the tiers agree, plans are what they should be, streams and sinks work."""

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievemark import engine as E
from sievemark.operators.kernel import Evaluator
from sievemark.operators.output import Selection
from sievemark.plans.catalog import SchemaCatalog
from sievemark.plans.errors import NeedsKernel, OutputOptionsError
from sievemark.sources import documents, loaders
from sievemark.streaming.validation import quarantine, validity_rates


def catalog_of(schema, dialect=None, **options):
    c = SchemaCatalog(**options)
    return c, c.register(schema, "https://t.example/e", dialect)


VALUES = [
    {"a": 1, "b": "x"}, {"a": 1.5}, {"a": True}, {"a": None}, {"b": "xyz"}, {}, [], [1, 2, 3], [1, "a"], [None], ["a", "b"], "text", "", 3, -1, 0.5, True, False, None,
    {"a": {"b": {"c": 1}}}, {"a": [1, 2]}, {"x1": 1, "x2": "y"}, {"a": "2020-02-30"}, {"a": 12345678901, "c": []},
]
SCHEMAS = [
    {"type": "object"}, {"type": ["array", "null"]}, {"type": "integer"}, {"type": "number"}, {"type": "boolean"}, {"type": "string", "minLength": 1},
    {"properties": {"a": {"type": "integer"}}, "required": ["a"]}, {"properties": {"a": {"enum": [1, "x", None, True]}}}, {"const": None}, {"const": 0.5}, {"enum": ["text", 3]},
    {"minimum": 0, "maximum": 2}, {"exclusiveMinimum": -1, "exclusiveMaximum": 3}, {"multipleOf": 0.5}, {"multipleOf": 2}, {"pattern": "^t"}, {"maxLength": 3},
    {"minItems": 1, "maxItems": 2}, {"items": {"type": "integer"}}, {"prefixItems": [{"type": "integer"}], "items": False}, {"contains": {"type": "string"}}, {"contains": {"type": "integer"}, "minContains": 2, "maxContains": 2},
    {"minProperties": 1, "maxProperties": 1}, {"propertyNames": {"maxLength": 1}}, {"patternProperties": {"^x": {"type": "integer"}}}, {"properties": {"a": True}, "additionalProperties": False}, {"additionalProperties": {"type": "string"}},
    {"dependentRequired": {"a": ["b"]}}, {"dependentSchemas": {"a": {"properties": {"b": {"minLength": 2}}}}}, {"if": {"required": ["a"]}, "then": {"required": ["b"]}, "else": {"type": "array"}},
    {"anyOf": [{"type": "array"}, {"required": ["b"]}]}, {"oneOf": [{"type": "object"}, {"required": ["a"]}]}, {"allOf": [{"minItems": 1}, {"minProperties": 1}]}, {"not": {"type": "object"}},
    {"$defs": {"s": {"type": "string"}}, "properties": {"b": {"$ref": "#/$defs/s"}}}, {"anyOf": [{"properties": {"a": {"type": "integer"}}, "required": ["a"]}, {"properties": {"b": True}}], "unevaluatedProperties": False},
    {"prefixItems": [True], "contains": {"type": "string"}, "unevaluatedItems": False}, {"if": {"properties": {"a": {"type": "integer"}}}, "then": {"properties": {"b": True}}, "unevaluatedProperties": False}, True, False,
]


def test_variant_columns_agree_with_the_kernel(spark):
    rows = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(VALUES)], "i int, doc string").withColumn("v", F.parse_json("doc"))
    columns, wanted = [], []
    for k, schema in enumerate(SCHEMAS):
        c, u = catalog_of(schema)
        columns.append(E.plan(c, u, F.col("v"), T.VariantType(), tier="variant").column.alias(f"s{k}"))
        wanted.append([Evaluator(c).is_valid(u, v) for v in VALUES])
    for r in rows.select("i", *columns).collect():
        for k in range(len(SCHEMAS)):
            assert r[f"s{k}"] is wanted[k][r.i], (SCHEMAS[k], VALUES[r.i])


TYPED = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType()), T.StructField("c", T.ArrayType(T.LongType())), T.StructField("d", T.DoubleType()), T.StructField("e", T.MapType(T.StringType(), T.LongType()))])
TYPED_SCHEMAS = [
    {"required": ["a", "b"]}, {"properties": {"a": {"type": "integer", "minimum": 3}}}, {"properties": {"d": {"type": "integer"}}}, {"properties": {"d": {"multipleOf": 0.5}}}, {"properties": {"b": {"pattern": "^x", "maxLength": 2}}}, {"properties": {"c": {"uniqueItems": True, "minItems": 1}}},
    {"properties": {"c": {"items": {"maximum": 3}, "contains": {"const": 1}}}}, {"properties": {"e": {"additionalProperties": {"minimum": 1}, "maxProperties": 1}}}, {"properties": {"e": {"patternProperties": {"^k": {"maximum": 1}}, "propertyNames": {"maxLength": 1}}}}, {"minProperties": 3}, {"additionalProperties": {"type": ["integer", "string"]}},
    {"properties": {"a": True, "b": True}, "anyOf": [{"properties": {"c": True}, "required": ["c"]}, {"properties": {"d": {"minimum": 0}}}], "unevaluatedProperties": False}, {"dependentRequired": {"a": ["b"]}}, {"properties": {"c": {"prefixItems": [{"minimum": 1}], "unevaluatedItems": False}}}, {"not": {"required": ["a"]}}, {"patternProperties": {"[ab]": {"type": "string"}}},
]


@pytest.mark.parametrize("nulls", ["omit", "null"])
def test_typed_columns_agree_with_the_kernel(spark, nulls):
    rows = [(1, "x", [1, 2], 1.5, {"k": 1}), (5, "xyz", [1, 1], 2.0, {"kk": 2, "z": 0}), (None, "y", [], None, {}), (3, None, None, 0.25, None), (None, None, [7], -1.0, {"k": 0}), (None,) * 5]
    df = spark.createDataFrame(rows, TYPED).select(F.monotonically_increasing_id().alias("i"), F.struct(*TYPED.names).alias("doc"))
    for schema in TYPED_SCHEMAS:
        c, u = catalog_of(schema)
        typed = E.validate(df, c, u, "doc", "typed", tier="typed", nulls=nulls)
        both = typed.withColumn("kernel", E.predicate(c, u, df, "doc", tier="kernel", nulls=nulls))
        assert [(r.typed, r.kernel) for r in both.collect() if r.typed != r.kernel] == [], schema


scalars = st.none() | st.booleans() | st.integers(-5, 5) | st.sampled_from([0.5, 1.0, 2.5]) | st.sampled_from(["", "a", "ab", "b"])
values = st.recursive(scalars, lambda x: st.lists(x, max_size=3) | st.dictionaries(st.sampled_from("abc"), x, max_size=3), max_leaves=8)
leaves = st.sampled_from([{"type": "integer"}, {"type": "string"}, {"minimum": 1}, {"maxLength": 1}, {"minItems": 1}, {"required": ["a"]}, {"const": 1}, {"multipleOf": 2}, True, False, {"enum": ["a", None, 1]}])
schemas = st.recursive(leaves, lambda s: st.fixed_dictionaries({}, optional={"properties": st.dictionaries(st.sampled_from("abc"), s, max_size=2), "items": s, "not": s, "anyOf": st.lists(s, min_size=1, max_size=2), "allOf": st.lists(s, min_size=1, max_size=2), "oneOf": st.lists(s, min_size=1, max_size=2), "if": s, "then": s, "else": s, "contains": s, "additionalProperties": s, "unevaluatedProperties": st.just(False), "prefixItems": st.lists(s, min_size=1, max_size=2), "unevaluatedItems": st.just(False)}), max_leaves=6)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(schema=schemas, batch=st.lists(values, min_size=20, max_size=40))
def test_fuzz(spark, schema, batch):
    c, u = catalog_of(schema)
    engine = Evaluator(c)
    wanted = [engine.is_valid(u, v) for v in batch]
    assert [engine.record(u, v).valid for v in batch] == wanted
    rows = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(batch)], "i int, doc string").select("i", F.parse_json("doc").alias("v"))
    try:
        column = E.plan(c, u, F.col("v"), T.VariantType(), tier="variant").column
    except NeedsKernel:
        return
    found = {r.i: r.valid for r in rows.select("i", column.alias("valid")).collect()}
    assert [found[i] for i in range(len(batch))] == wanted


HAZARDS = ['{"a":1,"a":2}', '{"a":2} x', '{"a":' + "9" * 42 + "}", '{"a":1e400}', '{"a":NaN}', "[" * 1100 + "]" * 1100, '{"b":1,"a":2}', None, "", "null", '{"a":2.0}']


def test_hazards(spark):
    c, u = catalog_of({"properties": {"a": {"const": 2}}})
    df = spark.createDataFrame([(i, t) for i, t in enumerate(HAZARDS)], "i int, doc string")
    found = {r.i: r.valid for r in E.validate(df, c, u, "doc").collect()}
    assert [found[i] for i in range(len(HAZARDS))] == [True, None, False, None, None, None if found[5] is None else True, True, None, None, True, True]
    kinds = {r.i: r.e for r in E.evaluate(df, c, u, "doc").select("i", F.col("result.engine_error.class").alias("e")).collect()}
    assert kinds[0] is None and kinds[1] == "JSONDecodeError" and kinds[3] == "ValueError"


def test_tier_census(spark):
    """Which tier serves which schema; a change here is a change of speed."""
    df = spark.createDataFrame([(1, '{"a":1}')], "i int, doc string").select("i", "doc", F.struct("i").alias("s"), F.parse_json("doc").alias("v"))
    tier = lambda schema, doc, **o: E.explain(*catalog_of(schema, assert_formats=True), df, doc, **o).split(":")[0]
    assert tier({"type": "object"}, "doc") == "kernel" and tier({"type": "object"}, "doc", well_formed=True) == "variant"
    assert tier({"type": "object"}, "v") == "variant" and tier({"type": "object"}, "s") == "typed"
    assert tier({"properties": {"i": {"$ref": "#"}}}, "s") == "kernel" and tier({"format": "email"}, "v") == "kernel" and tier({"format": "uuid"}, "v") == "variant"
    assert tier({"enum": [[1]]}, "v") == "kernel" and tier({"$dynamicRef": "#"}, "v") == "kernel"


def test_typed_predicates_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).select("id", (F.col("id") % 7).alias("k"), F.lit("x").alias("wide")).write.parquet(path)
    df = spark.read.parquet(path).select("id", F.struct("k").alias("doc"))
    c, u = catalog_of({"required": ["k"], "properties": {"k": {"minimum": 5}}})
    plan = df.where(E.predicate(c, u, df, "doc"))._jdf.queryExecution().executedPlan().toString()
    assert "wide" not in plan and "Python" not in plan and "Exchange" not in plan
    assert df.where(E.predicate(c, u, df, "doc")).count() == 28


def test_records(spark):
    c, u = catalog_of({"title": "t", "required": ["b"], "properties": {"a": {"maximum": 3}}})
    df = spark.createDataFrame([(1, '{"a":5}'), (2, '{"a":1,"b":2}')], "i int, doc string")
    found = E.errors(df, c, u, "doc", ["i"]).orderBy("error_index").collect()
    assert [(r.i, r.keyword, r.inputLocation, json.loads(r.params)) for r in found] == [(1, "maximum", "/a", {"limit": 3, "value": 5}), (1, "required", "", {"missing": ["b"]})]
    notes = E.annotations(df, c, u, "doc", ["i"], Selection(keywords=("title",))).collect()
    assert [(r.i, json.loads(r.annotation)) for r in notes] == [(2, "t")]
    out = E.evaluate(df, c, u, "doc", output="list", verbose=True, trace=True, annotations=True).orderBy("i").select("result.*").collect()
    assert json.loads(out[0].output_document)["valid"] is False and json.loads(out[1].trace)["valid"] and out[1].errors is None
    with pytest.raises(OutputOptionsError):
        E.evaluate(df, c, u, "doc", output="flag", trace=True)
    assert E.locations(spark, c).where("keyword = 'maximum'").count() == 1


def test_custom_keywords_and_formats(spark):
    vocabulary, dialect = "https://t.example/vocab", "https://t.example/dialect"
    core = "https://json-schema.org/draft/2020-12/vocab/"
    E.register_keyword("test-even", lambda v, unit: lambda x, f: not v or type(x) is not int or x % 2 == 0, lambda v, x: E.F.coalesce(~x.is_kind("integer") | (x.number() % 2 == 0), E.F.lit(True)) if v else E.F.lit(True))
    c = SchemaCatalog(assert_formats=True)
    c.register_vocabulary(vocabulary, {"even": "test-even"})
    c.register_dialect(dialect, [core + "core", core + "applicator", core + "format-assertion", vocabulary])
    c.register_format("short", lambda s: len(s) < 3)
    u = c.register({"$schema": dialect, "properties": {"a": {"even": True}}}, "https://t.example/k")
    w = c.register({"$schema": dialect, "properties": {"b": {"format": "short"}}}, "https://t.example/w")
    df = spark.createDataFrame([(0, '{"a":2,"b":"xx"}'), (1, '{"a":3,"b":"xxx"}')], "i int, doc string")
    for options in ({"tier": "kernel"}, {"tier": "variant", "well_formed": True}):
        assert [r.valid for r in E.validate(df, c, u, "doc", **options).orderBy("i").collect()] == [True, False]
    assert [r.valid for r in E.validate(df, c, w, "doc", well_formed=True).orderBy("i").collect()] == [True, False]


def test_positions_in_results(spark):
    c, u = catalog_of({"properties": {"a": {"maximum": 3}}})
    df = spark.createDataFrame([('{\n  "a": 5}',)], "doc string")
    found = E.evaluate(df, c, u, "doc", positions=True).first().result.positions
    assert {k: tuple(v) for k, v in found.items()} == {"/a": (2, 8, 9, 10)}


def test_sql_surface(spark):
    c, u = catalog_of({"properties": {"a": {"maximum": 3}}})
    E.register_sql(spark, c, u, "t_valid")
    assert spark.sql("""SELECT t_valid('{"a":1}') AS x, t_valid('{"a":4}') AS y, t_valid(NULL) AS z""").first()[:] == (True, False, None)
    assert [r.inputLocation for r in spark.sql("""SELECT * FROM t_valid_errors('{"a":4}')""").collect()] == ["/a"]
    df = spark.createDataFrame([(1,), (5,), (None,)], "a int").select(F.struct("a").alias("doc"))
    assert df.where(F.expr(E.to_sql(c, u, df, "doc"))).count() == 2
    with pytest.raises(NeedsKernel):
        E.to_sql(*catalog_of({"additionalProperties": {"$ref": "#"}}), df, "doc")


def test_streams_and_sinks(spark, tmp_path):
    source, shared = str(tmp_path / "in"), str(tmp_path / "cp")
    spark.createDataFrame([("2024-01-01 00:01:00", '{"k":1}'), ("2024-01-01 00:02:00", '{"k":9}'), ("2024-01-01 00:11:00", "{"), ("2024-01-01 00:12:00", '{"k":2}')], "ts string, doc string").select(F.to_timestamp("ts").alias("ts"), "doc").write.parquet(source)
    c, u = catalog_of({"properties": {"k": {"maximum": 5}}})
    stream = spark.readStream.schema("ts timestamp, doc string").parquet(source)
    quarantine(stream, c, u, "doc", str(tmp_path / "good"), str(tmp_path / "bad"), shared + "1").awaitTermination()
    assert spark.read.parquet(str(tmp_path / "good")).count() == 2 and spark.read.parquet(str(tmp_path / "bad")).count() == 2
    rates = validity_rates(E.validate(stream, c, u, "doc"), "ts")
    rates.writeStream.format("memory").queryName("t_rates").outputMode("complete").option("checkpointLocation", shared + "2").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.n_docs, r.n_valid) for r in spark.table("t_rates").collect()) == [(2, 1), (2, 1)]


def test_sources_and_loaders(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "a.json").write_text('{"$ref": "b.json"}')
    (tmp_path / "s" / "b.json").write_text('{"minimum": 3}')
    (tmp_path / "lines").write_text('{"b":1,"a":2}\n[1]\n')
    c = SchemaCatalog(loaders=[loaders.from_folder(spark, "https://t.example/f/", str(tmp_path / "s"))])
    u = c.load("https://t.example/f/a.json")
    df = spark.createDataFrame([("3",), ("2",)], "doc string")
    assert [r.valid for r in E.validate(df, c, u, "doc").collect()] == [True, False]
    assert [r.doc for r in documents.json_lines(spark, str(tmp_path / "lines")).collect()] == ['{"b":1,"a":2}', "[1]"]
    assert documents.json_files(spark, str(tmp_path / "s")).count() == 2
    stored = spark.createDataFrame([("https://t.example/x", '{"type": "null"}')], "uri string, schema string")
    assert SchemaCatalog(loaders=[loaders.from_table(stored)]).load("https://t.example/x") == "https://t.example/x"
    checked = E.validate(df, c, u, "doc")
    documents.write_split(checked, "valid", str(tmp_path / "good"), str(tmp_path / "bad"))
    assert spark.read.parquet(str(tmp_path / "good")).count() == spark.read.parquet(str(tmp_path / "bad")).count() == 1


def test_entry_and_queries(spark):
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert {r.event_type for r in entry.entry(spark).collect()} == {"click", "error", "purchase", "signup", "view"}
