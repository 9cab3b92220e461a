"""One rule: the typed, VARIANT and kernel tiers never disagree, and a table is read and judged once."""

import json
import math
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievemark import engine as E
from sievemark.functions import model
from sievemark.operators.columns import json_ready
from sievemark.plans.catalog import SchemaCatalog


def catalog_of(schema, dialect=None, **options):
    c = SchemaCatalog(**options)
    return c, c.register(schema, "https://t.example/e", dialect)


EDGES = [0.0, -0.0, 1.0, 0.1, 0.3, 0.30000000001, 1e-11, 1e20, 1e23, 8.41e21, 2e23, 1.7976931348623157e308, 5e-324, 2.0**53, 2.0**53 + 2, -(2.0**63), 123456789.125, 1e15, 1e16 + 2, 0.0075, 99999999999999.95, math.nan, math.inf, -math.inf, None]
LONGS = [0, 1, -7, 2**53 - 1, 2**53, 2**53 + 1, 2**63 - 1, -(2**63), 10**18, 35, None]
WIDE = [Decimal(0), Decimal(2**53 + 1), Decimal(10) ** 30 + 1, Decimal(-(10**37)), Decimal(35), None]
CENTS = [Decimal("0.10"), Decimal("5.00"), Decimal("123456789012345678.01"), Decimal("-0.30"), None]
NUMBER_SCHEMAS = [
    {"maximum": 2**53}, {"exclusiveMaximum": 2**53 + 1}, {"minimum": 0.1}, {"exclusiveMinimum": 10**30}, {"maximum": 0.3, "exclusiveMinimum": -(2**63)},
    {"multipleOf": 0.1}, {"multipleOf": 5}, {"multipleOf": 0.0025}, {"multipleOf": 3e24}, {"multipleOf": 1e-8},
    {"const": 0.1}, {"const": 2**53 + 1}, {"const": 10**20}, {"const": 35.0}, {"type": "integer"}, {"type": ["null", "string"]}, {"enum": [0.1, "a", 2**53 + 1, None, 5]},
]


def agree(spark, rows, kind, schemas, nulls="omit", variant=True):
    """Verdicts of all tiers for each value as a member v, column by column."""
    df = spark.createDataFrame([(i, (v,)) for i, v in enumerate(rows)], T.StructType([T.StructField("i", T.IntegerType()), T.StructField("doc", T.StructType([T.StructField("v", kind)]))]))
    ready = json_ready(F.col("doc"), df.schema["doc"].dataType)
    df = df.withColumn("text", F.to_json(ready, {"ignoreNullFields": "true" if nulls == "omit" else "false"}))
    df = df.withColumn("var", F.parse_json("text")).withColumn("obj", F.to_variant_object(ready))
    many = {f"p{k}": True for k in range(70)}
    columns, names = [], []
    for n, schema in enumerate(schemas):
        c, u = catalog_of({"properties": {"v": schema}})
        big, w = catalog_of({"properties": {"v": schema} | many})
        tiers = {"typed": E.predicate(c, u, df, "doc", tier="typed", nulls=nulls), "kernel": E.predicate(c, u, df, "text", tier="kernel")}
        if variant and n % 2 == 0:
            tiers |= {"variant": E.predicate(c, u, df, "var", tier="variant"), "large": E.predicate(big, w, df, "var"), "forced": E.predicate(c, u, df, "var", tier="kernel")}
            if nulls == "null":
                tiers["object"] = E.predicate(c, u, df, "obj", tier="variant")
        columns += [x.alias(f"{t}_{n}") for t, x in tiers.items()]
        names.append([f"{t}_{n}" for t in tiers])
    df, out, at = df.persist(), [], 0
    for k in range(0, len(schemas), 6):  # a few at a time: compiling code is what takes time
        own = names[k : k + 6]
        width = sum(map(len, own))
        for r in df.select("text", *columns[at : at + width]).collect():
            out += [(schemas[k + n], r.text, {x: r[x] for x in some}) for n, some in enumerate(own) if len({r[x] for x in some}) > 1]
        at += width
    df.unpersist()
    assert out == []


@pytest.mark.parametrize("nulls", ["omit", "null"])
def test_doubles(spark, nulls):
    g = random.Random(4)
    some = NUMBER_SCHEMAS if nulls == "omit" else NUMBER_SCHEMAS[-6:]
    more = [g.choice([g.uniform(-100, 100), round(g.uniform(-9, 9), g.randrange(6)), g.uniform(0, 1e18), g.randrange(2**60) * 1.0, math.ldexp(g.random(), g.randrange(-60, 90))]) for _ in range(40 if nulls == "omit" else 5)]
    agree(spark, EDGES + more, T.DoubleType(), some, nulls)


def test_floats(spark):
    agree(spark, [0.1, 0.5, 3.4e38, 1e-11, 16777216.0, math.nan, None, 35.0], T.FloatType(), NUMBER_SCHEMAS[2:14])


def test_whole_numbers(spark):
    agree(spark, LONGS, T.LongType(), NUMBER_SCHEMAS)


def test_decimals(spark):
    agree(spark, WIDE, T.DecimalType(38, 0), NUMBER_SCHEMAS)
    agree(spark, CENTS, T.DecimalType(20, 2), NUMBER_SCHEMAS[2:8])


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_times_in_any_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    schemas = [{"const": "2020-01-01T00:00:00.000000Z"}, {"pattern": "Z$"}, {"maxLength": 27}, {"minLength": 27}, {"type": "string"}, {"enum": ["2024-11-03T05:30:00.500000Z", "2024-03-10T02:30:00.000000", "2020-01-01"]}, {"format": "date-time"}]
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.sql("SELECT i, struct(t AS v) AS t, struct(cast(t AS timestamp_ntz) AS v) AS n, struct(cast(t AS date) AS v) AS d FROM VALUES (0, timestamp'2020-01-01T00:00:00Z'), (1, timestamp'2024-11-03T05:30:00.5Z'), (2, timestamp'2024-11-03T06:30:00.5Z'), (3, timestamp'2024-03-10T02:30:00.000001Z'), (4, NULL) v(i, t)")
        gap = spark.sql("SELECT 5 AS i, struct(timestamp_ntz'2024-03-10 02:30:00' AS v) AS n")
        for schema in schemas:
            c, u = catalog_of({"properties": {"v": schema}})
            for name in ("t", "n", "d"):
                rows = df if name != "n" else df.select("i", "n").union(gap)
                found = rows.select("i", E.predicate(c, u, rows, name, tier="typed").alias("typed"), E.predicate(c, u, rows, name, tier="kernel").alias("kernel")).collect()
                assert [r for r in found if r.typed != r.kernel] == [], (schema, name)
        c, u = catalog_of({"properties": {"v": schemas[0]}})
        assert [r.valid for r in E.validate(df, c, u, "t", tier="typed").orderBy("i").collect()] == [True, False, False, False, True]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_multiples_by_brute_force(spark):
    """The Column against exact decimals, for doubles of every size."""
    g = random.Random(9)
    values = [x for x in EDGES if x is not None and math.isfinite(x)] + [float(f"{g.randrange(1, 10**g.randrange(1, 18))}e{g.randrange(-25, 30)}") for _ in range(400)]
    steps = [0.1, 0.01, 0.25, 3, 5, 1e-7, 7e10, 2.5e15, 1e20]
    df = spark.createDataFrame([(i, (x,)) for i, x in enumerate(values)], "i int, doc struct<v:double>")
    columns = []
    for n, step in enumerate(steps):
        c, u = catalog_of({"properties": {"v": {"multipleOf": step}}})
        columns.append(E.predicate(c, u, df, "doc", tier="typed").alias(f"s{n}"))
    for r in df.select("i", *columns).collect():
        for n, step in enumerate(steps):
            assert r[f"s{n}"] is model.is_multiple(values[r.i], step), (values[r.i], step)


def test_malformed_values(spark):
    df = spark.createDataFrame([(1, (5, "x"))], "i int, s struct<a:int,b:string>").withColumn("v", F.to_variant_object("s"))
    for schema in ({"dependentRequired": 5}, {"properties": 5}, {"patternProperties": 5}, {"dependentSchemas": []}, {"required": 5}, {"prefixItems": 5}, {"enum": 5}, {"maxLength": "a"}, {"multipleOf": "a"}, {"pattern": 5}, {"$ref": 5}, {"allOf": 5}, {"type": 5}):
        c, u = catalog_of(schema)
        found = df.select(*[E.predicate(c, u, df, d, tier=t).alias(f"{d}{t}") for d, t in (("s", "typed"), ("v", "variant"), ("s", "kernel"), ("v", "auto"))]).first()
        assert len(set(found)) == 1, (schema, found)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_one_pass(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(i, f'{{"k": {i}}}' if i % 5 else '{"k":1,"k":2}') for i in range(50)], "i int, doc string").write.parquet(path)
    df = spark.read.parquet(path)
    c, u = catalog_of({"required": ["k", "z"], "properties": {"k": {"type": "integer", "maximum": 30}}})
    for out in (E.errors(df, c, u, "doc", ["i"]).groupBy("keyword").count(), E.annotations(df, c, u, "doc", ["i"]), E.first_errors(df, c, u, "doc", ["i"]), E.validate(df, c, u, "doc").where("not valid"), E.validate(df, c, u, "doc", errors_into="why").where("valid")):
        assert _plan(out).count("ArrowEvalPython") == 1 and _plan(out).count("FileScan") == 1, _plan(out)
    d, w = catalog_of({"properties": {"k": {"type": "integer", "maximum": 30, "minimum": 2}}})
    checked = E.validate(df, d, w, "doc", well_formed=True, tier="variant")
    plan = _plan(checked)
    assert plan.count("FileScan") == 1 and plan.count("ArrowEvalPython") == 1 and plan.count("parse_json") <= 1, plan
    wanted = {r.i: r.valid for r in E.validate(df, d, w, "doc").collect()}
    assert {r.i: r.valid for r in checked.collect()} == wanted  # repeated members go to the kernel
    assert checked.where("valid").count() == sum(bool(v) for v in wanted.values())


def test_failures_are_rows(spark):
    c = SchemaCatalog()
    u = c.register({"$id": "https://t.example/l", "$defs": {"loop": {"$ref": "#/$defs/loop"}}, "properties": {"next": {"$ref": "#"}, "x": {"$ref": "#/$defs/loop"}, "k": {"maximum": 0}}})
    docs = ['{"k":0}', '{"k":1}', "{bad", '{"next":' * 700 + "{}" + "}" * 700, '{"x":1}', None, '{"k":NaN}']
    df = spark.createDataFrame(list(enumerate(docs)), "i int, doc string")
    rows = {r.i: r for r in E.validate(df, c, u, "doc", errors_into="why").collect()}
    assert [rows[i].valid for i in range(7)] == [True, False, None, None, None, None, None]
    assert [rows[i].why and rows[i].why["class"] for i in range(7)] == [None, None, "JSONDecodeError", "MaxDepthExceededError", "InfiniteLoopError", None, "ValueError"]
    assert [r.valid for r in E.validate(df, c, u, "doc").orderBy("i").collect()] == [True, False, None, None, None, None, None]
    found = {(r.i, r.keyword, r.engine_error) for r in E.errors(df, c, u, "doc", ["i"]).collect()}
    assert found == {(1, "maximum", None), (2, None, "JSONDecodeError"), (3, None, "MaxDepthExceededError"), (4, None, "InfiniteLoopError"), (6, None, "ValueError")}
    valid = df.join(E.errors(df, c, u, "doc", ["i"]), "i", "left_anti").where("doc is not null")
    assert [r.i for r in valid.collect()] == [0]
    assert sorted((r.i, r.error) for r in E.first_errors(df, c, u, "doc", ["i"]).collect()) == [(1, "must be <= 0, got 1")]


def test_schemas_by_row(spark):
    c = SchemaCatalog()
    a, b = c.register({"minimum": 3}, "https://t.example/a"), c.register({"items": {"$ref": "#"}, "type": ["array", "null"]}, "https://t.example/b")
    df = spark.createDataFrame([(0, "5", a), (1, "2", a), (2, "[[null]]", b), (3, "[1]", b), (4, "1", "https://t.example/none"), (5, None, a), (6, "1", None), (7, "{", a)], "i int, doc string, u string")
    assert [r.valid for r in E.validate_by_uri(df, c, "doc", "u").orderBy("i").collect()] == [True, False, True, False, None, None, None, None]
    typed = spark.createDataFrame([(0, (5,), "https://t.example/p"), (1, (5,), "https://t.example/q")], "i int, doc struct<v:int>, u string")
    d = SchemaCatalog()
    d.register({"properties": {"v": {"minimum": 6}}}, "https://t.example/p")
    d.register({"properties": {"v": {"enum": [[1], 5]}}}, "https://t.example/q")
    assert [r.valid for r in E.validate_by_uri(typed, d, "doc", "u").orderBy("i").collect()] == [False, True]


def test_joins(spark):
    from sievemark.operators import joins

    g = random.Random(2)
    left = [(k, g.choice([1, 2, None]), g.randrange(0, 4_000_000)) for k in range(60)]
    right = [(100 + k, g.choice([1, 2, None]), g.randrange(0, 4_000_000)) for k in range(40)]
    make = lambda rows, *names: spark.createDataFrame(rows, "id int, u int, s long").select(F.col("id").alias(names[0]), "u", F.timestamp_seconds("s").alias(names[1]))
    a, b = make(left + [(61, 1, None)], "a", "t"), make(right, "b", "w")
    found = {r.a: r.b for r in joins.as_of_join(a, b, ["u"], "t", "w", ["b"]).collect()}
    wanted = {k: max(((s, i) for i, v, s in right if v == u and u is not None and s <= t), default=(0, None))[1] for k, u, t in left}
    assert found == wanted | {61: None}
    pairs = {(r.a, r.b) for r in joins.interval_join(a, b, ["u"], "t", "w", 90_000).collect()}
    assert pairs == {(k, i) for k, u, t in left for i, v, s in right if u == v and u is not None and 0 <= s - t <= 90_000}
    bands = [("x", 0, 5), ("y", 3, 30), ("z", 30, 30), ("w", -7, 1)]
    spans = {(r.v, r.n) for r in joins.range_join(spark.range(-10, 40).select(F.col("id").alias("v")), spark.createDataFrame(bands, "n string, lo long, hi long"), "v", "lo", "hi", 7).collect()}
    assert spans == {(v, n) for v in range(-10, 40) for n, lo, hi in bands if lo <= v < hi}
    rolled = {r.a: r.m for r in joins.rolling(a.where("t is not null and u is not null"), ["u"], "t", ["a"], F.col("a").cast("double"), 3, "m").collect()}
    for u in (1, 2):
        own = sorted((t, k) for k, v, t in left if v == u)
        for n, (_, k) in enumerate(own):
            last = [i for _, i in own[max(0, n - 3) : n + 1]]
            assert rolled[k] == pytest.approx(sum(last) / len(last))


def test_options(spark):
    c, u = catalog_of({"pattern": "(?<=a+)b$"}, regex_backend="regex")
    df = spark.createDataFrame([(0, '"aab"'), (1, '"b"')], "i int, doc string")
    assert [r.valid for r in E.validate(df, c, u, "doc").orderBy("i").collect()] == [True, False]
    assert json.loads(c.spec())["options"]["regex_backend"] == "regex"
    assert {form for _, form, _ in E.census(*catalog_of({"properties": {"a": {"enum": [[1]]}, "b": {"minimum": 1}}}))} == {"column", "kernel"}
