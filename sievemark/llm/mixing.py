"""Mixing sources to target weights by distributed prefix sums in a hash-random order.

Each document gets a seeded hash key. Keys cut every source into ranges of about ``ROWS_PER_RANGE``
documents; the ranges' sums are added up per source, and rows are summed only within their range. So
a source with a third of all rows is spread like any other. Rows that share an id, or have none, share
a key; a range that they make crowded is cut again by a hash of its rows. A source's budget is cut
exactly: whole epochs first, then documents in key order, the last one in part.

Targets are water-filling: weights share the total, and a source stops at ``MAX_EPOCHS`` times its
size, its excess going to the others by weight.

Defined results: size is the number of words, 0 for null text; a null source is a source of its own,
last in order; repeated rows each count (of rows equal in id and text, which one is cut may differ
between runs); an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievemark.llm.common import WORD, materialize, read_table, text_or_empty, unused

WEIGHTS, MAX_EPOCHS, ROWS_PER_RANGE, SEED = (5, 2, 1), 3, 1024, "mix-1"
#: A range of more than so many times its share of rows is cut again.
CROWDED = 4


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size, target from (source, source_size), a row per source.

    With sources in order of cap / weight, let level_i share what the caps before i leave among i and
    those after it. The water level is the largest level_i that doesn't pass its own cap / weight.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = sizes.select("source", "source_size", rank.alias("rank"))
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("long")
    capped = weighed.select("*", w.alias("w"), (F.col("source_size") * max_epochs).alias("cap")).withColumn("r", F.col("cap").cast("double") / F.col("w"))
    every = Window.orderBy("r", "rank")
    before = every.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double") / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    levels = capped.withColumn("level", level)
    water = F.max(F.when(F.col("level") <= F.col("r"), F.col("level"))).over(whole)
    return levels.select("source", "source_size", F.least(F.col("cap").cast("double"), water * F.col("w")).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """doc_id, size, source_size, target, taken: one row per row of ``docs``."""
    return _takes(docs, None, weights, max_epochs, id_col, text_col, source_col, seed, rows_per_range).select("doc_id", "size", "source_size", "target", "taken")


def _takes(docs: DataFrame, row: str | None, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """``mix`` with the column ``row`` of ``docs``, if any."""
    number = [F.col(row).alias("row")] if row else []
    names = ["row"] if row else []
    slim = materialize(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).cast("string").alias("source"),
            F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long").alias("size"),
            F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))), 1, 12), 16, 10).cast("long").alias("key"),
            F.crc32(text_or_empty(text_col).cast("binary")).alias("crc"),
            F.monotonically_increasing_id().alias("_n"),
            *number,
        ),
        "mix",
    )
    sizes = slim.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    targets = source_targets(sizes, weights, max_epochs)
    ranges = max(1, math.ceil(slim.count() / rows_per_range))
    rows = slim.select("*", F.floor(F.col("key").cast("double") * ranges / float(1 << 48)).cast("int").alias("range"), F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"))
    place = ["none", "name", "range", "part"]
    crowded = materialize(rows.groupBy(*place[:3]).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > CROWDED * rows_per_range).withColumn("parts", F.ceil(F.col("rows") / rows_per_range)).drop("rows"), "crowded")
    if crowded.isEmpty():
        rows = rows.withColumn("part", F.lit(0))
    else:
        cut = F.coalesce(F.pmod(F.xxhash64("crc", "size", "_n"), F.col("parts")), F.lit(0)).cast("int")
        rows = rows.join(crowded, place[:3], "left").withColumn("part", cut).drop("parts")
    part = rows.groupBy(*place).agg(F.sum("size").alias("range_size"))
    ahead = F.sum("range_size").over(Window.partitionBy("none", "name").orderBy("range", "part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("range_size")
    keyed = targets.select(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"), "source_size", "target")
    starts = part.select(*place, ahead.alias("ahead")).join(keyed, ["none", "name"])
    within = F.sum("size").over(Window.partitionBy(*place).orderBy("key", "doc_id", "size", "crc", "_n").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    placed = rows.withColumn("within", within).join(starts, place)
    budget = F.floor(F.col("target") + 0.5)
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = budget - epochs * F.col("source_size")
    cut = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("ahead") - F.col("within")))
    return placed.select(*names, "doc_id", "size", "source_size", "target", (epochs * F.col("size") + cut).cast("long").alias("taken"))


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` as the mix takes it: a row for each whole repeat, then one with the words of a part.

    Texts that are taken whole stay as they are; rows of which nothing is taken go. Rows are numbered
    and take by number, so rows without an id and rows that repeat one are taken like any other.
    """
    key, cuts, cut = unused(docs, "_key", "_cuts", "_cut")
    held = materialize(docs.withColumn(key, F.monotonically_increasing_id()), "numbered")
    taken = _takes(held, key, id_col=id_col, text_col=text_col, **options).where("taken > 0")
    none, size = F.array().cast("array<int>"), F.greatest(F.col("size"), F.lit(1))
    part = (F.col("taken") % size).cast("int")
    repeats = F.concat(F.array_repeat(F.lit(0), F.floor(F.col("taken") / size).cast("int")), F.when(part > 0, F.array(part)).otherwise(none))
    grown = held.join(taken.select(F.col("row").alias(key), repeats.alias(cuts)), key).withColumn(cut, F.explode(cuts))
    words = F.regexp_extract_all(F.col(text_col), F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    text = F.when(F.col(cut) > 0, F.array_join(F.slice(words, F.lit(1), F.greatest(F.col(cut), F.lit(1))), "")).otherwise(F.col(text_col))
    return grown.withColumn(text_col, text).select(*docs.columns)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix-1:' || doc_id::VARCHAR)[1:12] AS key
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w,
             row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s),
c AS (SELECT *, source_size * 3 AS cap, (source_size * 3)::DOUBLE / w AS r FROM w),
l AS (SELECT *, ((sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY r, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
              / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY r, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE) AS level FROM c),
t AS (SELECT source, source_size, least(cap::DOUBLE, max(CASE WHEN level <= r THEN level END) OVER () * w) AS target FROM l),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target + 0.5)::BIGINT AS budget,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM p)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, budget - epochs * source_size - start)))::BIGINT AS taken
FROM e
"""
