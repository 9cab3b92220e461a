"""Exact deduplication by content-defined chunk recipes (DataFrame functions only).

Every text is cut into chunks at sentence or line ends (a rule of the content, so equal passages
give equal chunks), each chunk is named by a 64-bit hash, and the names are verified: all distinct
(name, chunk) pairs of the corpus are gathered once, with map-side combining, and names that stand
for more than one chunk get a variant number. A document's recipe is its ordered list of verified
identifiers; documents are compared by recipe, so whole texts never move again.

Defined results: null text counts as empty; empty texts equal each other; of equal texts the row
with the largest id stays (null ids come last; one row stays among repeated rows); an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemark.llm.common import materialize, read_table, rows_kept, text_or_empty, unused

CHUNK_MIN, CHUNK_MAX = 256, 2048
#: Rows of one group of equal texts are spread over so many salts.
SALTS = 256


def chunks(text: Column, least: int = CHUNK_MIN, most: int = CHUNK_MAX) -> Column:
    """Content-defined chunks: they end after a sentence or line end; their concatenation is the text."""
    rule = rf"(?s).{{{least},{most}}}?(?:[.!?]\s+|\n)|(?s).{{1,{most}}}"
    return F.regexp_extract_all(text, F.lit(rule), F.lit(0))


def chunk_variants(docs: DataFrame, text_col: str, name_of: Callable[[Column], Column]) -> DataFrame | None:
    """(name, chunk, variant) of names that stand for several chunks; None if every name is unique."""
    pairs = (
        docs.select(F.explode(chunks(text_or_empty(text_col))).alias("chunk"))
        .select(name_of(F.col("chunk")).alias("name"), "chunk")
        .groupBy("name", "chunk")
        .agg(F.count(F.lit(1)).alias("uses"))
    )
    shared = pairs.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("uses").alias("_")).where("n > 1").select("name")
    if shared.isEmpty():
        return None
    from pyspark.sql import Window

    return pairs.join(shared, "name").select("name", "chunk", (F.row_number().over(Window.partitionBy("name").orderBy("chunk")) - 1).alias("variant"))


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name_of: Callable[[Column], Column] | None = None, row_col: str | None = None) -> DataFrame:
    """One row per document: doc_id, row (unique, or ``row_col``), recipe (ordered verified identifiers), text_sha256."""
    name_of = name_of or (lambda c: F.xxhash64(c))
    text = text_or_empty(text_col)
    variants = chunk_variants(docs, text_col, name_of)
    base = docs.select(F.col(id_col).alias("doc_id"), (F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("row"), chunks(text).alias("chunks"), F.sha2(text, 256).alias("text_sha256"))
    named = base.withColumn("recipe", F.transform("chunks", lambda c: name_of(c).cast("long")))
    if variants is None:
        return materialize(named.select("doc_id", "row", "recipe", "text_sha256"), "recipes")
    base = materialize(base, "chunked")
    listed = (
        base.select("row", F.posexplode("chunks").alias("pos", "chunk"))
        .withColumn("name", name_of(F.col("chunk")))
        .join(variants, ["name", "chunk"], "left")
        .groupBy("row")
        .agg(F.sort_array(F.collect_list(F.struct("pos", F.col("name").cast("long").alias("name"), F.coalesce("variant", F.lit(0)).cast("long").alias("variant")))).alias("ids"))
        .select("row", F.flatten(F.transform("ids", lambda x: F.array(x["name"], x["variant"]))).alias("recipe"))
    )
    empty = F.array().cast("array<bigint>")
    return materialize(base.drop("chunks").join(listed, "row", "left").select("doc_id", "row", F.coalesce("recipe", empty).alias("recipe"), "text_sha256"), "recipes")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name_of: Callable[[Column], Column] | None = None, salts: int = SALTS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of ``docs``.

    A group is summed in two steps, by (recipe, salt) and then by recipe, and its sum goes back to
    those of its salts that exist; so a group of a third of all rows is dealt over ``salts`` tasks.
    """
    return _groups(recipes(docs, id_col, text_col, name_of), salts).drop("row")


def _groups(listed: DataFrame, salts: int) -> DataFrame:
    """``exact_dedup`` of recipes, with their ``row``."""
    ids = listed.select(
        "*", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("order_id"), F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int").alias("salt"), F.xxhash64("recipe").alias("recipe_hash")
    )
    part = ids.groupBy("recipe_hash", "recipe", "salt").agg(F.count(F.lit(1)).alias("n"), F.max("order_id").alias("top"), F.max_by("row", "order_id").alias("top_row"))
    whole = part.groupBy("recipe_hash", "recipe").agg(
        F.sum("n").alias("group_size"), F.max("top").alias("top"), F.max_by("top_row", "top").alias("top_row"), F.collect_set("salt").alias("present")
    )
    back = whole.select("recipe_hash", "recipe", F.explode("present").alias("salt"), "group_size", "top", "top_row")
    return ids.join(back, ["recipe_hash", "recipe", "salt"]).select(
        "doc_id",
        "row",
        F.when(F.col("top") == -(2**63), F.lit(None).cast("long")).otherwise(F.col("top")).alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("row") == F.col("top_row")).alias("kept"),
        "text_sha256",
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one of each group, by the row's number.

    Only chunks' names and bits move; texts are written once, numbered, and stay where they are.
    """
    (number,) = unused(docs, "_row")
    numbered = materialize(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    kept = _groups(recipes(numbered, id_col, text_col, row_col=number), SALTS).where("kept").select("row")
    return rows_kept(numbered, number, kept).drop(number)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents"))


ORACLE = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
