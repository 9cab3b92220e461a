"""Sharding by a two-pass external shuffle (DataFrame functions only).

Pass 1 scatters rows into memory-sized buckets by a seeded hash. Pass 2 gathers each bucket, shuffles
it by Fisher-Yates (Spark's ``shuffle`` with a seed) and numbers its rows from the bucket's offset,
which gives one global random order; row g goes to shard g mod n, slot g div n. So the law is
``rows``: shard sizes differ by one at most, whatever the texts are.

Equal rows count as one row with a number of copies, with map-side combining, and are scattered
in lots of ``LOT``; so rows that share an id, or have none, fill no bucket, and the order depends on the
table alone. Offsets are summed in two levels: over blocks of buckets, then within each block.

Buckets are sorted before they are shuffled and are dealt to a fixed number of partitions, so a task
that is run again, or a second run over the same table, gives the same order.

Defined results: null text has no bytes and crc 0; equal texts are dealt like any rows, by id and
text; repeated rows each get a slot; an empty table gives an empty result; other columns are ignored
(``write_shards`` keeps them, and takes columns that can be hashed and sorted).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievemark.llm.common import read_table, text_or_empty

SHARDS, ROWS_PER_BUCKET, SEED, LOT, BUCKETS_PER_BLOCK = 40, 2048, 20240, 4, 4096


def bucket_offsets(counts: DataFrame, per_block: int = BUCKETS_PER_BLOCK) -> DataFrame:
    """(_bucket, _start) from (_bucket, _n): the rows before each bucket, by blocks of buckets."""
    blocked = counts.withColumn("_block", F.floor(F.col("_bucket") / per_block))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocked.groupBy("_block").agg(F.sum("_n").alias("_sum")).select("_block", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("_block").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return blocked.withColumn("_ahead", F.coalesce(F.sum("_n").over(within), F.lit(0))).join(blocks, "_block").select("_bucket", (F.col("_base") + F.col("_ahead")).alias("_start"))


def global_shuffle(rows: DataFrame, total: int, rows_per_bucket: int = ROWS_PER_BUCKET, seed: int = SEED, combine: bool = True) -> DataFrame:
    """``rows`` with a column ``place``: a random order, gapless from 0.

    ``rows_per_bucket`` times the mean row size is the memory that a bucket takes. Only counts of
    buckets reach the prefix sums, never the rows themselves. Rows too wide to move once more are
    not combined: equal ones are scattered by their number in the table's partitions instead.
    """
    names, buckets = rows.columns, max(1, math.ceil(total / rows_per_bucket))
    copies = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("_copies")) if combine else rows.withColumn("_copies", F.lit(1))
    numbers = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_copies") - 1) / LOT))) if combine else F.pmod(F.monotonically_increasing_id(), F.lit(4096))
    lots = copies.withColumn("_lot", numbers)
    spread = lots.select(
        F.struct(*names).alias("_row"), (F.least(F.lit(LOT), F.col("_copies") - F.col("_lot") * LOT).cast("int") if combine else F.lit(1)).alias("_k"), F.pmod(F.xxhash64(F.lit(seed), *names, "_lot"), F.lit(buckets)).alias("_bucket")
    )
    filled = (
        spread.repartition(min(buckets, 100_000), "_bucket")
        .groupBy("_bucket")
        .agg(F.sort_array(F.collect_list(F.struct("_row", "_k"))).alias("_lots"))
        .sortWithinPartitions("_bucket")
        .select("_bucket", F.shuffle(F.flatten(F.transform("_lots", lambda x: F.array_repeat(x["_row"], x["_k"]))), seed).alias("_rows"))
    )
    offsets = bucket_offsets(spread.groupBy("_bucket").agg(F.sum("_k").alias("_n")))
    return filled.join(offsets, "_bucket").select(F.posexplode("_rows").alias("_i", "_row"), "_start").select("_row.*", (F.col("_start") + F.col("_i")).alias("place"))


def shard_rows(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: one row per row of ``docs``."""
    text = text_or_empty(text_col)
    slim = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = global_shuffle(slim, docs.select(id_col).count(), rows_per_bucket, seed)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("place") % shards).cast("int").alias("shard"), F.floor(F.col("place") / shards).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = 64 << 20) -> None:
    """Write whole rows to ``path``/shard=k, each file in slot order; buckets hold about ``bucket_bytes``."""
    width = sum((F.octet_length(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in docs.columns), F.lit(16))
    n, size = docs.agg(F.count(F.lit(1)), F.sum(width)).first()
    per = max(1, int(bucket_bytes // max(1, (size or 0) / max(1, n))))
    placed = global_shuffle(docs, n, per, seed, combine=False)
    out = placed.withColumn("shard", (F.col("place") % shards).cast("int")).withColumn("slot", F.floor(F.col("place") / shards).cast("long")).drop("place")
    out.repartition(shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(read_table(spark, sf_dir, "documents"))
