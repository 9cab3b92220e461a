"""Joins and windows over verdicts and errors that Spark has no operator for, as compositions of its own.

All of them cut time (or a number) into slots, so no key's whole history has to be sorted in one task:
what one slot needs of those before it is carried over as one row a slot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _slot(time: Column, seconds: int) -> Column:
    return F.floor(F.unix_micros(time.cast("timestamp")) / (seconds * 1_000_000))


def as_of_join(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, take: list[str], seconds: int = 3600) -> DataFrame:
    """``left`` with the columns ``take`` of the latest row of ``right`` that isn't later, of equal ``by``.

    NULL where there is none, or a key or time is NULL. Of rows of one time, the greatest by ``take`` counts.
    """
    known = right.where(F.col(right_time).isNotNull())
    for b in by:
        known = known.where(F.col(b).isNotNull())
    seen = F.struct(F.col(right_time).alias("_at"), *[F.col(c) for c in take])
    whole = F.struct(*[F.col(c) for c in left.columns])
    found = known.select(*by, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), seen.alias("_seen"))
    asked = left.select(*by, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), whole.alias("_row"))
    rows = found.unionByName(asked, allowMissingColumns=True).withColumn("_slot", _slot(F.col("_t"), seconds))
    ends = rows.groupBy(*by, "_slot").agg(F.max("_seen").alias("_end"))
    carried = ends.select(*by, "_slot", F.max("_end").over(Window.partitionBy(*by).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))
    own = Window.partitionBy(*by, "_slot").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.withColumn("_own", F.max("_seen").over(own)).where("_side = 1").join(carried, [*by, "_slot"], "left")
    latest = F.when(F.col("_t").isNotNull(), F.coalesce("_own", "_carry"))
    return joined.select("_row.*", *[latest[c].alias(c) for c in take])


def range_join(values: DataFrame, ranges: DataFrame, value: str, low: str, high: str, width: float) -> DataFrame:
    """Rows of ``values`` with every row of ``ranges`` in whose [low, high) they lie.

    Ranges are dealt to slots of ``width``, a row a slot, so the join is by equality first.
    """
    points = values.withColumn("_slot", F.floor(F.col(value) / F.lit(width)))
    last = F.ceil(F.col(high) / F.lit(width)) - 1
    spans = ranges.where(F.col(low) < F.col(high)).withColumn("_slot", F.explode(F.sequence(F.floor(F.col(low) / F.lit(width)), last)))
    return points.join(spans, "_slot").where((F.col(value) >= F.col(low)) & (F.col(value) < F.col(high))).drop("_slot")


def interval_join(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, seconds: int) -> DataFrame:
    """Pairs of equal ``by`` in which right's time lies within ``seconds`` after left's; right's columns keep their names."""
    asked = left.withColumn("_slot", F.explode(F.sequence(_slot(F.col(left_time), seconds), _slot(F.col(left_time), seconds) + 1)))
    found = right.withColumn("_slot", _slot(F.col(right_time), seconds))
    gap = F.unix_micros(F.col(right_time).cast("timestamp")) - F.unix_micros(F.col(left_time).cast("timestamp"))
    return asked.join(found, [*by, "_slot"]).where((gap >= 0) & (gap <= seconds * 1_000_000)).drop("_slot")


def rolling(df: DataFrame, by: list[str], time: str, order: list[str], value: Column, before: int, into: str, seconds: int = 3600) -> DataFrame:
    """``df`` with the mean of ``value`` over each row and the ``before`` rows ahead of it, in order of time.

    The last ``before`` rows ahead of a slot lie in as many filled slots ahead of it, so each slot hands
    its last few on and no key is one task.
    """
    names = df.columns
    rows = df.select("*", value.alias("_v"), _slot(F.col(time), seconds).alias("_slot"))
    item = F.struct(F.col(time).alias("_t"), *[F.col(c).alias(f"_o{n}") for n, c in enumerate(order)], F.col("_v"))
    tails = rows.groupBy(*by, "_slot").agg(F.slice(F.reverse(F.sort_array(F.collect_list(item))), 1, before).alias("_tail"))
    ahead = F.flatten(F.collect_list("_tail").over(Window.partitionBy(*by).orderBy("_slot").rowsBetween(-before, -1)))
    carried = tails.select(*by, "_slot", F.slice(F.reverse(F.sort_array(ahead)), 1, before).alias("_a")).select(*by, "_slot", F.explode("_a").alias("_c")).select(*by, "_slot", "_c.*").withColumn("_own", F.lit(False))
    own = rows.select(*by, "_slot", F.col(time).alias("_t"), *[F.col(c).alias(f"_o{n}") for n, c in enumerate(order)], "_v", F.lit(True).alias("_own"), F.struct(*names).alias("_row"))
    both = own.unionByName(carried, allowMissingColumns=True)
    window = Window.partitionBy(*by, "_slot").orderBy("_t", *[f"_o{n}" for n in range(len(order))]).rowsBetween(-before, 0)
    return both.withColumn(into, F.avg("_v").over(window)).where("_own").select("_row.*", into)
