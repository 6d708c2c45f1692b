"""Numbering rows in order without one task for the whole order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.llm import common as C


def same(a: str, b: str, keys: Sequence[str]) -> Column:
    """Equal keys of the frames named a and b; null keys are keys like any other."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return out


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "place", total: str = "n") -> DataFrame:
    """Adds the place of each row, from 0, by `order` (rising, nulls first) among the rows of its keys, and the number of
    those rows. Rows that are equal in all of these come in any order.

    Ranges of keys and order are sorted each by itself and written; a range carries its first number within the session,
    and a table of ranges by key, written too, what comes before it. So a key with a third of all rows is many ranges.
    """
    by = [*keys, *order]
    dealt = df.repartitionByRange(*[F.col(c).asc() for c in by]).sortWithinPartitions(*by)
    rows = C.settle(dealt.withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_at", 33).alias("_part")
    parts = rows.groupBy(*keys, part).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select(*keys, "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"), F.sum("_n").over(W.partitionBy(*keys)).alias("_all"))
    # Written, so that Spark knows its size: below its own threshold it is broadcast, beyond it is joined by shuffles.
    parts = C.settle(parts, "ranges")
    both = rows.withColumn("_part", part).alias("r").join(parts.alias("p"), same("r", "p", [*keys, "_part"]))
    return both.select(*[F.col(f"r.{c}").alias(c) for c in df.columns], (F.col("_start") + F.col("_at") - F.col("_first")).alias(name), F.col("_all").alias(total))
