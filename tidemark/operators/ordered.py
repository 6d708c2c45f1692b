"""Order-dependent steps without one task for the whole order.

Rows are cut into buckets of consecutive rows; a window works within a bucket, and one edge row for each bucket carries
what the next bucket needs. A window over the edges then costs rows / bucket size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def _edges(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, keep: Column | None = None) -> DataFrame:
    """For each bucket the last value of all buckets before it."""
    own = df if keep is None else df.where(keep)
    last = own.groupBy(*keys, "_bucket").agg(F.max_by(value, F.struct(*order)).alias("_last"))
    if keep is not None:
        last = _beside(df.select(*keys, "_bucket").distinct(), last, keys)
    before = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    return last.select(*keys, "_bucket", F.last("_last", ignorenulls=True).over(before).alias("_edge"))


def previous(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[str], columns: dict[str, str | Column]) -> DataFrame:
    """Adds, under the names in `columns`, values of the row before in `order` among rows of the same keys.

    `bucket` must not fall as the order rises. Rows with null keys are one group more.
    """
    value = F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in columns.items()])
    df = df.withColumn("_bucket", bucket)
    within = W.partitionBy(*keys, "_bucket").orderBy(*order)
    out = _beside(df.withColumn("_before", F.lag(value).over(within)), _edges(df, keys, order, value), keys)
    both = F.coalesce("_before", "_edge")
    return out.select(*[c for c in df.columns if c != "_bucket"], *[both[n].alias(n) for n in columns])


def _beside(rows: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with the edge of their keys and bucket. Null keys are keys like any other."""
    named = edges.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_bucket").alias("_at_bucket"), *[c for c in edges.columns if c not in (*keys, "_bucket")])
    same = F.col("_bucket") == F.col("_at_bucket")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(named, same, "left").drop("_at_bucket", *[f"_k{i}" for i in range(len(keys))])


def carried(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[str], value: Column, name: str, when: Column, source: DataFrame | None = None) -> DataFrame:
    """Adds the value of the latest row, this one included, for which `when` holds. source: the same rows, read for the edges
    where those of df are dear to make."""
    edges = (df if source is None else source).withColumn("_bucket", bucket)
    df = df.withColumn("_bucket", bucket)
    boxed = F.struct(value.alias("v"))
    within = W.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = _beside(df.withColumn("_own", F.last(F.when(when, boxed), ignorenulls=True).over(within)), _edges(edges, keys, order, boxed, when), keys)
    return out.select(*[c for c in df.columns if c != "_bucket"], F.coalesce("_own", "_edge")["v"].alias(name))


def highest(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[str], value: Column, name: str) -> DataFrame:
    """Adds the greatest value of the rows of the same keys up to and with this one."""
    df = df.withColumn("_bucket", bucket)
    before = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    edges = df.groupBy(*keys, "_bucket").agg(F.max(value).alias("_top")).select(*keys, "_bucket", F.max("_top").over(before).alias("_edge"))
    within = W.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = _beside(df.withColumn("_own", F.max(value).over(within)), edges, keys)
    return out.select(*[c for c in df.columns if c != "_bucket"], F.greatest("_own", "_edge").alias(name))


def numbered(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[str], name: str) -> DataFrame:
    """Adds the place of each row among those of its keys, from 1."""
    df = df.withColumn("_bucket", bucket)
    sizes = df.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    out = _beside(df.withColumn("_at", F.row_number().over(W.partitionBy(*keys, "_bucket").orderBy(*order))), sizes, keys)
    return out.select(*[c for c in df.columns if c != "_bucket"], (F.col("_start") + F.col("_at")).alias(name))


def in_order(df: DataFrame, keys: Sequence[str], order: Sequence[str], fields: Sequence[str], added: str, start: Callable[[], object], step: Callable[[object, tuple], tuple[object, tuple]], made: dict[str, Column] | None = None) -> DataFrame:
    """Adds the columns `added` (a schema) by a fold over each key's rows in order, one row at a time. made: columns that are
    worked out behind the exchange, so that it does not carry them.

    For steps that need their own earlier output. Rows are sorted within partitions and pass as a stream: a task holds one
    batch and one state, however many rows a key has; a single key is one chain and so one task's work.
    """
    schema = df.sparkSession.createDataFrame([], added).schema
    # Without keys rows go to one task through an exchange, so that reading and preparing them stays parallel.
    dealt = (df.repartition(*keys) if keys else df.repartition(1)).sortWithinPartitions(*keys, *order)
    dealt = dealt.withColumns(made) if made else dealt

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, start()
        for batch in batches:
            rows = zip(*[batch.column(c).to_pylist() for c in fields])
            named = zip(*[batch.column(c).to_pylist() for c in keys]) if keys else iter(lambda: (), 1)
            found = []
            for key, row in zip(named, rows):
                if key != now:
                    now, state = key, start()
                state, out = step(state, row)
                found.append(out)
            extra = list(zip(*found)) if found else [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(list(v), pa.type_for_alias(t)) for v, t in zip(extra, types))], names=[*batch.schema.names, *schema.names])

    types = [{"string": "string", "long": "int64", "bigint": "int64", "boolean": "bool", "double": "float64"}[f.dataType.simpleString()] for f in schema]
    full = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema), added])
    return dealt.mapInArrow(run, full)
