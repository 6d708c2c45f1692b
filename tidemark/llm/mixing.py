"""Mixing sources to target weights by weighted sampling without replacement (Efraimidis-Spirakis).

A source's target is split into complete epochs, in which every document is taken, and a rest. For the rest,
each document gets the key -ln(u) / quality; documents are taken by rising key up to the token budget. The
prefix sums are distributed: keys fall into buckets, bucket sums are prefix-summed, and only the bucket in
which a source's budget ends is sorted. So no source, however large, is sorted by one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from tidemark.llm import common as C

BUCKETS = 4096


def uniform(seed: str, *cols: Column) -> Column:
    """A number in (0, 1] that depends on the seed and the columns alone."""
    key = F.concat_ws("|", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return (F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") + 1.0) / float(1 << 52)


def targets(sources: DataFrame, weights: tuple[float, ...], ratio: float, cap: float) -> DataFrame:
    """source, source_size, target for rows (source, source_size): sources by code point, null last, weigh `weights`,
    repeating; they share `ratio` times all sizes, none above `cap` times its own size, the excess reshared by weight.

    With sources ordered by capacity per weight, those up to some place are full and the rest share what is left in
    proportion to weight; that place is the first whose share does not exceed its capacity. One row for each source.
    """
    name = W.orderBy(F.col("source").isNull(), "source")
    full = W.orderBy(F.col("room") / F.col("weight"), "rank")
    before = full.rowsBetween(W.unboundedPreceding, -1)
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = sources.withColumn("rank", F.row_number().over(name) - 1).withColumn("weight", weight).withColumn("room", F.col("source_size") * F.lit(float(cap)))
    left = F.sum("source_size").over(every) * F.lit(float(ratio)) - F.coalesce(F.sum("room").over(before), F.lit(0.0))
    shared = ranked.withColumn("level", left / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    fits = F.col("level") <= F.col("room") / F.col("weight")
    level = F.min(F.when(fits, F.struct(F.col("room") / F.col("weight"), F.col("rank"), F.col("level")))).over(every)["level"]
    shared = shared.withColumn("at", level)
    return shared.select("source", "source_size", F.when(F.col("at").isNull(), F.col("room")).otherwise(F.least("room", F.col("weight") * F.col("at"))).alias("target"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), ratio: float = 1.5, cap: float = 2.0, seed: str = "mix", quality: str | None = None, size: Column | None = None) -> DataFrame:
    """One row for each document: doc_id, size, source, source_size, target (of its source), taken (words that the mix
    takes, repeats counted), epochs (times the document is taken).

    docs: doc_id, text, source, and `quality` (a positive weight; null or not positive: 1) if named. Size: words of the
    text, null text 0. A null source is a source of its own. Documents of size 0 take nothing. Repeated rows each count,
    with equal keys; ties go by doc_id, then size. The document in which a budget ends is taken if that brings the sum
    nearer to the target. An empty table gives an empty result. Other columns are ignored. The result depends on the rows and
    the seed alone.
    """
    n_words = F.coalesce(F.regexp_count(F.col("text"), F.lit(C.WORD_JAVA)), F.lit(0)).cast("long") if size is None else size
    grade = F.lit(1.0) if quality is None else F.when(F.col(quality) > 0, F.col(quality).cast("double")).otherwise(F.lit(1.0))
    own = docs.select(F.col("doc_id"), F.col("source").cast(T.StringType()).alias("source"), n_words.alias("size"), (-F.log(uniform(seed, F.col("doc_id"))) / grade).alias("key"))
    sized = C.settle(own.withColumn("bucket", F.floor((1.0 - F.exp(-F.col("key"))) * BUCKETS).cast("int")), "mix-sized")

    sums = sized.groupBy("source", "bucket").agg(F.sum("size").alias("size"))
    goal = targets(sums.groupBy("source").agg(F.sum("size").alias("source_size")), weights, ratio, cap)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goal = C.settle(goal.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")), "mix-targets")

    # Where each source's rest ends: its bucket, and what is left on entering it.
    run = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    ends = sums.withColumn("upto", F.sum("size").over(run)).alias("s").join(goal.alias("g"), F.col("s.source").eqNullSafe(F.col("g.source")))
    ends = ends.where("upto >= rest").groupBy(F.col("g.source").alias("source")).agg(F.min_by(F.struct(F.col("bucket"), (F.col("rest") - (F.col("upto") - F.col("size"))).alias("open")), "bucket").alias("end"))
    goal = goal.alias("g").join(ends.alias("e"), F.col("g.source").eqNullSafe(F.col("e.source")), "left").select("g.*", F.col("end.bucket").alias("end_bucket"), F.col("end.open").alias("open"))
    goal = C.settle(goal, "mix-ends")

    rows = sized.alias("d").join(goal.alias("g"), F.col("d.source").eqNullSafe(F.col("g.source"))).select("d.*", "source_size", "target", "epochs", "end_bucket", "open")
    last = F.col("bucket") == F.col("end_bucket")
    near = W.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    done = F.sum("size").over(near)
    # Inclusive sum, minus half the size: up to the open words the document brings the sum nearer to the target.
    edge = rows.where(last).withColumn("more", (done - F.col("size") / 2.0 <= F.col("open")).cast("long"))
    rest = rows.where(F.coalesce(~last, F.lit(True))).withColumn("more", F.when(F.col("end_bucket").isNull() | (F.col("bucket") < F.col("end_bucket")), 1).otherwise(0).cast("long"))
    taken = rest.unionByName(edge).withColumn("epochs", F.least(F.col("epochs") + F.col("more"), F.lit(int(cap)).cast("long")))
    return taken.select("doc_id", "size", "source", "source_size", "target", (F.col("size") * F.col("epochs")).alias("taken"), "epochs")


def graded(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, source and a quality weight from labels: 2 for good, 1/2 for bad, 1 without a label."""
    best = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("label"))
    weight = F.when(F.col("label") == 1, 2.0).when(F.col("label") == 0, 0.5).otherwise(1.0)
    return docs.select("doc_id", "text", "source").join(best, "doc_id", "left").select("doc_id", "text", "source", weight.alias("quality"))


def op4_mix_sources(spark, sf_dir: str) -> DataFrame:
    """Digest of the mix of all documents with the production weights."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n_words = F.coalesce(F.regexp_count(F.col("text"), F.lit(C.WORD_JAVA)), F.lit(0)).cast("long")
    sized = docs.select("doc_id", "source", n_words.alias("text"))
    found = mix(graded(sized, spark.read.parquet(f"{sf_dir}/labels.parquet")), quality="quality", size=F.col("text"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), l AS (
  SELECT doc_id, max(quality) AS q FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), k AS (
  SELECT d.doc_id, source, size,
         -ln((CAST('0x' || substr(md5('mix|' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) + 1.0) / 4503599627370496.0)
           / CASE q WHEN 1 THEN 2.0 WHEN 0 THEN 0.5 ELSE 1.0 END AS key
  FROM d LEFT JOIN l ON d.doc_id = l.doc_id
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source IS NULL, source COLLATE "C") - 1 AS rank FROM k GROUP BY source
), w AS (
  SELECT *, CASE rank % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS weight, source_size * 2.0::DOUBLE AS room FROM s
), v AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(room) OVER f, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER f, 0)) AS level
  FROM w WINDOW f AS (ORDER BY room / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, least(room, weight * (SELECT arg_min(level, room / weight + rank * 1e-9) FROM v WHERE level <= room / weight)) AS target FROM v
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM t
), r AS (
  SELECT k.*, source_size, target, epochs, target - epochs * source_size AS rest,
         sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size, source_size, target,
       CAST(size * least(2, epochs + CASE WHEN upto - size / 2.0 <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r
"""
