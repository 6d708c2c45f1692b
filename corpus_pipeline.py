"""From raw documents to a mix for training: five stages, each over all that the one before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the next one reads it from Parquet. All but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common as C
from tidemark.llm import decontam, mixing, ngramjoin, quality, substring
from tidemark.operators import ordered as O


class _Rows:
    """The columns of docs under names of their own, in0, in1, ..., so that no column of docs can clash with a stage's."""

    def __init__(self, docs: DataFrame):
        self.docs, self.names = docs, docs.columns
        self.own = [f"in{i}" for i in range(len(self.names))]
        self.plain = docs.toDF(*self.own)
        self.id, self.text = (self.own[self.names.index(c)] for c in ("doc_id", "text"))

    def back(self, df: DataFrame) -> DataFrame:
        return df.select(*self.own).toDF(*self.names)

    def keyed(self, distinct: bool) -> DataFrame:
        """Adds row_id, another one for each row: doc_id where no other row has it; of rows that share one, the first by
        content has it, and the rest, like rows without, have numbers beyond all doc_ids. With `distinct`, rows that are
        equal in every column count once.

        Which doc_ids are shared is worked out from ids alone and written, so that its size is known when texts are joined
        with it: few ids are broadcast by Spark's own threshold, and the texts of the other rows stay where they are."""
        key = F.xxhash64(*[F.col(c).cast("string") for c in self.own])
        top, unnamed = self.plain.agg(F.max(self.id), F.count_if(F.col(self.id).isNull())).first()
        top = top or 0
        shared = self.plain.where(F.col(self.id).isNotNull()).groupBy(F.col(self.id).alias("shared")).agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("shared")
        shared = C.settle(shared, "pipeline-shared-ids")
        if not unnamed and shared.isEmpty():
            return self.plain.withColumn("row_id", F.col(self.id).cast("long"))
        once = self.plain.where(F.col(self.id).isNotNull()).join(shared, F.col(self.id) == F.col("shared"), "left_anti").withColumn("row_id", F.col(self.id).cast("long"))
        rest = self.plain.where(F.col(self.id).isNull()).unionByName(self.plain.join(shared, F.col(self.id) == F.col("shared"), "left_semi"))
        rest = (rest.dropDuplicates() if distinct else rest).withColumn("content", key)
        least = rest.where(F.col(self.id).isNotNull()).groupBy(F.col(self.id).alias("shared")).agg(F.min("content").alias("first"))
        # Buckets of contents are numbered by themselves, so no task sees all of these rows.
        rest = O.numbered(rest, [], F.shiftright("content", 52), ["content", *self.own], "place").join(least, F.col(self.id) == F.col("shared"), "left")
        firsts = rest.where("content = first").groupBy(F.col(self.id).alias("of")).agg(F.min("place").alias("lead"))
        rest = rest.join(firsts, F.col(self.id) == F.col("of"), "left")
        row_id = F.when(F.col("place") == F.col("lead"), F.col(self.id)).otherwise(F.lit(top) + F.col("place")).cast("long")
        return once.unionByName(rest.select(*self.own, row_id.alias("row_id")))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that a quality rule rejects. A null or empty text has no words and goes. Rows are judged each by
    itself, so repeats and ties need no rule; an empty table stays empty."""
    rows = _Rows(docs)
    return rows.back(quality.cascade(rows.plain, text=rows.text, keep=tuple(rows.own)).where("kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row stays: that with the smallest doc_id. Each row is judged by its own text, so
    different texts of one doc_id all stay unless they are near copies of others; of those that share a doc_id, all but
    the first by content come after all doc_ids, and so do rows without one. Rows equal in every column are one."""
    rows = _Rows(docs)
    keyed = rows.keyed(distinct=True)
    groups = ngramjoin.near_duplicates(keyed.select(F.col("row_id").alias("doc_id"), F.col(rows.text).alias("text")))
    # A row goes if it belongs to a smaller one; ids are few bytes a row, texts travel by id alone.
    away = groups.where("component_id < doc_id").select(F.col("doc_id").alias("row_id"))
    return rows.back(keyed.join(away, "row_id", "left_anti"))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out word sequences of 13 words or more that a document of smaller doc_id has; n_chars follows the text. Texts
    without any stay as they are."""
    rows = _Rows(docs)
    named = rows.plain.withColumns({"doc_id": F.col(rows.id), "text": F.col(rows.text)})
    left = substring.dedup(named, keep=tuple(rows.own), lengths=False)
    out = left.withColumn(rows.text, F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col(rows.text)))
    if "n_chars" in rows.names:
        size = rows.own[rows.names.index("n_chars")]
        out = out.withColumn(size, F.length(rows.text).cast(rows.plain.schema[size].dataType))
    return rows.back(out)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows whose text leaks a benchmark item: exactly those that an LCS of every item with every passage would find. A
    null or empty text leaks nothing and stays. Each row is judged by its own text, whatever its doc_id; repeated rows all
    stay or all go; an empty table stays empty."""
    rows = _Rows(docs)
    keyed = rows.keyed(distinct=False)
    searched = keyed.select(F.col("row_id").alias("doc_id"), F.col(rows.text).alias("text"))
    leaked = decontam.leaks(searched, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(F.col("doc_id").alias("row_id")).distinct()
    return rows.back(keyed.join(leaked, "row_id", "left_anti"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document that is left. A null or empty text has size 0 and is
    taken 0 words; a null source is one of its own; repeated rows each count; an empty table stays empty."""
    graded = mixing.graded(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return mixing.mix(graded, quality="quality").select("doc_id", "size", "source_size", "target", "taken")


STAGES = [
    ("quality_rules", keep_good),
    ("ngram_jaccard_join", drop_near_copies),
    ("substring_dedup", drop_repeats),
    ("benchmark_decontamination", drop_leaks),
    ("mix_sources", mix),
]

#: Latent semantic retrieval is not expressible in SQL; tests hold all rows of the pipeline against a brute-force version of
#: the five stages on small tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = C.settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
