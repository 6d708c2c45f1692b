"""Suspicious patterns found as the ledger grows: a batch costs what it brings and the hours that it touches."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import detect
from tidemark.streaming import jobs, keyed

_OFF = "sequence_id long, employee_id int, created_at timestamp_ntz, hour long, batch long"
#: The tables that flags are made of.
FOUND = {"salaries": "sequence_id long, employee_id int", "deletions": "sequence_id long, employee_id int", "ahead": "sequence_id long, employee_id int, created_at timestamp_ntz, n_ahead long"}


def salary_changes(ledger: DataFrame, share: str = "0.30") -> DataFrame:
    """sequence_id, employee_id of salaries as `detect.salary_changes` finds them. State: each employee's last salary.

    Sequences must rise from batch to batch."""
    percent = int(Decimal(share) * 100)

    def follow(state: tuple | None, rows: list[tuple]) -> tuple[tuple, list[tuple]]:
        (before,) = state or (None,)
        out = []
        for seq, text in rows:
            now = None if text is None else int(text)
            if now is not None and before is not None and before > 0 and 100 * abs(now - before) > percent * before:
                out.append((seq,))
            before = now
        return (before,), out

    # Cents as text, so that null stays null in pandas.
    rows = ledger.where("table_name = 'salary_history' AND action = 'INSERT'").select("sequence_id", "employee_id", (F.col("amount") * 100).cast("long").cast("string").alias("cents"))
    return keyed.folded(rows, "employee_id", ["sequence_id"], ["sequence_id", "cents"], "sequence_id long", follow).select("sequence_id", "employee_id")


def _kept(spark: SparkSession, path: str, schema: str, batch: int) -> DataFrame:
    """What batches up to this one have left; a batch that was cut short may have left a later folder."""
    return spark.read.schema(schema).option("basePath", path).parquet(path).where(F.col("batch") <= batch)


def _hours(rows: DataFrame) -> DataFrame:
    """The hours whose counts the rows change: their own and the one before."""
    return rows.select(F.explode(F.array("hour", F.col("hour") - 1)).alias("hour")).distinct()


def run(ledger: DataFrame, base: str, more_than: int = 3) -> None:
    """Works through what the stream has and ends; started again it goes on where it stopped.

    Two queries read the stream. Salaries go through state. Deletions and deactivations of a batch are kept in folders of its
    number, deactivations by hour too, and replace what is there, so a batch that runs again changes nothing. Counts are
    worked out again for the hours that a batch touches, from the deactivations of these and the next hours alone: the scan
    is cut to the batch's first and last hour, so late rows cost more but are counted.
    """
    spark = ledger.sparkSession

    def work(rows: DataFrame, batch: int) -> None:
        detect.deletions(rows).write.mode("overwrite").parquet(f"{base}/deletions/batch={batch}")
        off = detect.deactivations(rows).withColumn("hour", F.floor(detect.micros(F.col("created_at")) / detect.HOUR))
        off.write.mode("overwrite").partitionBy("hour").parquet(f"{base}/off/batch={batch}")
        low, high = _kept(spark, f"{base}/off", _OFF, batch).where(F.col("batch") == batch).agg(F.min("hour"), F.max("hour")).first()
        if low is None:
            return
        near = _kept(spark, f"{base}/off", _OFF, batch).where(F.col("hour").between(low - 1, high + 1))
        touched = _hours(near.where(F.col("batch") == batch))
        needed = touched.select(F.explode(F.array("hour", F.col("hour") + 1)).alias("hour")).distinct()
        counted = detect.counts_ahead(near.join(needed, "hour", "left_semi")).join(touched, "hour", "left_semi")
        counted.where(F.col("n_ahead") > more_than).select("sequence_id", "employee_id", "created_at", "n_ahead").write.mode("overwrite").parquet(f"{base}/ahead/batch={batch}")

    def keep(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{base}/salaries/batch={batch}")

    for name, schema in FOUND.items():  # so that what was found can be read even if nothing comes
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{base}/{name}/batch=-1")
    running = [jobs.each_batch(salary_changes(ledger), keep, f"{base}/salaries-state"), jobs.each_batch(ledger, work, f"{base}/events-state")]
    for q in running:
        q.awaitTermination()


def flags(spark: SparkSession, base: str) -> DataFrame:
    """The flags of all that has been worked through, as `detect.flags` has them for the whole ledger, from what was found
    alone. A burst's count grows from batch to batch; the highest stands."""
    found = {name: spark.read.schema(schema).parquet(f"{base}/{name}") for name, schema in FOUND.items()}
    starts = found["ahead"].groupBy("sequence_id").agg(*[F.max(c).alias(c) for c in ("employee_id", "created_at", "n_ahead")])
    return detect.ranked(found["salaries"], found["deletions"], detect.first_starts(detect.rooted(starts)))
