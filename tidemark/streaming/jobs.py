"""The ledger's services as Structured Streaming: chains that grow, budgets, detection by batch, checkpoint sealing."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import detect
from tidemark.streaming import keyed


def source(spark: SparkSession, path: str, per_trigger: int | None = None) -> DataFrame:
    """Parquet files of a path as a stream, with the schema that they have. The path may name one file."""
    schema = spark.read.parquet(path).schema
    path = f"{path[:-1]}[{path[-1]}]"  # as a pattern, for a file that is no folder
    stream = spark.readStream.schema(schema)
    return (stream.option("maxFilesPerTrigger", per_trigger) if per_trigger else stream).parquet(path)


def arriving(rows: DataFrame, path: str, order: str, files: int) -> None:
    """Writes rows as `files` files of growing `order`, one after another: the stream reads files by their age."""
    low, high = rows.agg(F.min(order), F.max(order)).first()
    place = F.least(F.floor((F.col(order) - low) * files / ((high - low) or 1)), F.lit(files - 1)) if low is not None else F.lit(0)
    for i in range(files):
        rows.where(place == i).coalesce(1).write.mode("append").parquet(path)


def chained(ledger: DataFrame, key: str = "employee_id") -> DataFrame:
    """sequence_id, key, chain_seq, previous_hash, entry_hash as rows arrive. State: each key's position and last hash.

    New rows of one micro-batch are sorted in memory by groups of keys; maxFilesPerTrigger bounds them. sequence_id must rise
    from batch to batch.
    """

    def grow(state: tuple | None, rows: list[tuple]) -> tuple[tuple, list[tuple]]:
        at, before = state or (0, X.GENESIS)
        out = []
        for seq, serial in rows:
            now = hashlib.sha256((serial + before).encode()).hexdigest()
            at += 1
            out.append((seq, at, before, now))
            before = now
        return (at, before), out

    rows = ledger.select("sequence_id", key, X.serialised().alias("serial"))
    made = keyed.folded(rows, key, ["sequence_id"], ["sequence_id", "serial"], "sequence_id long, chain_seq long, previous_hash string, entry_hash string", grow)
    return made.select("sequence_id", key, "chain_seq", "previous_hash", "entry_hash")


def budgets(requests: DataFrame, key: str, at: str, seconds: int = 60, late: str = "1 minute") -> DataFrame:
    """Requests by key and window; a window is given out once the watermark has passed it."""
    rows = requests.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return rows.groupBy(key, F.window(at, f"{seconds} seconds")).agg(F.count(F.lit(1)).alias("requests")).select(key, F.col("window.start").alias("start"), "requests")


def sealing(ledger: DataFrame, rows: int = 25, seconds: int | None = 60, key: str = "employee_id", idle: bool = False) -> DataFrame:
    """key, sealed_after, sealed_at, reason, as rows (key, sequence_id, created_at) arrive: a checkpoint is due after
    `rows` rows (count) or once a row comes `seconds` after the first that waits (time); the count is tested first.

    State: how many rows are sealed, how many wait, and since when. With `idle` a processing-time timer also seals what
    has waited that long while nothing came.
    """

    def grow(state: tuple | None, new: list[tuple]) -> tuple[tuple, list[tuple]]:
        done, waiting, since = state or (0, 0, 0)
        out = []
        for (t,) in new:
            since = int(t) if not waiting else since
            waiting += 1
            reason = "count" if waiting >= rows else "time" if seconds is not None and t - since >= seconds * 1_000_000 else None
            if reason:
                out.append((done, done + waiting, reason))
                done, waiting = done + waiting, 0
        return (done, waiting, since), out

    def late(state: tuple) -> tuple[tuple, list[tuple]]:
        done, waiting, since = state
        return (done + waiting, 0, since), [(done, done + waiting, "time")]

    timed = ledger.select("sequence_id", key, detect.micros(F.col("created_at")).alias("micros"))
    wait = (lambda x: seconds * 1000 if x[1] and seconds is not None else None) if idle else None
    return keyed.folded(timed, key, ["sequence_id"], ["micros"], "sealed_after long, sealed_at long, reason string", grow, late, wait)


def transitions(statuses: DataFrame, key: str = "monitor", ties: Sequence[str] = ()) -> DataFrame:
    """key, checked_at, status, before: the rows of (key, checked_at, status) whose status is not that of the one before;
    before the first it counts as intact. Columns `ties` order rows of one time. State: the last status."""

    def follow(state: tuple | None, rows: list[tuple]) -> tuple[tuple, list[tuple]]:
        (before,) = state or ("intact",)
        out = []
        for t, now in rows:
            if now != before:
                out.append((t, now, before))
            before = now
        return (before,), out

    rows = statuses.select(key, F.col("checked_at").cast("long").alias("checked_at"), "status", *ties)
    return keyed.folded(rows, key, ["checked_at", *ties], ["checked_at", "status"], "checked_at long, status string, before string", follow)


def each_batch(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None):
    """Runs `work` on each micro-batch: all that is there, once, or at an interval. One query takes the place of a lock."""
    writer = stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def to_files(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
