"""The ledger watched as it grows: chains verified row by row across batches, checkpoints sealed by count, time or boundary."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import text as X
from tidemark.operators import detect
from tidemark.sources import shared
from tidemark.streaming import jobs, keyed


def fed(rows: DataFrame, order: str, parts: int, base: str, span: DataFrame | None = None) -> Iterator[DataFrame]:
    """Streams of rows that come in `parts`, by growing `order`: one after each part, over all that is there by then. Rows are
    sorted into parts and written once; a part is as many files as Spark writes. span: rows with the same order, or more,
    that are read for its ends where `rows` are dear to make."""
    spark = rows.sparkSession
    low, high = (rows if span is None else span).agg(F.min(order), F.max(order)).first()
    place = F.least(F.floor((F.col(order) - low) * parts / ((high - low) or 1)), F.lit(parts - 1)) if low is not None else F.lit(0)
    rows.withColumn("part", place.cast("int")).write.partitionBy("part").parquet(f"{base}/all")
    held = spark.read.schema(T.StructType([*rows.schema, T.StructField("part", T.IntegerType())])).parquet(f"{base}/all")
    for i in range(parts):
        held.where(F.col("part") == i).drop("part").write.mode("append").parquet(f"{base}/ledger")
        yield spark.readStream.schema(rows.schema).parquet(f"{base}/ledger")


def in_turn(rows: DataFrame, order: str, parts: int, job: Callable[[DataFrame, str], DataFrame], name: str, span: DataFrame | None = None) -> DataFrame:
    """What a streaming job makes of rows that come in `parts`, by growing `order`. After each part the job starts again from
    its checkpoint and runs until nothing is left, so every part but the first is met after a restart.

    job: a stream of the rows and the folder of its own to its output stream. span: see `fed`.
    """
    base = shared.folder(rows.sparkSession, name)
    for stream in fed(rows, order, parts, base, span):
        out = job(stream, base)
        jobs.to_files(out, f"{base}/out", f"{base}/state").awaitTermination()
    return rows.sparkSession.read.schema(out.schema).parquet(f"{base}/out")


def verified(chain: DataFrame, key: str = "employee_id", position: str = "chain_seq", stale_s: int | None = None) -> DataFrame:
    """Verification as rows come: key, position, mismatch, gap, orphan of each row that is not sound, and after each batch one
    row with the chain's status (intact or tampered), entries, and the counts so far, position then the last one seen.

    State: each chain's last position and recomputed hash, and the counts; so a batch costs what it brings, whatever came
    before, and the outcome is that of a batch over all rows, wherever batches end. Positions must not fall from batch to
    batch; a row that comes late is a gap. With `stale_s` a chain of which nothing came for twice that many seconds is
    reported once more, with status unknown: an old status is no status.
    """

    def follow(state: tuple | None, rows: list[tuple]) -> tuple[tuple, list[tuple]]:
        last, before, entries, bad, _ = state or (0, X.GENESIS, 0, 0, None)
        out: list[tuple] = []
        for at, previous, entry, again in rows:
            flags = again != entry, at != last + 1, previous != before
            if any(flags):
                bad += 1
                out.append((at, *flags, None, None, None))
            last, before, entries = int(at), again, entries + 1
        out.append((last, None, None, None, "tampered" if bad else "intact", entries, bad))
        return (last, before, entries, bad, stale_s), out

    def late(state: tuple) -> tuple[tuple, list[tuple]]:
        last, before, entries, bad, _ = state
        return (last, before, entries, bad, None), [(last, None, None, None, "unknown", entries, bad)]

    rows = chain.select(key, F.col(position).alias("at"), "previous_hash", "entry_hash", X.entry_hash(F.col("previous_hash")).alias("again"))
    out = f"{position} long, mismatch boolean, gap boolean, orphan boolean, status string, entries long, bad long"
    wait = None if stale_s is None else lambda x: None if x[4] is None else 2000 * stale_s
    return keyed.folded(rows, key, ["at"], ["at", "previous_hash", "entry_hash", "again"], out, follow, late, wait)


def sealing(ledger: DataFrame, rows: int = 25, seconds: int = 60, interval: int | None = None, key: str = "employee_id", idle: bool = False) -> DataFrame:
    """key, sealed_after, sealed_at, reason, at_micros: the checkpoints that are due as rows (key, sequence_id, created_at)
    come. They are judged at every row, by its own time, so batches do not matter.

    count: `rows` rows wait. time: so many seconds have passed since the last checkpoint, or since the first row where there
    is none. boundary, only with `interval`, in place of both: the position reaches the next multiple of the interval after
    the last checkpoint. With `idle` a processing-time timer seals what waits while nothing comes. State: the rows that are
    sealed and seen, and the time of the last checkpoint or of the first row.
    """

    def follow(state: tuple | None, rows: list[tuple]) -> tuple[tuple, list[tuple]]:
        done, seen, since = state or (0, 0, None)
        out = []
        for (t,) in rows:
            t, seen = int(t), seen + 1
            since = t if since is None else since
            if interval is not None:
                reason = "boundary" if seen >= (done // interval + 1) * interval else None
            else:
                reason = "count" if seen - done >= rows_most else "time" if t - since >= seconds * 1_000_000 else None
            if reason:
                out.append((done, seen, reason, t))
                done, since = seen, t
        return (done, seen, since), out

    def late(state: tuple) -> tuple[tuple, list[tuple]]:
        done, seen, since = state
        if seen == done:
            return state, []
        since += seconds * 1_000_000
        return (seen, seen, since), [(done, seen, "time", since)]

    rows_most = rows
    timed = ledger.select("sequence_id", key, detect.micros(F.col("created_at")).alias("micros"))
    wait = (lambda x: seconds * 1000 if x[1] > x[0] else None) if idle else None
    return keyed.folded(timed, key, ["sequence_id"], ["micros"], "sealed_after long, sealed_at long, reason string, at_micros long", follow, late, wait)
