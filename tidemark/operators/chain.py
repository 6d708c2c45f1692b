"""SHA-256 chains over ledger rows: building, verification at any parallelism, localisation and roll-up."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.functions import text as X
from tidemark.operators import ordered as O

#: Consecutive rows that one window of the verification looks at.
BUCKET = 1 << 16


def build(ledger: DataFrame, keys: Sequence[str] = ("employee_id",)) -> DataFrame:
    """Adds chain_seq, previous_hash and entry_hash: one chain for each key, or one over all without keys."""

    def step(state: tuple, row: tuple) -> tuple:
        at, before = state
        now = hashlib.sha256((row[0] + before).encode()).hexdigest()
        return (at + 1, now), (at + 1, before, now)

    return O.in_order(ledger, keys, ["sequence_id"], ["_serial"], "chain_seq bigint, previous_hash string, entry_hash string", lambda: (0, X.GENESIS), step, {"_serial": X.serialised()}).drop("_serial")


def links(chain: DataFrame, keys: Sequence[str] = ("employee_id",), position: str = "chain_seq", bucket: int = BUCKET, start: int = 0, seed: str | None = X.GENESIS) -> DataFrame:
    """Every row with mismatch, gap and orphan.

    mismatch: the row's hash is not that of its content; gap: its position does not follow the row before; orphan: its
    previous hash is not the recomputed hash of the row before. The first row must follow `start` and carry `seed`;
    with seed None it is trusted, position included. The bucket size never changes the outcome.
    """
    rows = chain.withColumn("recomputed", X.entry_hash(F.col("previous_hash")))
    rows = O.previous(rows, keys, F.floor((F.col(position) - 1) / bucket), [position], {"before_seq": position, "before_hash": "recomputed"})
    first_seq, first_hash = (F.lit(start), F.lit(seed)) if seed is not None else (F.col(position) - 1, F.col("previous_hash"))
    return rows.select(
        *chain.columns,
        (F.col("recomputed") != F.col("entry_hash")).alias("mismatch"),
        (F.col(position) != F.coalesce("before_seq", first_seq) + 1).alias("gap"),
        (F.col("previous_hash") != F.coalesce("before_hash", first_hash)).alias("orphan"),
    )


def anomalies(chain: DataFrame, keys: Sequence[str] = ("employee_id",), position: str = "chain_seq", **options) -> DataFrame:
    return links(chain, keys, position, **options).where("mismatch OR gap OR orphan").select(*keys, position, "mismatch", "gap", "orphan")


def report(chain: DataFrame, keys: Sequence[str] = ("employee_id",), position: str = "chain_seq", **options) -> DataFrame:
    """One row for each chain: total_entries, last_seq, counts of each anomaly, valid, and where it first broke.

    first_bad: the first mismatch, else the position before the first gap's row that is missing, else the first orphan;
    last_verified: the position before it, or the last one.
    """
    rows = O.previous(links(chain, keys, position, **options), keys, F.floor((F.col(position) - 1) / BUCKET), [position], {"_p": position})
    count = lambda c: F.count_if(F.col(c))
    out = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_entries"),
        F.max(position).alias("last_seq"),
        count("mismatch").alias("n_mismatch"),
        count("gap").alias("n_gap"),
        count("orphan").alias("n_orphan"),
        F.coalesce(F.min(F.when(F.col("mismatch"), F.col(position))), F.min(F.when(F.col("gap"), F.coalesce("_p", F.lit(0)) + 1)), F.min(F.when(F.col("orphan"), F.col(position)))).alias("first_bad"),
    )
    valid = F.col("first_bad").isNull()
    return out.withColumn("valid", valid).withColumn("last_verified", F.when(valid, F.col("last_seq")).otherwise(F.col("first_bad") - 1))


def segments(chain: DataFrame, size: int, keys: Sequence[str] = ("employee_id",), position: str = "chain_seq") -> DataFrame:
    """The report by segment of `size` positions, judged as one chain: an edge between segments is checked like any other."""
    rows = links(chain, keys, position).withColumn("segment", F.floor((F.col(position) - 1) / size))
    return rows.groupBy(*keys, "segment").agg(F.count(F.lit(1)).alias("entries"), F.bool_and(~(F.col("mismatch") | F.col("gap") | F.col("orphan"))).alias("valid"))


def tail_status(chain: DataFrame, tails: DataFrame, keys: Sequence[str] = ("employee_id",)) -> DataFrame:
    """Against the recorded tails (keys, tail_hash, tail_seq): pass or fail. Shows a truncated end, which links cannot."""
    now = chain.groupBy(*keys).agg(F.max_by("entry_hash", "chain_seq").alias("hash"), F.max("chain_seq").alias("seq"))
    match = F.lit(True)
    for k in keys:
        match = match & F.col(f"t.{k}").eqNullSafe(F.col(f"n.{k}"))
    both = tails.alias("t").join(now.alias("n"), match, "left").select("t.*", "hash", "seq")
    same = F.col("tail_hash").eqNullSafe(F.coalesce("hash", F.lit(X.GENESIS))) & F.col("tail_seq").eqNullSafe(F.coalesce("seq", F.lit(0)))
    return both.select(*keys, F.when(same, "pass").otherwise("fail").alias("tail"))


def bounds(chain: DataFrame, sealed: DataFrame, keys: Sequence[str] = ("employee_id",), position: str = "chain_seq", bucket: int = BUCKET) -> DataFrame:
    """Each row with the segment that it falls in by a list of checkpoints (keys, last_seq): sealed_after, the checkpoint
    before it (0 without any), and sealed_at, its own, null in the open last segment.

    Rows and checkpoints are one order, read up and down, so no row is matched with more than its two neighbours.
    Checkpoints that repeat count once.
    """
    return bounds_by_bucket(chain, sealed, keys, position, bucket).drop("_bucket")


def bounds_by_bucket(chain: DataFrame, sealed: DataFrame, keys: Sequence[str], position: str, bucket: int = BUCKET) -> DataFrame:
    """`bounds` with `_bucket`, by which, with the keys, the rows are dealt still: windows within it need no exchange.

    A bucket gets the checkpoints next to it, before and after, as marks of its own, so that rows pass one exchange and no
    join; which these are is worked out from one row a bucket."""
    within = lambda at: F.floor(at / bucket)
    at = F.col(position).cast("long")
    marks = sealed.where(F.col("last_seq") > 0).select(*keys, F.col("last_seq").cast("long").alias("_at")).distinct()
    ends = chain.select(*keys, within(at).alias("_bucket"), F.lit(None).cast("long").alias("_at")).unionByName(marks.withColumn("_bucket", within(F.col("_at"))))
    ends = ends.groupBy(*keys, "_bucket").agg(F.min("_at").alias("_low"), F.max("_at").alias("_high"))
    by = W.partitionBy(*keys)
    before = F.last("_high", ignorenulls=True).over(by.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1))
    after = F.last("_low", ignorenulls=True).over(by.orderBy(F.col("_bucket").desc()).rowsBetween(W.unboundedPreceding, -1))
    beside = ends.withColumns({"_before": before, "_after": after})
    beside = beside.select(*keys, "_bucket", F.explode(F.array_compact(F.array("_before", "_after"))).alias("_at"))
    marks = marks.withColumn("_bucket", within(F.col("_at"))).unionByName(beside).withColumn("_mark", F.lit(True))
    both = chain.withColumn("_at", at).withColumn("_bucket", within(at)).withColumn("_mark", F.lit(False)).unionByName(marks, allowMissingColumns=True)
    order = 2 * F.col("_at") + F.when(F.col("_mark"), 1).otherwise(0)
    marked, by = F.when(F.col("_mark"), F.col("_at")), W.partitionBy(*keys, "_bucket")
    so_far = lambda o: F.last(marked, ignorenulls=True).over(by.orderBy(o).rowsBetween(W.unboundedPreceding, 0))
    both = both.withColumns({"sealed_after": so_far(order), "sealed_at": so_far(order.desc())})
    return both.where(~F.col("_mark")).select(*chain.columns, F.coalesce("sealed_after", F.lit(0)).cast("long").alias("sealed_after"), "sealed_at", "_bucket")


def segments_by(chain: DataFrame, sealed: DataFrame, keys: Sequence[str] = ("employee_id",), position: str = "chain_seq") -> DataFrame:
    """The report by the segments between checkpoints, the last one open; edges are checked like any other link."""
    rows = bounds(links(chain, keys, position), sealed, keys, position)
    return rows.groupBy(*keys, "sealed_after", "sealed_at").agg(F.count(F.lit(1)).alias("entries"), F.bool_and(~(F.col("mismatch") | F.col("gap") | F.col("orphan"))).alias("valid"))


def tails(chain: DataFrame, keys: Sequence[str] = ("employee_id",)) -> DataFrame:
    return chain.groupBy(*keys).agg(F.max_by("entry_hash", "chain_seq").alias("tail_hash"), F.max("chain_seq").alias("tail_seq"))


def newest_links(chain: DataFrame, newest: int = 1000, keys: Sequence[str] = ()) -> DataFrame:
    """intact, newest sequence and rows over the newest rows of one chain, or of each chain by the keys; the limit is the
    feature."""
    if keys:
        rows = chain.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(F.col("sequence_id").desc()))).where(F.col("_r") <= newest).drop("_r")
    else:
        rows = chain.orderBy(F.col("sequence_id").desc()).limit(newest)
    rows = O.previous(rows, keys, F.lit(0), ["sequence_id"], {"prior": "entry_hash"})
    return rows.groupBy(*keys).agg(F.coalesce(F.bool_and(F.when(F.col("prior").isNotNull(), F.col("previous_hash") == F.col("prior"))), F.lit(True)).alias("intact"), F.max("sequence_id").alias("newest"), F.count(F.lit(1)).alias("rows"))


def rolled_up(checks: Column) -> Column:
    """tampered if any check fails, intact if all pass, else unknown: unknown is never a pass."""
    return F.when(F.array_contains(checks, "fail"), "tampered").when((F.size(checks) > 0) & F.forall(checks, lambda x: x == "pass"), "intact").otherwise("unknown")


def inferred_attack(gap: Column, chain_bad: Column, anchor: Column, signature: Column) -> Column:
    return F.when(gap, "row_deleted").when(chain_bad, "row_tampered").when(anchor == "fail", "recomputed_and_hidden").when(signature == "fail", "signature_forged").otherwise("none")


def score(checks: Column) -> Column:
    """Percent of checks that pass, halves to even; unknown does not count as passed."""
    return F.bround(100 * F.size(F.filter(checks, lambda x: x == "pass")) / F.size(checks)).cast("int")


def tampered(chain: DataFrame, edit: Column, drop: Column) -> DataFrame:
    """A copy in which the rows of `edit` have another payload and those of `drop` are missing."""
    return chain.where(~drop).withColumn("new_value_text", F.when(edit, F.lit('{"forged": "true"}')).otherwise(F.col("new_value_text")))
