"""Suspicious patterns: large salary changes, deletions, bursts of deactivations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.functions import text as X
from tidemark.operators import ordered as O

HOUR = 3_600_000_000
BUCKET = 1 << 16


def micros(t: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), t.cast("timestamp_ntz"))


def salary_changes(ledger: DataFrame, share: str = "0.30") -> DataFrame:
    """INSERTs of a salary that differ from the employee's one before by more than `share` of it, up or down."""
    rows = ledger.where("table_name = 'salary_history' AND action = 'INSERT'").select("sequence_id", "employee_id", "amount")
    rows = O.previous(rows, ["employee_id"], F.floor(F.col("sequence_id") / BUCKET), ["sequence_id"], {"before": "amount"})
    return rows.where((F.col("before") > 0) & (F.abs(F.col("amount") - F.col("before")) > F.lit(share).cast("decimal(3,2)") * F.col("before")))


def deletions(ledger: DataFrame) -> DataFrame:
    return ledger.where("action = 'DELETE'").select("sequence_id", "employee_id")


def deactivations(ledger: DataFrame) -> DataFrame:
    was, now = (F.get_json_object(c, "$.is_active") for c in ("old_value_text", "new_value_text"))
    return ledger.where((F.col("table_name") == "employees") & (F.col("action") == "UPDATE") & (was == "true") & (now == "false")).select("sequence_id", "employee_id", "created_at")


def counts_ahead(events: DataFrame, span: int = HOUR) -> DataFrame:
    """Adds n_ahead: events within [t, t + span], peers at both ends included.

    An event is copied into the span-wide bucket before its own, so every bucket holds all that its own events look at.
    """
    rows = events.withColumn("_t", micros(F.col("created_at"))).withColumn("_own", F.floor(F.col("_t") / span))
    rows = rows.select("*", F.explode(F.array("_own", F.col("_own") - 1)).alias("_bucket"))
    ahead = W.partitionBy("_bucket").orderBy("_t").rangeBetween(W.currentRow, span)
    return rows.withColumn("n_ahead", F.count(F.lit(1)).over(ahead)).where("_bucket = _own").drop("_t", "_own", "_bucket")


def burst_starts(ledger: DataFrame, more_than: int = 3) -> DataFrame:
    """Every deactivation that more than `more_than` (itself included) fall within an hour of."""
    return counts_ahead(deactivations(ledger)).where(F.col("n_ahead") > more_than)


def incidents(ledger: DataFrame, more_than: int = 3) -> DataFrame:
    """The first start of each incident: starts at most an hour after the one before belong to its incident."""
    return first_starts(grouped(ledger, more_than))


def first_starts(starts: DataFrame) -> DataFrame:
    return starts.where(F.col("sequence_id") == F.col("root")).drop("root")


def grouped(ledger: DataFrame, more_than: int = 3) -> DataFrame:
    """Every burst start with the root of its incident, the sequence of its first start: the flag that stands for it."""
    return rooted(burst_starts(ledger, more_than))


def rooted(starts: DataFrame) -> DataFrame:
    """Burst starts with root."""
    starts = starts.withColumn("_t", micros(F.col("created_at")))
    day = F.floor(F.col("_t") / (24 * HOUR))
    starts = O.previous(starts, [], day, ["_t", "sequence_id"], {"_before": "_t"})
    opens = F.col("_before").isNull() | (F.col("_t") - F.col("_before") > HOUR)
    return O.carried(starts, [], day, ["_t", "sequence_id"], F.col("sequence_id"), "root", opens).drop("_t", "_before")


def new_flags(found: DataFrame, stored: DataFrame) -> DataFrame:
    """Flags of sequences that no stored flag has, whatever its reason: what a refresh adds."""
    return found.join(stored.select("sequence_id").distinct(), "sequence_id", "left_anti")


def open_flags(reviewed: DataFrame) -> DataFrame:
    """Of flags with decision and root those that wait for a review: open or reopened, and not superseded by a root."""
    return reviewed.where(F.col("decision").isin("open", "reopened") & (F.col("root") == F.col("sequence_id")))


def flags(ledger: DataFrame) -> DataFrame:
    """sequence_id, employee_id, reason: one flag for each row, in order of precedence; affected: the events it stands for."""
    return ranked(salary_changes(ledger), deletions(ledger), incidents(ledger))


def ranked(changes: DataFrame, deleted: DataFrame, bursts: DataFrame) -> DataFrame:
    """The flags of what was found, one for each row."""
    named = [(changes, "salary_change", F.lit(1)), (deleted, "data_deletion", F.lit(1)), (bursts, "deactivation_burst", F.col("n_ahead"))]
    every = [df.select("sequence_id", "employee_id", F.struct(F.lit(i).alias("rank"), F.lit(reason).alias("reason"), n.cast("long").alias("affected")).alias("flag")) for i, (df, reason, n) in enumerate(named)]
    out = every[0].unionByName(every[1]).unionByName(every[2]).groupBy("sequence_id").agg(F.first("employee_id").alias("employee_id"), F.min("flag").alias("flag"))
    return out.select("sequence_id", "employee_id", "flag.reason", "flag.affected")


def mass_deletions(ledger: DataFrame) -> DataFrame:
    """Deletions that are the first, middle or last of three within an hour."""
    rows = ledger.where("action = 'DELETE'").select("sequence_id", "employee_id", micros(F.col("created_at")).alias("_t"))
    day = 24 * HOUR
    # Three within an hour: a row with the two before it. Their numbers name the rows, so each is found by one join.
    rows = O.numbered(rows, [], F.floor(F.col("_t") / day), ["_t", "sequence_id"], "_n")
    third = O.previous(rows, [], F.floor(F.col("_n") / BUCKET), ["_n"], {"_b": F.struct("_t", "_n")})
    third = O.previous(third, [], F.floor(F.col("_n") / BUCKET), ["_n"], {"_bb": "_b"}).where(F.col("_t") - F.col("_bb._t") <= HOUR)
    near = third.select(F.explode(F.array(F.col("_n"), F.col("_n") - 1, F.col("_n") - 2)).alias("_n")).distinct()
    return rows.join(near, "_n", "left_semi").select("sequence_id", "employee_id")


def review_state(flagged: DataFrame, reviews: DataFrame) -> DataFrame:
    """Each flag with its latest decision by (reviewed_at, review_id), open without any."""
    last = reviews.groupBy("sequence_id").agg(F.max_by("decision", F.struct("reviewed_at", "review_id")).alias("decision"))
    return flagged.join(last, "sequence_id", "left").withColumn("decision", F.coalesce("decision", F.lit("open")))


def group_review_state(flagged: DataFrame, reviews: DataFrame) -> DataFrame:
    """Flags (sequence_id, root) with the latest decision on any flag of their group: a review of the root or of a
    superseded flag holds for all of the group. All reviews stay; the last by (reviewed_at, review_id) counts."""
    by_root = reviews.join(flagged.select("sequence_id", "root"), "sequence_id").groupBy("root").agg(F.max_by("decision", F.struct("reviewed_at", "review_id")).alias("decision"))
    return flagged.join(by_root, "root", "left").withColumn("decision", F.coalesce("decision", F.lit("open")))


def alerts(statuses: DataFrame) -> DataFrame:
    """Of (checked_at, status) the rows where the status changed, and the first unless it is intact."""
    t = micros(F.col("checked_at"))
    rows = O.previous(statuses, [], F.floor(t / (24 * HOUR)), ["checked_at"], {"before": "status"})
    return rows.where(~F.col("status").eqNullSafe(F.coalesce("before", F.lit("intact"))))


def freshness(status: Column, age_s: Column, interval_s: int = 300) -> Column:
    """A status older than twice the check interval is unknown."""
    return F.when(age_s > 2 * interval_s, "unknown").otherwise(status)


def severity_of(ledger: DataFrame) -> DataFrame:
    return ledger.select("sequence_id", X.severity(F.col("action"), F.col("table_name")).alias("severity"))
