"""Streams that verify and seal the ledger as it grows, each restarted between the parts that it is given."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.plans.catalogue import _FLAGS, BAD, _bad_chain, _links, query
from tidemark.sources import derived as D
from tidemark.sources import shared
from tidemark.streaming import detection, monitor

PARTS = 3


def _watched(spark, sf_dir):
    return monitor.in_turn(_bad_chain(spark, sf_dir), "sequence_id", PARTS, lambda rows, _: monitor.verified(rows), "verify", D.ledger(spark, sf_dir))


@query(BAD + ", " + _links("bad") + " select employee_id, chain_seq, mismatch, gap, orphan from checked where mismatch or gap or orphan")
def stream_verify(spark, sf_dir):
    """The rows that do not hold, found as they come; state carries each chain over batches and restarts."""
    return _watched(spark, sf_dir).where("status IS NULL").select("employee_id", "chain_seq", "mismatch", "gap", "orphan")


@query(BAD + ", " + _links("bad") + " select employee_id, max(chain_seq) as last_seq, count(*) as entries, count(*) filter (mismatch or gap or orphan) as bad, case when bool_or(mismatch or gap or orphan) then 'tampered' else 'intact' end as status from checked group by 1")
def stream_verify_status(spark, sf_dir):
    """Every chain's last status."""
    last = _watched(spark, sf_dir).where("status IS NOT NULL").groupBy("employee_id").agg(F.max(F.struct("entries", F.col("chain_seq").alias("last_seq"), "bad", "status")).alias("x"))
    return last.select("employee_id", "x.last_seq", "x.entries", "x.bad", "x.status")


ROWS, SECONDS, EVERY = 6, 259200, 7

_STEPS = D.with_sql("ledger") + f""", o as (select employee_id, epoch_us(created_at) as t, row_number() over (partition by employee_id order by sequence_id) as i from ledger),
r as (select employee_id, i, t, 0::bigint as done, t as since, null::bigint as was_done, null::varchar as reason from o where i = 1
  union all select employee_id, i, t, case when reason is null then done else i end, case when reason is null then since else t end, done, reason from (
    select o.employee_id, o.i, o.t, r.done, r.since, case when o.i - r.done >= {ROWS} then 'count' when o.t - r.since >= {SECONDS}::bigint * 1000000 then 'time' end as reason from r join o on o.employee_id = r.employee_id and o.i = r.i + 1))"""


@query(_STEPS + " select employee_id, was_done as sealed_after, i as sealed_at, reason, t as at_micros from r where reason is not null")
def stream_seal_timed(spark, sf_dir):
    """Checkpoints by count, or by the time since the last one, as rows come."""
    return monitor.in_turn(D.ledger(spark, sf_dir), "sequence_id", PARTS, lambda rows, _: monitor.sealing(rows, ROWS, SECONDS), "seal")


@query(D.with_sql("ledger") + f", o as (select employee_id, epoch_us(created_at) as t, row_number() over (partition by employee_id order by sequence_id) as i from ledger) select employee_id, i - {EVERY} as sealed_after, i as sealed_at, 'boundary' as reason, t as at_micros from o where i % {EVERY} = 0")
def stream_seal_boundary(spark, sf_dir):
    """Checkpoints at the multiples of an interval, as rows come."""
    return monitor.in_turn(D.ledger(spark, sf_dir), "sequence_id", PARTS, lambda rows, _: monitor.sealing(rows, interval=EVERY), "schedule")


@query(_FLAGS + " select sequence_id, employee_id, reason, affected from flags")
def stream_detect(spark, sf_dir):
    """The flags of the ledger as it comes in parts, the detector being started again for each."""
    base = shared.folder(spark, "detect")
    for rows in monitor.fed(D.ledger(spark, sf_dir), "sequence_id", PARTS, base):
        detection.run(rows, base)
    return detection.flags(spark, base)
