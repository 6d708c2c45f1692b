import hashlib
import hmac

from pyspark.sql import functions as F

from tidemark.operators import contexts as A
from tidemark.streaming import jobs, keyed, monitor

BIG = (1 << 60) + 1


def states(spark, job, rows, order, parts=2):
    """What a job makes of rows in parts, and how many rows its state has at the end."""
    seen = []

    def kept(stream, base):
        out = job(stream, base)
        seen.append((out, base))
        return out

    found = monitor.in_turn(rows, order, parts, kept, "keyed")
    # Once more over the same folders: nothing is new, but the progress tells the state's size.
    out, base = seen[-1]
    rows.limit(1).write.mode("append").parquet(f"{base}/ledger")
    query = jobs.to_files(out, f"{base}/again", f"{base}/state")
    query.awaitTermination()
    return found, query.lastProgress["stateOperators"][0]["numRowsTotal"]


def test_many_keys_share_rows_of_the_state(spark):
    """With a row for each key, each costs a call with data frames of its own in every batch."""
    rows = spark.range(6 * 2000).selectExpr("id as sequence_id", "cast(id % 2000 as int) as employee_id", "cast('2024-01-01' as timestamp_ntz) as created_at")
    found, held = states(spark, lambda r, _: jobs.sealing(r, 2, None), rows, "sequence_id")
    assert held <= keyed.GROUPS < 2000
    assert found.count() == 6000 and found.distinct().count() == 6000 and found.agg(F.max("sealed_at")).first()[0] == 6


def test_keys_are_apart_whatever_their_group(spark):
    """A null key, and long ones that a double does not tell apart, next to each other in one group."""
    keys = [None, 0, BIG, BIG + 1]
    rows = spark.createDataFrame([(i, keys[i % 4], i * (1 + i % 4)) for i in range(40)], "at long, owner long, x long")
    follow = lambda s, new: ((s or 0) + sum(x for (x,) in new), [(len(new), (s or 0) + sum(x for (x,) in new))])
    want = {k: sum(i * (1 + i % 4) for i in range(40) if keys[i % 4] == k) for k in keys}
    for groups in (1, 7):
        found = monitor.in_turn(rows, "at", 3, lambda r, _: keyed.folded(r, "owner", ["at"], ["x"], "n long, total long", follow, groups=groups), "apart")
        assert {r["owner"]: r["total"] for r in found.groupBy("owner").agg(F.max("total").alias("total")).collect()} == want


def test_states_of_one_time_come_in_the_order_of_their_ties(spark):
    rows = spark.createDataFrame([("m", 5, i, s) for i, s in enumerate(["a", "b", "a", "b"])], "monitor string, checked_at long, event_id long, status string").orderBy(F.desc("event_id"))
    found = monitor.in_turn(rows, "checked_at", 1, lambda r, _: jobs.transitions(r, ties=["event_id"]), "ties")
    assert sorted((r["status"], r["before"]) for r in found.collect()) == [("a", "b"), ("a", "intact"), ("b", "a"), ("b", "a")]


def test_nonces_in_one_group_have_their_own_owners(spark):
    key = b"example"

    def context(i, nonce, transaction):
        parts = ["k", "1", "2", "hr_admin", nonce, "100", "160"]
        signature = hmac.new(key, "|".join([A.LABEL, *parts]).encode(), hashlib.sha256).hexdigest()
        return (i, "1", *parts[:3], "hr_admin", "hr_admin", nonce, "100", "160", signature, transaction, 130)

    nonce = lambda i: f"{i:08x}-0000-0000-0000-000000000000"
    rows = [context(2 * i, nonce(i), i) for i in range(3000)] + [context(6001 + i, nonce(i), i + (i % 3 == 0)) for i in range(3000)]
    contexts = spark.createDataFrame(rows, "event_id long, version string, key_id string, user_id string, employee_id string, role string, session_role string, nonce string, issued_at string, expires_at string, signature string, transaction_id long, now long")
    keys = spark.createDataFrame([("k", key, True)], "key_id string, material binary, enabled boolean")
    found, held = states(spark, lambda r, _: A.watched(r, keys, "event_id", None), contexts, "event_id")
    assert held <= keyed.GROUPS
    told = {r["event_id"]: r["fault"] for r in found.collect()}
    assert told == {2 * i: None for i in range(3000)} | {6001 + i: "nonce_used" if i % 3 == 0 else None for i in range(3000)}
