import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import bitemporal as B
from tidemark.operators import replay

COLUMNS = "sequence_id long, employee_id int, action string, table_name string, row_id int, old_value_text string, new_value_text string, created_at timestamp_ntz"


def fold(rows, skip, as_of):
    """One employee's rows (tuples of COLUMNS), one after another: actual, counterfactual, money and days above."""
    tracks, before, money, days = ({}, {}), None, 0.0, 0

    def at(track, day):
        held = [(e, i, a) for i, (a, e) in track.items() if e <= day]
        return max(held)[2] if held else 0.0

    def add(first, last):
        nonlocal money, days
        for k in range((last - first).days):
            day = first + dt.timedelta(k)
            gain = at(tracks[0], day) - at(tracks[1], day)
            money, days = money + max(0.0, gain), days + (gain > 0)

    for seq, _, action, table, row_id, old, new, when in rows:
        if when > as_of:
            continue
        if before is not None:
            add(before, when.date())
        before = when.date()
        if table != "salary_history":
            continue
        for track in tracks[: 1 if seq in skip else 2]:
            p = json.loads(old if action == "DELETE" else new) if (old if action == "DELETE" else new) else {}
            i = p.get("salary_history_id", row_id)
            if action == "DELETE":
                track.pop(int(i), None)
                continue
            if "amount" not in p:
                continue
            try:
                i, amount = int(i), float(p["amount"])
            except (TypeError, ValueError):
                continue
            try:
                date = dt.date.fromisoformat((p.get("effective_date") or "")[:10])
            except ValueError:
                date = when.date()
            track[i] = (amount, date)
    if before is not None:
        add(before, as_of.date())
    return at(tracks[0], as_of.date()), at(tracks[1], as_of.date()), round(money / replay.YEAR_DAYS, 2), round(days / replay.MONTH_DAYS, 1)


def frame(spark, rows):
    return spark.createDataFrame(rows, COLUMNS).repartition(5)


def salary(seq, employee, action, i, when, amount=None, date=None, row_id=0):
    payload = {k: v for k, v in (("salary_history_id", i), ("amount", amount), ("effective_date", date)) if v is not None}
    text = json.dumps({k: str(v) for k, v in payload.items()})
    return (seq, employee, action, "salary_history", row_id, text if action == "DELETE" else None, None if action == "DELETE" else text, when)


@pytest.mark.parametrize("bucket", [3, 1 << 16])
def test_replay_is_the_fold_on_random_ledgers(spark, monkeypatch, bucket):
    monkeypatch.setattr(B, "BUCKET", bucket)
    rng = random.Random(bucket)
    start, rows, seq = dt.datetime(1969, 11, 1, 8), [], 0
    for employee in range(40):
        when = start
        for _ in range(rng.randrange(1, 14)):
            seq += 1
            when += dt.timedelta(days=rng.choice([0, 0, 1, 3, 40]), hours=rng.randrange(3))
            action = rng.choice(["INSERT", "INSERT", "UPDATE", "DELETE"])
            if rng.random() < 0.2:
                rows.append((seq, employee, action, "employees", employee, None, "{}", when))
                continue
            date = rng.choice([None, "soon", (when + dt.timedelta(days=rng.randrange(-60, 60))).date().isoformat()])
            rows.append(salary(seq, employee, action, rng.choice([None, 1, 2, 3]), when, rng.choice([100, 200.5, 300, "none", None]), date, rng.choice([1, 2])))
    skip, as_of = {s for s in range(1, seq + 1) if rng.random() < 0.4}, start + dt.timedelta(days=120)
    found = B.replayed(frame(spark, rows), spark.createDataFrame([(s,) for s in skip], "sequence_id long"), F.lit(as_of.isoformat(sep=" ")).cast("timestamp_ntz")).collect()
    assert len(found) == 40
    for r in found:
        own = [x for x in rows if x[1] == r["employee_id"]]
        a, c, money, months = fold(own, skip, as_of)
        assert (float(r["actual"]), float(r["counterfactual"]), float(r["annual"])) == (a, c, max(0.0, a - c))
        assert abs(r["cumulative"] - money) < 0.011 and r["tenure_months"] == months
        known = [x for x in own if x[7] <= as_of]
        assert (r["skipped"], r["applied"]) == (sum(x[0] in skip for x in known), sum(x[0] not in skip for x in known))


def test_late_entry_does_not_rewrite_what_was_known(spark):
    """A backdated row entered later holds from its entry on, and does not outrank a later effective date."""
    day = lambda m, d: dt.datetime(2024, m, d)
    rows = [salary(1, 1, "INSERT", 1, day(1, 1), 80000, "2024-01-01"), salary(2, 1, "INSERT", 2, day(1, 1), 200000, "2024-01-01"), salary(3, 1, "INSERT", 3, day(7, 3), 100000, "2024-07-03"), salary(4, 1, "INSERT", 4, day(8, 1), 50000, "2024-03-01")]
    found = B.replayed(frame(spark, rows), spark.createDataFrame([(2,)], "sequence_id long"), F.lit("2024-12-31").cast("timestamp_ntz")).first()
    assert (float(found["actual"]), float(found["counterfactual"]), float(found["annual"])) == (100000, 100000, 0)
    assert found["cumulative"] == round(120000 * 184 / 365.2425, 2) and found["tenure_months"] == 6.0


@pytest.mark.parametrize("since,until", [(0, 1), (5, 5), (-3, 4), (0, 70000), (19700, 19800), (1, 1 << 18), (-70000, 70001)])
def test_blocks_make_up_the_span(spark, since, until):
    got = spark.range(1).select(B.blocks(F.lit(since), F.lit(until)).alias("b")).first()["b"]
    days = sorted(range_ for x in got for range_ in [(x["at"] << x["size"], (x["at"] + 1) << x["size"])])
    assert sum(b - a for a, b in days) == max(0, until - since)
    assert not days or (days[0][0] == since and days[-1][1] == until and all(x[1] == y[0] for x, y in zip(days, days[1:])))


def test_dual_states_and_what_was_asked(spark):
    t = lambda h: dt.datetime(2024, 1, 1, h)
    rows = [(1, 1, "INSERT", "employees", 1, None, '{"a": "1", "b": "1"}', t(0)), (2, 1, "UPDATE", "employees", 1, None, '{"a": "2"}', t(1)), (3, 1, "UPDATE", "employees", 1, None, None, t(2)), (4, 2, "INSERT", "employees", 2, None, '{"a": "3"}', t(3)), (5, 2, "DELETE", "employees", 2, "{}", None, t(4)), (6, 3, "INSERT", "employees", 3, None, '{"z": "9"}', t(9))]
    as_of, df = F.lit("2024-01-01 08:00:00").cast("timestamp_ntz"), frame(spark, rows)
    skipped = spark.createDataFrame([(2,), (5,)], "sequence_id long")
    found = {r["employee_id"]: (r["actual"], r["counterfactual"]) for r in B.documents(df, skipped, as_of).collect()}
    assert found == {1: ({"a": "2", "b": "1"}, {"a": "1", "b": "1"}), 2: (None, {"a": "3"})}
    asked = spark.createDataFrame([(1, 2), (1, 4), (1, 99), (3, 6), (3, None), (2, 5)], "employee_id int, sequence_id long")
    assert {(r["employee_id"], r["sequence_id"]): r["status"] for r in B.asked_status(df, asked, as_of).collect()} == {(1, 2): "ok", (1, 4): "not_in_stream", (1, 99): "not_in_ledger", (3, 6): "not_in_stream", (3, None): "nothing_asked", (2, 5): "ok"}
    held = {k: {r["employee_id"]: r["state"] for r in replay.documents(df, F.lit(True), k).collect()} for k in ("none", "empty", "keep")}
    assert held["none"].get(1) is None and held["empty"][1] == {} and held["keep"][1] == {"a": "2", "b": "1"}
