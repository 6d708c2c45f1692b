import random
from bisect import bisect_left

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark.operators import chain as CH
from tidemark.operators import sealed as SE
from tidemark.plans import catalogue as Q
from tidemark.sources import capsules

SF = "/root/testdata/sf0.01"


def moved(spark) -> int:
    """Bytes that stages have exchanged and written so far."""
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
    stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() + stages.apply(i).outputBytes() for i in range(stages.size()))


def test_capsules_exchange_no_paths(spark):
    """Paths, payloads and what a checkpoint has are not sent from step to step with each row, also where no table is small
    enough for a broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64k")
    try:
        start = moved(spark)
        rows = entry.queries()["evidence_capsules"](spark, SF).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("path")), F.max("root"), F.max("leaf"), F.max("status")).first()["n"]
        assert (moved(spark) - start) / rows < 700
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("bucket", [4, 1 << 16])
def test_segments_over_bucket_ends(spark, monkeypatch, bucket):
    """Segments shorter and longer than a bucket, gaps, positions below 1, marks without rows, null keys."""
    monkeypatch.setattr(SE, "BUCKET", bucket)
    draw = random.Random(bucket)
    chains = {k: sorted(draw.sample(range(-6, 60), draw.choice([1, 9, 40]))) for k in (1, 2, 3, None)}
    marks = {k: sorted(draw.sample(range(-2, 64), n)) for k, n in zip((1, 2, 3, None, 9), (2, 12, 0, 5, 1))}
    rows = [(k, p, p, 1, "a", "t", 1, None, f"n{p}", "2024", f"{p:064x}") for k, ps in chains.items() for p in ps]
    chain = spark.createDataFrame(rows, "employee_id int, chain_seq long, sequence_id long, actor_user_id int, action string, table_name string, row_id int, old_value_text string, new_value_text string, created_at_text string, entry_hash string").repartition(5)
    listed = spark.createDataFrame([(k, m) for k, ms in marks.items() for m in ms * 2], "employee_id int, last_seq long").repartition(3)
    expected, ends = {}, {}
    for k, ps in chains.items():
        good = [m for m in marks[k] if m > 0]
        for p in ps:
            i = bisect_left(good, p)
            ends[k, p] = (good[i - 1] if i else 0, good[i] if i < len(good) else None)
        for p in ps:
            own = [q for q in ps if ends[k, q][1] == ends[k, p][1]]
            if ends[k, p][1] is not None:
                expected[k, p] = (*ends[k, p], own.index(p), len(own))
    assert {(r["employee_id"], r["chain_seq"]): (r["sealed_after"], r["sealed_at"]) for r in CH.bounds(chain, listed, bucket=bucket).collect()} == ends
    got = SE.leaves(chain, listed).collect()
    assert {(r["employee_id"], r["chain_seq"]): (r["sealed_after"], r["sealed_at"], r["place"], r["n"]) for r in got} == expected and len(got) == len(expected)
    assert {r["entry_hash"] for r in got} == {f"{p:064x}" for _, p in expected}
    asked = spark.createDataFrame([(k, p) for k, p in ends if p % 3 == 0] * 2, "employee_id int, chain_seq long")
    paths = {(r["employee_id"], r["chain_seq"]): tuple(r["path"]) for r in SE.proofs(chain, listed).collect()}
    assert set(paths) == set(expected)
    assert {(r["employee_id"], r["chain_seq"]): tuple(r["path"]) for r in SE.proofs(chain, listed, asked=asked).collect()} == {x: y for x, y in paths.items() if x[1] % 3 == 0}


def test_capsules_of_asked_rows(spark):
    """With and without payloads, for rows that are asked for twice, that are not there, and for a null."""
    chain = Q._chain(spark, "/root/testdata/sf0.001")
    sealed = SE.K.signed(SE.K.fixed(chain, 5), bytes(32), "k")
    asked = spark.createDataFrame([(3,), (3,), (17,), (10**9,), (None,)], "sequence_id long")
    whole = {r["sequence_id"]: r for r in capsules.capsules(chain, sealed, asked).collect()}
    slim = {r["sequence_id"]: r for r in capsules.capsules(chain, sealed, asked, payload=False).collect()}
    all_rows = {r["sequence_id"]: r for r in capsules.capsules(chain, sealed).collect()}
    assert {k: r["status"] for k, r in whole.items()} == {k: r["status"] for k, r in slim.items()} == {3: "ok", 17: "ok", 10**9: "not_found", None: "not_found"}
    assert whole[3] == all_rows[3] and whole[17] == all_rows[17] and whole[3]["action"] is not None
    kept = [c for c in spark.createDataFrame([], capsules._SCHEMA).columns if c not in capsules.ROW or c == "sequence_id"]
    assert [slim[3][c] for c in kept] == [whole[3][c] for c in kept] and slim[3]["action"] is None
    assert len(all_rows) == chain.count()
