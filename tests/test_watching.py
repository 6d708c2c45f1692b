import time

from pyspark.sql import functions as F

from tests.parity import SF
from tidemark.operators import chain as CH
from tidemark.operators import checkpoints as K
from tidemark.sources import derived as D
from tidemark.streaming import monitor


def until(path, spark, schema, found, seconds=60):
    end = time.time() + seconds
    while time.time() < end:
        try:
            rows = spark.read.schema(schema).parquet(path).collect()
        except Exception:
            rows = []
        if found(rows):
            return rows
        time.sleep(0.5)
    raise AssertionError(rows)


def timed(spark, stream, base):
    return stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(processingTime="1 second").start()


def test_old_status_turns_unknown_and_waiting_rows_are_sealed(spark, tmp_path):
    chain = CH.build(D.ledger(spark, SF).where("employee_id = 3"))
    chain.where("chain_seq <= 7").coalesce(1).write.parquet(f"{tmp_path}/in")
    rows = spark.readStream.schema(chain.schema).parquet(f"{tmp_path}/in")
    watch, seal = monitor.verified(rows, stale_s=1), monitor.sealing(rows, 100, 3, idle=True)
    running = [timed(spark, watch, f"{tmp_path}/watch"), timed(spark, seal, f"{tmp_path}/seal")]
    try:
        found = until(f"{tmp_path}/watch/out", spark, watch.schema, lambda x: any(r["status"] == "unknown" for r in x))
        assert sorted((r["status"], r["entries"], r["bad"]) for r in found) == [("intact", 7, 0), ("unknown", 7, 0)]
        sealed = until(f"{tmp_path}/seal/out", spark, seal.schema, lambda x: any(r["sealed_at"] == 7 for r in x))
        assert max(r["sealed_at"] for r in sealed) == 7 and {r["reason"] for r in sealed} == {"time"}
    finally:
        for q in running:
            q.stop()


def test_forged_seam_between_batches(spark):
    """A chain that goes on from another hash at the very place where a batch ends."""
    chain = CH.build(D.ledger(spark, SF).where("employee_id IN (3, 4)"))
    middle = chain.where("employee_id = 3 AND sequence_id > 500").agg(F.min("chain_seq")).first()[0]
    bad = chain.withColumn("previous_hash", F.when((F.col("employee_id") == 3) & (F.col("chain_seq") == middle), "f" * 64).otherwise(F.col("previous_hash")))
    wanted = sorted(tuple(r) for r in CH.anomalies(bad).collect())
    assert wanted and wanted[0][1] == middle
    out = monitor.in_turn(bad, "sequence_id", 2, lambda rows, _: monitor.verified(rows), "seam")
    assert sorted(tuple(r) for r in out.where("status IS NULL").select("employee_id", "chain_seq", "mismatch", "gap", "orphan").collect()) == wanted
    assert monitor.in_turn(bad.limit(0), "sequence_id", 1, lambda rows, _: monitor.verified(rows), "none").count() == 0


def test_due_counts_time_from_the_last_checkpoint(spark):
    rows = [(1, i, f"2024-01-01 00:00:{i:02d}") for i in range(1, 5)] + [(2, 1, "2024-01-01 00:00:00"), (3, 1, "2024-01-01 00:00:00"), (None, 1, "2024-01-01 00:00:00")]
    chain = spark.createDataFrame(rows, "employee_id int, chain_seq long, t string").selectExpr("employee_id", "chain_seq", "cast(t as timestamp_ntz) as created_at", "'h' as entry_hash")
    sealed = spark.createDataFrame([(1, 2, "2024-01-01 00:00:30"), (3, 1, "2024-01-01 00:00:30")], "employee_id int, last_seq long, t string").selectExpr("employee_id", "last_seq", "cast(t as timestamp_ntz) as sealed_when")
    at = lambda t, n: {r["employee_id"]: (r["pending"], r["elapsed"], r["trigger"]) for r in K.due(chain, sealed, F.lit(t).cast("timestamp_ntz"), n).collect()}
    assert at("2024-01-01 00:01:10", 25) == {1: (2, 40, None), 2: (1, 70, "time"), None: (1, 70, "time")}
    assert at("2024-01-01 00:01:30", 25)[1] == (2, 60, "time") and at("2024-01-01 00:00:10", 2)[1] == (2, 0, "count")
