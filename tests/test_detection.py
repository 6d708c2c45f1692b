import datetime as dt
import random
from decimal import Decimal

from tidemark.operators import detect
from tidemark.streaming import detection

COLUMNS = "sequence_id long, employee_id int, action string, table_name string, old_value_text string, new_value_text string, amount decimal(12,2), created_at timestamp_ntz"


def ledger(n, seed):
    """Deactivations in heaps, with equal times and times that fall; salaries with gaps and nulls; deletions."""
    rng, at, out = random.Random(seed), dt.datetime(2024, 1, 1), []
    for seq in range(1, n + 1):
        at += dt.timedelta(minutes=rng.choice([0, 0, 1, 5, 20, 55, 70, 200]))
        when = at - dt.timedelta(minutes=rng.choice([0, 0, 0, 90]))
        who, kind = rng.choice([None, 1, 2, 3]), rng.randrange(5)
        if kind < 3:
            out.append((seq, who, "UPDATE", "employees", '{"is_active": "true"}', '{"is_active": "false"}', None, when))
        elif kind == 3:
            out.append((seq, who, "INSERT", "salary_history", None, "{}", rng.choice([None, Decimal(0), Decimal("100.00"), Decimal("130.00"), Decimal("130.01"), Decimal("70.00")]), when))
        else:
            out.append((seq, who, rng.choice(["DELETE", "INSERT"]), "employees", "{}", None, None, when))
    return out


def told(df):
    return sorted(map(tuple, df.select("sequence_id", "employee_id", "reason", "affected").collect()))


def test_flags_after_each_batch_are_those_of_all_rows_so_far(spark, tmp_path):
    rows, base = ledger(150, 3), str(tmp_path)
    schema = spark.createDataFrame([], COLUMNS).schema
    for i in range(0, len(rows), 50):
        spark.createDataFrame(rows[i : i + 50], COLUMNS).write.mode("append").parquet(f"{base}/in")
        detection.run(spark.readStream.schema(schema).parquet(f"{base}/in"), base)
        wanted = told(detect.flags(spark.createDataFrame(rows[: i + 50], COLUMNS)))
        assert told(detection.flags(spark, base)) == wanted
    assert {r[2] for r in wanted} == {"salary_change", "data_deletion", "deactivation_burst"}


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    """The offset of the last batch is written but its end is not: it runs again over what it left."""
    rows, base = ledger(60, 4), str(tmp_path)
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{base}/in")
    stream = lambda: spark.readStream.schema(spark.createDataFrame([], COLUMNS).schema).parquet(f"{base}/in")
    detection.run(stream(), base)
    before = told(detection.flags(spark, base))
    for state in ("events-state", "salaries-state"):
        for done in (tmp_path / state / "commits").iterdir():
            done.unlink()
    detection.run(stream(), base)
    assert told(detection.flags(spark, base)) == before == told(detect.flags(spark.createDataFrame(rows, COLUMNS)))


def test_nothing_comes(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/in")
    detection.run(spark.readStream.schema(spark.createDataFrame([], COLUMNS).schema).parquet(f"{tmp_path}/in"), str(tmp_path))
    assert told(detection.flags(spark, str(tmp_path))) == []
