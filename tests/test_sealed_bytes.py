import json

from pyspark.sql import functions as F

from tidemark.operators import sealed as SE


def test_any_entry_hash_comes_back_as_it_was(spark):
    said = ["0" * 64, "ab" * 32, "AB" * 32, "ab" * 32 + "\n", "", "x", None, "é" * 16, "\x00" * 33]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(said)], "i int, x string")
    data = rows.select("i", SE._short(F.col("x")).alias("d"))
    found = data.select("i", SE._long(F.col("d")).alias("x"), F.octet_length("d").alias("n")).orderBy("i").collect()
    assert [r["x"] for r in found] == said and [r["n"] for r in found[:2]] == [32, 32]


def test_leaves_exchange_no_payload(spark):
    """A row with a long payload costs its leaf's exchanges no more than one without."""
    one = lambda size: spark.range(400).selectExpr("cast(1 as int) as employee_id", "id + 1 as chain_seq", "id as sequence_id", "1 as actor_user_id", "'a' as action", "'t' as table_name", "1 as row_id", f"repeat(sha2(cast(id as string), 256), {size}) as old_value_text", "'n' as new_value_text", "'2024' as created_at_text", "sha2(cast(id as string), 256) as entry_hash")
    marks = spark.createDataFrame([(1, 100), (1, 400)], "employee_id int, last_seq long")

    def written() -> int:
        store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
        stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    sizes = []
    for size in (0, 100):
        start = written()
        assert SE.proofs(one(size), marks).count() == 400
        sizes.append(written() - start)
    assert sizes[1] < 1.5 * sizes[0], json.dumps(sizes)
