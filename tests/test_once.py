"""Dear steps are done once, and by many tasks."""

import os
import uuid

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import functions as F

from tests.parity import SF
from tidemark.operators import chain as CH
from tidemark.operators import checkpoints as K
from tidemark.operators import cosign
from tidemark.operators import sealed as SE
from tidemark.plans import witnesses
from tidemark.sources import derived as D


def counted(df, path):
    """df, and how many of its rows have been made so far, by a file for each batch."""
    os.makedirs(path)

    def run(batches):
        for b in batches:
            open(f"{path}/{b.num_rows}-{uuid.uuid4().hex}", "w").close()
            yield b

    return df.mapInArrow(run, df.schema), lambda: sum(int(n.split("-")[0]) for n in os.listdir(path))


def test_signatures_over_few_bytes_are_many_tasks_work(spark, tmp_path, monkeypatch):
    """By bytes Spark puts these 2000 short rows into one task, whatever a row costs."""

    def watched(*columns):
        @F.pandas_udf("boolean")
        def check(a: pd.Series) -> pd.Series:
            if len(a):
                open(f"{tmp_path}/{TaskContext.get().partitionId()}", "w").close()
            return pd.Series([True] * len(a))

        return check(columns[2])

    monkeypatch.setattr(cosign.S, "signature_valid", watched)
    heads = spark.range(2000).selectExpr("cast(id as int) as list", "'x' as prefix_digest")
    said = heads.selectExpr("list", "0 as place", "'a' as witness", "'00' as signature_hex")
    registry = spark.createDataFrame([("a", "00", "one")], "witness string, public_key string, domain string")
    told = cosign.verdicts(heads, said, registry, "ff", ["list"])
    assert told.where("verdict = 'verified'").count() == 2000
    assert len(os.listdir(tmp_path)) >= 8


def test_binding_makes_the_chain_and_the_list_once(spark, tmp_path):
    plain = CH.build(D.ledger(spark, SF)).localCheckpoint()
    sealed = K.fixed(plain, 8).localCheckpoint()
    chain, rows = counted(plain, f"{tmp_path}/chain")
    listed, said = counted(sealed, f"{tmp_path}/list")
    assert SE.binding(chain, listed).where("binding = 'pass'").count() == sealed.count()
    assert rows() == plain.count() and said() == sealed.count()


def test_heads_make_the_list_once(spark, tmp_path, monkeypatch):
    plain = CH.build(D.ledger(spark, SF)).localCheckpoint()
    chain, rows = counted(plain, f"{tmp_path}/chain")
    monkeypatch.setattr(witnesses, "_chain", lambda *_: chain)
    assert witnesses.witness_heads(spark, SF).count() == plain.select("employee_id").distinct().count()
    assert rows() == plain.count()
