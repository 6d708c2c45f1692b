"""The context tree over all contexts, worked out by subtrees, against the tree that is built in one place."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import lmscore

TEXTS = [None, "", "a", "Abracadabra, abracadabra!", "zur Übung ünd zurück", "the cat sat on the mat; the cat sat", *[f"row {i} of {i * i % 97} rows, {chr(97 + i % 26) * (i % 9)}" for i in range(120)]]


@pytest.mark.parametrize("depth, frequent, block", [(4, 1.0, 50), (4, 1e-3, 200_000), (4, 0.0, 50), (3, 1e-3, 50), (1, 1e-2, 50), (0, 1e-2, 50)])
def test_scores_are_those_of_the_whole_tree(spark, monkeypatch, depth, frequent, block):
    monkeypatch.setattr(lmscore, "BLOCK_GRAMS", block)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3)
    held = F.col("doc_id") % 5 == 3
    whole = lmscore.train(docs.where(~held), depth, 0.0)
    want = whole.scores(pa.array([t or "" for t in TEXTS], pa.large_string()))
    rows = {r["doc_id"]: r["score"] for r in lmscore.score(docs, held, depth=depth, frequent=frequent).collect()}
    # The whole tree holds its numbers in 32 bits.
    np.testing.assert_allclose([rows[i] for i in range(len(TEXTS))], want, rtol=2e-5, atol=2e-5)


def test_a_rare_context_counts(spark):
    """One context in a large corpus, below the share that a split took: its next byte is foreseen."""
    docs = spark.createDataFrame([(0, "qxzj7 " * 12), *[(i, "plain words of no note " * 40) for i in range(1, 400)]], "doc_id long, text string")
    rows = {r["doc_id"]: r["score"] for r in lmscore.score(docs, F.lit(False)).where("doc_id = 0").collect()}
    capped = {r["doc_id"]: r["score"] for r in lmscore.score(docs, F.lit(False), split=lmscore.share(368_000)).where("doc_id = 0").collect()}
    assert rows[0] > capped[0] + 20


def test_reruns_agree(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    first, again = (sorted((r["doc_id"], r["score"]) for r in lmscore.score(docs.repartition(n), F.col("doc_id") % 5 == 3).collect()) for n in (2, 5))
    np.testing.assert_allclose([x for _, x in first], [x for _, x in again], rtol=1e-9)
