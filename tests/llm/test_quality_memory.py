"""What the quality rules hold in a task: a kept text travels once, and features take few bytes a byte of text."""

import tracemalloc

import pyarrow as pa

from tidemark.llm import common as C
from tidemark.llm import quality


def test_a_kept_text_is_sent_to_the_tasks_once(spark):
    docs = spark.createDataFrame([(1, "a b " * 60, "x"), (2, None, None)], "doc_id long, text string, source string")
    found = quality.cascade(docs, keep=("doc_id", "text", "source"))
    plan = found._jdf.queryExecution().optimizedPlan()
    while not plan.nodeName().startswith("MapInArrow"):
        plan = plan.children().head()
    assert plan.children().head().output().size() == 3
    rows = {r["doc_id"]: r for r in found.collect()}
    plain = {r["doc_id"]: r for r in quality.cascade(docs).collect()}
    assert rows[1]["text"] == "a b " * 60 and rows[2]["text"] is None
    assert {k: (r["kept"], r["rejected_by"]) for k, r in rows.items()} == {k: (r["kept"], r["rejected_by"]) for k, r in plain.items()}


def test_features_of_characters_take_few_bytes_a_byte_of_text():
    texts = C.plain(pa.array(["Wörter & Zeichen! # " * 50_000, "", "!!" * 10_000]))
    n_bytes = len(C.buffers(texts)[0])
    tracemalloc.start()
    found = quality._chars(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [found[k].tolist() for k in ("word_chars", "n_symbols", "n_shouts")] == [[16 * 50_000, 0, 20_000], [2 * 50_000, 0, 0], [50_000, 0, 20_000]]
    # 8 of them are the index that numpy makes of the bytes.
    assert peak < 16 * n_bytes
