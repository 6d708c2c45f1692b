import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.llm.test_odd_rows import _prose, brute_groups, words
from tests.parity import SF, same
from tidemark.llm import mixing, queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, name):
    got, wanted = same(spark, queries.QUERIES[name], queries.ORACLE[name])
    assert got == wanted


def test_pipeline_stages(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = [docs.count()]
    now = docs
    for name, stage in pipeline.STAGES[:-1]:
        now = pipeline.C.settle(stage(spark, now, SF), f"test-{name}")
        assert now.columns == docs.columns
        sizes.append(now.count())
    assert sizes == sorted(sizes, reverse=True) and 0 < sizes[-1] < sizes[0]
    mixed = pipeline.STAGES[-1][1](spark, now, SF).collect()
    assert Counter(r["doc_id"] for r in mixed) == Counter(r["doc_id"] for r in now.collect())


def test_pipeline_repeated_and_unnamed_rows(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    item = next(r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").collect() if len((r["text"] or "").split()) > 20)
    words = lambda k: " ".join(f"{k}w{i}" for i in range(60))
    near = words("a") + " more"
    rows = [(1, words("a"), "x"), (1, words("a"), "x"), (1, words("a"), "x"), (None, words("a"), "x"), (None, near, "x"), (7, near, "x")]
    rows += [(2, words("b"), "x"), (2, words("c"), "x"), (None, words("d"), "x"), (None, words("d"), "x"), (None, words("d") + " more", "x"), (None, words("e"), "y"), (None, None, "y"), (None, None, "y"), (3, "", "x"), (4, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    left = [tuple(r) for r in pipeline.drop_near_copies(spark, docs, SF).collect()]
    ids, texts = Counter(r[0] for r in left), [r[1] for r in left]
    # Different texts of doc_id 2 both stay; equal rows are one.
    assert ids == {1: 1, 2: 2, 3: 1, 4: 1, None: 3} and texts.count(words("a")) == 1 and near not in texts
    assert texts.count(words("d")) + texts.count(words("d") + " more") == 1 and texts.count(words("e")) == 1 and texts.count(None) == 1

    leaky = spark.createDataFrame([(None, f"{words('f')} {item} {words('g')}", "x"), (None, words("h"), "x"), (None, None, "x"), (9, item, "x"), (10, words("i"), "x")], docs.schema)
    assert Counter((r["doc_id"], r["text"]) for r in pipeline.drop_leaks(spark, leaky, SF).collect()) == {(None, words("h")): 1, (None, None): 1, (10, words("i")): 1}


def test_pipeline_with_clashing_columns(spark):
    """Columns of docs named like what the stages make come through untouched."""
    pipeline = pytest.importorskip("corpus_pipeline")
    clash = ["first", "n_removed", "kept_text", "_key", "_id", "kept", "row_id", "place", "content", "in0", "in1", "component_id", "hashes", "later", "k0", "quality"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*[F.col("doc_id").cast("string").alias(c) for c in clash], "doc_id", "text", "source")
    now = docs
    for name, stage in pipeline.STAGES[:-1]:
        now = pipeline.C.settle(stage(spark, now, SF), f"clash-{name}")
        assert now.columns == docs.columns
    for r in now.collect():
        assert {r[c] for c in clash} == {str(r["doc_id"])}
    assert pipeline.STAGES[-1][1](spark, now, SF).count() == now.count() > 0
    none = docs.limit(0)
    for name, stage in pipeline.STAGES[:-1]:
        none = pipeline.C.settle(stage(spark, none, SF), f"none-{name}")
    assert pipeline.STAGES[-1][1](spark, none, SF).count() == 0


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def brute_pipeline(rows, items, labels):
    """doc_id, size, source_size, target, taken of rows (doc_id, text, source), stage by stage in plain Python."""
    kept = []
    for d, t, s in rows:
        ws, ln = words(t), [x for x in (t or "").split("\n") if words(x)]
        tri = Counter(zip(ws, ws[1:], ws[2:]))
        hit = {i + j for i in range(len(ws) - 2) if tri[tuple(ws[i : i + 3])] > 1 for j in range(3)}
        chars, marks = sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t or "")
        bad = len(ws) < 50 or 100 * len(hit) > 50 * len(ws) or 10 * marks > 3 * len(ws) or 10 * (t or "").count("!") > 3 * len(ws)
        if not (bad or chars < 2 * len(ws) or chars > 20 * len(ws) or 2 * (len(ln) - len(set(ln))) > len(ln)):
            kept.append((d, t, s))
    kept = [r for r, (d, _, least) in zip(kept, brute_order(kept)) if d == least]
    split = [words(t) for _, t, _ in kept]
    first = {}
    for (d, _, _), ws in zip(kept, split):
        for i in range(len(ws) - 12):
            first[tuple(ws[i : i + 13])] = min(d, first.get(tuple(ws[i : i + 13]), d))
    shown = []
    for (d, t, s), ws in zip(kept, split):
        gone = {i + j for i in range(len(ws) - 12) if first[tuple(ws[i : i + 13])] < d for j in range(13)}
        shown.append((d, " ".join(w for i, w in enumerate(ws) if i not in gone) if gone else t, s))
    trim = lambda t: [x for x in (w.strip(".,;:!?\"'()[]{}<>*$%&#|-_/") for w in words(t, True)) if x]
    seqs = [trim(t) for t in items]
    clean = [r for r in shown if not any(q and brute_lcs(q, trim(r[1])) >= 0.7 * len(q) for q in seqs)]
    return clean


def brute_order(rows):
    groups = {}
    for d, n, least in brute_groups([(d, t) for d, t, _ in rows]):
        groups[d] = (d, n, least)
    return [groups[d] for d, _, _ in rows]


def test_pipeline_equals_brute_force(spark, tmp_path):
    """The rows that reach the mix, and the mix of them, against plain Python over a small corpus with planted cases."""
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(12)
    items = [_prose(rng, 30) for _ in range(6)]
    common = _prose(rng, 40)
    rows = [(i, _prose(rng, rng.randint(45, 160)), rng.choice(["a", "b", None])) for i in range(50)]
    near = rows[1][1].split()
    near[5] = "changed"
    rows += [(100, " ".join(near), "a"), (101, rows[2][1], "b"), (102, None, "a"), (103, "", "b"), (104, "no no no " * 40, "a"), (105, "! # " * 60 + rows[3][1], "b")]
    rows += [(110 + i, f"{_prose(rng, 50)} {common} {_prose(rng, 20)}", "a") for i in range(4)]
    rows += [(120 + i, f"{_prose(rng, 60)} {items[i]} {_prose(rng, 30)}", "b") for i in range(3)]
    docs = spark.createDataFrame([(d, t, s, "en", len(t or "")) for d, t, s in rows], "doc_id long, text string, source string, lang string, n_chars long")
    docs.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(d, d % 2, 0) for d, _, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    clean = brute_pipeline(rows, items, None)
    assert {120, 121, 122, 104, 105, 103, 102, 100, 101}.isdisjoint(d for d, _, _ in clean) and {111, 112, 113} <= {d for d, _, _ in clean}
    now = docs
    for name, stage in pipeline.STAGES[:-1]:
        now = pipeline.C.settle(stage(spark, now, str(tmp_path)), f"brute-{name}")
    assert Counter((r["doc_id"], r["text"], r["source"]) for r in now.collect()) == Counter(clean)
    # The mix has its own brute-force form, in DuckDB.
    got = sorted(tuple(r) for r in pipeline.run(spark, str(tmp_path)).select("doc_id", "size", "source_size", "target", "taken").collect())
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?)", clean)
    con.execute(f"create view labels as select * from read_parquet('{tmp_path}/labels.parquet/*.parquet')")
    want = sorted(con.execute(f"select doc_id, size, source_size, target, taken from ({mixing.OP4_SQL})").fetchall())
    assert [(*g[:3], round(g[3], 6), g[4]) for g in got] == [(*w[:3], round(w[3], 6), w[4]) for w in want]
