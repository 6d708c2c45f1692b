import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.parity import SF
from tidemark.llm import common as C
from tidemark.llm import merkle, negatives, packing, ranks

# Manifest.


def h(x):
    return hashlib.sha256(x.encode()).hexdigest()


def brute_paths(leaves, fan=16):
    """The root, and each leaf's siblings by level, by making the whole tree."""
    paths, level, span = [[] for _ in leaves], list(leaves), 1
    while len(level) > 1:
        for i in range(len(leaves)):
            at = i // span
            run = level[at // fan * fan : at // fan * fan + fan]
            k = at % fan
            paths[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
        level = [h("".join(level[i : i + fan])) for i in range(0, len(level), fan)]
        span *= fan
    return level[0], paths


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 26, 27, 28, 63, 64, 65, 80, 81, 82])
def test_fractal_traversal_is_the_whole_tree(n):
    leaves = [h(str(i)) for i in range(n)]
    for fan in (3, 4, 16):
        root, paths = brute_paths(leaves, fan)
        up = merkle.height(n, fan)
        assert merkle.root(leaves, up, fan) == root
        assert [list(zip(*[list(x) for x in p])) for p in merkle.traversed(leaves, up, fan)] == paths


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


@pytest.mark.parametrize("fan,levels", [(16, 3), (2, 2), (3, 1)])
def test_manifest_of_odd_rows(spark, fan, levels):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "b", "é", None, "a" * 40]), rng.choice(["en", None]), rng.choice([None, 5]), rng.choice(["Text", "", None, "ß" * 999])) for i in range(150)]
    rows += [(7, "a", "en", 1, "x")] * 3 + [(None, "a", None, None, None), (None, None, None, None, None), (9, "alone", None, 1, "one")]
    clash = ["path", "place", "n", "g", "block", "node", "top", "_at", "leaf"]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(7)
    df = df.select("*", *[F.lit("clash").alias(c) for c in clash])
    found = merkle.manifest(df, fan=fan, levels=levels).withColumn("again", merkle.folded(F.col("leaf"), F.col("path"))).collect()
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append((r[0] is not None, r[0] or 0, h("".join(map(field, r)))))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: brute_paths([x[2] for x in sorted(groups[s])], fan) for s in order}
    root, tops = brute_paths([trees[s][0] for s in order], fan)
    wanted = sorted((x[1] if x[0] else -1, i, x[2], trees[s][0], root, str(trees[s][1][i] + tops[order.index(s)])) for s in order for i, x in enumerate(sorted(groups[s])))
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["place"], r["leaf"], r["subroot"], r["root"], str([tuple(x) for x in r["path"]])) for r in found) == wanted
    assert all(r["again"] == root for r in found)
    assert merkle.manifest(df.limit(0)).count() == 0


def test_ranks_of_hot_and_null_keys(spark):
    rows = [(k, v) for k, n in ((None, 5), ("a", 400), ("b", 1)) for v in range(n)] + [("a", 7)] * 20
    found = ranks.ranked(spark.createDataFrame(rows, "k string, v long").repartition(9), ["k"], ["v"]).collect()
    for k in (None, "a", "b"):
        own = sorted((r for r in found if r["k"] == k), key=lambda r: r["place"])
        assert [r["place"] for r in own] == list(range(len(own))) and {r["n"] for r in own} == {len(own)}
        assert [r["v"] for r in own] == sorted(r["v"] for r in own)


# Hard negatives.


def brute_mined(rows, every=100, positives=5, negatives_=10):
    held = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i is not None and i % 7 == 0 else label
        held.append((i, [math.floor(256 * x) for x in v], label))
    out = []
    key = lambda s, i: (-s, i is None, i or 0)
    for at, (i, v, label) in enumerate(held):
        if i is None or i % every:
            continue
        scored = [(max(-negatives.LONG, min(negatives.LONG, sum(x * y for x, y in zip(v, w)))), j, m) for k, (j, w, m) in enumerate(held) if k != at]
        near = sorted((x for x in scored if x[2] == label), key=lambda x: key(x[0], x[1]))[:positives]
        for p, pid, _ in near:
            fit = sorted((x for x in scored if x[2] != label and 30 * p <= 100 * x[0] <= 90 * p), key=lambda x: key(x[0], x[1]))[:negatives_]
            out += [(i, pid, r, n[1], p, n[0]) for r, n in enumerate(fit, 1)]
    return out


def mined(spark, rows, **kw):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5)
    df = df.select("*", *[F.lit(1).alias(c) for c in ("uid", "id", "v", "norm", "down", "block", "place")])
    return [tuple(r) for r in negatives.mined(negatives.prepared(df), **kw).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()]


def test_negatives_of_odd_rows(spark):
    rng = random.Random(2)
    v = lambda s=1.0: [float(np.float32(rng.gauss(0, 1) * s)) for _ in range(6)]
    rows = [(i, v(rng.choice([0.01, 1, 30])), rng.randrange(3)) for i in range(300)]
    # Ties, zero vectors, short and long ones, rows that take no part.
    rows += [(300 + i, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0], i % 3) for i in range(40)] + [(400, [0.0] * 6, 1), (500, [], 2), (600, [1.0], 1), (700, [0.5] * 9, 0)]
    rows += [(801, None, 1), (802, [1.0, None], 1), (803, [math.nan] * 6, 1), (804, [math.inf] * 6, 2), (805, v(), None), (None, v(), 1), (None, [0.3] * 6, 2), (900, None, 2)]
    assert sorted(mined(spark, rows), key=str) == sorted(brute_mined(rows), key=str)


def test_negatives_in_several_blocks_and_of_large_components(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, [float(np.float32(rng.gauss(0.5, 1) * rng.choice([1, 3e6, 1e7]))) for _ in range(3)], rng.randrange(4)) for i in range(200)]
    monkeypatch.setattr(negatives, "BLOCK", 9)
    monkeypatch.setattr(negatives, "BUCKET", 16)
    monkeypatch.setattr(negatives, "PART", 2)
    brute = brute_mined(rows, every=10)
    assert max(r[4] for r in brute) == negatives.LONG and max(r[5] for r in brute) > 1 << 60
    assert sorted(mined(spark, rows, every=10)) == sorted(brute)


def test_negatives_of_nothing(spark):
    assert mined(spark, []) == [] and mined(spark, [(1, [1.0], 1)]) == [] and mined(spark, [(100, [1.0], 1)]) == []


# Packing.


@pytest.fixture(scope="module")
def path():
    tokenizers = pytest.importorskip("public_tokenizers")
    return tokenizers.path("byte_bpe_50k.json")


def tokenizer(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


ODD = ["", None, " ", "a", " a", "a b  c", "x\ny z", "x\n y", "tab\tand nbsp", "<|endoftext|>", "a <|endoftext|> b", "it's he'll 'tis", "naïve ß 中文 日本 ゎ한글", "𝔘𝔫𝔦 𐓷𐓘 ꮳꮃꭹ", "\x00\x01 \x7f", "é cö", "a\r\nb", "12345 678", "end ", "\n", "🙂🙂 ok", "a" * 5000, "word " * 3000]


def test_ids_are_the_tokenizers(path):
    encode, plain = packing.Encoder(path), tokenizer(path)
    assert encode.fast is not None
    docs = [x or "" for x in ODD] + [r for r in random.Random(4).sample([a + b for a in ODD if a and len(a) < 99 for b in ODD if b and len(b) < 99], 200)]
    ids, off = encode(pa.array(docs, pa.large_string()))
    for i, text in enumerate(docs):
        assert ids[off[i] : off[i + 1]].tolist() == plain.encode(text, add_special_tokens=False).ids, text


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=1, max_size=8))
def test_ids_of_any_text(texts):
    tokenizers = pytest.importorskip("public_tokenizers")
    path = tokenizers.path("byte_bpe_50k.json")
    ids, off = packing.encoder(path)(pa.array(texts, pa.large_string()))
    assert ids.tolist() == [x for t in texts for x in _plain(path).encode(t, add_special_tokens=False).ids] and len(off) == len(texts) + 1


def _plain(path, held={}):
    return held.setdefault(path, tokenizer(path))


def check_packing(rows, docs, encode, capacity):
    """rows of one document each; docs: (doc_id, text)."""
    by, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append(r)
    assert by.keys() == {d for d, _ in docs}
    for d, text in docs:
        ids, at = [*encode(text or ""), 0], 0
        for k, p in enumerate(sorted(by[d], key=lambda r: r["piece"])):
            assert (p["piece"], p["start"]) == (k, at) and (k == 0 or p["length"] == capacity)
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[at : at + p["length"]], "<u4").tobytes())
            at += p["length"]
        assert at == len(ids) and len(by[d]) == -(-len(ids) // capacity)
    for own in bins.values():
        at = 0
        for p in sorted(own, key=lambda r: r["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= capacity
    return len(bins), -(-sum(r["length"] for r in rows) // capacity)


def test_packing_of_all_documents(spark, path):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    encode = lambda t: tokenizer_ids(path, t)
    bins, least = check_packing(packing.op13_best_fit_packing(spark, SF).collect(), docs, encode, 2048)
    assert bins <= least + 1


def tokenizer_ids(path, text):
    return _plain(path).encode(text, add_special_tokens=False).ids


def test_packing_of_odd_rows(spark, path):
    rows = list(enumerate(ODD)) + [(100 + i, "same words again") for i in range(60)] + [(None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    df = df.select("*", *[F.lit(1).alias(c) for c in ("piece", "length", "place", "n", "ids", "offset")])
    out = packing.pack(df, path, capacity=64, ids=True)
    found = out.collect()
    bins, least = check_packing(found, rows, lambda t: tokenizer_ids(path, t), 64)
    assert bins <= least + 1
    whole = packing.sequences(C.settle(out, "packed")).collect()
    assert len(whole) == bins and all(len(r["ids"]) <= 64 for r in whole)
    assert sum(len(r["ids"]) for r in whole) == sum(r["length"] for r in found)
    assert packing.pack(df.limit(0), path).count() == 0
    again = packing.pack(spark.createDataFrame([(1, "twice")] * 3, "doc_id long, text string"), path).collect()
    assert [r["length"] for r in again] == [again[0]["length"]] * 3 and len({r["offset"] for r in again}) == 3


def brute_fullest(counts, room):
    sums = {0}
    for k, n in counts.items():
        sums = {s + k * j for s in sums for j in range(n + 1) if s + k * j <= room}
    return max(sums)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 4), max_size=8), st.integers(0, 60))
def test_fullest_is_the_largest_sum(counts, room):
    got = packing.fullest(counts, room)
    assert all(n <= counts[k] for k, n in got.items()) and sum(k * n for k, n in got.items()) == brute_fullest(counts, room)


def test_plan_uses_each_piece_once_and_few_bins():
    rng = random.Random(5)
    for capacity, most in ((100, 5), (64, 400), (2048, 30)):
        counts = {k: rng.randrange(1, most + 1) for k in rng.sample(range(1, capacity + 1), min(capacity, 400))}
        rows = packing.plan(counts, capacity)
        used, bins = defaultdict(int), defaultdict(int)
        for k in counts:
            own = [r for r in rows if r[0] == k]
            assert own[0][1] == 0 and [r[1] for r in own] == sorted(r[1] for r in own)
            for r, upto in zip(own, [*(r[1] for r in own[1:]), counts[k]]):
                assert (upto - r[1]) % r[3] == 0
                for b in range(r[2], r[2] + (upto - r[1]) // r[3]):
                    bins[b] += k * r[3]
                used[k] += upto - r[1]
        assert used == counts and max(bins.values()) <= capacity and len(bins) == max(bins) + 1
        # Best fit decreasing, for comparison.
        open_, n = defaultdict(int), 0
        for k in sorted(counts, reverse=True):
            for _ in range(counts[k]):
                room = next((x for x in range(k, capacity) if open_[x]), None)
                if room is None:
                    n, room = n + 1, capacity
                else:
                    open_[room] -= 1
                open_[room - k] += 1
        assert len(bins) <= 1.01 * n and len(rows) <= 40 * len(counts)
