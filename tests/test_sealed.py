import hashlib

import pytest
from pyspark.sql import functions as F

from tests.parity import SF
from tidemark.functions import text as X
from tidemark.operators import chain as CH
from tidemark.operators import checkpoints as K
from tidemark.operators import sealed as SE
from tidemark.sources import derived as D


def parent(a, b):
    return hashlib.sha256(b"\x01" + bytes.fromhex(a) + bytes.fromhex(b)).hexdigest()


def brute(leaves):
    """Levels of the tree, and each leaf's path."""
    levels = [list(leaves)]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([parent(*now[i : i + 2]) if i + 1 < len(now) else now[i] for i in range(0, len(now), 2)])
    paths = []
    for i in range(len(leaves)):
        path = []
        for level in levels[:-1]:
            if i % 2:
                path.append("left:" + level[i - 1])
            elif i + 1 < len(level):
                path.append("right:" + level[i + 1])
            i //= 2
        paths.append(path)
    return levels, paths


@pytest.mark.parametrize("step", [2, 3])
def test_stored_trees_of_any_size(spark, step):
    sizes = {None: 1, "b": 2, "c": 3, "d": 8, "e": 9, "f": 65, "g": 64}
    leaf = lambda k, i: hashlib.sha256(f"{k}{i}".encode()).hexdigest()
    rows = [(k, 1, i, leaf(k, i), n) for k, n in sizes.items() for i in range(n)]
    tree = SE.Tree(spark.createDataFrame(rows, "k string, sealed_at long, place long, hash string, n long").repartition(5), ["k"], step)
    roots, nodes, paths = ({} for _ in range(3))
    for r in tree.roots().collect():
        roots[r["k"]] = r["merkle_root"]
    for r in tree.nodes().collect():
        assert nodes.setdefault((r["k"], r["level"], r["place"]), r["hash"]) == r["hash"]
    checked = tree.paths().withColumn("n", F.lit(0)).collect()
    for r in checked:
        paths[r["k"], r["place"]] = r["path"]
    assert len(tree.nodes().collect()) == len(nodes)
    for k, n in sizes.items():
        levels, wanted = brute([leaf(k, i) for i in range(n)])
        assert roots[k] == levels[-1][0]
        assert {(l, i): h for (q, l, i), h in nodes.items() if q == k} == {(l, i): h for l, level in enumerate(levels) for i, h in enumerate(level)}
        assert [paths[k, i] for i in range(n)] == wanted
        fit = spark.createDataFrame([(i, p) for i, p in enumerate(wanted)], "i int, p array<string>")
        assert fit.where(~SE.placed(F.col("p"), F.col("i"), F.lit(n))).count() == 0
    asked = spark.createDataFrame([("f", 1, 64), ("f", 1, 3), (None, 1, 0), ("f", 1, 99)], "k string, sealed_at long, place long")
    assert {(r["k"], r["place"]): r["path"] for r in tree.paths(asked).collect()} == {x: paths[x] for x in (("f", 64), ("f", 3), (None, 0))}
    wrong = spark.createDataFrame([(3, brute([leaf("f", i) for i in range(65)])[1][4])], "i int, p array<string>")
    assert wrong.where(SE.placed(F.col("p"), F.col("i"), F.lit(65))).count() == 0


def test_checkpoint_sealed_before_the_chain_grew(spark):
    """An honest checkpoint of five rows passes whatever follows; the next one covers what comes after it."""
    grown = CH.build(D.ledger(spark, SF)).where("employee_id IN (3, 4)").cache()
    early = SE.made(grown.where("chain_seq <= 5"), spark.createDataFrame([(3, 5), (4, 5)], "employee_id int, last_seq long"))
    late = SE.made(grown, spark.createDataFrame([(3, 5), (3, 18), (4, 5)], "employee_id int, last_seq long")).where("sealed_after = 5")
    sealed = early.unionByName(late).cache()
    assert {(r["employee_id"], r["last_seq"], r["n_rows"]) for r in sealed.collect()} == {(3, 5, 5), (3, 18, 13), (4, 5, 5)}
    assert {r["binding"] for r in SE.binding(grown, sealed).collect()} == {"pass"}
    assert {r["status"] for r in SE.bound(grown, sealed).collect()} == {"pass"}
    for forged, at in ((grown.where("NOT (employee_id = 3 AND chain_seq = 18)"), 18), (grown.where("NOT (employee_id = 3 AND chain_seq = 2)"), 5)):
        assert {r["employee_id"]: (r["status"], r["first_fail"]) for r in SE.bound(forged, sealed).collect()} == {3: ("fail", at), 4: ("pass", None)}
    assert {r["status"] for r in SE.bound(grown, sealed.limit(0)).collect()} == {"unknown"}
    assert {r["employee_id"]: r["status"] for r in SE.bound(grown, sealed.unionByName(sealed.where("employee_id = 4"))).collect()} == {3: "pass", 4: "fail"}


def test_one_segment_over_a_whole_ledger(spark):
    """All rows in one segment: root and digest are those of all leaves and hashes."""
    chain = CH.build(D.ledger(spark, SF), ()).cache()
    rows = chain.select("entry_hash", K.leaf(X.serialised()).alias("leaf")).orderBy("chain_seq").collect()
    one = SE.made(chain, spark.createDataFrame([(len(rows),)], "last_seq long"), ()).first()
    assert (one["n_rows"], one["merkle_root"]) == (len(rows), brute([r["leaf"] for r in rows])[0][-1][0])
    assert one["digest"] == hashlib.sha256("".join(r["entry_hash"] for r in rows).encode()).hexdigest()
