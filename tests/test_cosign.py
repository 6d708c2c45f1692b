from pyspark.sql import functions as F

from tidemark.functions import secrets as S
from tidemark.operators import cosign

SEED = {n: n.encode() * 32 for n in "abcdo"}
KEY = {n: S.ed25519_public(s).hex() for n, s in SEED.items()}


def sign(name, digest):
    return S.ed25519_sign(SEED[name], (cosign.STATEMENT + digest).encode()).hex()


def test_verdicts_in_order_and_quorum(spark):
    registry = [("a", KEY["a"], "One"), ("b", KEY["b"].upper(), "two"), ("c", KEY["c"], " ONE "), ("own", KEY["o"], "own"), ("blank", KEY["d"], " "), ("twice", KEY["d"], "x"), ("twice", KEY["c"], "y"), ("short", "00", "short")]
    cases = {
        1: ([("a", sign("a", "L1")), ("b", sign("b", "L1"))], ["verified", "verified"], "pass"),
        2: ([("a", sign("a", "L1")), ("b", sign("b", "L2"))], ["invalid", "verified"], "fail"),
        3: ([("a", sign("a", "L3")), ("a", sign("a", "L3"))], ["verified", "malformed"], "fail"),
        4: ([("a", sign("a", "L4")), ("c", sign("c", "L4"))], ["verified", "counted"], "fail"),
        5: ([("a", sign("b", "L5")), ("c", sign("c", "L5"))], ["invalid", "verified"], "fail"),  # a bad signature uses up nothing
        6: ([("own", sign("o", "L6")), ("", "00"), (None, "00"), ("b", None)], ["counted", "malformed", "malformed", "malformed"], "fail"),
        7: ([("a", sign("a", "L7")), ("blank", sign("d", "L7")), ("twice", sign("d", "L7")), ("new", "zz")], ["verified", "untrusted", "untrusted", "untrusted"], "unknown"),
        8: ([("a", sign("a", "L8"))], ["verified"], "unknown"),
        9: ([("short", "zz"), ("b", sign("b", "L9"))], ["invalid", "verified"], "fail"),
        10: ([(f"w{i}", "00") for i in range(21)], ["too_many"] * 21, "fail"),
        11: ([], [], "unknown"),
        None: ([("a", sign("a", "none")), ("b", sign("b", "none"))], ["verified", "verified"], "pass"),
    }
    heads = spark.createDataFrame([(k, f"L{k}" if k else "none") for k in cases], "list int, prefix_digest string")
    said = [(k, i, w, s) for k, (rows, _, _) in cases.items() for i, (w, s) in enumerate(rows)] + [(99, 0, "a", sign("a", "L99"))]
    said = spark.createDataFrame(said, "list int, place int, witness string, signature_hex string").repartition(3)
    registry = spark.createDataFrame(registry, "witness string, public_key string, domain string")
    told = {}
    for r in cosign.verdicts(heads, said, registry, KEY["o"], ["list"]).orderBy("list", "place").collect():
        told.setdefault(r["list"], []).append(r["verdict"])
    assert told == {k: v for k, (_, v, _) in cases.items() if v} | {99: ["invalid"]}
    found = {r["list"]: (r["status"], r["total"], r["valid"]) for r in cosign.quorum(heads, said, registry, 2, KEY["o"], ["list"]).collect()}
    assert found == {k: (s, len(v), v.count("verified")) for k, (_, v, s) in cases.items()}
    assert cosign.verdicts(heads.limit(0), said.limit(0), registry.limit(0), KEY["o"], ["list"]).count() == 0
