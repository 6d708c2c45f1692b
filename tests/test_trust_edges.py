import hashlib
import json

from pyspark.sql import functions as F

from tidemark.operators import contexts as A
from tidemark.operators import trust

NAMES = "checkpoint_id long, sequence_id long, checkpoint_hash string, merkle_root string, signature_hex string, key_id string"


def rows(*ids, root="a"):
    return [(i, 50 * i, f"{i:064x}", root * 64, "0" * 128, "k") for i in ids]


def test_prefix_digests_cover_all_fields_in_any_length(spark):
    made = rows(*range(1, 30))
    found = {r["checkpoint_id"]: r["prefix_digest"] for r in trust.prefix_digests(spark.createDataFrame(made, NAMES).repartition(3)).collect()}
    names = [x.split()[0] for x in NAMES.split(", ")]
    for n in (1, 2, 29):
        text = trust.PREFIX + json.dumps([dict(zip(names, r)) for r in made[:n]], sort_keys=True, separators=(",", ":"))
        assert found[n] == hashlib.sha256(text.encode()).hexdigest()
    for change in ((0, 0, "", "", "1" * 128, ""), (0, 0, "", "", "", "other")):
        other = [tuple(c or x for c, x in zip(change, r)) for r in made[:1]] + made[1:]
        assert trust.prefix_digests(spark.createDataFrame(other, NAMES)).where("checkpoint_id = 29").first()["prefix_digest"] != found[29]


def test_admission_place_by_place(spark):
    held = spark.createDataFrame(rows(1, 2), NAMES)
    cases = {"accepted": rows(1, 2, 5, 6), "shorter": rows(1), "changed": rows(1, 7, 8), "invalid": [*rows(1, 2), (3, 100, "x" * 64, "a" * 64, "0" * 128, "k")]}
    for verdict, offered in cases.items():
        df = spark.createDataFrame(offered, NAMES)
        got = trust.admission(held, df).first()
        assert got["verdict"] == verdict, offered
        assert [(r["checkpoint_id"], r["ordinal"]) for r in trust.admitted(held, df).orderBy("ordinal").collect()] == ([(5, 3), (6, 4)] if verdict == "accepted" else [])
    assert trust.admission(held, held.withColumn("signature_hex", F.lit("1" * 128))).first()["verdict"] == "changed"
    assert trust.admission(held, held.limit(0)).first()["verdict"] == "empty"
    # A store with nothing takes a valid list; offering it again adds nothing.
    assert trust.admission(held.limit(0), held).first()["added"] == 2 and trust.admission(held, held).first()["added"] == 0


def test_origin_does_not_witness_itself(spark):
    ours = spark.createDataFrame(rows(1, 2), NAMES)
    digest = trust.prefix_digests(ours).where("checkpoint_id = 2").first()["prefix_digest"]
    published = ours.withColumn("witness", F.explode(F.array(F.lit("a"), F.lit("b"))))
    said = spark.createDataFrame([("a", digest, "k1", "d1", True), ("b", digest, "k2", "d2", True)], "witness string, prefix_digest string, key_id string, domain string, valid boolean")
    assert trust.heads(ours, published, said, 2).first()["status"] == "pass"
    assert trust.heads(ours, published, said, 2, origin_key="k2").first()["status"] == "fail"


def test_context_windows_keys_and_nonces(spark):
    keys = spark.createDataFrame([("k", b"key", True), ("off", b"key", False), ("two", b"a", True), ("two", b"b", True)], "key_id string, material binary, enabled boolean")
    nonce = "0123456789ab-cdef-0123-4567-89abcdef".replace("-", "")
    nonce = f"{nonce[:8]}-{nonce[8:12]}-{nonce[12:16]}-{nonce[16:20]}-" + "0" * 12
    base = {"version": "1", "key_id": "k", "user_id": "7", "employee_id": "0", "role": "hr_admin", "session_role": "hr_admin", "issued_at": "100", "expires_at": "160", "now": 130, "transaction_id": 1}
    cases = [
        (None, {}), (None, {"now": 95}), ("outside_window", {"now": 94}), (None, {"now": 159}), ("outside_window", {"now": 160}), ("outside_window", {"expires_at": "161"}),
        ("outside_window", {"expires_at": "100", "now": 99}), ("malformed", {"role": "root"}), ("malformed", {"session_role": "compliance_auditor"}), ("malformed", {"user_id": "07"}),
        ("malformed", {"version": None}), ("no_key", {"key_id": "off"}), ("no_key", {"key_id": "two"}), ("no_key", {"key_id": "gone"}), ("bad_signature", {"signature": "0" * 64}), ("malformed", {"signature": "0"}),
    ]
    made = [base | {"n": i, "nonce": f"{i:08x}{nonce[8:]}"} | change for i, (_, change) in enumerate(cases)]
    # One nonce: its owner, the owner's transaction again, another transaction, and the owner before it by order.
    made += [base | {"n": n, "nonce": nonce, "transaction_id": t} for n, t in ((101, 5), (102, 5), (103, 6))]
    names = [*base, "n", "nonce"]
    df = spark.createDataFrame([[r[c] for c in names] + [r.get("signature")] for r in made], ", ".join(f"{c} {'long' if c in ('now', 'transaction_id', 'n') else 'string'}" for c in names) + ", signature string")
    df = df.withColumn("signature", F.coalesce("signature", A.keyed(F.lit(b"key"), A.payload())))
    found = {r["n"]: r["fault"] for r in A.admitted(df, keys, "n").collect()}
    assert found == {i: fault for i, (fault, _) in enumerate(cases)} | {101: None, 102: None, 103: "nonce_used"}
