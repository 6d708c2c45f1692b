import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from tests.parity import SF
from tidemark.functions import secrets as S
from tidemark.functions import text as X
from tidemark.operators import chain as CH
from tidemark.operators import checkpoints as K
from tidemark.operators import detect, limits, replay, rules, trust
from tidemark.operators import sealed as SE
from tidemark.sources import bundle, capsules, imports
from tidemark.sources import derived as D
from tidemark.streaming import detection, jobs

ANCHORS = "checkpoint_id long, sequence_id long, checkpoint_hash string, merkle_root string, signature_hex string, key_id string"
LEDGER = "sequence_id long, actor_user_id int, employee_id int, action string, table_name string, row_id int, old_value_text string, new_value_text string, severity string, created_at timestamp_ntz, created_at_text string"


def ledger(spark, rows):
    """rows: (seq, employee, action, table, old, new, minutes)."""
    made = [(s, 1, e, a, t, e, o, n, "INFO", f"2026-01-01 00:00:00", m) for s, e, a, t, o, n, m in rows]
    df = spark.createDataFrame(made, "sequence_id long, actor_user_id int, employee_id int, action string, table_name string, row_id int, old_value_text string, new_value_text string, severity string, created_at_text string, m double")
    return df.withColumn("created_at", F.expr("timestamp_ntz'2026-01-01 00:00:00' + make_dt_interval(0, 0, 0, m * 60)"))


def whole(spark):
    return CH.build(D.ledger(spark, SF), ()).cache()


def test_serialised_form(spark):
    row = spark.createDataFrame([(1, 42, None, "INSERT", "employees", 1001, None, '{"a": 1}', "INFO", None, "2026-09-12T10:00:00+00:00")], LEDGER)
    want = "1|42|INSERT|employees|1001|null|{\"a\": 1}|2026-09-12T10:00:00+00:00"
    assert row.select(X.serialised()).first()[0] == want
    assert row.select(X.entry_hash(F.lit(X.GENESIS))).first()[0] == hashlib.sha256((want + "0" * 64).encode()).hexdigest()


@pytest.mark.parametrize("bucket", [7, 100, 1 << 16])
def test_tampering_is_located_whatever_the_bucket(spark, bucket):
    chain = whole(spark)
    bad = CH.tampered(chain, F.col("chain_seq") == 500, F.col("chain_seq") == 700)
    found = CH.anomalies(bad, (), bucket=bucket).orderBy("chain_seq").collect()
    assert [tuple(r) for r in found] == [(500, True, False, False), (501, False, False, True), (701, False, True, True)]
    # A whole bucket gone, and the end cut off.
    hole = chain.where("chain_seq <= 100 OR chain_seq > 400")
    assert [r[0] for r in CH.anomalies(hole, (), bucket=bucket).collect()] == [401]
    cut = chain.where("chain_seq <= 900")
    assert CH.report(cut, ()).first()["valid"]
    assert CH.tail_status(cut.withColumn("one", F.lit(1)), CH.tails(chain.withColumn("one", F.lit(1)), ["one"]), ["one"]).first()["tail"] == "fail"


def test_recomputed_forward_is_caught_by_binding(spark):
    chain = CH.build(D.ledger(spark, SF))
    sealed = K.fixed(chain, 8)
    forged = CH.build(D.ledger(spark, SF).withColumn("new_value_text", F.when(F.col("sequence_id") == 300, "{}").otherwise(F.col("new_value_text"))))
    assert CH.anomalies(forged).count() == 0
    assert SE.binding(forged, sealed).where("binding = 'fail'").count() > 0
    assert SE.binding(chain, sealed).where("binding <> 'pass'").count() == 0


def test_rollup_never_passes_on_unknown(spark):
    cases = [(["pass", "pass"], "intact"), (["pass", "unknown"], "unknown"), (["unknown", "fail"], "tampered"), ([], "unknown")]
    df = spark.createDataFrame([(x,) for x, _ in cases], "x array<string>")
    assert [r[0] for r in df.select(CH.rolled_up(F.col("x"))).collect()] == [y for _, y in cases]


@pytest.mark.parametrize("interval", [1, 3, 8, 10])
def test_every_proof_leads_to_the_root(spark, interval):
    chain = CH.build(D.ledger(spark, SF).where("employee_id < 12"))
    rows = K.proofs(chain, interval).withColumn("ok", K.proved_root(F.col("leaf"), F.col("path")) == F.col("merkle_root"))
    assert rows.count() == chain.count() and rows.where("NOT ok OR ok IS NULL").count() == 0


def test_scheduler_boundaries(spark):
    cases = [(216, 217, None), (249, 250, 249), (200, 201, None), (216, 216, None), (None, 16, None), (None, 50, 0), (218, 249, None), (218, 250, 218)]
    df = spark.createDataFrame([(a, b) for a, b, _ in cases], "a long, b long")
    assert [r[0] for r in df.select(K.scheduled_after(F.col("a"), F.col("b"), 50)).collect()] == [c for _, _, c in cases]


def test_state_equals_a_fold(spark):
    rng = random.Random(5)
    rows, folded = [], {}
    for s in range(1, 400):
        e, a = rng.randrange(6), rng.choice(["INSERT", "UPDATE", "UPDATE", "UPDATE", "DELETE"])
        new = None if a == "DELETE" else {rng.choice("abc"): rng.choice(["1", "2", None]) for _ in range(2)}
        text = None if new is None else "{" + ", ".join(f'"{k}": ' + ("null" if v is None else f'"{v}"') for k, v in new.items()) + "}"
        rows.append((s, e, a, "employees", None, text, 0.0))
        folded[e] = None if a == "DELETE" else dict(new) if a == "INSERT" else {**(folded.get(e) or {}), **new}
    got: dict = {}
    for r in replay.state(ledger(spark, rows), F.lit(True)).collect():
        got.setdefault(r["employee_id"], {})[r["key"]] = r["value"]
    assert got == {e: s for e, s in folded.items() if s}


def test_counterfactual_goldens(spark):
    rows = spark.createDataFrame([(1, 1, "80000", "2024-01-01"), (1, 2, "250000", "2024-06-01"), (2, 3, "100000", "2024-01-01"), (2, 4, "200000", "2024-01-01")], "employee_id long, salary_id long, amount string, effective_date string")
    rows = rows.withColumns({"amount": F.col("amount").cast("decimal(12,2)"), "effective_date": F.col("effective_date").cast("date")})
    skip = spark.createDataFrame([(2,), (4,)], "salary_id long")
    got = {r["employee_id"]: r for r in replay.without(rows, skip, F.lit("2026-01-01").cast("date")).collect()}
    assert (got[1]["actual"], got[1]["counterfactual"], got[1]["annual"]) == (250000, 80000, 170000)
    assert got[2]["annual"] == 100000 and 23.5 <= got[2]["tenure_months"] <= 24.5 and 195_000 <= got[2]["cumulative"] <= 205_000
    assert replay.unknown_ids(rows, spark.createDataFrame([(9,)], "salary_id long")).count() == 1


def test_detection_boundaries(spark):
    pay = lambda s, x, m: (s, 1, "INSERT", "salary_history", None, f'{{"amount": "{x}"}}', m)
    rows = ledger(spark, [pay(1, 100, 0.0), pay(2, 130, 0.0), pay(3, 170, 0.0), pay(4, 0, 0.0), pay(5, 50, 0.0)])
    rows = rows.withColumn("amount", F.get_json_object("new_value_text", "$.amount").cast("decimal(12,2)"))
    assert sorted(r[0] for r in detect.salary_changes(rows).select("sequence_id").collect()) == [3, 4]
    off = lambda s, m: (s, s, "UPDATE", "employees", '{"is_active": "true"}', '{"is_active": "false"}', m)
    three = ledger(spark, [off(1, 0.0), off(2, 1.0), off(3, 60.0)])
    assert detect.burst_starts(three).count() == 0
    four = ledger(spark, [off(1, 0.0), off(2, 1.0), off(3, 2.0), off(4, 60.0)])
    assert [(r["sequence_id"], r["n_ahead"]) for r in detect.burst_starts(four).collect()] == [(1, 4)]
    def bursts(gap):
        return ledger(spark, [off(i, 0.0) for i in range(1, 5)] + [off(i, gap) for i in range(5, 9)])
    assert [r["sequence_id"] for r in detect.incidents(bursts(60.0)).collect()] == [1]
    assert sorted(r["sequence_id"] for r in detect.incidents(bursts(60.0 + 1e-5)).collect()) == [1, 5]


def test_signatures_and_digests(spark):
    # RFC 8032, tests 1 and 2; RFC 4231, test 2.
    cases = [("d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a", "", "e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e065224901555fb8821590a33bacc61e39701cf9b46bd25bf5f0595bbe24655141438e7a100b"), ("3d4017c3e843895a92b70aa74d1b7ebc9c982ccf2ec4968cc0cd55f12af4660c", "72", "92a009a9f0d4cab8720e820b5f642540a2b27b5416503f8fb3762223ebdb69da085ac1e43e15996e458f3613d0f11d8c387b2eaeb4302aeeb00d291612bb0c00")]
    for key, message, signature in cases:
        k, m, s = (bytes.fromhex(x) for x in (key, message, signature))
        assert S.ed25519_valid(k, m, s) and not S.ed25519_valid(k, m + b"x", s) and not S.ed25519_valid(k, m, s[:-1] + b"\x7f")
    df = spark.createDataFrame([("what do ya want for nothing?",), (None,)], "v string")
    assert [r[0] for r in df.select(S.blind_index(F.col("v"), b"Jefe")).collect()] == ["5bdcc146bf60754e6a042426089575c75a003f089d2739839dec58b964ec3843", None]


def test_anchor_lists(spark):
    def listed(n, root="a", key="k"):
        return spark.createDataFrame([(i, 50 * i, f"{i:064x}", root * 64, "0" * 128, key) for i in range(1, n + 1)], ANCHORS)
    status = lambda a, b, **k: trust.compare(a, b, **k).first()["status"]
    # The minimum holds for the published list, and a malformed or empty one is never more than unknown.
    assert status(listed(4), listed(2), minimum=150) == "fail" and status(listed(3), listed(0)) == "unknown"
    assert status(listed(3), listed(3, "x")) == "unknown" and status(listed(3), listed(3, "A")) == "unknown" and status(listed(3), listed(3, key=None)) == "unknown"
    falling = listed(2).withColumn("sequence_id", F.lit(50).cast("long"))
    assert status(listed(3), falling) == "unknown" and status(listed(3), listed(3).withColumn("signature_hex", F.lit("1" * 128))) == "fail"
    assert status(listed(3), listed(3, key="other")) == "fail" and status(listed(3), listed(1), interval=100) == "unknown"
    assert status(listed(3), listed(3)) == "pass" and status(listed(2), listed(3)) == "fail" and status(listed(3), listed(2)) == "unknown"
    assert status(listed(3), listed(3, "b")) == "fail" and status(listed(3), listed(3), minimum=200) == "fail"
    other = listed(3).unionByName(spark.createDataFrame([(4, 175, "0" * 64, "a" * 64, "0" * 128, "k")], ANCHORS))
    assert status(other, listed(3), interval=50) == "pass"
    assert trust.forks(listed(3).unionByName(listed(3, "b"))).count() == 3


def test_witness_statements(spark):
    def judged(rows, **options):
        df = spark.createDataFrame([(1, *r) for r in rows], "sequence_id long, witness string, key_id string, domain string, valid boolean")
        return tuple(trust.quorum(df, 2, **options).first())[1:]
    three = [("a", "k1", "d1", True), ("b", "k2", "d2", True), ("c", "k3", "d3", True)]
    assert judged(three) == ("pass", 3) and judged(three[:1]) == ("unknown", 1) and judged(three, origin_key="k2")[0] == "fail"
    # Of three witnesses two share a key, a domain (whatever its case), or a name.
    for again in (("c", "k2", "d3", True), ("c", "k3", " D2 ", True), ("b", "k3", "d3", True), (None, "k3", "d3", True), ("c", "k3", "d3", False)):
        assert judged([*three[:2], again])[0] == "fail"
    assert judged([*three[:2], ("c", None, "d3", True)]) == ("unknown", 2) and judged([*three[:2], ("c", "k3", " ", False)]) == ("unknown", 2)
    assert judged([(f"w{i}", f"k{i}", f"d{i}", True) for i in range(21)])[0] == "fail"


def test_witness_heads(spark):
    ours = spark.createDataFrame([(i, 50 * i, f"{i:064x}", "a" * 64, "0" * 128, "k") for i in range(1, 4)], ANCHORS)
    digest = trust.prefix_digests(ours).orderBy(F.col("checkpoint_id").desc()).first()["prefix_digest"]
    def judged(*witnesses, **options):
        published = ours.where("false").withColumn("witness", F.lit(""))
        for w, rows, _ in witnesses:
            published = published.unionByName(rows.withColumn("witness", F.lit(w)))
        said = spark.createDataFrame([(w, d, f"k{w}", f"d{w}", True) for w, _, d in witnesses], "witness string, prefix_digest string, key_id string, domain string, valid boolean")
        return trust.heads(ours, published, said, 2, **options).first()["status"]
    good = [("a", ours, digest), ("b", ours, digest)]
    late, other = ("c", ours.where("checkpoint_id < 3"), digest), ("c", ours.withColumn("merkle_root", F.lit("b" * 64)), digest)
    assert judged(*good) == "pass" and judged(*good, late) == "pass" and judged(good[0], late) == "unknown"
    assert judged(*good, other) == "fail" and judged(*good, minimum=200) == "unknown" and judged(good[0], ("b", ours, "x")) == "unknown"


def test_redaction_at_any_depth(spark):
    def hide(v):
        if isinstance(v, dict):
            return {k: X.REDACTED if k.lower() in X.SENSITIVE else hide(x) for k, x in v.items()}
        return [hide(x) for x in v] if isinstance(v, list) else v
    rng = random.Random(7)
    def value(depth):
        kind = rng.choice(["text", "number", "null", "list", "dict"]) if depth else "text"
        if kind == "dict":
            return {rng.choice([*X.SENSITIVE, "role", "Phone", "EMAIL", "amounts", "salary_id"]): value(depth - 1) for _ in range(3)}
        return {"text": rng.choice(["x", 'q"email": "y"', "a\\b", "{", "é"]), "number": rng.choice([1, 2.5, True]), "null": None, "list": [value(depth - 1) for _ in range(2)]  if depth else []}[kind]
    made = [{rng.choice([*X.SENSITIVE, "Full_Name", "k"]): value(d) for _ in range(4)} for d in (0, 1, 3) for _ in range(60)] + [{k: "v", k.upper(): 5} for k in X.SENSITIVE]
    texts = [json.dumps(x, ensure_ascii=bool(i % 2)) for i, x in enumerate(made)]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", X.redacted_json(F.col("t")).alias("r")).orderBy("i").select("r").collect()]
    assert [json.loads(x) for x in got] == [hide(x) for x in made]
    odd = [None, "not json [", '{"x": 1, email: "a@b.org"}', '{"x": 1 "email": "a@b.org"}', '{"email": a@b.org}', '{"email": "a" "b"}', '{"x": 1,}', "{}", ' { "email" : "a@b.org" } ', '{"x": -1.5e3, "ok": true}']
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "i int, t string").select("i", X.redacted_json(F.col("t"))).orderBy("i").select(F.col("*")).toDF("i", "r").select("r").collect()]
    assert got == [None, *[X.REDACTED] * 6, "{}", ' { "email" : "[REDACTED]" } ', '{"x": -1.5e3, "ok": true}']


def test_write_mask_with_keyed_index(spark):
    key = b"Jefe"
    df = spark.createDataFrame([(1, {"national_id": "what do ya want for nothing?", "name": "n"}, None), (2, {"national_id": X.REDACTED, "national_id_blind_index": "old"}, "short"), (3, {"contact_info": "c"}, "a" * 64), (4, {"national_id_encrypted": r"\x" + "ff"}, None)], "i int, p map<string,string>, s string")
    out = X.masked_payload(F.col("p"), F.col("s"), S.blind_index(X.raw_identity(F.col("p")), key))
    got = {r[0]: r[1] for r in df.select("i", out).collect()}
    base = {"national_id_encrypted": X.REDACTED, "contact_info_encrypted": X.REDACTED}
    assert got == {1: base | {"name": "n", "national_id_blind_index": "5bdcc146bf60754e6a042426089575c75a003f089d2739839dec58b964ec3843"}, 2: base | {"national_id_blind_index": "old"}, 3: base | {"national_id_blind_index": "a" * 64}, 4: base}
    assert df.limit(1).select(S.blind_index(F.lit(" p "), b"salt", 2)).first()[0] == hashlib.pbkdf2_hmac("sha256", b"p", b"salt", 2).hex()


def test_updates_without_payload_clear_the_state(spark):
    rows = [(1, 1, "INSERT", "employees", None, '{"a": "1", "b": "2"}', 0.0), (2, 1, "UPDATE", "employees", None, None, 1.0), (3, 1, "UPDATE", "employees", None, '{"c": "3"}', 2.0), (4, 2, "INSERT", "employees", None, "{}", 3.0), (5, 3, "INSERT", "employees", None, '{"a": "1"}', 4.0), (6, 3, "UPDATE", "employees", None, None, 5.0), (7, 4, "INSERT", "employees", None, None, 6.0)]
    got = {r["employee_id"]: r["state"] for r in replay.documents(ledger(spark, rows), F.lit(True)).collect()}
    assert got == {1: {"c": "3"}, 2: {}}
    assert [tuple(r) for r in replay.state(ledger(spark, rows), F.lit(True)).collect()] == [(1, "c", "3")]


@pytest.mark.parametrize("bucket", [2, 1 << 16])
def test_chains_without_employee(spark, bucket):
    chain = CH.build(D.ledger(spark, SF).withColumn("employee_id", F.when(F.col("employee_id") % 2 == 0, F.col("employee_id"))))
    assert CH.anomalies(chain, bucket=bucket).count() == 0
    bad = CH.tampered(chain, F.lit(False), F.col("employee_id").isNull() & (F.col("chain_seq") == 5))
    assert [tuple(r) for r in CH.anomalies(bad, bucket=bucket).collect()] == [(None, 6, False, True, True)]
    assert {r["tail"] for r in CH.tail_status(chain, CH.tails(chain)).collect()} == {"pass"}


def test_capsules_stand_alone(spark, tmp_path):
    seed = bytes(range(32))
    public = S.ed25519_public(seed).hex()
    chain = CH.build(D.ledger(spark, SF).where("sequence_id <= 200")).cache()
    sealed = K.signed(K.fixed(chain, 8).withColumn("merkle_root", F.expr("CASE WHEN checkpoint > 0 THEN merkle_root END")), seed, "k")
    plain = capsules.capsules(chain, sealed)
    assert {r["status"] for r in plain.collect()} == {"ok", "before_merkle"}
    made = capsules.capsules(chain, sealed, seed=seed, public_hex=public)
    assert {r["status"] for r in made.collect()} == {"ok", "attested"}
    capsules.write(made, f"{tmp_path}/capsules")
    (tmp_path / "capsules" / "odd.json").write_text("no json\n")
    back = capsules.verified(capsules.read(spark, f"{tmp_path}/capsules"), public)
    assert {r[0]: r[1] for r in back.groupBy("verdict").count().collect()} == {"VALID": 200, "MALFORMED": 1}
    other = S.ed25519_public(bytes(32)).hex()
    assert {r["verdict"] for r in capsules.verified(made, other).collect()} == {"SIGNATURE_INVALID"}
    # No attestation for a chain that is broken up to it, a digest that is another, or a signature of another key.
    broken = CH.tampered(chain, F.col("chain_seq") == 2, F.lit(False))
    assert {r["status"] for r in capsules.capsules(broken, sealed, seed=seed, public_hex=public).where("checkpoint = 0").collect()} == {"before_merkle"}
    assert {r["status"] for r in capsules.capsules(chain, sealed.withColumn("digest", F.lit("x")), seed=seed, public_hex=public).where("checkpoint = 0").collect()} == {"before_merkle"}
    assert {r["status"] for r in capsules.capsules(chain, sealed, seed=seed, public_hex=other).where("checkpoint = 0").collect()} == {"before_merkle"}


def test_signature_statuses(spark):
    seed = bytes(range(32))
    sealed = spark.createDataFrame([("a", "r"), ("b", None)], "digest string, merkle_root string")
    signed = K.signed(sealed, seed, "k")
    public = S.ed25519_public(seed).hex()
    assert [r["signature"] for r in K.signature_statuses(signed).collect()] == ["no_key_provided"] * 2
    assert [r["signature"] for r in K.signature_statuses(signed, default_key=public).collect()] == ["verified"] * 2
    assert [r["signature"] for r in K.signature_statuses(signed.withColumn("merkle_root", F.lit("x")), default_key=public).collect()] == ["invalid_signature"] * 2
    none = spark.createDataFrame([], "key_id string, public_hex string")
    assert [r["signature"] for r in K.signature_statuses(signed, none).collect()] == ["key_not_found"] * 2


def test_import_files(spark, tmp_path):
    head, row = ",".join(imports.COLUMNS), "a,a@x.org,r,d,1,c,2024-01-01,1"
    made = {"good": [head, row], "bom": ["\ufeff" + head, row], "order": [",".join(reversed(imports.COLUMNS)), row], "long": [head, *[row] * 101], "large": [head, "x" * 250_001]}
    for name, lines in made.items():
        (tmp_path / f"{name}.csv").write_text("\n".join(lines), encoding="utf-8")
    got = {r["file"].rsplit("/", 1)[1][:-4]: r["fault"] for r in imports.file_faults(spark, str(tmp_path)).collect()}
    assert got == {"good": None, "bom": None, "order": "header", "long": "too_many_rows", "large": "too_large"}


def test_evidence_export_is_sealed(spark, tmp_path):
    seed = bytes(range(32))
    rows = D.ledger(spark, SF).where("sequence_id <= 50")
    bundle.write_export(rows, D.table(spark, SF, "users"), f"{tmp_path}/export", seed)
    lines = [json.loads(r[0]) for r in spark.read.text(f"{tmp_path}/export/lines").collect()]
    assert sorted(x["sequence_id"] for x in lines) == list(range(1, 51)) and all("actor_name" in x for x in lines)
    seal = spark.read.json(f"{tmp_path}/export/seal").first()
    hashes = [hashlib.sha256(r[0].encode()).hexdigest() for r in sorted(spark.read.text(f"{tmp_path}/export/lines").collect(), key=lambda r: json.loads(r[0])["sequence_id"])]
    assert seal["digest"] == hashlib.sha256("".join(hashes).encode()).hexdigest() and S.ed25519_valid(S.ed25519_public(seed), seal["digest"].encode(), bytes.fromhex(seal["signature_hex"]))


def test_batch_rules(spark):
    batch = spark.createDataFrame([("a@x",), ("A@x ",)], "email string")
    assert tuple(rules.batch_errors(batch).first()) == (False, True) and tuple(rules.batch_errors(batch, 1).first()) == (True, True)


def test_scores_freshness_and_durations(spark):
    df = spark.range(1)
    one = lambda c: df.select(c).first()[0]
    assert one(CH.score(F.array(*map(F.lit, ["pass", "fail", "unknown", "pass", "pass", "fail", "fail", "pass"])))) == 50
    assert [one(detect.freshness(F.lit("intact"), F.lit(x))) for x in (600, 601)] == ["intact", "unknown"]
    assert [one(X.duration(F.lit(x))) for x in (1.5, 90.0, 7200.0, 172800.0)] == ["1.50 s", "1.5 min", "2.0 hours", "2.0 days"]


def test_unknown_ids(spark):
    sound = spark.createDataFrame([(1,)], "salary_id long")
    assert [r[0] for r in replay.unknown_ids(sound, spark.createDataFrame([(1,), (9,)], "salary_id long")).collect()] == [9]


@pytest.mark.parametrize("files", [1, 3])
def test_streams_equal_batches(spark, tmp_path, files):
    rows = D.ledger(spark, SF)
    jobs.arriving(rows, f"{tmp_path}/ledger", "sequence_id", files)
    detection.run(jobs.source(spark, f"{tmp_path}/ledger", 1), str(tmp_path))
    assert sorted(map(tuple, detection.flags(spark, str(tmp_path)).collect())) == sorted(map(tuple, detect.flags(rows).collect()))
    sealed = jobs.sealing(jobs.source(spark, f"{tmp_path}/ledger", 1), 5, 172_800)
    jobs.to_files(sealed, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    want = []
    for (e,), group in rows.select("employee_id", "sequence_id", detect.micros(F.col("created_at")).alias("t")).toPandas().sort_values("sequence_id").groupby(["employee_id"]):
        done = waiting = since = 0
        for t in group["t"]:
            since = t if not waiting else since
            waiting += 1
            reason = "count" if waiting >= 5 else "time" if t - since >= 172_800_000_000 else None
            if reason:
                want.append((e, done, done + waiting, reason))
                done, waiting = done + waiting, 0
    assert got == sorted(want) and {r[3] for r in got} == {"count", "time"}


def test_sliding_limit_counts_the_allowed(spark):
    df = spark.createDataFrame([("a", i, float(i * 10)) for i in range(12)], "k string, id long, s double").withColumn("t", F.expr("timestamp_ntz'2026-01-01' + make_dt_interval(0, 0, 0, s)"))
    got = [r["allowed"] for r in limits.sliding(df, "k", "t", "id", 2, 60).orderBy("id").collect()]
    assert got == [True, True, False, False, False, False] * 2


def test_bundle_tamper_matrix(spark, tmp_path):
    chain = CH.build(D.ledger(spark, SF).where("sequence_id <= 10"), ())
    sealed = K.fixed(chain, 8, ())
    bad = {"clean": chain, "edited": CH.tampered(chain, F.col("sequence_id") == 4, F.lit(False)), "removed": chain.where("sequence_id <> 5"), "cut": chain.where("sequence_id < 9")}
    bundle.write(chain, sealed, f"{tmp_path}/clean")
    for name in ("edited", "removed", "cut"):
        bundle.write(bad[name], sealed, f"{tmp_path}/{name}")
        import shutil

        shutil.rmtree(f"{tmp_path}/{name}/manifest")
        shutil.copytree(f"{tmp_path}/clean/manifest", f"{tmp_path}/{name}/manifest")
    bundle.write(chain, sealed, f"{tmp_path}/signed", bytes(range(32)))
    public = S.ed25519_public(bytes(range(32))).hex()
    assert [bundle.verify(spark, f"{tmp_path}/{n}", k).first()[0] for n, k in (("signed", public), ("signed", "00" * 32), ("clean", public))] == ["SUCCESS", "SIGNATURE_INVALID", "SIGNATURE_INVALID"]
    got = {n: bundle.verify(spark, f"{tmp_path}/{n}").first()[0] for n in (*bad, "absent")}
    assert got == {"clean": "SUCCESS", "edited": "HASH_BREAK", "removed": "SEQUENCE_GAP", "cut": "HASH_BREAK", "absent": "MALFORMED_BUNDLE"}


def test_import_faults(spark, tmp_path):
    lines = [",".join(imports.COLUMNS), 'Ann B,ann@x.com,NATION_1,AFRICA,1,c,2024-02-29,100.50', '"Q ""D"", Jr",ANN@x.com,NATION_1,AFRICA,1,c,2023-02-29,abc', ",bad,Nobody,Nowhere,,,x,"]
    (tmp_path / "a.csv").write_text("\n".join(lines))
    roles = spark.createDataFrame([(1, "NATION_1", 0)], "role_id int, title string, department_id int")
    got = imports.faults(imports.read(spark, str(tmp_path)), roles, spark.createDataFrame([(0, "AFRICA")], "department_id int, department string"))
    found = {r["full_name"]: r["faults"] for r in got.collect()}
    assert found["Ann B"] == ["repeated_email"] and found['Q "D", Jr'] == ["repeated_email", "date", "salary"]
    assert found[None] == ["name", "email", "role", "date", "salary"]


def test_trust_by_chain(spark):
    rows = [(e, i, i * 8, f"{e}{i}" * 32, "a" * 64, "0" * 128, "k") for e in (1, 2, 3) for i in range(1, 5)]
    names = f"employee_id int, {ANCHORS}"
    ours = spark.createDataFrame([x for x in rows if x[0] != 3 or x[1] < 3], names)
    theirs = spark.createDataFrame([x if x[:2] != (2, 3) else (*x[:4], "b" * 64, *x[5:]) for x in rows] + [(4, 1, 8, "41" * 32, "a" * 64, "0" * 128, "k")], names)
    got = {r["employee_id"]: tuple(r)[1:] for r in trust.compare(ours, theirs, keys=["employee_id"]).collect()}
    assert got == {1: ("pass", 0, 0, 0), 2: ("fail", 0, 0, 1), 3: ("fail", 2, 0, 0), 4: ("fail", 1, 0, 0)}
    assert [tuple(r) for r in trust.forks(ours.unionByName(theirs), ["employee_id"]).collect()] == [(2, 24, 2)]
    said = spark.createDataFrame([(1, 5, "a", True), (1, 5, "b", True), (2, 5, "a", True), (2, 6, "a", False)], "employee_id int, sequence_id long, witness string, valid boolean").selectExpr("*", "witness as key_id", "witness as domain")
    assert {tuple(r)[:3] for r in trust.quorum(said, 2, ["employee_id"]).collect()} == {(1, 5, "pass"), (2, 5, "unknown"), (2, 6, "fail")}


def test_newest_links_of_every_chain(spark):
    chain = CH.build(D.ledger(spark, SF))
    one = chain.groupBy("employee_id").agg(F.count(F.lit(1)).alias("n"), F.max("sequence_id").alias("top")).orderBy(F.col("n").desc(), "employee_id").first()
    bad = chain.withColumn("previous_hash", F.when(F.col("sequence_id") == one["top"], "x").otherwise(F.col("previous_hash")))
    got = CH.newest_links(bad, 3, ["employee_id"]).collect()
    assert one["n"] > 1 and [r["employee_id"] for r in got if not r["intact"]] == [one["employee_id"]]
    assert len(got) == chain.select("employee_id").distinct().count() and max(r["rows"] for r in got) == min(3, one["n"])
