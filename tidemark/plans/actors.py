"""Signed actor contexts, one for each event, in a batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import contexts as A
from tidemark.plans.catalogue import query
from tidemark.streaming import monitor

#: Examples: not secrets. k0 and k1 are enabled, k2 is not, k3 is there twice.
KEYS = {"k0": b"first example", "k1": b"second example", "k2": b"third example", "k3": b"fourth example"}

#: column -> SQL over events, k and seen, the event whose nonce and transaction are shown (again).
COLUMNS = {
    "event_id": "event_id",
    "version": "case when k % 29 = 1 then '2' else '1' end",
    "key_id": "'k' || cast(k % 7 % 5 as string)",
    "user_id": "cast(case when k % 31 = 2 then 0 else 1 + seen % 9 end as string)",
    "employee_id": "cast(seen % 9 as string)",
    "role": "case when seen % 2 = 0 then 'hr_admin' else 'compliance_auditor' end",
    "session_role": "case when k % 37 = 3 then 'other' when seen % 2 = 0 then 'hr_admin' else 'compliance_auditor' end",
    "nonce": "substr(md5(cast(seen as string)), 1, 8) || '-' || substr(md5(cast(seen as string)), 9, 4) || '-' || substr(md5(cast(seen as string)), 13, 4) || '-' || substr(md5(cast(seen as string)), 17, 4) || '-' || substr(md5(cast(seen as string)), 21, 12)",
    "issued_at": "cast(1700000000 + seen as string)",
    "expires_at": "cast(1700000000 + seen + case when k % 17 = 4 then 61 when k % 19 = 5 then 0 else 60 end as string)",
    "now": "1700000000 + seen + case when k % 23 = 6 then 60 when k % 41 = 7 then -6 else 30 end",
    "transaction_id": "seen + case when k % 3 = 0 then 0 else event_id - seen end",
}
_PARTS = ("key_id", "user_id", "employee_id", "role", "nonce", "issued_at", "expires_at")


def _sql_hmac(key: bytes, message: str) -> str:
    pads = [bytes(a ^ p for a in key.ljust(64, b"\0")).hex() for p in (0x36, 0x5C)]
    return f"sha256(unhex('{pads[1]}') || unhex(sha256(unhex('{pads[0]}') || encode({message}))))"


def _sql_expected() -> str:
    message = f"concat_ws('|', '{A.LABEL}', {', '.join(_PARTS)})"
    return "case key_id " + " ".join(f"when '{k}' then {_sql_hmac(v, message)}" for k, v in KEYS.items() if k in ("k0", "k1")) + " end"


_WHOLE = "version = '1' and user_id <> '0' and role = session_role"
_JUDGED = "with made as (select " + ", ".join(f"{x} as {n}" for n, x in COLUMNS.items()) + """, k from (select *, event_id - case when k % 4 = 0 and event_id > 0 then 1 else 0 end as seen from (select *, cast(json_extract_string(props, '$.k') as int) as k from events))),
""" + f"""signed as (select *, {_sql_expected()} as mac from made),
sent as (select *, case when k % 13 = 8 then repeat('0', 64) else coalesce(mac, repeat('0', 64)) end as signature from signed),
checked as (select *, case when {_WHOLE} then mac end as expected, case when not ({_WHOLE}) then 'malformed'
  when issued_at::bigint > now + 5 or expires_at::bigint <= now or expires_at::bigint <= issued_at::bigint or expires_at::bigint - issued_at::bigint > 60 then 'outside_window' when mac is null then 'no_key' when signature <> mac then 'bad_signature' end as fault from sent),
owners as (select nonce, arg_min((transaction_id, user_id, employee_id, role, signature), event_id) as owner from checked where fault is null group by 1),
judged as (select event_id, c.nonce, expected, coalesce(fault, case when (transaction_id, user_id, employee_id, role, signature) <> owner then 'nonce_used' end) as fault from checked c left join owners o on o.nonce = c.nonce)
"""


def _contexts(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    keys = spark.createDataFrame([(k, v, k != "k2") for k, v in KEYS.items()] + [("k3", b"another", True)], "key_id string, material binary, enabled boolean")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("*", "cast(get_json_object(props, '$.k') as int) as k")
    seen = events.withColumn("seen", F.expr("event_id - case when k % 4 = 0 and event_id > 0 then 1 else 0 end"))
    made = seen.selectExpr(*[f"{x} as {n}" for n, x in COLUMNS.items()], "k")
    own = F.element_at(F.create_map(*[y for k in ("k0", "k1") for y in (F.lit(k), F.lit(KEYS[k]))]), F.col("key_id"))
    signature = F.when(F.col("k") % 13 == 8, "0" * 64).otherwise(F.coalesce(A.keyed(own, A.payload()), F.lit("0" * 64)))
    return made.withColumn("signature", signature).drop("k"), keys


@query(_JUDGED + "select event_id, nonce, expected, fault from judged")
def actor_contexts(spark, sf_dir):
    """Every context with the digest that it should carry, and its first fault."""
    rows, keys = _contexts(spark, sf_dir)
    return A.admitted(rows, keys, "event_id").select("event_id", "nonce", "expected", "fault")


@query(_JUDGED + "select event_id, nonce, fault from judged where fault is null or fault = 'nonce_used'")
def stream_nonces(spark, sf_dir):
    """The same as contexts come, in three parts, each after a restart: a nonce is held over them."""
    rows, keys = _contexts(spark, sf_dir)
    return monitor.in_turn(rows, "event_id", 3, lambda part, _: A.watched(part, keys, "event_id", None), "nonces")
