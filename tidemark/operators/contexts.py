"""Signed actor contexts: who writes, vouched for by a keyed digest, for a short while, once."""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.streaming.keyed import folded

#: What the digest is taken of begins with this: a label of this library.
LABEL = "tidemark/actor-context/1"
#: Roles that may write, and the forms of the fields.
ROLES = ("hr_admin", "compliance_auditor")
FORMS = {"version": "^1$", "key_id": "^[A-Za-z0-9_-]{1,32}$", "user_id": "^[1-9][0-9]{0,9}$", "employee_id": "^(0|[1-9][0-9]{0,9})$", "nonce": "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$", "issued_at": "^[0-9]{1,12}$", "expires_at": "^[0-9]{1,12}$", "signature": "^[0-9a-fA-F]{64}$"}
#: Who a nonce belongs to: the same transaction may show it again.
OWNER = ("transaction_id", "user_id", "employee_id", "role", "signature")


def payload() -> Column:
    """What the digest of a context is taken of."""
    return F.concat_ws("|", F.lit(LABEL), "key_id", "user_id", "employee_id", "role", F.lower("nonce"), "issued_at", "expires_at")


def keyed(key: Column, message: Column) -> Column:
    """Hex HMAC-SHA256 of a message by a key of the row; null where either is."""

    @F.pandas_udf("string")
    def digest(keys: pd.Series, messages: pd.Series) -> pd.Series:
        made = [None if k is None or m is None else hmac.new(bytes(k), m.encode(), hashlib.sha256).hexdigest() for k, m in zip(keys, messages)]
        return pd.Series(made, dtype=object)

    return digest(key, message)


def checked(contexts: DataFrame, keys: DataFrame, most_s: int = 60, skew_s: int = 5) -> DataFrame:
    """Contexts with expected (the digest that they should carry, null where none can be worked out) and fault, the first of:
    malformed (a field's form, or a role that may not write or is not the session's); outside_window (issued after now and
    `skew_s`, expired, at the second itself too, expiring before it begins, or valid for more than `most_s`);
    no_key (none enabled of that id, or several); bad_signature. Null: sound so far.

    contexts: version, key_id, user_id, employee_id, role, session_role, nonce, issued_at, expires_at, signature (texts),
    transaction_id, now (seconds). keys: key_id, material (binary), enabled."""
    usable = keys.where("enabled").groupBy("key_id").agg(F.count(F.lit(1)).alias("_n"), F.first("material").alias("_key")).where("_n = 1").drop("_n")
    whole = F.col("role").isin(*ROLES) & F.col("role").eqNullSafe(F.col("session_role"))
    for name, form in FORMS.items():
        whole = whole & F.coalesce(F.col(name), F.lit("")).rlike(form)
    whole = F.coalesce(whole, F.lit(False))
    issued, expires, now = F.expr("try_cast(issued_at as bigint)"), F.expr("try_cast(expires_at as bigint)"), F.col("now")
    outside = (issued > now + skew_s) | (expires <= now) | (expires <= issued) | (expires - issued > most_s)
    rows = contexts.join(usable, "key_id", "left")
    rows = rows.withColumn("expected", keyed(F.when(whole, F.col("_key")), payload()))
    fault = F.when(~whole, "malformed").when(outside, "outside_window").when(F.col("_key").isNull(), "no_key").when(F.col("expected") != F.lower("signature"), "bad_signature")
    return rows.withColumn("fault", fault).drop("_key").select(*contexts.columns, "expected", "fault")


def admitted(contexts: DataFrame, keys: DataFrame, order: str, **options) -> DataFrame:
    """`checked`, with fault nonce_used too: the first sound context of a nonce by `order` owns it, and others pass only if
    they are of the same transaction, actor, role and signature."""
    rows = checked(contexts, keys, **options)
    mine = F.struct(*[F.lower(c).alias(c) if c == "signature" else F.col(c) for c in OWNER])
    owners = rows.where("fault IS NULL").groupBy(F.lower("nonce").alias("_nonce")).agg(F.min_by(mine, order).alias("_owner"))
    both = rows.join(owners, F.lower("nonce") == F.col("_nonce"), "left")
    return both.withColumn("fault", F.coalesce("fault", F.when(~mine.eqNullSafe(F.col("_owner")), "nonce_used"))).select(*rows.columns)


def watched(contexts: DataFrame, keys: DataFrame, order: str, keep_s: int | None = 6 * 3600, **options) -> DataFrame:
    """The same over a stream: `order`, nonce, fault of every context that is sound but for its nonce. State: each nonce's
    owner, which leaves the state when nothing has shown it for keep_s seconds; contexts expire long before. With None it
    stays, as it must where a stream runs until nothing is left: there a timer would keep it from ending."""

    def claim(owner: bytes | None, rows: list[tuple]) -> tuple[bytes, list[tuple]]:
        owner = bytes(rows[0][1]) if owner is None else owner
        return owner, [(at, None if bytes(mine) == owner else "nonce_used") for at, mine in rows]

    rows = checked(contexts, keys, **options).where("fault IS NULL")
    # Whom a nonce belongs to is told by a digest of all its fields, so that a state of very many nonces stays small.
    owner = F.struct(F.col("transaction_id").cast("long").alias("transaction_id"), "user_id", "employee_id", "role", F.lower("signature").alias("signature"))
    slim = rows.select(F.col(order).cast("long").alias(order), F.lower("nonce").alias("nonce"), F.unhex(F.sha2(F.to_json(owner, {"ignoreNullFields": "false"}), 256)).alias("mine"))
    found = folded(slim, "nonce", [order], [order, "mine"], f"{order} long, fault string", claim, lambda _: (None, []), None if keep_s is None else lambda _: keep_s * 1000)
    return found.select(order, "nonce", "fault")
