"""Checkpoints over a chain: digests, Merkle roots, inclusion proofs, binding and triggers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import secrets as S
from tidemark.functions import text as X


def leaf(content: Column) -> Column:
    return F.sha2(F.concat(F.unhex(F.lit("00")), content.cast("binary")), 256)


def parent(left: Column, right: Column) -> Column:
    return F.sha2(F.concat(F.unhex(F.lit("01")), F.unhex(left), F.unhex(right)), 256)


def _up(level: Column) -> Column:
    """The level above: neighbours hashed together, an odd last one as it is."""
    half = F.ceil(F.size(level) / 2).cast("int")
    at = lambda i: F.element_at(level, i + 1)
    return F.transform(F.sequence(F.lit(0), half - 1), lambda i: F.when(2 * i + 1 < F.size(level), parent(at(2 * i), F.try_element_at(level, 2 * i + 2))).otherwise(at(2 * i)))


def _levels(size: int) -> int:
    return max(size - 1, 0).bit_length()


def fixed(chain: DataFrame, interval: int, keys: Sequence[str] = ("employee_id",), position: str = "chain_seq") -> DataFrame:
    """A checkpoint after each `interval` rows, a partial one at the end: checkpoint, first and last position, rows,
    digest (SHA-256 of the hashes joined) and Merkle root. A group has at most `interval` rows."""
    rows = chain.withColumn("checkpoint", F.floor((F.col(position) - 1) / interval))
    packed = F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.col("entry_hash").alias("h"), leaf(X.serialised()).alias("leaf"))))
    out = rows.groupBy(*keys, "checkpoint").agg(packed.alias("_rows"))
    out = out.withColumn("_level", F.col("_rows.leaf"))
    for _ in range(_levels(interval)):
        out = out.withColumn("_level", _up(F.col("_level")))
    return out.select(*keys, "checkpoint", F.element_at("_rows", 1)["p"].alias("first_seq"), F.element_at("_rows", -1)["p"].alias("last_seq"), F.size("_rows").alias("n_rows"), F.sha2(F.concat_ws("", F.col("_rows.h")), 256).alias("digest"), F.element_at("_level", 1).alias("merkle_root"))


def proofs(chain: DataFrame, interval: int, keys: Sequence[str] = ("employee_id",), position: str = "chain_seq") -> DataFrame:
    """For each row its leaf, checkpoint, and path: left:hash or right:hash by level, none where it is promoted."""
    rows = chain.withColumn("checkpoint", F.floor((F.col(position) - 1) / interval))
    packed = F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), leaf(X.serialised()).alias("leaf"))))
    out = rows.groupBy(*keys, "checkpoint").agg(packed.alias("_rows")).withColumn("_l0", F.col("_rows.leaf"))
    depth = _levels(interval)
    for d in range(depth):
        out = out.withColumn(f"_l{d + 1}", _up(F.col(f"_l{d}")))
    out = out.select(*keys, "checkpoint", *[f"_l{d}" for d in range(depth + 1)], F.posexplode("_rows").alias("_at", "_row"))

    def sibling(d: int) -> Column:
        at = F.shiftright("_at", d)
        other = F.when(at % 2 == 0, at + 1).otherwise(at - 1)
        found = F.try_element_at(F.col(f"_l{d}"), other + 1)
        return F.when(found.isNotNull(), F.concat(F.when(at % 2 == 0, "right:").otherwise("left:"), found))

    path = F.array_compact(F.array(*[sibling(d) for d in range(depth)]) if depth else F.array().cast("array<string>"))
    return out.select(*keys, "checkpoint", F.col("_row.p").alias(position), F.col("_row.leaf").alias("leaf"), path.alias("path"), F.element_at(f"_l{depth}", 1).alias("merkle_root"))


def proved_root(leaf_hash: Column, path: Column) -> Column:
    """The root that a path leads to from a leaf."""
    return F.aggregate(path, leaf_hash, lambda now, x: F.when(x.startswith("right:"), parent(now, F.substring(x, 7, 64))).otherwise(parent(F.substring(x, 6, 64), now)))


def dual_trigger(pending: Column, elapsed_s: Column, rows: int = 25, seconds: int = 60) -> Column:
    """count if enough rows wait, else time if enough time passed, else null. The count is tested first."""
    return F.when(pending >= rows, "count").when((pending > 0) & (elapsed_s >= seconds), "time")


def due(chain: DataFrame, sealed: DataFrame, now: Column, rows: int = 25, seconds: int = 60, keys: Sequence[str] = ("employee_id",)) -> DataFrame:
    """For every key with rows behind its newest checkpoint: pending, elapsed and trigger (see `dual_trigger`).

    sealed: keys, last_seq, sealed_when. elapsed: whole seconds from the newest checkpoint to now, from the first waiting row
    where there is none, never below 0."""
    waiting = unsealed(chain, sealed, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("pending"), F.min("created_at").alias("_first"))
    last = sealed.groupBy(*keys).agg(F.max_by("sealed_when", "last_seq").alias("_sealed")).alias("s")
    match = F.lit(True)
    for k in keys:
        match = match & F.col(f"w.{k}").eqNullSafe(F.col(f"s.{k}"))
    both = waiting.alias("w").join(last, match, "left")
    elapsed = F.greatest(F.lit(0), F.timestamp_diff("SECOND", F.coalesce("_sealed", "_first"), now)).cast("long")
    return both.select(*[f"w.{k}" for k in keys], "pending", elapsed.alias("elapsed")).withColumn("trigger", dual_trigger(F.col("pending"), F.col("elapsed"), rows, seconds))


def scheduled_after(last: Column, latest: Column, interval: int) -> Column:
    """The sequence to seal after, once the latest row reaches the next multiple of the interval; else null."""
    done = F.coalesce(last, F.lit(0))
    return F.when(latest >= (F.floor(done / interval) + 1) * interval, done)


def sealed_payload(digest: Column, root: Column) -> Column:
    return F.concat_ws(":", digest, root)


def one(sealed: DataFrame, checkpoint: int) -> DataFrame:
    return sealed.where(F.col("checkpoint") == checkpoint)


def between(sealed: DataFrame, first: int, last: int) -> DataFrame:
    """Checkpoints whose last position lies in [first, last], both included, in order."""
    return sealed.where(F.col("last_seq").between(first, last)).orderBy("last_seq")


def ordered(sealed: DataFrame, keys: Sequence[str] = ("employee_id",)) -> DataFrame:
    return sealed.orderBy(*keys, "last_seq")


def latest(sealed: DataFrame, keys: Sequence[str] = ("employee_id",)) -> DataFrame:
    """The newest checkpoint of each key."""
    own = [c for c in sealed.columns if c not in keys]
    return sealed.groupBy(*keys).agg(F.max_by(F.struct(*own), "last_seq").alias("_c")).select(*keys, "_c.*")


def unsealed(chain: DataFrame, sealed: DataFrame, keys: Sequence[str] = ("employee_id",), position: str = "chain_seq", slim: bool = False) -> DataFrame:
    """Rows behind the newest checkpoint of their key, all where it has none; slim: position and hash alone."""
    ends = sealed.groupBy(*keys).agg(F.max("last_seq").alias("_end")).alias("s")
    match = F.lit(True)
    for k in keys:
        match = match & F.col(f"c.{k}").eqNullSafe(F.col(f"s.{k}"))
    rows = chain.alias("c").join(ends, match, "left").where(F.col(position) > F.coalesce("_end", F.lit(0)))
    return rows.select(*[f"c.{x}" for x in (*keys, position, "entry_hash")]) if slim else rows.select("c.*")


def appended(existing: DataFrame, offered: DataFrame, keys: Sequence[str] = ("employee_id",)) -> DataFrame:
    """Offered checkpoints whose position is not taken yet; of equal ones offered together, one. Writing these again
    adds nothing, so a sink that appends them may be retried."""
    place = [*keys, "last_seq"]
    return offered.join(existing.select(*place).distinct(), place, "left_anti").dropDuplicates(place)


def signed(sealed: DataFrame, seed: bytes, key_id: str) -> DataFrame:
    """Adds key_id and signature_hex over digest and root, or the digest alone where there is no root."""
    return sealed.withColumn("key_id", F.lit(key_id)).withColumn("signature_hex", S.signature(sealed_payload(F.col("digest"), F.col("merkle_root")), seed))


def signature_statuses(sealed: DataFrame, registry: DataFrame | None = None, default_key: str | None = None) -> DataFrame:
    """Adds signature: unsigned, key_not_found, no_key_provided, verified or invalid_signature, by the key registry
    (key_id, public_hex) and, for keys that it lacks, the default key in hex."""
    rows = sealed.drop("public_hex")
    rows = rows.join(registry.select("key_id", "public_hex"), "key_id", "left") if registry is not None else rows.withColumn("public_hex", F.lit(None).cast("string"))
    public = F.coalesce("public_hex", F.lit(default_key))
    unsigned = F.coalesce("signature_hex", F.lit("")).isin("", "00" * 64)
    valid = S.signature_valid(F.unhex(F.when(~unsigned, public)), sealed_payload(F.col("digest"), F.col("merkle_root")), F.unhex(F.col("signature_hex")))
    missing = F.lit("no_key_provided" if registry is None else "key_not_found")
    status = F.when(unsigned, "unsigned").when(public.isNull(), missing).when(valid, "verified").otherwise("invalid_signature")
    return rows.withColumn("signature", status).drop("public_hex")


def lag(tail: Column, sealed: Column) -> Column:
    return F.greatest(F.lit(0), tail - sealed)


def capsule_status(found: Column, sealed_at: Column, root: Column) -> Column:
    return F.when(~found, "not_found").when(sealed_at.isNull(), "uncheckpointed").when(root.isNull(), "before_merkle").otherwise("ok")
