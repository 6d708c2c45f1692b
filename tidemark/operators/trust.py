"""Checkpoint lists from different places held against each other."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import ordered as O

#: Checkpoints that one window of a comparison looks at.
BUCKET = 1 << 16
#: What two checkpoint lists must agree on, and the form of published hashes and signatures.
COMPARED = ("checkpoint_id", "sequence_id", "checkpoint_hash", "merkle_root", "signature_hex", "key_id")
HEX_64, HEX_128 = "^[0-9a-f]{64}$", "^[0-9a-f]{128}$"
#: Fixed value: the most witness signatures of a checkpoint.
MOST_WITNESSES = 20


def placed(checkpoints: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Adds place, from 1 in order of checkpoint_id within the keys, and rising: whether ids and sequences rise."""
    rows = O.previous(checkpoints, keys, F.floor(F.col("checkpoint_id") / BUCKET), ["checkpoint_id"], {"_id": "checkpoint_id", "_seq": "sequence_id"})
    rows = rows.withColumn("rising", F.coalesce((F.col("checkpoint_id") > F.col("_id")) & (F.col("sequence_id") > F.col("_seq")), F.lit(True))).drop("_id", "_seq")
    return O.numbered(rows, keys, F.floor(F.col("checkpoint_id") / BUCKET), ["checkpoint_id"], "place")


def _matched(a: str, b: str, keys: Sequence[str]) -> Column:
    """Rows of equal keys, null keys among them."""
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return same


def differences(ours: DataFrame, theirs: DataFrame, interval: int = 1, keys: Sequence[str] = ()) -> DataFrame:
    """The keys, place, problem (ours_missing, theirs_missing, differs) wherever two lists do not agree, place by place.
    Checkpoints off the interval's multiples are no anchors and left out."""
    a, b = (placed(x.where(F.col("sequence_id") % interval == 0), keys) for x in (ours, theirs))
    both = a.alias("a").join(b.alias("b"), _matched("a", "b", keys) & (F.col("a.place") == F.col("b.place")), "full")
    same = F.lit(True)
    for f in COMPARED:
        same = same & F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}"))
    problem = F.when(F.col("a.checkpoint_id").isNull(), "ours_missing").when(F.col("b.checkpoint_id").isNull(), "theirs_missing").when(~same, "differs")
    named = [F.when(F.col("a.place").isNotNull(), F.col(f"a.{k}")).otherwise(F.col(f"b.{k}")).alias(k) for k in keys]
    return both.select(*named, F.coalesce("a.place", "b.place").alias("place"), problem.alias("problem")).where("problem IS NOT NULL")


def well_formed(checkpoints: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Adds fit: whether a published checkpoint has positive, rising ids and sequences, hashes and signature in hex, and a
    key id."""
    hexes = [F.col(c).rlike(p) for c, p in (("checkpoint_hash", HEX_64), ("merkle_root", HEX_64), ("signature_hex", HEX_128))]
    fit = F.col("rising") & (F.col("checkpoint_id") > 0) & (F.col("sequence_id") > 0) & hexes[0] & hexes[1] & hexes[2] & F.col("key_id").isNotNull()
    return placed(checkpoints, keys).withColumn("fit", F.coalesce(fit, F.lit(False)))


def compare(ours: DataFrame, theirs: DataFrame, interval: int = 1, minimum: int = 0, keys: Sequence[str] = ()) -> DataFrame:
    """The keys, status and counts of problems, one row for each of their values in either list, or one row without keys.

    In this order: unknown if the other list is malformed (see `well_formed`) or has no anchor; fail if its newest anchor
    lies below the minimum, if it has an anchor that we do not have, or if any differs; unknown if it lacks one of ours,
    which may wait for publication; else pass.
    """
    kinds = ("ours_missing", "theirs_missing", "differs")
    found = differences(ours, theirs, interval, keys).groupBy(*keys).agg(*[F.count_if(F.col("problem") == x).alias(x) for x in kinds])
    anchor = F.col("sequence_id") % interval == 0
    order = well_formed(theirs, keys).groupBy(*keys).agg(F.count_if(~F.col("fit")).alias("malformed"), F.coalesce(F.max(F.when(anchor, F.col("sequence_id"))), F.lit(0)).alias("newest"))
    status = F.when((F.col("malformed") > 0) | (F.col("newest") == 0), "unknown").when((F.col("newest") < minimum) | (F.col("ours_missing") > 0) | (F.col("differs") > 0), "fail").when(F.col("theirs_missing") > 0, "unknown").otherwise("pass")
    if keys:
        each = ours.select(*keys).union(theirs.select(*keys)).distinct().alias("e")
        both = each.join(found.alias("f"), _matched("e", "f", keys), "left").join(order.alias("o"), _matched("e", "o", keys), "left")
        both = both.select(*[F.col(f"e.{k}").alias(k) for k in keys], *[F.coalesce(c, F.lit(0)).alias(c) for c in (*kinds, "malformed", "newest")])
    else:
        both = found.crossJoin(order)
    return both.select(*keys, status.alias("status"), *kinds)


def forks(statements: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Sequences, by the keys, for which different roots were stated."""
    return statements.groupBy(*keys, "sequence_id").agg(F.count_distinct("merkle_root").alias("roots")).where("roots > 1")


def quorum(statements: DataFrame, threshold: int, keys: Sequence[str] = (), origin_key: str | None = None) -> DataFrame:
    """The keys, sequence_id, status, valid (statements that count) of witness statements (witness, key_id, domain, valid).

    key_id and domain are what is configured for the witness, null where nothing is. fail: a witness without name or
    named twice, a configured key or custody domain that another statement has too (or the origin's own key), a
    signature that does not hold, or more than MOST_WITNESSES statements. Else unknown: trust that is not configured, or
    fewer than `threshold`. Domains are compared without case and outer spaces.
    """
    domain = F.nullif(F.lower(F.trim("domain")), F.lit(""))
    rows = statements.withColumn("_trusted", F.nullif("key_id", F.lit("")).isNotNull() & domain.isNotNull()).withColumn("_domain", domain)
    trusted = lambda c: F.when(F.col("_trusted"), F.col(c))
    rows = rows.groupBy(*keys, "sequence_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(F.nullif("witness", F.lit(""))).alias("names"), F.count_if("_trusted").alias("trusted"),
        F.count_distinct(trusted("key_id")).alias("key_ids"), F.count_distinct(trusted("_domain")).alias("domains"),
        F.count_if(F.col("_trusted") & F.coalesce("valid", F.lit(False))).alias("valid"), F.count_if(F.col("_trusted") & (F.col("key_id") == F.lit(origin_key))).alias("own"),
    )
    bad = (F.col("names") < F.col("n")) | (F.least("key_ids", "domains", "valid") < F.col("trusted")) | (F.col("own") > 0) | (F.col("n") > MOST_WITNESSES)
    status = F.when(bad, "fail").when((F.col("trusted") < F.col("n")) | (F.col("valid") < threshold), "unknown").otherwise("pass")
    return rows.select(*keys, "sequence_id", status.alias("status"), "valid")


def heads(ours: DataFrame, published: DataFrame, statements: DataFrame, threshold: int, minimum: int = 0, keys: Sequence[str] = (), origin_key: str | None = None) -> DataFrame:
    """The keys, status and the number of witnesses of each kind, one row for each of the keys' values that a statement has
    (one row without keys): independent witnesses' whole histories against ours.

    published: keys, witness and checkpoints (COMPARED); statements: keys, witness, prefix_digest, key_id, domain, valid of
    their heads. A witness disagrees if a place of its history differs from ours; it has too much, or it lags, or its digest
    is not that of our history, or it is current. Any that disagrees fails; else the quorum of the current ones decides, in
    which the origin's own key does not count, so missing or lagging witnesses leave it unknown. Below the minimum nothing is
    known.
    """
    a, b = placed(ours, keys).alias("a"), placed(published, [*keys, "witness"]).alias("b")
    same = F.lit(True)
    for f in COMPARED:
        same = same & F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}"))
    seen = b.join(a, _matched("a", "b", keys) & (F.col("a.place") == F.col("b.place")), "left")
    seen = seen.groupBy(*[F.col(f"b.{k}").alias(k) for k in (*keys, "witness")]).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("a.place").isNull()).alias("more"), F.count_if(F.col("a.place").isNotNull() & ~same).alias("other"))
    last = prefix_digests(ours, keys).groupBy(*keys).agg(F.max_by("prefix_digest", "checkpoint_id").alias("_digest"), F.count(F.lit(1)).alias("_all"), F.max("sequence_id").alias("_newest"))
    held = statements.alias("s").join(seen.alias("o"), _matched("s", "o", [*keys, "witness"]), "left").select("s.*", "n", "more", "other")
    held = held.alias("h").join(last.alias("l"), _matched("h", "l", keys), "left").select("h.*", "_digest", F.coalesce("_all", F.lit(0)).alias("_all"), F.coalesce("_newest", F.lit(0)).alias("_newest"))
    kind = F.when(F.col("more") > 0, "too_much").when(F.col("other") > 0, "disagrees").when(F.coalesce("n", F.lit(0)) < F.col("_all"), "lags").when(~F.col("prefix_digest").eqNullSafe(F.col("_digest")), "other_digest").otherwise("current")
    held = held.withColumn("kind", kind)
    kinds = ("disagrees", "too_much", "lags", "other_digest", "current")
    out = held.groupBy(*keys).agg(*[F.count_if(F.col("kind") == k).alias(k) for k in kinds], F.coalesce(F.max("_all"), F.lit(0)).alias("_all"), F.coalesce(F.max("_newest"), F.lit(0)).alias("_newest"))
    current = quorum(held.where("kind = 'current'").withColumn("sequence_id", F.col("_newest")), threshold, keys, origin_key).groupBy(*keys).agg(F.max("status").alias("_status"))
    out = out.alias("h").join(current.alias("q"), _matched("h", "q", keys), "left").select("h.*", "_status")
    status = F.when((F.col("_all") == 0) | (F.col("_newest") < minimum) | F.lit(threshold < 2), "unknown").when(F.col("disagrees") > 0, "fail").otherwise(F.coalesce("_status", F.lit("unknown")))
    return out.select(*keys, status.alias("status"), *kinds)


#: What a prefix is signed under: a label of this library.
PREFIX = "tidemark/checkpoint-prefix/1\n"


def prefix_digests(checkpoints: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Adds prefix_digest: SHA-256 of a label and the list, as JSON without spaces and with sorted names, of all fields that
    lists must agree on, of this checkpoint and all before it.

    A list is one stream of rows whose state is the digest so far, so any length fits; lists of different keys are
    independent. Null fields are written as null."""

    def step(state: tuple, row: tuple) -> tuple:
        digest, more = state
        digest.update((("," if more else "") + row[0]).encode())
        now = digest.copy()
        now.update(b"]")
        return (digest, True), (now.hexdigest(),)

    def start() -> tuple:
        return hashlib.sha256(f"{PREFIX}[".encode()), False

    rows = checkpoints.withColumn("_json", F.to_json(F.struct(*sorted(COMPARED)), {"ignoreNullFields": "false"}))
    return O.in_order(rows, keys, ["checkpoint_id"], ["_json"], "prefix_digest string", start, step).drop("_json")


def admission(existing: DataFrame, offered: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The keys, verdict, held and added (checkpoints) of whole lists that are offered to append-only stores, each of which
    takes a list only if it begins with all that the store holds.

    In this order: empty, without any checkpoint; shorter than what is held; invalid, if a checkpoint is not well formed or
    ids or sequences do not rise; changed, if any place that is held differs in any field; else accepted, with `added` new
    ones. A store with nothing takes any valid list. Stores that nothing is offered to have no row."""
    a, b = placed(existing, keys).alias("a"), well_formed(offered, keys).alias("b")
    same = F.lit(True)
    for f in COMPARED:
        same = same & F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}"))
    both = b.join(a, _matched("a", "b", keys) & (F.col("a.place") == F.col("b.place")), "left")
    offers = both.groupBy(*[F.col(f"b.{k}").alias(k) for k in keys]).agg(F.count(F.lit(1)).alias("_n"), F.count_if(~F.col("fit")).alias("_bad"), F.count_if(F.col("a.place").isNotNull() & ~same).alias("_other"))
    held = existing.groupBy(*keys).agg(F.count(F.lit(1)).alias("_held"))
    out = offers.alias("o").join(held.alias("h"), _matched("o", "h", keys), "left").select("o.*", F.coalesce("_held", F.lit(0)).alias("held"))
    verdict = F.when(F.col("_n") == 0, "empty").when(F.col("_n") < F.col("held"), "shorter").when(F.col("_bad") > 0, "invalid").when(F.col("_other") > 0, "changed").otherwise("accepted")
    return out.select(*keys, verdict.alias("verdict"), "held", F.when(verdict == "accepted", F.col("_n") - F.col("held")).otherwise(0).alias("added"))


def admitted(existing: DataFrame, offered: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The checkpoints that the stores take, with ordinal, their place in the store: those of accepted lists behind what is
    held. Writing these again changes the list and is refused."""
    taken = admission(existing, offered, keys).where("verdict = 'accepted'")
    rows = placed(offered, keys).drop("rising").withColumnRenamed("place", "ordinal")
    return rows.alias("o").join(taken.alias("t"), _matched("o", "t", keys)).where("ordinal > held").select("o.*")
