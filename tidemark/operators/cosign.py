"""Witness signatures on whole checkpoint lists, verified with registered keys and then counted towards a quorum."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import secrets as S
from tidemark.operators import trust
from tidemark.sources import shared

#: What a statement is signed under: a label of this library. The signed bytes are it and the hex digest of the list, which
#: covers every field of every checkpoint (`trust.prefix_digests`).
STATEMENT = "tidemark/witness-statement/1\n"
VERDICTS = ("verified", "malformed", "untrusted", "counted", "invalid", "too_many")


def message(digest: Column) -> Column:
    return F.concat(F.lit(STATEMENT), digest)


def newest(checkpoints: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The keys and prefix_digest of each whole list: of its last checkpoint."""
    return trust.prefix_digests(checkpoints, keys).groupBy(*keys).agg(F.max_by("prefix_digest", "checkpoint_id").alias("prefix_digest"))


def _registered(registry: DataFrame) -> DataFrame:
    """One row a witness: lower-case key and domain without outer spaces, null where they are blank or the witness is
    registered twice, so that neither entry is trusted."""
    clean = [F.nullif(F.lower(F.trim(c)), F.lit("")).alias(c) for c in ("public_key", "domain")]
    rows = registry.where("witness IS NOT NULL").select(F.col("witness").alias("_name"), *clean)
    once = F.count(F.lit(1)) == 1
    return rows.groupBy("_name").agg(*[F.when(once, F.first(c)).alias(c) for c in ("public_key", "domain")])


def _fold(rows: Column, origin_key: str) -> Column:
    """Verdicts of at most MOST_WITNESSES statements in order: what is verified uses up its key and its domain."""
    texts = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    has = lambda seen, x: F.coalesce(F.array_contains(seen, x), F.lit(False))
    start = F.struct(texts().alias("names"), texts(origin_key.lower()).alias("used"), texts().alias("domains"), texts().alias("verdicts"))

    def step(s: Column, r: Column) -> Column:
        bad = F.coalesce(r["witness"], F.lit("")) == ""
        verdict = F.when(bad | has(s["names"], r["witness"]) | r["signature_hex"].isNull(), "malformed").when(r["public_key"].isNull() | r["domain"].isNull(), "untrusted")
        verdict = verdict.when(has(s["used"], r["public_key"]) | has(s["domains"], r["domain"]), "counted").when(r["valid"], "verified").otherwise("invalid")
        more = lambda seen, x, when: F.when(when, F.array_append(seen, x)).otherwise(seen)
        holds = verdict == "verified"
        return F.struct(more(s["names"], r["witness"], ~bad).alias("names"), more(s["used"], r["public_key"], holds).alias("used"), more(s["domains"], r["domain"], holds).alias("domains"), F.array_append(s["verdicts"], verdict).alias("verdicts"))

    return F.aggregate(rows, start, step, lambda s: s["verdicts"])


def verdicts(heads: DataFrame, statements: DataFrame, registry: DataFrame, origin_key: str, keys: Sequence[str] = ()) -> DataFrame:
    """The keys, place, witness, verdict of every statement.

    heads: keys, prefix_digest. statements: keys, place (their order in a list, each its own), witness, signature_hex.
    registry: witness, public_key (hex), domain. In this order: too_many, where a list has more than MOST_WITNESSES, of which
    none is verified; malformed, without a name, with one that the list had before, or without a signature; untrusted, if no
    key or domain is registered; counted, if the key is the origin's or one that is verified already, or the domain is;
    invalid, if the signature does not hold for the list (also where there is no such list); else verified.
    """
    rows = statements.select(*keys, "place", "witness", "signature_hex")
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    rows = rows.alias("r").join(sizes.alias("n"), trust._matched("r", "n", keys)).select("r.*", "_n")
    many = rows.where(F.col("_n") > trust.MOST_WITNESSES).select(*keys, "place", "witness", F.lit("too_many").alias("verdict"))
    rows = rows.where(F.col("_n") <= trust.MOST_WITNESSES).join(_registered(registry), F.col("witness") == F.col("_name"), "left").drop("_name", "_n")
    rows = rows.alias("r").join(heads.alias("h"), trust._matched("r", "h", keys), "left").select("r.*", "prefix_digest")
    # Only what names a registered key is verified: null gives false without a check.
    rows = shared.spread(rows, *keys, "place")
    valid = S.signature_valid(F.unhex("public_key"), message(F.col("prefix_digest")), F.unhex("signature_hex"))
    rows = rows.withColumn("valid", valid)
    each = F.struct("place", "witness", "signature_hex", "public_key", "domain", "valid")
    lists = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(each)).alias("_rows"))
    told = lists.select(*keys, F.explode(F.arrays_zip("_rows", _fold(F.col("_rows"), origin_key).alias("verdict"))).alias("x"))
    return told.select(*keys, F.col("x._rows.place").alias("place"), F.col("x._rows.witness").alias("witness"), F.col("x.verdict").alias("verdict")).unionByName(many)


def quorum(heads: DataFrame, statements: DataFrame, registry: DataFrame, threshold: int, origin_key: str, keys: Sequence[str] = ()) -> DataFrame:
    """The keys, status, total and valid (statements) of every list: fail if a statement is too_many, malformed, counted or
    invalid; unknown if there is no statement, one is untrusted, or fewer than `threshold` are verified; else pass."""
    found = verdicts(heads, statements, registry, origin_key, keys)
    counts = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS])
    out = heads.alias("h").join(counts.alias("c"), trust._matched("h", "c", keys), "left")
    named = [F.col(f"h.{k}").alias(k) for k in keys]
    bad = F.col("malformed") + F.col("counted") + F.col("invalid") + F.col("too_many")
    status = F.when(bad > 0, "fail").when((F.col("untrusted") > 0) | (F.coalesce("verified", F.lit(0)) < threshold) | F.col("total").isNull(), "unknown").otherwise("pass")
    return out.select(*named, status.alias("status"), F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("verified", F.lit(0)).alias("valid"))
