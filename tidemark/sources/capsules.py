"""Evidence capsules: a ledger row with the Merkle proof that its checkpoint holds it, to be checked without the ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import secrets as S
from tidemark.functions import text as X
from tidemark.operators import chain as CH
from tidemark.operators import checkpoints as K
from tidemark.operators import sealed as SE
from tidemark.sources import shared

ROW = ("sequence_id", "actor_user_id", "action", "table_name", "row_id", "old_value_text", "new_value_text", "created_at_text")
#: What a later attestation of an older checkpoint is signed under: a label of this library.
ATTESTED = "tidemark/capsule/root-attested-later/1"
_SCHEMA = "employee_id int, chain_seq long, sequence_id long, actor_user_id int, action string, table_name string, row_id int, old_value_text string, new_value_text string, created_at_text string, status string, checkpoint long, first_seq long, last_seq long, digest string, merkle_root string, signature_hex string, key_id string, leaf string, path array<string>, proof_root string, attestation_hex string"


def capsules(chain: DataFrame, sealed: DataFrame, asked: DataFrame | None = None, seed: bytes | None = None, public_hex: str | None = None, payload: bool = True) -> DataFrame:
    """One capsule for each row of the chain that is asked for (sequence_id), or for all rows.

    sealed: signed checkpoints, however far apart. status: ok; uncheckpointed, in the tail behind the last checkpoint;
    before_merkle, whose checkpoint has no root; not_found, for an asked sequence that the ledger lacks. With a seed a
    capsule of such an older checkpoint gets an attestation instead (status attested), provided that the chain up to it
    is whole, its digest is that of its rows, and its own signature holds for public_hex.

    Without `payload` only sequence_id of a row comes back, not the rest of ROW, and paths are exchanged with nothing.
    """
    # Read twice here and once more for each attestation.
    sealed = shared.stored(sealed.select("employee_id", "checkpoint", "first_seq", "last_seq", "digest", "merkle_root", "signature_hex", "key_id"), "sealed")
    shared.free_shuffles(chain.sparkSession)
    named = None if asked is None else asked.select("sequence_id").distinct()
    held = sealed.select(F.col("last_seq").cast("long").alias("sealed_at"), *[c for c in sealed.columns if c != "merkle_root"], F.col("merkle_root").alias("_root"))
    # Rows behind the last checkpoint have a leaf and a path among themselves, though nothing vouches for them.
    out = SE.proofs_of(SE.hashed(chain, more=["sequence_id"]), sealed, asked=None if named is None else named.where("sequence_id IS NOT NULL"), held=held, tails=True)
    out = out.withColumnsRenamed({"hash": "leaf", "merkle_root": "proof_root"}).withColumnRenamed("_root", "merkle_root")
    out = out.withColumn("last_seq", F.col("sealed_at"))
    if payload:
        rows = chain.select("employee_id", "chain_seq", *[c for c in ROW if c != "sequence_id"])
        out = SE.joined(out, rows, ["employee_id", "chain_seq"])
    else:
        out = out.withColumns({c.split(" ")[0]: F.lit(None).cast(c.split(" ")[1]) for c in _SCHEMA.split(", ") if c.split(" ")[0] in ROW and c.split(" ")[0] != "sequence_id"})
    out = out.withColumn("status", K.capsule_status(F.lit(True), F.when(F.col("checkpoint").isNotNull(), F.col("last_seq")), F.col("merkle_root")))
    if seed is not None:
        out = _attested(out, chain, sealed, seed, public_hex)
    else:
        out = out.withColumn("attestation_hex", F.lit(None).cast("string"))
    if asked is not None:
        missing = named.join(chain.select("sequence_id"), "sequence_id", "left_anti").withColumn("status", F.lit("not_found"))
        out = out.unionByName(missing, allowMissingColumns=True)
    return out.selectExpr(*[f"cast({x.rsplit(' ', 1)[0]} as {x.rsplit(' ', 1)[1]}) as {x.rsplit(' ', 1)[0]}" for x in _SCHEMA.split(", ")])


def attestation(prefix: str = "") -> Column:
    """What is signed for an older checkpoint: its place, digest and the root worked out now."""
    return F.concat_ws("|", F.lit(ATTESTED), *[F.col(prefix + c).cast("string") for c in ("employee_id", "checkpoint", "first_seq", "last_seq", "digest", "proof_root")])


def _attested(out: DataFrame, chain: DataFrame, sealed: DataFrame, seed: bytes, public_hex: str | None) -> DataFrame:
    whole = CH.report(chain).select("employee_id", F.col("last_verified").alias("_whole"))
    now = SE.digests(SE.leaves(chain, sealed)).select("employee_id", F.col("sealed_at").alias("last_seq"), F.col("digest").alias("_digest"))
    old = out.where("status = 'before_merkle'").select("employee_id", "checkpoint", "first_seq", "last_seq", "digest", "proof_root", "signature_hex").distinct()
    old = old.join(whole, "employee_id").join(now, ["employee_id", "last_seq"])
    fit = (F.col("_whole") >= F.col("last_seq")) & (F.col("_digest") == F.col("digest")) & S.signature_valid(F.unhex(F.lit(public_hex)), F.col("digest"), F.unhex("signature_hex"))
    made = old.where(fit).select("employee_id", "checkpoint", S.signature(attestation(), seed).alias("attestation_hex"))
    out = out.join(made, ["employee_id", "checkpoint"], "left")
    return out.withColumn("attestation_hex", F.when(F.col("status") == "before_merkle", F.col("attestation_hex"))).withColumn("status", F.when(F.col("attestation_hex").isNotNull(), "attested").otherwise(F.col("status")))


def write(made: DataFrame, path: str) -> None:
    """Capsules that prove something, a line of JSON each."""
    made.where(F.col("status").isin("ok", "attested")).write.json(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Capsules of a path; a line that is none has nulls alone, and `verified` calls it MALFORMED."""
    return spark.read.schema(_SCHEMA).json(path)


def verified(made: DataFrame, public_hex: str) -> DataFrame:
    """Adds verdict: VALID, or the first check that fails: MALFORMED, SIGNATURE_INVALID, LEAF_MISMATCH, ROOT_MISMATCH, PLACE_MISMATCH
    (the path is not that of the row's place between first_seq and last_seq).

    public_hex is a key that the reader trusts already; nothing in a capsule vouches for itself.
    """
    needed = ("sequence_id", "chain_seq", "checkpoint", "first_seq", "last_seq", "digest", "signature_hex", "leaf", "path", "proof_root")
    whole = F.lit(True)
    for c in needed:
        whole = whole & F.col(c).isNotNull()
    public = F.unhex(F.lit(public_hex))
    own = S.signature_valid(public, K.sealed_payload(F.col("digest"), F.col("merkle_root")), F.unhex("signature_hex"))
    later = S.signature_valid(public, attestation(), F.unhex("attestation_hex"))
    signed = own & (F.col("merkle_root").isNotNull() | later)
    root = F.coalesce("merkle_root", "proof_root")
    verdict = F.when(~whole, "MALFORMED").when(~signed, "SIGNATURE_INVALID").when(K.leaf(X.serialised()) != F.col("leaf"), "LEAF_MISMATCH").when(K.proved_root(F.col("leaf"), F.col("path")) != root, "ROOT_MISMATCH").when(~SE.placed(F.col("path"), F.col("chain_seq") - F.col("first_seq"), F.col("last_seq") - F.col("first_seq") + 1), "PLACE_MISMATCH").otherwise("VALID")
    return made.withColumn("verdict", verdict)
