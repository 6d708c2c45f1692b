"""Evidence bundles: the ledger's rows as ordered JSON lines beside checkpoints and a manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import secrets as S
from tidemark.operators import chain as CH
from tidemark.operators import search

#: The most rows of a bundle.
MOST_EVENTS, MOST_CHECKPOINTS = 50_000, 10_000


class TooLarge(ValueError):
    """The ledger has more rows than a bundle may hold."""


def write(chain: DataFrame, checkpoints: DataFrame, path: str, seed: bytes | None = None) -> None:
    """events/, checkpoints/ and manifest/ under path, the manifest signed if there is a seed. Fails beyond the caps
    rather than cutting rows off."""
    for df, most in ((chain, MOST_EVENTS), (checkpoints, MOST_CHECKPOINTS)):
        if df.limit(most + 1).count() > most:
            raise TooLarge(f"more than {most} rows")
    chain.repartitionByRange("sequence_id").sortWithinPartitions("sequence_id").write.json(f"{path}/events")
    checkpoints.write.json(f"{path}/checkpoints")
    digest = chain.agg(F.count(F.lit(1)).alias("events"), F.max_by("entry_hash", "chain_seq").alias("tail_hash"))
    digest = digest.withColumn("signature_hex", S.signature(_signed(), seed) if seed is not None else F.lit(None).cast("string"))
    digest.write.json(f"{path}/manifest")


def _signed() -> Column:
    return F.concat_ws(":", F.col("events").cast("string"), F.col("tail_hash"))


def verify(spark: SparkSession, path: str, public_hex: str | None = None) -> DataFrame:
    """One row, status: SUCCESS, HASH_BREAK, SEQUENCE_GAP, SIGNATURE_INVALID or MALFORMED_BUNDLE. The first row may start
    anywhere. With a public key the manifest must be signed by it."""
    try:
        schema = "sequence_id long, actor_user_id int, action string, table_name string, row_id int, old_value_text string, new_value_text string, created_at_text string, chain_seq long, previous_hash string, entry_hash string"
        events = spark.read.schema(schema).json(f"{path}/events")
        manifest = spark.read.schema("events long, tail_hash string, signature_hex string").json(f"{path}/manifest")
        rows = CH.links(events, (), seed=None)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.range(1).select(F.lit("MALFORMED_BUNDLE").alias("status"))
    forged = ~S.signature_valid(F.unhex(F.lit(public_hex)), _signed(), F.unhex("signature_hex")) if public_hex else F.lit(False)
    seen = rows.agg(F.count_if(F.col("mismatch") | F.col("orphan")).alias("breaks"), F.count_if(F.col("gap")).alias("gaps"), F.count(F.lit(1)).alias("n"), F.max_by("entry_hash", "chain_seq").alias("tail"), F.count_if(F.col("entry_hash").isNull()).alias("bad"))
    status = F.when((F.col("bad") > 0) | F.col("events").isNull(), "MALFORMED_BUNDLE").when(F.col("forged"), "SIGNATURE_INVALID").when(F.col("gaps") > 0, "SEQUENCE_GAP").when((F.col("breaks") > 0) | ~F.col("tail").eqNullSafe(F.col("tail_hash")) | (F.col("n") != F.col("events")), "HASH_BREAK").otherwise("SUCCESS")
    return seen.crossJoin(manifest.withColumn("forged", forged)).select(status.alias("status"))


def export(chain: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """Rows as JSON with sorted fields, whole payloads and, with users, the actor's name: sequence_id, line, line_hash."""
    if users is not None:
        chain = search.with_actor(chain, users)
    line = F.to_json(F.struct(*sorted(chain.columns)), {"ignoreNullFields": "false"})
    return chain.select("sequence_id", line.alias("line")).withColumn("line_hash", F.sha2("line", 256))


def write_export(chain: DataFrame, users: DataFrame, path: str, seed: bytes) -> None:
    """lines/, in order of sequence, and seal/: rows, the digest of all line digests in order, and its signature. Fails
    beyond the cap, which bounds what the digest's one group holds."""
    if chain.limit(MOST_EVENTS + 1).count() > MOST_EVENTS:
        raise TooLarge(f"more than {MOST_EVENTS} rows")
    lines = export(chain, users)
    lines.repartitionByRange("sequence_id").sortWithinPartitions("sequence_id").select("line").write.text(f"{path}/lines")
    export_seal(lines).withColumn("signature_hex", S.signature(F.col("digest"), seed)).write.json(f"{path}/seal")


def export_seal(lines: DataFrame) -> DataFrame:
    """rows, digest: SHA-256 of the line digests joined in order of sequence."""
    in_order = F.array_sort(F.collect_list(F.struct("sequence_id", "line_hash")))
    return lines.agg(F.count(F.lit(1)).alias("rows"), F.sha2(F.array_join(F.transform(in_order, lambda x: x["line_hash"]), ""), 256).alias("digest"))
