"""Checkpoint lists before witnesses: whole prefixes digested, admitted and compared, a list for every employee."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import secrets as S
from tidemark.operators import checkpoints as K
from tidemark.operators import cosign, trust
from tidemark.plans.catalogue import _LISTS, CHAIN, INTERVAL, _chain, _lists, _sealed, query
from tidemark.sources import shared

KEYS = ["employee_id"]
_JSON = """'{"checkpoint_hash":"' || digest || '","checkpoint_id":' || checkpoint_id || ',"key_id":"k1","merkle_root":"' || merkle_root || '","sequence_id":' || sequence_id || ',"signature_hex":"' || signature || '"}'"""
_LABEL = f"'{trust.PREFIX.strip()}' || chr(10) || '['"


@query(_LISTS + f" select employee_id, checkpoint_id, sha256({_LABEL} || string_agg({_JSON}, ',') over (partition by employee_id order by checkpoint_id) || ']') as prefix_digest from theirs")
def prefix_digests(spark, sf_dir):
    """The digest of every prefix of every published list."""
    return trust.prefix_digests(_lists(spark, sf_dir)[1], KEYS).select("employee_id", "checkpoint_id", "prefix_digest")


_OFFERED = _LISTS + """, held as (select employee_id, count(*) as held from ours group by 1),
offers as (select b.employee_id, count(*) as n, count(*) filter (not regexp_full_match(b.signature, '[0-9a-f]{128}')) as bad, count(*) filter (a.place is not null and (a.checkpoint_id, a.sequence_id, a.digest, a.merkle_root, a.signature) <> (b.checkpoint_id, b.sequence_id, b.digest, b.merkle_root, b.signature)) as other
  from b left join a on a.employee_id = b.employee_id and a.place = b.place group by 1),
judged as (select employee_id, n, coalesce(held, 0) as held, case when n < coalesce(held, 0) then 'shorter' when bad > 0 then 'invalid' when other > 0 then 'changed' else 'accepted' end as verdict from offers left join held using (employee_id))"""


@query(_OFFERED + " select employee_id, verdict, held, case when verdict = 'accepted' then n - held else 0 end as added from judged")
def prefix_admission(spark, sf_dir):
    """Lists that are offered to a store which holds others: as they are, changed, cut, longer or malformed."""
    return trust.admission(*_lists(spark, sf_dir), KEYS)


@query(_OFFERED + " select b.employee_id, checkpoint_id, place as ordinal from b join judged j on j.employee_id = b.employee_id where verdict = 'accepted' and place > held")
def prefix_additions(spark, sf_dir):
    """The checkpoints that the stores take."""
    return trust.admitted(*_lists(spark, sf_dir), KEYS).select("employee_id", "checkpoint_id", "ordinal")


#: Which witnesses there are, and whose key they sign with.
_THERE = "NOT (witness = 'other' AND employee_id % 2 = 0) AND NOT (witness = 'long' AND employee_id % 3 > 0) AND NOT (witness = 'a' AND employee_id % 7 = 2)"
_KEY = "CASE WHEN witness = 'b' AND employee_id % 5 = 1 THEN 'origin' ELSE 'key ' || witness END"
WITNESSES = ("a", "b", "odd", "other", "late", "long")


@query(CHAIN + ", " + _sealed("chain") + f""",
ours as (select employee_id, checkpoint + 1 as checkpoint_id, last_seq as sequence_id, digest, merkle_root, max(checkpoint + 1) over (partition by employee_id) as top, row_number() over (partition by employee_id order by checkpoint) as place, count(*) over (partition by employee_id) as n_all from sealed),
stated as (select * from (select distinct employee_id, n_all, unnest({list(WITNESSES)}) as witness from ours) where {_THERE}),
pub as (select o.employee_id, witness, checkpoint_id, sequence_id, digest, case when witness = 'other' and checkpoint_id = top then repeat('0', 64) else merkle_root end as merkle_root from ours o join stated using (employee_id) where not (witness = 'late' and checkpoint_id = top)
  union all select o.employee_id, witness, checkpoint_id + 1, sequence_id + 1, digest, merkle_root from ours o join stated using (employee_id) where witness = 'long' and checkpoint_id = top),
p as (select *, row_number() over (partition by employee_id, witness order by checkpoint_id) as place from pub),
seen as (select p.employee_id, witness, count(*) as n, count(*) filter (o.place is null) as more, count(*) filter ((o.checkpoint_id, o.sequence_id, o.digest, o.merkle_root) <> (p.checkpoint_id, p.sequence_id, p.digest, p.merkle_root)) as other from p left join ours o on o.employee_id = p.employee_id and o.place = p.place group by 1, 2),
kinds as (select s.employee_id, s.witness, {_KEY.replace('employee_id', 's.employee_id').replace("witness", "s.witness")} as key_id, case when more > 0 then 'too_much' when other > 0 then 'disagrees' when coalesce(n, 0) < n_all then 'lags' when s.witness = 'odd' then 'other_digest' else 'current' end as kind from stated s left join seen using (employee_id, witness)),
counts as (select employee_id, count(*) filter (kind = 'disagrees') as disagrees, count(*) filter (kind = 'too_much') as too_much, count(*) filter (kind = 'lags') as lags, count(*) filter (kind = 'other_digest') as other_digest, count(*) filter (kind = 'current') as current, bool_or(kind = 'current' and key_id = 'origin') as own from kinds group by 1)
select employee_id, case when disagrees > 0 or (current > 0 and own) then 'fail' when current < 2 then 'unknown' else 'pass' end as status, disagrees, too_much, lags, other_digest, current from counts""")
def witness_heads(spark, sf_dir):
    """Every employee's checkpoints before up to six witnesses: with all of them, another digest, another last root, one
    checkpoint fewer, one more, or the origin's own key."""
    sealed = K.fixed(_chain(spark, sf_dir), INTERVAL)
    ours = sealed.select("employee_id", (F.col("checkpoint") + 1).alias("checkpoint_id"), F.col("last_seq").alias("sequence_id"), F.col("digest").alias("checkpoint_hash"), "merkle_root", F.concat("digest", "merkle_root").alias("signature_hex"), F.lit("k1").alias("key_id"))
    # The chain is built once, not for each place that reads the list.
    ours = shared.stored(ours, "ours")
    tops = ours.groupBy("employee_id").agg(F.max("checkpoint_id").alias("_top"))
    each = F.explode(F.array(*map(F.lit, WITNESSES))).alias("witness")
    rows = ours.join(tops, "employee_id").select("*", each).where(_THERE)
    at_top = F.col("checkpoint_id") == F.col("_top")
    kept = rows.where(~((F.col("witness") == "late") & at_top)).withColumn("merkle_root", F.when((F.col("witness") == "other") & at_top, F.lit("0" * 64)).otherwise(F.col("merkle_root")))
    more = rows.where((F.col("witness") == "long") & at_top).withColumns({"checkpoint_id": F.col("checkpoint_id") + 1, "sequence_id": F.col("sequence_id") + 1})
    return trust.heads(ours, kept.unionByName(more).drop("_top"), _said(ours), 2, keys=KEYS, origin_key="origin")


def _said(ours: DataFrame) -> DataFrame:
    """What each witness says of its head: the digest of our list, written out in one piece."""
    row = F.to_json(F.struct(*sorted(trust.COMPARED)))
    lists = ours.groupBy("employee_id").agg(F.array_sort(F.collect_list(F.struct("checkpoint_id", row.alias("j")))).alias("_rows"))
    digest = F.sha2(F.concat(F.lit(trust.PREFIX + "["), F.array_join("_rows.j", ","), F.lit("]")), 256)
    said = lists.select("employee_id", F.explode(F.array(*map(F.lit, WITNESSES))).alias("witness"), digest.alias("_digest")).where(_THERE)
    return said.select("employee_id", "witness", F.when(F.col("witness") == "odd", "x").otherwise(F.col("_digest")).alias("prefix_digest"), F.expr(_KEY).alias("key_id"), F.concat(F.lit("at "), "witness").alias("domain"), F.lit(True).alias("valid"))


#: Who signs with which seed, and what is registered: d has no domain, e has the key of a.
SEEDS = {"a": b"a" * 32, "b": b"b" * 32, "c": b"c" * 32, "d": b"d" * 32, "e": b"a" * 32}
DOMAINS = {"a": "Alpha", "b": "beta ", "c": "gamma", "d": " ", "e": "epsilon"}
#: Which statements there are, what name they bear, and whether they sign the list as it is or an older digest.
_SIGNS = "case signer when 'a' then true when 'b' then employee_id % 5 <> 4 when 'c' then employee_id % 5 in (0, 2) when 'd' then employee_id % 5 = 3 else employee_id % 7 = 3 end"
_NAMED = "case when signer = 'c' and employee_id % 5 = 2 then 'a' else signer end"
_STALE = "signer = 'b' and employee_id % 5 = 1"

_COSIGNED = CHAIN + ", " + _sealed("chain") + f""",
signed as (select employee_id, checkpoint + 1 as checkpoint_id, last_seq as sequence_id, digest, merkle_root, digest || merkle_root as signature from sealed),
heads as (select employee_id, sha256({_LABEL} || string_agg({_JSON}, ',' order by checkpoint_id) || ']') as prefix_digest from signed group by 1),
registry as (select unnest({list(SEEDS)}) as witness, unnest({[s[:1].decode() for s in SEEDS.values()]}) as held_key, nullif(lower(trim(unnest({list(DOMAINS.values())}))), '') as domain),
said as (select *, {_NAMED} as witness, case when {_STALE} then 'older' else prefix_digest end as over from (select *, unnest({list(SEEDS)}) as signer, unnest(range(1, {len(SEEDS)} + 1)) as place from heads) where {_SIGNS}),
checked as (select s.employee_id, s.place, s.witness, r.held_key, r.domain, over = prefix_digest and o.held_key = r.held_key as valid, row_number() over (partition by s.employee_id, s.witness order by place) > 1 as again
  from said s left join registry r on r.witness = s.witness join registry o on o.witness = s.signer),
verdicts as (select *, case when again then 'malformed' when domain is null then 'untrusted'
  when exists (select 1 from checked e where e.employee_id = c.employee_id and e.place < c.place and e.valid and not e.again and e.domain is not null and (e.held_key = c.held_key or e.domain = c.domain)) then 'counted'
  when valid then 'verified' else 'invalid' end as verdict from checked c)"""


def _cosigned(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    sealed = K.fixed(_chain(spark, sf_dir), INTERVAL)
    ours = sealed.select("employee_id", (F.col("checkpoint") + 1).alias("checkpoint_id"), F.col("last_seq").alias("sequence_id"), F.col("digest").alias("checkpoint_hash"), "merkle_root", F.concat("digest", "merkle_root").alias("signature_hex"), F.lit("k1").alias("key_id"))
    # As many files as tasks, so that those who sign share the lists.
    heads = shared.stored(shared.spread(cosign.newest(ours, KEYS), *KEYS), "heads")
    said = None
    for place, (signer, seed) in enumerate(SEEDS.items(), 1):
        rows = heads.select("*", F.lit(place).alias("place"), F.lit(signer).alias("signer")).where(_SIGNS)
        over = F.when(F.expr(_STALE), "older").otherwise(F.col("prefix_digest"))
        rows = rows.select("employee_id", "place", F.expr(_NAMED).alias("witness"), S.signature(cosign.message(over), seed).alias("signature_hex"))
        said = rows if said is None else said.unionByName(rows)
    registry = spark.createDataFrame([(w, S.ed25519_public(SEEDS[w]).hex(), DOMAINS[w]) for w in SEEDS], "witness string, public_key string, domain string")
    return heads, said, registry


@query(_COSIGNED + " select employee_id, place, witness, verdict from verdicts")
def witness_statements(spark, sf_dir):
    """Signed statements of up to five witnesses on every employee's list: good ones, a stale one, a name that repeats, one
    whose domain is not registered, one with a key that counts already."""
    return cosign.verdicts(*_cosigned(spark, sf_dir), S.ed25519_public(b"o" * 32).hex(), KEYS)


@query(_COSIGNED + " select employee_id, case when bool_or(verdict in ('malformed', 'counted', 'invalid')) then 'fail' when bool_or(verdict = 'untrusted') or count(*) filter (verdict = 'verified') < 2 then 'unknown' else 'pass' end as status, count(*) as total, count(*) filter (verdict = 'verified') as valid from verdicts group by 1")
def witness_signed_quorum(spark, sf_dir):
    """Whether two independent witnesses have signed every employee's list, by signatures that are verified."""
    return cosign.quorum(*_cosigned(spark, sf_dir), 2, S.ed25519_public(b"o" * 32).hex(), KEYS)
