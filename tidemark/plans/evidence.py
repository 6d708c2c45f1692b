"""More ledger queries: redaction and masks, checkpoint scans, signatures, capsules, reviews, lists, streams of seals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import secrets as S
from tidemark.functions import text as X
from tidemark.operators import chain as CH
from tidemark.operators import checkpoints as K
from tidemark.operators import detect, replay, rules, search
from tidemark.plans import catalogue as Q
from tidemark.plans.catalogue import BAD, CHAIN, INTERVAL, query
from tidemark.sources import bundle, capsules, shared
from tidemark.sources import derived as D
from tidemark.streaming import jobs, monitor

#: A seed for examples: not a secret.
SEED = bytes(range(32))
PUBLIC = S.ed25519_public(SEED).hex()
_SEALED = CHAIN + ", " + Q._sealed("chain")


# Payloads.


_NESTED = "concat('{\"Person\": {\"EMAIL\": \"e', sequence_id, '@x.org\", \"role\": ', actor_user_id, ', \"pay\": [{\"salary\": ', row_id, ', \"note\": \"n', row_id, '\"}]}, \"Full_Name\": [1, 2], \"kept\": \"', action, '\"}')"


@query(D.with_sql("ledger") + " select sequence_id, '[REDACTED]' as email, actor_user_id::varchar as role, '[REDACTED]' as salary, 'n' || row_id as note, '[REDACTED]' as full_name, action as kept from ledger")
def ledger_redacted_nested(spark, sf_dir):
    """Payloads with sensitive keys inside objects and lists."""
    shown = D.ledger(spark, sf_dir).select("sequence_id", X.redacted_json(F.expr(_NESTED)).alias("shown"))
    paths = {"email": "$.Person.EMAIL", "role": "$.Person.role", "salary": "$.Person.pay[0].salary", "note": "$.Person.pay[0].note", "full_name": "$.Full_Name", "kept": "$.kept"}
    return shown.select("sequence_id", *[F.get_json_object("shown", p).alias(n) for n, p in paths.items()])


@query(D.with_sql("ledger") + """, m as (select sequence_id, case when sequence_id % 2 = 0 then sha256('s' || employee_id) when action = 'DELETE' then sha256('B' || employee_id) when sequence_id % 3 = 0 then (case when sequence_id % 5 = 0 then 'old' end) else sha256('N' || employee_id) end as i from ledger)
select sequence_id, '{"contact_info_encrypted":"[REDACTED]","full_name":"x",' || coalesce('"national_id_blind_index":"' || i || '",', '') || '"national_id_encrypted":"[REDACTED]"}' as written from m""")
def write_mask(spark, sf_dir):
    """What may be written of payloads with an identity number in clear, redacted already, or as bytes in an envelope."""
    rows = D.ledger(spark, sf_dir)
    clear = F.when(F.col("sequence_id") % 3 == 0, X.REDACTED).when(F.col("action") != "DELETE", F.concat(F.lit("N"), F.col("employee_id").cast("string")))
    envelope = F.when(F.col("action") == "DELETE", F.concat(F.lit(r"\x"), F.hex(F.concat(F.lit("B"), F.col("employee_id").cast("string")))))
    values = {"full_name": F.lit("x"), "contact_info": F.lit("c"), "national_id": clear, "national_id_encrypted": envelope, "national_id_blind_index": F.when(F.col("sequence_id") % 5 == 0, "old")}
    payload = F.map_filter(F.create_map(*[y for k, v in values.items() for y in (F.lit(k), v)]), lambda _, v: v.isNotNull())
    supplied = F.when(F.col("sequence_id") % 2 == 0, F.sha2(F.concat(F.lit("s"), F.col("employee_id").cast("string")), 256)).otherwise("no index")
    derived = F.sha2(X.raw_identity(payload), 256)
    return rows.select("sequence_id", X.sorted_json(X.masked_payload(payload, supplied, derived)).alias("written"))


_EDGES = "case when action = 'UPDATE' and sequence_id % 11 = 0 then null when action <> 'DELETE' and sequence_id % 13 = 0 then '{}' else new_value_text end"


@query(D.with_sql("ledger") + f""", e as (select * replace ({_EDGES} as new_value_text) from ledger where table_name = 'employees'),
r as (select employee_id, max(sequence_id) as last_at, arg_max(action, sequence_id) as what from e where action <> 'UPDATE' or new_value_text is null group by 1),
live as (select e.* from e left join r using (employee_id) where new_value_text is not null and (last_at is null or sequence_id > last_at or (sequence_id = last_at and what = 'INSERT'))),
x as (select employee_id, sequence_id, new_value_text, unnest(json_keys(new_value_text)) as key from live),
v as (select employee_id, key, arg_max_null(json_extract_string(new_value_text, '$.' || key), sequence_id) as value from x group by 1, 2)
select employee_id, count(key)::int as n_keys, coalesce(string_agg(key || '=' || coalesce(value, 'null'), ',' order by key), '') as state from (select distinct employee_id from live) left join v using (employee_id) group by 1""")
def state_documents(spark, sf_dir):
    """Every employee's state as one row, over a ledger with updates without payload, which clear it, and empty ones."""
    rows = D.ledger(spark, sf_dir).withColumn("new_value_text", F.expr(_EDGES))
    out = replay.documents(rows, F.lit(True))
    shown = F.array_join(F.transform(F.map_entries("state"), lambda x: F.concat(x["key"], F.lit("="), F.coalesce(x["value"], F.lit("null")))), ",")
    return out.select("employee_id", F.size("state").alias("n_keys"), shown.alias("state"))


@query("select c_custkey, case c_custkey % 3 when 0 then 'ok' when 1 then 'ok' else 'plain' end as status, case when c_custkey % 3 = 0 then c_name end as value from customer")
def pii_envelope(spark, sf_dir):
    """Names sealed and opened again; a third are opened as another field, a third are no envelopes."""
    key = F.lit(bytes(range(32)))
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name")
    data = F.when(F.col("c_custkey") % 3 == 2, F.col("c_name").cast("binary")).otherwise(S.sealed(F.col("c_name"), "national_id", key))
    rows = rows.withColumn("data", data)
    value = F.when(F.col("c_custkey") % 3 == 1, S.opened(F.col("data"), "contact_info", key)).otherwise(S.opened(F.col("data"), "national_id", key))
    return rows.select("c_custkey", S.envelope_status(F.col("data")).alias("status"), value.alias("value"))


@query("select user_id, count(*) as iterations, 1e9 * count(*) / 1.2e9 as seconds from events group by 1")
def work_factor(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").agg(F.count(F.lit(1)).alias("iterations"))
    return rows.withColumn("seconds", X.projected_seconds(F.col("iterations")))


# Chains.


_NULLABLE = "case when employee_id % 7 = 3 then null else employee_id end"
_NULL_CHAIN = D.with_sql("ledger") + f""",
placed as (select * replace ({_NULLABLE} as employee_id), row_number() over (partition by {_NULLABLE} order by sequence_id) as chain_seq, {Q._SERIAL} as serial from ledger),
hashed as (
  select employee_id, chain_seq, repeat('0', 64) as previous_hash, sha256(serial || repeat('0', 64)) as entry_hash from placed where chain_seq = 1
  union all
  select p.employee_id, p.chain_seq, h.entry_hash, sha256(p.serial || h.entry_hash) from hashed h join placed p on p.employee_id is not distinct from h.employee_id and p.chain_seq = h.chain_seq + 1
),
chain as (select p.*, previous_hash, entry_hash from placed p join hashed h on p.employee_id is not distinct from h.employee_id and p.chain_seq = h.chain_seq),
bad as (select * replace (case when {Q.EDIT} then '{{"forged": "true"}}' else new_value_text end as new_value_text) from chain where not ({Q.DROP}))"""


@query(_NULL_CHAIN + ", " + Q._links("bad") + " select employee_id, chain_seq, mismatch, gap, orphan from checked where mismatch or gap or orphan")
def chain_verify_null_keys(spark, sf_dir):
    """Tampering with chains of which one has no employee; buckets of 8 rows, so that most links cross one."""
    chain = CH.build(D.ledger(spark, sf_dir).withColumn("employee_id", F.expr(_NULLABLE)))
    return CH.anomalies(CH.tampered(chain, F.expr(Q.EDIT), F.expr(Q.DROP)), bucket=8)


@query(BAD + ", " + Q._sealed("chain") + ", " + Q._links("bad") + """, marks as (select employee_id, last_seq from sealed where checkpoint % 3 <> 1)
select employee_id, sealed_after, sealed_at, count(*) as entries, bool_and(not (mismatch or gap or orphan)) as valid from (
  select c.*, (select coalesce(max(last_seq), 0) from marks m where m.employee_id = c.employee_id and last_seq < c.chain_seq)::bigint as sealed_after,
         (select min(last_seq) from marks m where m.employee_id = c.employee_id and last_seq >= c.chain_seq)::bigint as sealed_at from checked c) group by 1, 2, 3""")
def chain_verify_by_checkpoints(spark, sf_dir):
    """Segments between a list of checkpoints of uneven distance, the last one open."""
    marks = K.fixed(_chain(spark, sf_dir), INTERVAL).where("checkpoint % 3 <> 1")
    return CH.segments_by(Q._bad_chain(spark, sf_dir), marks)


def _chain(spark, sf_dir) -> DataFrame:
    return Q._chain(spark, sf_dir)


# Checkpoints: scans, sink, signatures.


@query(_SEALED + f" select {Q._SEAL_COLS} from sealed qualify row_number() over (partition by employee_id order by last_seq desc) = 1")
def checkpoint_latest(spark, sf_dir):
    return K.latest(K.fixed(_chain(spark, sf_dir), INTERVAL))


@query(_SEALED + f" select {Q._SEAL_COLS} from sealed where last_seq between 9 and 24")
def checkpoints_in_range(spark, sf_dir):
    return K.between(K.fixed(_chain(spark, sf_dir), INTERVAL), 9, 24)


@query(_SEALED + " select employee_id, checkpoint, last_seq, merkle_root from sealed where checkpoint = 0")
def checkpoint_by_id(spark, sf_dir):
    return K.one(K.fixed(_chain(spark, sf_dir), INTERVAL), 0).select("employee_id", "checkpoint", "last_seq", "merkle_root")


@query(_SEALED + f" select c.employee_id, chain_seq, entry_hash from chain c left join (select employee_id, max(last_seq) as done from sealed where n_rows = {INTERVAL} group by 1) using (employee_id) where chain_seq > coalesce(done, 0)")
def unsealed_tail(spark, sf_dir):
    chain = _chain(spark, sf_dir)
    return K.unsealed(chain, K.fixed(chain, INTERVAL).where(f"n_rows = {INTERVAL}"), slim=True)


@query(_SEALED + " select employee_id, last_seq, merkle_root from sealed where checkpoint % 2 = 1")
def checkpoint_append(spark, sf_dir):
    """Of all checkpoints, offered twice over, those that a store of every other one takes."""
    sealed = K.fixed(_chain(spark, sf_dir), INTERVAL)
    return K.appended(sealed.where("checkpoint % 2 = 0"), sealed.unionByName(sealed)).select("employee_id", "last_seq", "merkle_root")


_KIND = "(employee_id + checkpoint) % 6"


def _signed(spark, sf_dir) -> DataFrame:
    """All checkpoints, signed; by kind unsigned, by a key that nobody has, forged, or of the time before roots."""
    sealed = K.fixed(_chain(spark, sf_dir), INTERVAL).withColumn("merkle_root", F.expr(f"CASE WHEN {_KIND} <> 3 THEN merkle_root END"))
    signed = K.signed(sealed, SEED, "k1")
    return signed.withColumns({"signature_hex": F.expr(f"CASE WHEN {_KIND} = 0 THEN repeat('0', 128) ELSE signature_hex END"), "key_id": F.expr(f"CASE WHEN {_KIND} = 1 THEN 'lost' ELSE key_id END"), "digest": F.expr(f"CASE WHEN {_KIND} = 2 THEN sha2(digest, 256) ELSE digest END")})


@query(_SEALED + f" select employee_id, checkpoint, case {_KIND} when 0 then 'unsigned' when 1 then 'key_not_found' when 2 then 'invalid_signature' else 'verified' end as signature from sealed")
def checkpoint_signatures(spark, sf_dir):
    registry = spark.createDataFrame([("k1", PUBLIC)], "key_id string, public_hex string")
    return K.signature_statuses(_signed(spark, sf_dir), registry).select("employee_id", "checkpoint", "signature")


@query(_SEALED + f", ends as (select employee_id, max(chain_seq) as tail from chain group by 1), done as (select employee_id, max(last_seq) as done from sealed where n_rows = {INTERVAL} group by 1) select employee_id, greatest(0, tail - coalesce(done, 0)) as lag from ends left join done using (employee_id)")
def anchor_lag(spark, sf_dir):
    """How far every chain's end is ahead of its last full checkpoint."""
    chain = _chain(spark, sf_dir)
    ends = chain.groupBy("employee_id").agg(F.max("chain_seq").alias("tail"))
    done = K.latest(K.fixed(chain, INTERVAL).where(f"n_rows = {INTERVAL}")).select("employee_id", "last_seq")
    return ends.join(done, "employee_id", "left").select("employee_id", K.lag(F.col("tail"), F.coalesce("last_seq", F.lit(0))).alias("lag"))


# Capsules and exports.


_PATH = f"concat_ws(',', {Q._SIDE.format(i='i', l='l0')}, {Q._SIDE.format(i='(i // 2)', l='l1')}, {Q._SIDE.format(i='(i // 4)', l='l2')})"


@query(_SEALED + f""", p as (select *, unnest(range(0, n_rows)) as i from sealed), proofs as (select employee_id, first_seq + i as chain_seq, checkpoint, n_rows, l0[i + 1] as leaf, merkle_root as root, {_PATH} as path from p)
select sequence_id, case when n_rows < {INTERVAL} then 'uncheckpointed' when checkpoint % 3 = 2 then 'before_merkle' else 'ok' end as status, leaf, path, root from chain join proofs using (employee_id, chain_seq)
union all select sequence_id + 1000000000, 'not_found', null, null, null from ledger where action = 'DELETE'""")
def evidence_capsules(spark, sf_dir):
    """A capsule for every row, and for sequences that do not exist; checkpoints of three rows a cycle have no root."""
    # Stored, or each step that reads the chain would build it anew.
    chain = shared.stored(_chain(spark, sf_dir).select("employee_id", "chain_seq", *capsules.ROW, "entry_hash"), "chain")
    sealed = K.fixed(chain, INTERVAL).where(f"n_rows = {INTERVAL}").withColumn("merkle_root", F.expr("CASE WHEN checkpoint % 3 <> 2 THEN merkle_root END")).withColumn("signature_hex", F.lit("")).withColumn("key_id", F.lit("k1"))
    rows = D.ledger(spark, sf_dir)
    asked = rows.select("sequence_id").unionByName(rows.where("action = 'DELETE'").selectExpr("sequence_id + 1000000000 as sequence_id"))
    made = capsules.capsules(chain, sealed, asked, payload=False)
    return made.select("sequence_id", "status", "leaf", F.when(F.col("path").isNotNull(), F.concat_ws(",", "path")).alias("path"), F.col("proof_root").alias("root"))


_CASE = "sequence_id % 5"


@query(_SEALED + f" select sequence_id, case {_CASE} when 1 then 'LEAF_MISMATCH' when 2 then 'SIGNATURE_INVALID' when 3 then (case when n_rows > 1 then 'ROOT_MISMATCH' else 'VALID' end) when 4 then 'MALFORMED' else 'VALID' end as verdict from chain join (select employee_id, checkpoint, n_rows from sealed) s on s.employee_id = chain.employee_id and s.checkpoint = (chain_seq - 1) // {INTERVAL}")
def capsule_verdicts(spark, sf_dir):
    """Capsules of every row, four of five damaged in their row, signature, path or form."""
    chain = _chain(spark, sf_dir)
    sealed = K.signed(K.fixed(chain, INTERVAL), SEED, "k1")
    made = capsules.capsules(chain, sealed)
    bad = {"new_value_text": f"CASE WHEN {_CASE} = 1 THEN 'forged' ELSE new_value_text END", "signature_hex": f"CASE WHEN {_CASE} = 2 THEN repeat('1', 128) ELSE signature_hex END", "path": f"CASE WHEN {_CASE} = 3 THEN slice(path, 2, 64) ELSE path END", "leaf": f"CASE WHEN {_CASE} <> 4 THEN leaf END"}
    return capsules.verified(made.withColumns({k: F.expr(v) for k, v in bad.items()}), PUBLIC).select("sequence_id", "verdict")


_LINE = "'{\"action\":' || to_json(action) || ',\"actor_name\":' || to_json(actor_name) || ',\"actor_user_id\":' || actor_user_id || ',\"employee_id\":' || employee_id || ',\"new_value_text\":' || coalesce(to_json(new_value_text)::varchar, 'null') || ',\"old_value_text\":' || coalesce(to_json(old_value_text)::varchar, 'null') || ',\"sequence_id\":' || sequence_id || ',\"table_name\":' || to_json(table_name) || '}'"


@query(D.with_sql("ledger", "users") + f", named as (select l.*, {Q._ACTOR} as actor_name from ledger l left join users u on u.user_id = actor_user_id) select sequence_id, {_LINE} as line, sha256({_LINE}) as line_hash from named")
def evidence_export(spark, sf_dir):
    """The ledger's rows as canonical JSON with whole payloads and actor names."""
    rows = D.ledger(spark, sf_dir).select("sequence_id", "actor_user_id", "employee_id", "action", "table_name", "old_value_text", "new_value_text")
    return bundle.export(rows, D.table(spark, sf_dir, "users"))


# Flags, reviews and lists.


_GROUPED = D.with_sql("ledger") + f", {Q._AHEAD}, roots as (select s.sequence_id, s.employee_id, (select max(i.sequence_id) from incidents i where (i.created_at, i.sequence_id) <= (s.created_at, s.sequence_id) and i.created_at = (select max(j.created_at) from incidents j where (j.created_at, j.sequence_id) <= (s.created_at, s.sequence_id))) as root from starts s)"


@query(_GROUPED + " select sequence_id, employee_id, root from roots")
def deactivation_groups(spark, sf_dir):
    """Every burst start with the flag that stands for its incident."""
    return detect.grouped(D.ledger(spark, sf_dir)).select("sequence_id", "employee_id", "root")


_REVIEWED = _GROUPED + """, reviews as (select sequence_id, sequence_id % 3 as reviewed_at, 'cleared' as decision, 'cleared' as review_id from roots where sequence_id % 2 = 0 union all select sequence_id, sequence_id % 5, 'reopened', 'reopened' from roots where sequence_id % 3 = 0),
decided as (select root, arg_max(decision, (reviewed_at, review_id)) as decision from reviews join roots using (sequence_id) group by 1),
state as (select sequence_id, root, coalesce(decision, 'open') as decision from roots left join decided using (root))"""


def _reviewed(spark, sf_dir) -> DataFrame:
    flagged = detect.grouped(D.ledger(spark, sf_dir)).select("sequence_id", "root")
    made = [flagged.where(f"sequence_id % {a} = 0").selectExpr("sequence_id", f"sequence_id % {b} as reviewed_at", f"'{d}' as decision", f"'{d}' as review_id") for a, b, d in ((2, 3, "cleared"), (3, 5, "reopened"))]
    return detect.group_review_state(flagged, made[0].unionByName(made[1]))


@query(_REVIEWED + " select sequence_id, root, decision from state")
def group_review_state(spark, sf_dir):
    """Reviews of any flag of an incident hold for all of it."""
    return _reviewed(spark, sf_dir).select("sequence_id", "root", "decision")


@query(_REVIEWED + " select (select count(*) from ledger) as ledger_rows, (select count(*) from state where decision in ('open', 'reopened') and root = sequence_id) as open_flags")
def dashboard_open_flags(spark, sf_dir):
    rows = D.ledger(spark, sf_dir).agg(F.count(F.lit(1)).alias("ledger_rows"))
    return rows.crossJoin(detect.open_flags(_reviewed(spark, sf_dir)).agg(F.count(F.lit(1)).alias("open_flags")))


@query(_REVIEWED + " select sequence_id, decision from state where root = sequence_id")
def flag_list(spark, sf_dir):
    """Flags newest first, without superseded ones."""
    return search.flag_list(_reviewed(spark, sf_dir)).select("sequence_id", "decision")


@query(Q._FLAGS + ", stored as (select sequence_id from ledger where action = 'DELETE') select sequence_id, reason from flags where sequence_id not in (select sequence_id from stored)")
def flags_refresh(spark, sf_dir):
    """What a refresh adds where all deletions are flagged already."""
    rows = D.ledger(spark, sf_dir)
    return detect.new_flags(detect.flags(rows), detect.deletions(rows)).select("sequence_id", "reason")


@query(D.with_sql("ledger") + " select sequence_id, action, (select count(*) from ledger where table_name = 'employees') as total from ledger where table_name = 'employees' and sequence_id between 450 and 549")
def chain_explorer(spark, sf_dir):
    """The window about a sequence, at most 100 rows; the count is of all that the filter leaves."""
    rows = search.search(D.ledger(spark, sf_dir), table="employees")
    shown, total = search.explorer_page(rows, 1, 500, 500)
    return shown.select("sequence_id", "action", F.lit(total).cast("long").alias("total"))


@query(D.with_sql("ledger") + " select sequence_id as action_id, employee_id from ledger where action = 'UPDATE' and actor_user_id = 3 order by sequence_id desc limit 50")
def undo_list(spark, sf_dir):
    rows = D.ledger(spark, sf_dir).where("action = 'UPDATE'").withColumn("action_id", F.col("sequence_id"))
    return search.of_actor(rows, 3).select("action_id", "employee_id")


@query(D.with_sql("ledger") + """, e as (select * from ledger where table_name = 'employees'),
r as (select employee_id, max(sequence_id) as last_at, arg_max(action, sequence_id) as what from e where action <> 'UPDATE' group by 1),
live as (select e.* from e left join r using (employee_id) where new_value_text is not null and (last_at is null or sequence_id > last_at or (sequence_id = last_at and what = 'INSERT'))),
x as (select employee_id, sequence_id, new_value_text, unnest(json_keys(new_value_text)) as key from live),
v as (select employee_id, key, arg_max_null(json_extract_string(new_value_text, '$.' || key), sequence_id) as value from x group by 1, 2),
act as (select sequence_id as action_id, employee_id, old_value_text as o from e where action = 'UPDATE'),
k as (select action_id, employee_id, o, unnest(list_distinct(list_concat(json_keys(o), coalesce((select list(key) from v where v.employee_id = act.employee_id), [])))) as key from act),
c as (select action_id, string_agg(key, ',' order by key) as changes from k left join v using (employee_id, key) where json_extract_string(o, '$.' || key) is distinct from value group by 1),
has as (select distinct employee_id from live)
select action_id, act.employee_id, has.employee_id is not null and action_id % 2 = 0 as allowed, case when has.employee_id is not null and action_id % 2 = 0 then coalesce(changes, '') else '' end as changes from act left join has using (employee_id) left join c using (action_id)""")
def undo_preview(spark, sf_dir):
    """Every update as an undoable action; those with odd ids were made for another state than the present one."""
    rows = D.ledger(spark, sf_dir)
    current = replay.documents(rows, F.lit(True))
    digest = F.when(F.col("action_id") % 2 == 0, F.sha2(X.sorted_json(F.col("state")), 256)).otherwise("another")
    actions = rows.where("action = 'UPDATE' AND table_name = 'employees'").select(F.col("sequence_id").alias("action_id"), "employee_id", X.payload(F.col("old_value_text")).alias("before"))
    actions = actions.join(current, "employee_id", "left").withColumn("after_hash", digest).drop("state")
    return search.undo_preview(actions, current).withColumn("changes", F.array_join("changes", ","))


@query("select event_id, user_id, (select count(*) from events where event_type = 'error') as total from events where event_type = 'error' order by event_id desc limit 20 offset 20")
def security_events(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type = 'error'").select("event_id", "user_id")
    return search.event_list(events, 2, 20)


@query(D.with_sql("ledger") + """, k as (select sequence_id, old_value_text as o, new_value_text as n, unnest(list_distinct(list_concat(coalesce(json_keys(old_value_text), []), coalesce(json_keys(new_value_text), [])))) as key from ledger),
v as (select *, list_contains(coalesce(json_keys(o), []), key) as ho, list_contains(coalesce(json_keys(n), []), key) as hn, json_extract_string(o, '$.' || key) as old, json_extract_string(n, '$.' || key) as new from k)
select sequence_id, count(*) filter (not ho) as added, count(*) filter (ho and not hn) as removed, count(*) filter (ho and hn) as changed, bool_or(not regexp_full_match(key, '[A-Za-z_][A-Za-z0-9_]*')) as anomalous from v where not ho or not hn or old is distinct from new group by 1""")
def payload_diff_counts(spark, sf_dir):
    return search.change_counts(search.field_changes(D.ledger(spark, sf_dir)))


# Trust and streams.


@query(CHAIN + f" select employee_id, chain_seq - {INTERVAL} as sealed_after, chain_seq as sealed_at, 'count' as reason from chain where chain_seq % {INTERVAL} = 0")
def stream_seal(spark, sf_dir):
    """The checkpoint scheduler over a ledger that arrives in four parts, started again for each."""
    return monitor.in_turn(D.ledger(spark, sf_dir), "sequence_id", 4, lambda rows, _: jobs.sealing(rows, INTERVAL, None), "seal")


@query("select user_id::varchar as monitor, epoch_us(ts) as checked_at, event_type as status, before from (select *, coalesce(lag(event_type) over (partition by user_id order by ts, event_id), 'intact') as before from events) where event_type <> before")
def stream_transitions(spark, sf_dir):
    """Alerts when the kind of a user's events changes, over a stream of four parts in order of time."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    t = detect.micros(F.col("ts"))
    statuses = events.select(F.col("user_id").cast("string").alias("monitor"), t.alias("checked_at"), F.col("event_type").alias("status"), "event_id")
    return monitor.in_turn(statuses, "checked_at", 4, lambda rows, _: jobs.transitions(rows, ties=["event_id"]), "alerts")


# Pages, batches, scores and repeats.


@query(D.with_sql("employees", "roles", "departments") + " select employee_id, title, ceil(row_number() over (order by employee_id) / 20.0)::bigint as page, ceil(count(*) over () / 20.0)::bigint as pages from employees join roles using (role_id) join departments using (department_id)")
def directory_pages(spark, sf_dir):
    """Every page of the directory, in order of id."""
    rows = search.directory(*(D.table(spark, sf_dir, t) for t in ("employees", "roles", "departments")))
    return search.paged(rows, 20).select("employee_id", "title", "page", "pages")


_BATCH = {"batch": "case when employee_id % 2 = 0 then 'even ' || cast(floor(employee_id / 40) as int) else 'odd ' || cast(floor(employee_id / 50) as int) end", "email": "case when employee_id % 160 < 40 and employee_id % 8 = 0 then 'Shared@example.com' when employee_id % 160 < 40 and employee_id % 8 = 4 then 'SHARED@example.com' else email end"}


@query(D.with_sql("employees") + f" select batch, count(*) > 20 as too_many, count(distinct lower(trim(email))) < count(email) as repeated_email from (select {', '.join(D.select(_BATCH))} from employees) group by 1")
def rule_batches(spark, sf_dir):
    """Employees entered in batches, some of which are too large or have an e-mail twice."""
    return rules.batch_errors(D.table(spark, sf_dir, "employees").selectExpr(*D.select(_BATCH)), keys=["batch"])


@query(BAD + ", " + Q._report("bad") + " select employee_id, round_even(100.0 * ((n_mismatch = 0)::int + (n_gap = 0)::int + (n_orphan = 0)::int) / 3, 0)::int as score from report")
def integrity_scores(spark, sf_dir):
    """Of the three checks of every chain the percentage that passes."""
    each = [F.when(F.col(c) == 0, "pass").otherwise("fail") for c in ("n_mismatch", "n_gap", "n_orphan")]
    return CH.report(Q._bad_chain(spark, sf_dir)).select("employee_id", CH.score(F.array(*each)).alias("score"))


@query(Q._LISTS + " select employee_id, sequence_id, count(*) as n from (select * from ours union all select * from theirs) group by 1, 2 having count(*) > 1")
def repeated_sequences(spark, sf_dir):
    """Sequences that two checkpoints of an employee have, when published lists are put to ours."""
    ours, theirs = Q._lists(spark, sf_dir)
    return rules.repeated(ours.unionByName(theirs), ["employee_id", "sequence_id"])
