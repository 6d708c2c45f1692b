"""The ledger queries by name, each with DuckDB SQL for the same rows where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import secrets as S
from tidemark.functions import text as X
from tidemark.operators import chain as CH
from tidemark.operators import checkpoints as K
from tidemark.operators import detect, limits, replay, rules, search, trust
from tidemark.operators import sealed as SE
from tidemark.sources import derived as D
from tidemark.streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

INTERVAL = 8
EDIT, DROP = "sequence_id % 997 = 500", "sequence_id % 1499 = 700"
WHEN, AT_SEQUENCE, AS_OF = "2024-01-15 00:00:00", 700, "2026-01-01"
SKIPPED = "salary_id % 7 = 3"


def query(sql: str | None = None, **kinds: str) -> Callable:
    """Registers a query and its SQL. kinds: columns given out as another type, so that both engines hand over the same."""

    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = (lambda spark, sf_dir: f(spark, sf_dir).withColumns({c: F.col(c).cast(k) for c, k in kinds.items()})) if kinds else f
        if sql:
            ORACLE[f.__name__] = f"select * replace ({', '.join(f'cast({c} as {k}) as {c}' for c, k in kinds.items())}) from ({sql})" if kinds else sql
        return f

    return put


def _chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CH.build(D.ledger(spark, sf_dir))


def _bad_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CH.tampered(_chain(spark, sf_dir), F.expr(EDIT), F.expr(DROP))


_SERIAL = "concat_ws('|', sequence_id, actor_user_id, action, table_name, row_id, coalesce(old_value_text, 'null'), coalesce(new_value_text, 'null'), created_at_text)"
CHAIN = D.with_sql("ledger") + f""",
placed as (select *, row_number() over (partition by employee_id order by sequence_id) as chain_seq, {_SERIAL} as serial from ledger),
hashed as (
  select employee_id, chain_seq, repeat('0', 64) as previous_hash, sha256(serial || repeat('0', 64)) as entry_hash from placed where chain_seq = 1
  union all
  select p.employee_id, p.chain_seq, h.entry_hash, sha256(p.serial || h.entry_hash) from hashed h join placed p on p.employee_id = h.employee_id and p.chain_seq = h.chain_seq + 1
),
chain as (select p.*, previous_hash, entry_hash from placed p join hashed h using (employee_id, chain_seq))"""
BAD = CHAIN + f""",
bad as (select * replace (case when {EDIT} then '{{"forged": "true"}}' else new_value_text end as new_value_text) from chain where not ({DROP}))"""


def _links(rows: str) -> str:
    return f"""checked as (
  select *, recomputed <> entry_hash as mismatch, chain_seq <> coalesce(lag(chain_seq) over w, 0) + 1 as gap,
         previous_hash <> coalesce(lag(recomputed) over w, repeat('0', 64)) as orphan, coalesce(lag(chain_seq) over w, 0) as before
  from (select *, sha256({_SERIAL} || previous_hash) as recomputed from {rows}) window w as (partition by employee_id order by chain_seq))"""


def _report(rows: str) -> str:
    return _links(rows) + """,
report as (
  select *, first_bad is null as valid, case when first_bad is null then last_seq else first_bad - 1 end as last_verified from (
    select employee_id, count(*) as total_entries, max(chain_seq) as last_seq, count(*) filter (mismatch) as n_mismatch, count(*) filter (gap) as n_gap,
           count(*) filter (orphan) as n_orphan, coalesce(min(chain_seq) filter (mismatch), min(before + 1) filter (gap), min(chain_seq) filter (orphan)) as first_bad
    from checked group by employee_id))"""


def _sealed(rows: str, name: str = "sealed") -> str:
    up = "list_transform(range(0, (len({0}) + 1) // 2), lambda i: case when 2 * i + 2 <= len({0}) then sha256('\\x01'::blob || unhex({0}[2 * i + 1]) || unhex({0}[2 * i + 2])) else {0}[2 * i + 1] end)"
    return f"""{name}_0 as (
  select employee_id, (chain_seq - 1) // {INTERVAL} as checkpoint, min(chain_seq) as first_seq, max(chain_seq) as last_seq, count(*)::int as n_rows,
         sha256(string_agg(entry_hash, '' order by chain_seq)) as digest, list(sha256('\\x00'::blob || encode({_SERIAL})) order by chain_seq) as l0 from {rows} group by 1, 2),
{name}_1 as (select *, {up.format('l0')} as l1 from {name}_0), {name}_2 as (select *, {up.format('l1')} as l2 from {name}_1),
{name} as (select *, {up.format('l2')}[1] as merkle_root from {name}_2)"""


# Search and dashboards.

_ACTOR = "coalesce(nullif(nullif(trim(u.full_name), ''), 'Unknown'), nullif(trim(u.email), ''), 'unresolved_user#' || actor_user_id)"


@query(D.with_sql("ledger", "users") + f" select sequence_id, actor_user_id, action, table_name, severity, {_ACTOR} as actor_name from ledger left join users u on u.user_id = actor_user_id where action = 'UPDATE' and table_name ilike '%EMPLOY%' and severity = 'INFO' and actor_user_id = 3 order by sequence_id desc limit 50 offset 50")
def ledger_search_filtered(spark, sf_dir):
    rows = search.search(D.ledger(spark, sf_dir), actor=3, action="update", table="EMPLOY", severity="info")
    out = search.with_actor(search.page(rows, 2, 50), D.table(spark, sf_dir, "users"))
    return out.select("sequence_id", "actor_user_id", "action", "table_name", "severity", "actor_name")


@query(D.with_sql("ledger") + " select count(*) as total, ceil(count(*) / 50.0)::bigint as pages from ledger where action = 'DELETE'")
def ledger_search_total(spark, sf_dir):
    return search.search(D.ledger(spark, sf_dir), action="delete").agg(F.count(F.lit(1)).alias("total")).withColumn("pages", search.pages(F.col("total"), 50))


@query(D.with_sql("ledger") + " select sequence_id, action, case when (select count(*) from ledger where sequence_id < 600) > 25 then min(sequence_id) over () end as next_cursor from (select * from ledger where sequence_id < 600 order by sequence_id desc limit 25)")
def ledger_search_cursor(spark, sf_dir):
    return search.cursor_page(D.ledger(spark, sf_dir), 25, before=600).select("sequence_id", "action", "next_cursor")


@query(D.with_sql("ledger") + " select sequence_id, action, table_name from ledger where employee_id = 17 or (table_name = 'employees' and row_id = 17) or (table_name = 'salary_history' and (json_extract_string(new_value_text, '$.employee_id') = '17' or json_extract_string(old_value_text, '$.employee_id') = '17'))")
def ledger_by_employee(spark, sf_dir):
    return search.search(D.ledger(spark, sf_dir), employee=17).select("sequence_id", "action", "table_name")


@query(D.with_sql("ledger") + " select sequence_id, case severity when 'INFO' then 'low' when 'WARNING' then 'medium' else 'critical' end as label from ledger where sequence_id between 475 and 524")
def ledger_around_sequence(spark, sf_dir):
    return search.around(D.ledger(spark, sf_dir), 500, 50).select("sequence_id", X.severity_label(F.col("severity")).alias("label"))


def _hide(column: str) -> str:
    return f"regexp_replace({column}, '{X.FLAT_SECRET}', '\\1\"[REDACTED]\"', 'g')"


@query(D.with_sql("ledger") + f" select sequence_id, {_hide('old_value_text')} as old, {_hide('new_value_text')} as new from ledger")
def ledger_redacted(spark, sf_dir):
    return D.ledger(spark, sf_dir).select("sequence_id", X.redacted_json(F.col("old_value_text")).alias("old"), X.redacted_json(F.col("new_value_text")).alias("new"))


@query(D.with_sql("ledger") + " select sequence_id, severity from ledger")
def severity_assignment(spark, sf_dir):
    return detect.severity_of(D.ledger(spark, sf_dir))


_DIRECTORY = D.with_sql("employees", "roles", "departments", "salaries") + ", latest as (select employee_id, arg_max_null(amount, (effective_date, salary_id)) as amount from salaries group by 1), directory as (select employee_id, full_name, email, title, department, is_active, amount from employees join roles using (role_id) join departments using (department_id) left join latest using (employee_id))"


def _directory(spark, sf_dir, private=True):
    latest = replay.effective_salary(D.table(spark, sf_dir, "salaries"), F.lit(True))
    return search.directory(*(D.table(spark, sf_dir, x) for x in ("employees", "roles", "departments")), latest, private)


@query(_DIRECTORY + " select * from directory", amount="double")
def employee_directory(spark, sf_dir):
    return _directory(spark, sf_dir)


@query(_DIRECTORY + " select employee_id, 'Employee #' || employee_id as full_name, 'Restricted' as email, title, department, is_active, null::decimal(12,2) as amount from directory where is_active and department ilike 'asia'", amount="double")
def directory_masked(spark, sf_dir):
    return search.find_employees(_directory(spark, sf_dir, False), department="asia", active=True)


@query(_DIRECTORY + " select employee_id, full_name from directory where full_name ilike '%12%' or email ilike '%12%' or employee_id = 12")
def directory_search(spark, sf_dir):
    return search.find_employees(_directory(spark, sf_dir), text="12").select("employee_id", "full_name")


@query(D.with_sql("roles", "departments") + " select role_id, title, department from roles join departments using (department_id)")
def role_catalogue(spark, sf_dir):
    return D.table(spark, sf_dir, "roles").join(D.table(spark, sf_dir, "departments"), "department_id").orderBy("department", "title").select("role_id", "title", "department")


@query(D.with_sql("salaries") + " select employee_id, arg_max_null(amount, (effective_date, salary_id)) as amount from salaries group by 1", amount="double")
def latest_salary(spark, sf_dir):
    return replay.effective_salary(D.table(spark, sf_dir, "salaries"), F.lit(True))


# Detection.

_AHEAD = """off as (select sequence_id, employee_id, created_at from ledger where table_name = 'employees' and action = 'UPDATE' and json_extract_string(old_value_text, '$.is_active') = 'true' and json_extract_string(new_value_text, '$.is_active') = 'false'),
ahead as (select *, count(*) over (order by created_at range between current row and interval 1 hour following) as n_ahead from off),
starts as (select * from ahead where n_ahead > 3),
incidents as (select * from (select *, lag(created_at) over (order by created_at, sequence_id) as p from starts) where p is null or created_at - p > interval 1 hour)"""
_CHANGES = "changes as (select * from (select sequence_id, employee_id, amount, lag(amount) over (partition by employee_id order by sequence_id) as before from ledger where table_name = 'salary_history' and action = 'INSERT') where before > 0 and abs(amount - before) > 0.30::decimal(3,2) * before)"
_FLAGS = D.with_sql("ledger") + f", {_AHEAD}, {_CHANGES}, every_flag as (select sequence_id, employee_id, 0 as rank, 'salary_change' as reason, 1 as affected from changes union all select sequence_id, employee_id, 1, 'data_deletion', 1 from ledger where action = 'DELETE' union all select sequence_id, employee_id, 2, 'deactivation_burst', n_ahead from incidents), flags as (select sequence_id, employee_id, reason, affected::bigint as affected from every_flag qualify row_number() over (partition by sequence_id order by rank) = 1)"


@query(D.with_sql("ledger") + f", {_CHANGES} select sequence_id, employee_id, amount, before from changes", amount="double", before="double")
def salary_change_flags(spark, sf_dir):
    return detect.salary_changes(D.ledger(spark, sf_dir))


@query(D.with_sql("ledger") + " select sequence_id, employee_id from ledger where action = 'DELETE'")
def deletion_flags(spark, sf_dir):
    return detect.deletions(D.ledger(spark, sf_dir))


@query(D.with_sql("ledger") + f", {_AHEAD} select sequence_id, employee_id, n_ahead from starts")
def deactivation_burst_starts(spark, sf_dir):
    return detect.burst_starts(D.ledger(spark, sf_dir)).select("sequence_id", "employee_id", "n_ahead")


@query(D.with_sql("ledger") + f", {_AHEAD} select sequence_id, employee_id, n_ahead from incidents")
def deactivation_incidents(spark, sf_dir):
    return detect.incidents(D.ledger(spark, sf_dir)).select("sequence_id", "employee_id", "n_ahead")


@query(D.with_sql("ledger") + " select sequence_id, employee_id from (select sequence_id, employee_id, created_at as t, lag(created_at, 1) over w as b1, lag(created_at, 2) over w as b2, lead(created_at, 1) over w as a1, lead(created_at, 2) over w as a2 from ledger where action = 'DELETE' window w as (order by created_at, sequence_id)) where a2 - t <= interval 1 hour or a1 - b1 <= interval 1 hour or t - b2 <= interval 1 hour")
def mass_deletions_legacy(spark, sf_dir):
    return detect.mass_deletions(D.ledger(spark, sf_dir))


@query(_FLAGS + " select * from flags")
def all_flags_deduplicated(spark, sf_dir):
    return detect.flags(D.ledger(spark, sf_dir))


@query(_FLAGS + " select l.sequence_id, l.action, l.severity, f.reason from ledger l left join flags f using (sequence_id)")
def compliance_overview(spark, sf_dir):
    rows = D.ledger(spark, sf_dir)
    return rows.join(detect.flags(rows).select("sequence_id", "reason"), "sequence_id", "left").select("sequence_id", "action", "severity", "reason")


@query(_FLAGS + ", reviews as (select sequence_id, reviewed_at, decision from (select sequence_id, sequence_id % 3 as reviewed_at, 'cleared' as decision from flags where sequence_id % 2 = 0 union all select sequence_id, sequence_id % 5, 'reopened' from flags where sequence_id % 3 = 0)) select sequence_id, reason, coalesce((select arg_max(decision, (reviewed_at, decision)) from reviews r where r.sequence_id = f.sequence_id), 'open') as decision from flags f")
def review_state(spark, sf_dir):
    flagged = detect.flags(D.ledger(spark, sf_dir))
    made = [flagged.where(f"sequence_id % {a} = 0").selectExpr("sequence_id", f"sequence_id % {b} as reviewed_at", f"'{d}' as decision", f"'{d}' as review_id") for a, b, d in ((2, 3, "cleared"), (3, 5, "reopened"))]
    return detect.review_state(flagged, made[0].unionByName(made[1])).select("sequence_id", "reason", "decision")


_DASH = D.with_sql("employees", "ledger") + _FLAGS[_FLAGS.index(", off as") :]


@query(_DASH + " select (select count(*) from employees where is_active) as active_employees, (select count(*) from employees) as total_employees, (select count(*) from ledger) as ledger_rows, (select count(*) from flags) as open_flags")
def dashboard_stats(spark, sf_dir):
    rows = D.ledger(spark, sf_dir)
    return search.dashboard(D.table(spark, sf_dir, "employees"), rows, detect.flags(rows))


@query(D.with_sql("ledger", "users") + f" select sequence_id, action, {_ACTOR} as actor_name from ledger left join users u on u.user_id = actor_user_id order by sequence_id desc limit 10")
def recent_activity(spark, sf_dir):
    return search.with_actor(search.page(D.ledger(spark, sf_dir), 1, 10), D.table(spark, sf_dir, "users")).select("sequence_id", "action", "actor_name")


# Chains.


@query(CHAIN + " select sequence_id, employee_id, chain_seq, previous_hash, entry_hash from chain")
def chain_build_per_employee(spark, sf_dir):
    return _chain(spark, sf_dir).select("sequence_id", "employee_id", "chain_seq", "previous_hash", "entry_hash")


@query(CHAIN + ", " + _report("chain") + " select * from report")
def chain_verify_clean(spark, sf_dir):
    return CH.report(_chain(spark, sf_dir))


@query(BAD + ", " + _links("bad") + " select employee_id, chain_seq, mismatch, gap, orphan from checked where mismatch or gap or orphan")
def chain_verify_tampered(spark, sf_dir):
    return CH.anomalies(_bad_chain(spark, sf_dir))


@query(BAD + ", " + _links("bad") + " select employee_id, (chain_seq - 1) // 20 as segment, count(*) as entries, bool_and(not (mismatch or gap or orphan)) as valid from checked group by 1, 2")
def chain_verify_segments(spark, sf_dir):
    return CH.segments(_bad_chain(spark, sf_dir), 20)


@query(BAD + ", " + _report("bad") + " select * from report")
def tamper_localisation(spark, sf_dir):
    return CH.report(_bad_chain(spark, sf_dir))


@query(BAD + ", " + _report("bad") + ", t as (select employee_id, case when arg_max(c.entry_hash, c.chain_seq) = (select arg_max(b.entry_hash, b.chain_seq) from bad b where b.employee_id = c.employee_id) then 'pass' else 'fail' end as tail from chain c group by employee_id) select employee_id, case when valid then 'pass' else 'fail' end as chain, tail, case when not valid or tail = 'fail' then 'tampered' else 'intact' end as status, case when n_gap > 0 then 'row_deleted' when not valid then 'row_tampered' when tail = 'fail' then 'recomputed_and_hidden' else 'none' end as attack from report join t using (employee_id)")
def integrity_rollup(spark, sf_dir):
    whole = _chain(spark, sf_dir)
    bad = _bad_chain(spark, sf_dir)
    out = CH.report(bad).join(CH.tail_status(bad, CH.tails(whole)), "employee_id").withColumn("chain", F.when(F.col("valid"), "pass").otherwise("fail"))
    attack = CH.inferred_attack(F.col("n_gap") > 0, ~F.col("valid"), F.col("tail"), F.lit("pass"))
    return out.select("employee_id", "chain", "tail", CH.rolled_up(F.array("chain", "tail")).alias("status"), attack.alias("attack"))


def _newest(rows: str) -> str:
    return f""", ranked as (select *, row_number() over (partition by employee_id order by sequence_id desc) as r from {rows}),
pairs as (select employee_id, sequence_id, previous_hash, lag(entry_hash) over (partition by employee_id order by sequence_id) as prior from ranked where r <= 20)
select employee_id, coalesce(bool_and(previous_hash = prior) filter (prior is not null), true) as intact, max(sequence_id) as newest, count(*) as rows from pairs group by 1"""


@query(BAD + _newest("bad"))
def recent_link_check(spark, sf_dir):
    """The newest rows of every employee's chain, of which some rows are gone."""
    return CH.newest_links(_bad_chain(spark, sf_dir), 20, ["employee_id"])


@query(CHAIN + _newest("chain"))
def recent_link_check_all(spark, sf_dir):
    """The newest rows of every employee's chain."""
    return CH.newest_links(_chain(spark, sf_dir), 20, ["employee_id"])


@query(CHAIN + ", " + _report("chain") + _FLAGS[_FLAGS.index(", off as") :] + " select employee_id, total_entries, valid, coalesce(n_flags, 0) as n_flags from report left join (select employee_id, count(*) as n_flags from flags group by 1) using (employee_id)")
def employee_integrity(spark, sf_dir):
    """Every employee's chain verified, with the number of flags raised against it."""
    rows = D.ledger(spark, sf_dir)
    raised = detect.flags(rows).groupBy("employee_id").agg(F.count(F.lit(1)).alias("n_flags"))
    return CH.report(CH.build(rows)).join(raised, "employee_id", "left").select("employee_id", "total_entries", "valid", F.coalesce("n_flags", F.lit(0)).alias("n_flags"))


# Checkpoints and Merkle trees.

_SEAL_COLS = "employee_id, checkpoint, first_seq, last_seq, n_rows, digest, merkle_root"


@query(CHAIN + ", " + _sealed("chain") + f" select {_SEAL_COLS} from sealed")
def checkpoints_fixed_interval(spark, sf_dir):
    return K.fixed(_chain(spark, sf_dir), INTERVAL)


_TAIL = f", tail as (select c.* from chain c left join (select employee_id, max(last_seq) as done from sealed where n_rows = {INTERVAL} group by 1) using (employee_id) where chain_seq > coalesce(done, 0))"


NOW = "2024-01-31 00:00:00"


@query(CHAIN + ", " + _sealed("chain") + _TAIL + f""", t as (select employee_id, count(*) as pending, min(created_at) as first from tail group by 1), c as (select s.employee_id, max(created_at) as sealed from sealed s join chain c on c.employee_id = s.employee_id and c.chain_seq = s.last_seq where n_rows = {INTERVAL} group by 1),
w as (select employee_id, pending, greatest(0, date_diff('microsecond', coalesce(sealed, first), timestamp '{NOW}') // 1000000)::bigint as elapsed from t left join c using (employee_id))
select employee_id, pending, elapsed, case when pending >= 6 then 'count' when elapsed >= 259200 then 'time' end as trigger from w""")
def checkpoint_dual_trigger(spark, sf_dir):
    """Whether the rows behind every employee's last full checkpoint are due for sealing, and why: by their number, or by the
    time since that checkpoint (sealed with its last row), since the first row where there is none."""
    chain = _chain(spark, sf_dir)
    sealed = K.fixed(chain, INTERVAL).where(f"n_rows = {INTERVAL}")
    named = sealed.join(chain.selectExpr("employee_id", "chain_seq as last_seq", "created_at as sealed_when"), ["employee_id", "last_seq"])
    return K.due(chain, named, F.lit(NOW).cast("timestamp_ntz"), 6, 259200)


@query(CHAIN + f", t as (select employee_id, max(chain_seq) as latest, max(chain_seq) - 10 as last from chain group by 1) select employee_id, case when latest >= (floor(greatest(last, 0) / {INTERVAL}) + 1) * {INTERVAL} then greatest(last, 0) end as after from t")
def checkpoint_schedule(spark, sf_dir):
    rows = _chain(spark, sf_dir).groupBy("employee_id").agg(F.max("chain_seq").alias("latest"))
    return rows.select("employee_id", K.scheduled_after(F.greatest(F.col("latest") - 10, F.lit(0)), F.col("latest"), INTERVAL).alias("after"))


@query(BAD + ", " + _sealed("chain") + ", " + _sealed("bad", "now") + " select s.employee_id, s.checkpoint, case when n.digest is not distinct from s.digest and n.n_rows = s.n_rows and n.merkle_root = s.merkle_root then 'pass' else 'fail' end as binding from sealed s left join now n using (employee_id, checkpoint)")
def checkpoint_binding(spark, sf_dir):
    each = SE.binding(_bad_chain(spark, sf_dir), K.fixed(_chain(spark, sf_dir), INTERVAL))
    return each.select("employee_id", F.floor((F.col("last_seq") - 1) / INTERVAL).alias("checkpoint"), "binding")


@query(CHAIN + f", s as (select employee_id, (chain_seq - 1) // {INTERVAL} as checkpoint, max(chain_seq) as last_seq from chain group by 1, 2 having count(*) = {INTERVAL}) select c.employee_id, chain_seq, min(last_seq) as sealed_at, min(last_seq) - {INTERVAL} as sealed_after from chain c left join s on s.employee_id = c.employee_id and last_seq >= chain_seq group by 1, 2")
def enclosing_checkpoint(spark, sf_dir):
    rows = _chain(spark, sf_dir)
    return SE.enclosing(rows, K.fixed(rows, INTERVAL).where(f"n_rows = {INTERVAL}"))


@query(CHAIN + f" select employee_id, chain_seq, sha256('\\x00'::blob || encode({_SERIAL})) as leaf from chain")
def merkle_leaves(spark, sf_dir):
    return _chain(spark, sf_dir).select("employee_id", "chain_seq", K.leaf(X.serialised()).alias("leaf"))


_SIDE = "case when {i} % 2 = 0 then 'right:' || {l}[{i} + 2] else 'left:' || {l}[{i}] end"


@query(CHAIN + ", " + _sealed("chain") + f", p as (select *, unnest(range(0, n_rows)) as i from sealed) select employee_id, first_seq + i as chain_seq, merkle_root, concat_ws(',', {_SIDE.format(i='i', l='l0')}, {_SIDE.format(i='(i // 2)', l='l1')}, {_SIDE.format(i='(i // 4)', l='l2')}) as path from p")
def merkle_proof(spark, sf_dir):
    return K.proofs(_chain(spark, sf_dir), INTERVAL).select("employee_id", "chain_seq", "merkle_root", F.concat_ws(",", "path").alias("path"))


@query(BAD + f" select b.employee_id, b.chain_seq, b.leaf = sha256('\\x00'::blob || encode({_SERIAL})) as proved from (select employee_id, chain_seq, sha256('\\x00'::blob || encode({_SERIAL})) as leaf from bad) b join chain using (employee_id, chain_seq)")
def merkle_proof_check(spark, sf_dir):
    """Rows of the tampered chain against the proofs that were given out before."""
    now = _bad_chain(spark, sf_dir).select("employee_id", "chain_seq", K.leaf(X.serialised()).alias("now"))
    both = K.proofs(_chain(spark, sf_dir), INTERVAL).join(now, ["employee_id", "chain_seq"])
    return both.select("employee_id", "chain_seq", (K.proved_root(F.col("now"), F.col("path")) == F.col("merkle_root")).alias("proved"))


# Time travel and replay.


def _state(until: str) -> str:
    return D.with_sql("ledger") + f""", e as (select * from ledger where table_name = 'employees' and {until}),
r as (select employee_id, max(sequence_id) as last_at, arg_max(action, sequence_id) as what from e where action <> 'UPDATE' group by 1),
live as (select e.* from e left join r using (employee_id) where last_at is null or sequence_id > last_at or (sequence_id = last_at and what = 'INSERT')),
x as (select employee_id, sequence_id, new_value_text, unnest(json_keys(new_value_text)) as key from live)
select employee_id, key, arg_max_null(json_extract_string(new_value_text, '$.' || key), sequence_id) as value from x group by 1, 2"""


@query(_state(f"created_at <= timestamp '{WHEN}'"))
def state_as_of_timestamp(spark, sf_dir):
    return replay.state(D.ledger(spark, sf_dir), F.col("created_at") <= F.lit(WHEN).cast("timestamp_ntz"))


@query(_state(f"sequence_id <= {AT_SEQUENCE}"))
def state_as_of_sequence(spark, sf_dir):
    return replay.state(D.ledger(spark, sf_dir), F.col("sequence_id") <= AT_SEQUENCE)


@query("with s as (" + _state(f"sequence_id <= {AT_SEQUENCE}") + "), ids as (select distinct employee_id, (select max(value) from s x where x.employee_id = s.employee_id and key = 'role_id') as role from s) select employee_id, coalesce(n_name, 'Unknown') as title, coalesce(r_name, 'Unknown') as department from ids left join nation on n_nationkey = try_cast(role as int) left join region on r_regionkey = n_regionkey")
def state_enriched(spark, sf_dir):
    return replay.enriched(replay.state(D.ledger(spark, sf_dir), F.col("sequence_id") <= AT_SEQUENCE), D.table(spark, sf_dir, "roles"), D.table(spark, sf_dir, "departments"))


@query(D.with_sql("ledger") + f", e as (select employee_id, arg_max(action, sequence_id) as last from ledger where table_name = 'employees' and sequence_id <= {AT_SEQUENCE} group by 1) select c_custkey::int as employee_id, case when last is null then 'never_existed' when last = 'DELETE' then 'deleted' else 'ok' end as status from customer left join e on employee_id = c_custkey")
def state_lookup_status(spark, sf_dir):
    asked = D.table(spark, sf_dir, "employees").select(F.col("employee_id").cast("int").alias("employee_id"))
    return replay.lookup_status(D.ledger(spark, sf_dir), asked, F.col("sequence_id") <= AT_SEQUENCE)


@query(D.with_sql("ledger") + f" select employee_id, arg_max_null(amount, sequence_id) as amount from ledger where table_name = 'salary_history' and sequence_id <= {AT_SEQUENCE} group by 1", amount="double")
def salary_as_of_transaction(spark, sf_dir):
    return replay.last_entered_salary(D.ledger(spark, sf_dir), F.col("sequence_id") <= AT_SEQUENCE)


@query(D.with_sql("salaries") + " select employee_id, arg_max_null(amount, (effective_date, salary_id)) as amount from salaries where effective_date <= date '1997-01-01' group by 1", amount="double")
def salary_as_of_effective(spark, sf_dir):
    return replay.effective_salary(D.table(spark, sf_dir, "salaries"), F.col("effective_date") <= F.lit("1997-01-01").cast("date"))


_REPLAY = D.with_sql("salaries") + f""", s as (
  select employee_id, effective_date, arg_max(amount, salary_id) as a, arg_max(amount, salary_id) filter (not ({SKIPPED})) as c from salaries where effective_date <= date '{AS_OF}' group by 1, 2
), f as (
  select *, coalesce(last_value(c ignore nulls) over (partition by employee_id order by effective_date rows unbounded preceding), 0) as cf,
         date_diff('day', effective_date, coalesce(lead(effective_date) over (partition by employee_id order by effective_date), date '{AS_OF}')) as days from s
), r as (
  select employee_id, arg_max(a, effective_date) as actual, arg_max(cf, effective_date) as counterfactual, sum(greatest(0, a - cf) * days) as money, sum(case when a > cf then days else 0 end) as n from f group by 1
)"""


def _without(spark, sf_dir):
    rows = D.table(spark, sf_dir, "salaries")
    return replay.without(rows, rows.where(SKIPPED).select("salary_id"), F.lit(AS_OF).cast("date"))


@query(_REPLAY + " select employee_id, actual, counterfactual::decimal(12,2) as counterfactual, (actual - counterfactual)::decimal(13,2) as annual from r", actual="double", counterfactual="double", annual="double")
def counterfactual_annual(spark, sf_dir):
    return _without(spark, sf_dir).select("employee_id", "actual", "counterfactual", "annual")


@query(_REPLAY + " select employee_id, round(money::double / 365.2425, 2) as cumulative, round(n / 30.4375, 1) as tenure_months from r")
def counterfactual_cumulative(spark, sf_dir):
    return _without(spark, sf_dir).select("employee_id", "cumulative", "tenure_months")


@query(D.with_sql("ledger") + """ select sequence_id, case when table_name = 'salary_history' then action || ' salary ' || coalesce(json_extract_string(new_value_text, '$.amount'), 'none') when action <> 'UPDATE' then action || ' employee' else concat_ws(', ',
  case when json_extract_string(new_value_text, '$.role_id') is distinct from json_extract_string(old_value_text, '$.role_id') then 'role_id: ' || json_extract_string(old_value_text, '$.role_id') || ' -> ' || json_extract_string(new_value_text, '$.role_id') end,
  case when json_extract_string(new_value_text, '$.is_active') is distinct from json_extract_string(old_value_text, '$.is_active') then 'is_active: true -> false' end,
  case when json_extract_string(new_value_text, '$.full_name') is distinct from json_extract_string(old_value_text, '$.full_name') then 'full_name: ' || json_extract_string(old_value_text, '$.full_name') || ' -> ' || coalesce(json_extract_string(new_value_text, '$.full_name'), 'none') end) end as summary
from ledger where severity = 'WARNING'""")
def counterfactual_skipped_events(spark, sf_dir):
    summary = replay.delta_summary(*(F.col(c) for c in ("action", "table_name", "old_value_text", "new_value_text")))
    return D.ledger(spark, sf_dir).where("severity = 'WARNING'").select("sequence_id", summary.alias("summary"))


@query(D.with_sql("ledger") + """ select sequence_id, sequence_id % 7 = 3 as skipped, case when table_name = 'salary_history' then action || ' salary ' || coalesce(json_extract_string(new_value_text, '$.amount'), 'none') when action <> 'UPDATE' then action || ' employee' else concat_ws(', ',
  case when json_extract_string(new_value_text, '$.role_id') is distinct from json_extract_string(old_value_text, '$.role_id') then 'role_id: ' || json_extract_string(old_value_text, '$.role_id') || ' -> ' || json_extract_string(new_value_text, '$.role_id') end,
  case when json_extract_string(new_value_text, '$.is_active') is distinct from json_extract_string(old_value_text, '$.is_active') then 'is_active: true -> false' end,
  case when json_extract_string(new_value_text, '$.full_name') is distinct from json_extract_string(old_value_text, '$.full_name') then 'full_name: ' || json_extract_string(old_value_text, '$.full_name') || ' -> ' || coalesce(json_extract_string(new_value_text, '$.full_name'), 'none') end) end as summary
from ledger""")
def counterfactual_events_all(spark, sf_dir):
    """Every event summarised, and whether the counterfactual skips it."""
    summary = replay.delta_summary(*(F.col(c) for c in ("action", "table_name", "old_value_text", "new_value_text")))
    return D.ledger(spark, sf_dir).select("sequence_id", F.expr("sequence_id % 7 = 3").alias("skipped"), summary.alias("summary"))


# Rules.


@query(D.with_sql("salaries") + " select employee_id, salary_id, amount, before from (select *, lag(amount) over (partition by employee_id order by effective_date, salary_id) as before from salaries) where amount < 0.70::decimal(3,2) * before", amount="double", before="double")
def rule_decrease(spark, sf_dir):
    return rules.decreases(D.table(spark, sf_dir, "salaries")).select("employee_id", "salary_id", "amount", "before")


@query(_DIRECTORY + " select employee_id, role_id, amount from latest join employees using (employee_id) join roles using (role_id) where amount not between band_min and band_max", amount="double")
def rule_band(spark, sf_dir):
    latest = replay.effective_salary(D.table(spark, sf_dir, "salaries"), F.lit(True))
    return rules.out_of_band(latest, D.table(spark, sf_dir, "employees"), D.table(spark, sf_dir, "roles"))


@query(D.with_sql("ledger") + " select sequence_id, employee_id from ledger where table_name = 'salary_history' and action = 'INSERT' and actor_user_id <> 0 and actor_user_id = employee_id")
def rule_self(spark, sf_dir):
    return rules.own_salary(D.ledger(spark, sf_dir))


@query(D.with_sql("salaries") + " select employee_id, effective_date, count(*) as n from salaries group by 1, 2 having count(*) > 1", effective_date="string")
def rule_duplicate_date(spark, sf_dir):
    return rules.repeated_dates(D.table(spark, sf_dir, "salaries"))


@query(D.with_sql("ledger") + " select sequence_id, employee_id from ledger where table_name = 'employees' and action = 'UPDATE' and json_extract_string(old_value_text, '$.full_name') is distinct from json_extract_string(new_value_text, '$.full_name')")
def rule_immutable(spark, sf_dir):
    return rules.immutable(D.ledger(spark, sf_dir), "full_name")


@query(D.with_sql("ledger") + """, k as (select sequence_id, old_value_text as o, new_value_text as n, unnest(list_distinct(list_concat(coalesce(json_keys(old_value_text), []), coalesce(json_keys(new_value_text), [])))) as key from ledger),
v as (select *, list_contains(coalesce(json_keys(o), []), key) as ho, list_contains(coalesce(json_keys(n), []), key) as hn, json_extract_string(o, '$.' || key) as old, json_extract_string(n, '$.' || key) as new from k)
select sequence_id, key, old, new, case when not ho then 'Added' when not hn then 'Removed' else 'Changed' end as change from v where not ho or not hn or old is distinct from new""")
def payload_diff(spark, sf_dir):
    return search.field_changes(D.ledger(spark, sf_dir))


@query("select event_type, count(*) as n, round(min(value), 3) as least, round(max(value), 3) as most, round(avg(value), 3) as mean, round(quantile_cont(value, 0.5), 3) as p50, round(quantile_cont(value, 0.95), 3) as p95, round(quantile_cont(value, 0.99), 3) as p99, round(stddev_pop(value), 3) as deviation from events group by 1")
def latency_statistics(spark, sf_dir):
    return search.statistics(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_type", "value")


# Trust.


_LISTS = CHAIN + ", " + _sealed("chain") + """,
ours as (select employee_id, checkpoint + 1 as checkpoint_id, last_seq as sequence_id, digest, merkle_root, digest || merkle_root as signature from sealed where not (employee_id % 6 = 3 and checkpoint >= 1)),
theirs as (select employee_id, checkpoint + 1 as checkpoint_id, last_seq as sequence_id, digest, case when employee_id % 6 = 1 and checkpoint = 1 then repeat('0', 64) else merkle_root end as merkle_root,
  case when employee_id % 6 = 4 and checkpoint = 0 then 'forged' else digest || merkle_root end as signature from sealed where not (employee_id % 6 = 2 and checkpoint >= 2)),
a as (select *, row_number() over (partition by employee_id order by checkpoint_id) as place from ours), b as (select *, row_number() over (partition by employee_id order by checkpoint_id) as place from theirs),
d as (select coalesce(a.employee_id, b.employee_id) as employee_id, a.place is null as om, b.place is null as tm, (a.checkpoint_id, a.sequence_id, a.digest, a.merkle_root, a.signature) <> (b.checkpoint_id, b.sequence_id, b.digest, b.merkle_root, b.signature) as df
  from a full join b on a.employee_id = b.employee_id and a.place = b.place),
m as (select employee_id, bool_or(not regexp_full_match(signature, '[0-9a-f]{128}')) as malformed, max(sequence_id) as newest from theirs group by 1),
n as (select employee_id, count(*) filter (om) as ours_missing, count(*) filter (tm) as theirs_missing, count(*) filter (not om and not tm and df) as differs from d group by 1)"""


def _lists(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Every employee's checkpoints, and what is published of them: by employee as it is, changed, cut, longer than ours
    or malformed."""
    sealed = K.fixed(_chain(spark, sf_dir), INTERVAL)
    named = sealed.select("employee_id", (F.col("checkpoint") + 1).alias("checkpoint_id"), F.col("last_seq").alias("sequence_id"), F.col("digest").alias("checkpoint_hash"), "merkle_root", F.concat("digest", "merkle_root").alias("signature_hex"), F.lit("k1").alias("key_id"))
    theirs = named.where("NOT (employee_id % 6 = 2 AND checkpoint_id > 2)").withColumns({"merkle_root": F.expr("CASE WHEN employee_id % 6 = 1 AND checkpoint_id = 2 THEN repeat('0', 64) ELSE merkle_root END"), "signature_hex": F.expr("CASE WHEN employee_id % 6 = 4 AND checkpoint_id = 1 THEN 'forged' ELSE signature_hex END")})
    return named.where("NOT (employee_id % 6 = 3 AND checkpoint_id > 1)"), theirs


def _compared(minimum: int) -> str:
    return _LISTS + f" select employee_id, case when malformed then 'unknown' when newest < {minimum} or ours_missing > 0 or differs > 0 then 'fail' when theirs_missing > 0 then 'unknown' else 'pass' end as status, ours_missing, theirs_missing, differs from n join m using (employee_id)"


@query(_compared(5))
def anchor_prefix_compare(spark, sf_dir):
    """Every employee's checkpoints against the published list, which must reach position 5."""
    return trust.compare(*_lists(spark, sf_dir), minimum=5, keys=["employee_id"])


@query(_compared(0))
def anchor_prefix_compare_all(spark, sf_dir):
    """The same without a minimum."""
    return trust.compare(*_lists(spark, sf_dir), keys=["employee_id"])


_FORKS = " select employee_id, sequence_id, count(distinct merkle_root) as roots from (select * from ours union all select * from theirs) group by 1, 2 having count(distinct merkle_root) > 1"


@query(_LISTS + _FORKS)
def fork_detection(spark, sf_dir):
    ours, theirs = _lists(spark, sf_dir)
    return trust.forks(ours.unionByName(theirs), ["employee_id"])


@query(_LISTS + _FORKS)
def fork_detection_all(spark, sf_dir):
    """The same over the published list alone and ours, taken in the other order."""
    ours, theirs = _lists(spark, sf_dir)
    return trust.forks(theirs.unionByName(ours), ["employee_id"])


_SAID = CHAIN + f""", said as (select employee_id, (chain_seq - 1) // {INTERVAL} as sequence_id, chain_seq as witness, case when sequence_id % 50 > 0 then actor_user_id + 10 * (chain_seq % 40) end as key_id, 'D' || sequence_id % 1009 as domain, action <> 'DELETE' or sequence_id % 3 > 0 as valid from chain),
q as (select employee_id, sequence_id, count(*) as n, count(key_id) as trusted, count(distinct key_id) as ks, count(distinct domain) filter (key_id is not null) as ds, count(*) filter (key_id is not null and valid) as valid from said group by 1, 2)"""


def _said(spark, sf_dir):
    """Each row of a checkpoint as a witness's statement about it."""
    return _chain(spark, sf_dir).selectExpr("employee_id", f"(chain_seq - 1) div {INTERVAL} as sequence_id", "cast(chain_seq as string) as witness", "cast(CASE WHEN sequence_id % 50 > 0 THEN actor_user_id + 10 * (chain_seq % 40) END as string) as key_id", "concat('D', sequence_id % 1009) as domain", "action <> 'DELETE' OR sequence_id % 3 > 0 as valid")


def _judged(threshold: int) -> str:
    return _SAID + f" select employee_id, sequence_id, case when least(ks, ds, valid) < trusted then 'fail' when trusted < n or valid < {threshold} then 'unknown' else 'pass' end as status, valid from q"


@query(_judged(2))
def witness_quorum(spark, sf_dir):
    return trust.quorum(_said(spark, sf_dir), 2, ["employee_id"])


@query(_judged(4))
def witness_quorum_all(spark, sf_dir):
    """The same with a threshold of four."""
    return trust.quorum(_said(spark, sf_dir), 4, ["employee_id"])


# Limits, secrets and streams.


@query("select user_id, epoch_us(ts) // 3600000000 as slot, count(*) as requests, least(count(*), 4) as consumed, greatest(count(*) - 3, 0) as refused from events group by 1, 2")
def request_budget_fixed(spark, sf_dir):
    return limits.budget(spark.read.parquet(f"{sf_dir}/events.parquet"), "user_id", "ts", 3, 3600)


@query("""with recursive o as (select event_id, user_id, ts, row_number() over (partition by user_id order by ts, event_id) as i from events),
r as (select user_id, i, event_id, [ts] as seen, true as allowed from o where i = 1
  union all select o.user_id, o.i, o.event_id, case when len(k) < 3 then list_append(k, o.ts) else k end, len(k) < 3
  from (select r.*, list_filter(r.seen, lambda x: o2.ts - x < interval 1 day) as k from r join o o2 on o2.user_id = r.user_id and o2.i = r.i + 1) r join o on o.user_id = r.user_id and o.i = r.i + 1)
select event_id, user_id, allowed from r""")
def rate_limit_sliding(spark, sf_dir):
    return limits.sliding(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "ts"), "user_id", "ts", "event_id", 3, 86400).select("event_id", "user_id", "allowed")


_KEY = b"example key, not a secret"
_PADS = [bytes(x ^ y for x, y in zip(_KEY.ljust(64, b"\0"), [pad] * 64)).hex() for pad in (0x36, 0x5C)]
_HMAC = f"sha256(unhex('{_PADS[1]}') || unhex(sha256(unhex('{_PADS[0]}') || encode({{0}}))))"


@query(D.with_sql("ledger") + f" select sequence_id, employee_id from ledger where action = 'INSERT' and table_name = 'employees' and {_HMAC.format('employee_id::varchar')} = {_HMAC.format(chr(39) + '42' + chr(39))}")
def blind_index_search(spark, sf_dir):
    """Rows whose payload has the blind index of an identity number; the digest of the one asked for is worked out once."""
    rows = D.ledger(spark, sf_dir).where("action = 'INSERT' AND table_name = 'employees'")
    index = S.blind_index(F.col("employee_id").cast("string"), _KEY)
    rows = rows.withColumn("new_value_text", F.to_json(F.struct(index.alias("national_id_blind_index"))))
    asked = S.hmac_hex(_KEY, "42")
    return search.search(rows, blind_index=asked).select("sequence_id", "employee_id")


def _shared(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: under spark.checkpoint.dir, or the warehouse where none is named."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _streamed(spark, stream: DataFrame, mode: str = "append") -> DataFrame:
    base = _shared(spark, "stream")
    jobs.to_files(stream, f"{base}/out", f"{base}/state", mode).awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


@query(CHAIN + " select sequence_id, employee_id, chain_seq, previous_hash, entry_hash from chain")
def stream_chain(spark, sf_dir):
    events = jobs.source(spark, f"{sf_dir}/events.parquet").selectExpr("*", "cast(get_json_object(props, '$.k') as int) as k").selectExpr(*D.select(D.LEDGER))
    return _streamed(spark, jobs.chained(events))
