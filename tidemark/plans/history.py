"""Replays over two time axes: what salaries and states would be without some rows, over the corrected ledger."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.operators import bitemporal as B
from tidemark.operators import replay
from tidemark.plans.catalogue import AT_SEQUENCE, query
from tidemark.sources import derived as D

AS_OF = "2024-01-24 12:00:00"
SKIPPED = "sequence_id % 7 in (2, 3)"

_P = "case when action = 'DELETE' then old_value_text else new_value_text end"
_E = "substr(json_extract_string(p, '$.effective_date'), 1, 10)"


def _sound(as_of: str) -> str:
    """CTEs up to `sound`: the whole salary writes of the corrected ledger up to a time."""
    return D.with_sql("corrected") + f""",
entered as (select employee_id, sequence_id, created_at::date as day, action = 'DELETE' as gone, try_cast(json_extract_string(p, '$.amount') as decimal(12,2)) as amount,
  case when list_contains(coalesce(json_keys(p), []), 'salary_history_id') then try_cast(json_extract_string(p, '$.salary_history_id') as bigint) else row_id end as salary_id,
  coalesce(case when regexp_full_match({_E}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') then try_cast({_E} as date) end, created_at::date) as effective
  from (select *, {_P} as p from corrected where table_name = 'salary_history' and action in ('INSERT', 'UPDATE', 'DELETE') and created_at <= timestamp '{as_of}')),
sound as (select * from entered where salary_id is not null and (gone or amount is not null))"""


_VERSIONS = _sound(AS_OF) + f""",
tracked as (select 'actual' as track, * from sound union all select 'counterfactual', * from sound where not ({SKIPPED})),
versions as (select *, greatest(day, effective) as since, lead(day) over (partition by track, employee_id, salary_id order by sequence_id) as until from tracked)"""

# Day by day: every employee on every day, with the best version of either track.
_REPLAYED = _VERSIONS + f""",
counts as (select employee_id, count(*) filter ({SKIPPED}) as skipped, count(*) filter (not ({SKIPPED})) as applied, min(created_at) filter ({SKIPPED}) as first_skipped, min(created_at)::date as first_day
  from corrected where created_at <= timestamp '{AS_OF}' group by 1),
days as (select employee_id, unnest(generate_series(first_day::timestamp, timestamp '{AS_OF}', interval 1 day))::date as d from counts),
held as (select d.employee_id, d.d, coalesce(arg_max(amount, (effective, salary_id)) filter (track = 'actual'), 0) as a, coalesce(arg_max(amount, (effective, salary_id)) filter (track = 'counterfactual'), 0) as c
  from days d left join versions v on v.employee_id = d.employee_id and not gone and since <= d.d and (until is null or d.d < until) group by 1, 2),
totals as (select employee_id, arg_max(a, d) as actual, arg_max(c, d) as counterfactual, sum(case when d < date '{AS_OF[:10]}' then greatest(0, a - c) end) as money, count(*) filter (d < date '{AS_OF[:10]}' and a > c) as n from held group by 1)
select employee_id, skipped, applied, first_skipped, actual, counterfactual, greatest(0, actual - counterfactual) as annual, coalesce(round(money::double / 365.2425, 2), 0) as cumulative, round(n / 30.4375, 1) as tenure_months
from counts join totals using (employee_id)"""


def _skipped(rows):
    return rows.where(SKIPPED).select("sequence_id")


def _as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp_ntz")


@query(_REPLAYED, actual="double", counterfactual="double", annual="double", first_skipped="string")
def bitemporal_counterfactual(spark, sf_dir):
    """Every employee's salary as it is and without the skipped rows, and the money and time above it, judged each day by
    what was known on it."""
    rows = D.ledger(spark, sf_dir, D.CORRECTED)
    return B.replayed(rows, _skipped(rows), _as_of())


@query(_VERSIONS + f" select employee_id, track, salary_id, amount, effective, since, least(until, date '{AS_OF[:10]}' + 1) as until from versions where not gone and since < coalesce(least(until, date '{AS_OF[:10]}' + 1), date '{AS_OF[:10]}' + 1)", amount="double", effective="string", since="string", until="string")
def salary_versions(spark, sf_dir):
    """Every version of every salary row with the days over which it is known and holds, in both tracks."""
    rows = D.ledger(spark, sf_dir, D.CORRECTED)
    held = B.spans(B.salary_events(rows, _as_of()), _skipped(rows), B.day(_as_of()))
    return held.withColumns({c: F.date_add(F.lit("1970-01-01").cast("date"), F.col(c)) for c in ("effective", "since", "until")})


def _states(rows: str, name: str, until: str, blank: str = "keep") -> str:
    resets, stays = ("", "INSERT") if blank == "keep" else (" or new_value_text is null", "INSERT")
    return f"""{name}_e as (select * from {rows} where table_name = 'employees' and {until}),
{name}_r as (select employee_id, max(sequence_id) as last_at, arg_max(action, sequence_id) as what from {name}_e where action <> 'UPDATE'{resets} group by 1),
{name}_l as (select e.* from {name}_e e left join {name}_r using (employee_id) where last_at is null or sequence_id > last_at or (sequence_id = last_at and {"what <> 'DELETE'" if blank == 'empty' else f"what = '{stays}'"})),
{name}_x as (select employee_id, sequence_id, new_value_text, unnest(json_keys(new_value_text)) as key from {name}_l where new_value_text is not null),
{name}_v as (select employee_id, key, arg_max_null(json_extract_string(new_value_text, '$.' || key), sequence_id) as value from {name}_x group by 1, 2),
{name} as (select employee_id, coalesce(string_agg(key || '=' || coalesce(value, 'null'), ',' order by key), '') as state from (select distinct employee_id from {name}_l{'' if blank == 'empty' else ' where new_value_text is not null'}) left join {name}_v using (employee_id) group by 1)"""


def _shown(state: str) -> Column:
    return F.array_join(F.transform(F.map_entries(state), lambda x: F.concat(x["key"], F.lit("="), F.coalesce(x["value"], F.lit("null")))), ",")


_UNTIL = f"created_at <= timestamp '{AS_OF}'"


@query(D.with_sql("corrected") + f", kept as (select * from corrected where not ({SKIPPED})), " + _states("corrected", "sa", _UNTIL) + ", " + _states("kept", "sc", _UNTIL) + " select employee_id, sa.state as actual, sc.state as counterfactual from sa full join sc using (employee_id)")
def counterfactual_states(spark, sf_dir):
    """Every employee's state as it is and without the skipped rows."""
    rows = D.ledger(spark, sf_dir, D.CORRECTED)
    out = B.documents(rows, _skipped(rows), _as_of())
    return out.select("employee_id", _shown("actual").alias("actual"), _shown("counterfactual").alias("counterfactual"))


@query(D.with_sql("corrected") + f", by_time as (with recursive " + _states("corrected", "st", _UNTIL, "none") + " select * from st), by_sequence as (with recursive " + _states("corrected", "ss", f"sequence_id <= {AT_SEQUENCE}", "empty") + " select * from ss) select employee_id, t.state as by_time, s.state as by_sequence from by_time t full join by_sequence s using (employee_id)")
def state_documents_by_axis(spark, sf_dir):
    """Every employee's state by time, where an UPDATE without payload leaves none, and by sequence, where it leaves an
    empty one."""
    rows = D.ledger(spark, sf_dir, D.CORRECTED)
    by_time = replay.documents(rows, F.col("created_at") <= _as_of()).select("employee_id", _shown("state").alias("by_time"))
    by_sequence = replay.documents(rows, F.col("sequence_id") <= AT_SEQUENCE, "empty").select("employee_id", _shown("state").alias("by_sequence"))
    return by_time.join(by_sequence, "employee_id", "full")


_ASKED = "case when sequence_id % 10 = 0 then sequence_id + 1000000000 when sequence_id % 10 = 1 then sequence_id + 1 when sequence_id % 10 > 2 then sequence_id end"


@query(D.with_sql("corrected") + f""", asked as (select distinct employee_id, {_ASKED} as sequence_id from corrected),
found as (select a.employee_id, a.sequence_id, c.sequence_id is not null as there, c.created_at <= timestamp '{AS_OF}' and (c.employee_id = a.employee_id or (c.table_name = 'employees' and c.row_id = a.employee_id)) as inside from asked a left join corrected c on c.sequence_id = a.sequence_id)
select employee_id, sequence_id, case when sequence_id is null then 'nothing_asked' when not there then 'not_in_ledger' when inside then 'ok' else 'not_in_stream' end as status from found""")
def counterfactual_asked(spark, sf_dir):
    """Whether each requested row can be skipped: whether the ledger has it, and the employee's stream up to the time."""
    rows = D.ledger(spark, sf_dir, D.CORRECTED)
    return B.asked_status(rows, rows.select("employee_id", F.expr(_ASKED).alias("sequence_id")), _as_of())
