"""A change ledger and its dimensions, derived from the star-schema tables by expressions that Spark and DuckDB share.

events become the ledger, orders the effective-dated amounts, customer the employees, nation the roles, region the
departments and supplier the users.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: column -> SQL over events and k, the number in props.
LEDGER = {
    "sequence_id": "event_id + 1",
    "actor_user_id": "k % 10",
    "employee_id": "cast(user_id as int)",
    "action": "case event_type when 'signup' then 'INSERT' when 'purchase' then 'INSERT' when 'error' then 'DELETE' else 'UPDATE' end",
    "table_name": "case when event_type = 'purchase' then 'salary_history' else 'employees' end",
    "row_id": "cast(user_id as int)",
    "old_value_text": """case event_type when 'view' then '{"is_active": "true"}'
        when 'click' then '{"full_name": "Name ' || cast(k % 13 as string) || '", "role_id": "' || cast(k % 25 as string) || '"}'
        when 'error' then '{"employee_id": "' || cast(user_id as string) || '"}' end""",
    "new_value_text": """case event_type
        when 'signup' then '{"employee_id": "' || cast(user_id as string) || '", "full_name": "Employee ' || cast(user_id as string) || '", "is_active": "true", "role_id": "' || cast(k % 25 as string) || '"}'
        when 'click' then '{"full_name": ' || case when k % 7 = 0 then 'null' else '"Name ' || cast(k % 11 as string) || '"' end || ', "role_id": "' || cast((k + 1) % 25 as string) || '"}'
        when 'view' then '{"is_active": "false"}'
        when 'purchase' then '{"amount": "' || cast(cast(value as decimal(12,2)) as string) || '", "employee_id": "' || cast(user_id as string) || '", "salary_history_id": "' || cast(event_id + 1 as string) || '"}' end""",
    "severity": "case when event_type = 'error' then 'CRITICAL' when event_type = 'purchase' then 'WARNING' else 'INFO' end",
    "amount": "case when event_type = 'purchase' then cast(value as decimal(12,2)) end",
    "created_at": "ts",
    "created_at_text": "cast(ts as string)",
}
#: The same with salaries that are corrected: several rows of a salary id, dates before and after the day of entry, rows
#: taken away, payloads without id or with a date that is none, updates of employees without payload.
CORRECTED = LEDGER | {
    "action": "case when event_type = 'purchase' and k % 6 = 0 then 'DELETE' when event_type = 'purchase' and k % 6 < 3 then 'UPDATE' else " + LEDGER["action"] + " end",
    "row_id": "cast(case when event_type = 'purchase' then user_id * 4 + k % 4 else user_id end as int)",
    "old_value_text": """case when event_type = 'purchase' and k % 6 = 0 then '{"salary_history_id": "' || cast(user_id * 4 + k % 4 as string) || '"}' when event_type <> 'purchase' then """ + LEDGER["old_value_text"] + " end",
    "new_value_text": """case when event_type = 'purchase' and k % 6 > 0 then '{"amount": "' || case when k % 23 = 5 then 'none' else cast(cast(value as decimal(12,2)) as string) end || '"'
        || case when k % 11 = 0 then '' else ', "salary_history_id": "' || cast(user_id * 4 + k % 4 as string) || '"' end
        || case when k % 10 = 1 then '' when k % 10 = 2 then ', "effective_date": "soon"' else ', "effective_date": "' || cast(cast(ts as date) + cast(k % 40 - 20 as int) as string) || 'T00:00:00"' end || '}'
        when event_type <> 'purchase' and not (event_type = 'click' and k % 5 = 0) then """ + LEDGER["new_value_text"] + " end",
    "amount": "case when event_type = 'purchase' and k % 6 > 0 and k % 23 <> 5 then cast(value as decimal(12,2)) end",
}
SALARIES = {"employee_id": "o_custkey", "salary_id": "o_orderkey", "amount": "cast(o_totalprice as decimal(12,2))", "effective_date": "cast(o_orderdate as date)"}
EMPLOYEES = {"employee_id": "c_custkey", "full_name": "c_name", "email": "lower(c_name) || '@example.com'", "role_id": "c_nationkey", "is_active": "c_acctbal >= 0"}
ROLES = {"role_id": "n_nationkey", "title": "n_name", "department_id": "n_regionkey", "band_min": "cast(10000 + 1000 * n_nationkey as decimal(12,2))", "band_max": "cast(250000 + 5000 * n_nationkey as decimal(12,2))"}
DEPARTMENTS = {"department_id": "r_regionkey", "department": "r_name"}
USERS = {"user_id": "cast(s_suppkey as int)", "full_name": "case s_suppkey % 3 when 0 then 'Unknown' when 1 then s_name else '  ' end", "email": "case when s_suppkey % 5 = 0 then '' else lower(s_name) || '@example.com' end"}
TABLES = {"salaries": ("orders", SALARIES), "employees": ("customer", EMPLOYEES), "roles": ("nation", ROLES), "departments": ("region", DEPARTMENTS), "users": ("supplier", USERS)}


def select(columns: dict[str, str]) -> list[str]:
    return [f"{x} as {name}" for name, x in columns.items()]


def ledger(spark: SparkSession, sf_dir: str, columns: dict[str, str] = LEDGER) -> DataFrame:
    """The ledger: one row for each event, in order of sequence_id."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.selectExpr("*", "cast(get_json_object(props, '$.k') as int) as k").selectExpr(*select(columns))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of TABLES."""
    source, columns = TABLES[name]
    return spark.read.parquet(f"{sf_dir}/{source}.parquet").selectExpr(*select(columns))


def with_sql(*names: str) -> str:
    """A WITH clause for DuckDB that defines the named tables; `ledger`, `corrected` and those of TABLES."""
    out = []
    for name in names:
        if name in ("ledger", "corrected"):
            out.append(f"{name} as (select " + ", ".join(select(LEDGER if name == "ledger" else CORRECTED)) + " from (select *, cast(json_extract_string(props, '$.k') as int) as k from events))")
        else:
            source, columns = TABLES[name]
            out.append(f"{name} as (select " + ", ".join(select(columns)) + f" from {source})")
    return "with recursive " + ",\n".join(out)
