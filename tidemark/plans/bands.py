"""Salaries against the bands of their roles over time: the corrected ledger's salary and role writes, and band edits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import bands as R
from tidemark.operators import bitemporal as B
from tidemark.plans.catalogue import query
from tidemark.plans.history import _sound
from tidemark.sources import derived as D

#: The ledger's rows that stand for an edit of a band, and the edit; a role's first band is written before the ledger.
EDITED = "table_name = 'employees' and action = 'UPDATE' and old_value_text = '{\"is_active\": \"true\"}' and sequence_id % 7 = 0"
EDIT = {"role_id": "cast(sequence_id % 25 as bigint)", "band_min": "cast(10 + sequence_id % 11 as decimal(12,2))", "band_max": "cast(120 + sequence_id % 97 as decimal(12,2))", "place": "sequence_id"}
FIRST = {"role_id": "cast(n_nationkey as bigint)", "band_min": "cast(5 + n_nationkey as decimal(12,2))", "band_max": "cast(200 + 5 * n_nationkey as decimal(12,2))", "place": "cast(0 as bigint)"}

_HISTORIES = _sound("9999-01-01") + f""",
salary as (select employee_id, sequence_id as place, salary_id, case when not gone then amount end as amount, effective, lead(sequence_id) over (partition by salary_id order by sequence_id) as until from sound),
role as (select *, lag(role_id) over w as was, lead(place) over w as until from (
  select employee_id, sequence_id as place, case when action <> 'DELETE' then try_cast(json_extract_string(new_value_text, '$.role_id') as bigint) end as role_id from corrected
  where table_name = 'employees' and (action = 'DELETE' or list_contains(coalesce(json_keys(new_value_text), []), 'role_id'))) window w as (partition by employee_id order by place)),
band as (select *, lag(row(band_min, band_max)) over (partition by role_id order by place) as was from (
  select {', '.join(D.select(EDIT))} from corrected where {EDITED} union all select {', '.join(D.select(FIRST))} from nation)),
written as (select w.employee_id, w.place, w.amount, r.role_id from salary w asof join role r on w.employee_id = r.employee_id and w.place > r.place where w.amount is not null),
moved as (select employee_id, place, role_id from role where role_id <> was),
asked as (select 'salary' as kind, employee_id, place, role_id, amount from written union all select 'role', employee_id, place, role_id, null from moved),
held as (select a.*, band_min, band_max from asked a asof join band b on a.role_id = b.role_id and a.place > b.place),
edited as (select 'band' as kind, r.employee_id, b.place, b.role_id, band_min, band_max from band b join role r on r.role_id = b.role_id and r.place <= b.place and (r.until is null or b.place < r.until) where b.was is not null and b.was <> row(b.band_min, b.band_max)),
points as (select kind, employee_id, place, role_id, band_min, band_max from held where kind = 'role' union all select * from edited),
every as (select kind, employee_id, place, role_id, amount, band_min, band_max from held where kind = 'salary'
  union all select p.kind, p.employee_id, p.place, p.role_id, arg_max(s.amount, (s.effective, s.salary_id)), p.band_min, p.band_max from points p join salary s on s.employee_id = p.employee_id and s.amount is not null and s.place <= p.place and (s.until is null or p.place < s.until) group by all),
violations as (select * from every where amount < band_min or amount > band_max)"""


def _violations(spark, sf_dir) -> DataFrame:
    ledger = D.ledger(spark, sf_dir, D.CORRECTED)
    salaries = B.salary_events(ledger, F.lit("9999-01-01").cast("timestamp_ntz")).withColumnRenamed("sequence_id", "place").withColumn("amount", F.when(~F.col("gone"), F.col("amount")))
    gone = F.col("action") == "DELETE"
    names = F.coalesce(F.array_contains(F.json_object_keys("new_value_text"), "role_id"), F.lit(False))
    roles = ledger.where((F.col("table_name") == "employees") & (gone | names))
    roles = roles.select("employee_id", F.when(~gone, F.expr("try_cast(get_json_object(new_value_text, '$.role_id') as bigint)")).alias("role_id"), F.col("sequence_id").alias("place"))
    first = spark.read.parquet(f"{sf_dir}/nation.parquet").selectExpr(*D.select(FIRST))
    return R.violations(salaries, roles, ledger.where(EDITED).selectExpr(*D.select(EDIT)).unionByName(first))


@query(_HISTORIES + " select place, kind, employee_id, role_id, amount, band_min, band_max from violations", amount="double", band_min="double", band_max="double")
def rule_band_history(spark, sf_dir):
    """Every write that left a salary outside a band: salaries, changes of role, and edits of a band for each who held it."""
    return _violations(spark, sf_dir)


@query(_HISTORIES + " select role_id, kind, count(*) as n, count(distinct employee_id) as employees from violations group by 1, 2")
def rule_band_by_role(spark, sf_dir):
    """How many writes of each kind broke a role's bands, and for how many employees."""
    return _violations(spark, sf_dir).groupBy("role_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("employee_id").alias("employees"))
