"""What comes from outside: import files judged row by row, and excerpts of chains verified without their beginning."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import chain as CH
from tidemark.plans.catalogue import _SERIAL, BAD, _bad_chain, query
from tidemark.sources import derived as D
from tidemark.sources import imports, shared

#: Positions of an excerpt.
EXCERPT = 20

_CASE = "employee_id % 17"
#: Import rows with the faults of a careless file, by expressions that Spark and DuckDB share: names without letters, with
#: quotes and commas, shared and missing addresses, unknown roles and departments, days and salaries that are none.
_FIELDS = {
    "full_name": f"case {_CASE} when 1 then null when 2 then '\"Q\", ' || full_name else full_name end",
    "email": f"case {_CASE} when 3 then 'no address' when 4 then 'Shared' || cast(employee_id % 5 as string) || '@example.com' when 5 then null when 14 then upper(email) else email end",
    "job_title": f"case {_CASE} when 6 then 'Nobody' when 7 then lower(title) else title end",
    "department": f"case {_CASE} when 8 then 'Nowhere' when 7 then lower(department) when 15 then null else department end",
    "national_id": "cast(employee_id as string)",
    "contact_info": "'c' || cast(role_id as string)",
    "date_hired": f"case {_CASE} when 9 then '2023-02-29' when 10 then 'soon' when 16 then '2024-2-1' else '2024-02-29' end",
    "salary": f"case {_CASE} when 11 then '1.234' when 12 then '-5' when 13 then null else cast(employee_id as string) || '.50' end",
}
_FILE = D.with_sql("employees", "roles", "departments") + ", file as (select " + ", ".join(D.select(_FIELDS)) + " from employees join roles using (role_id) join departments using (department_id))"
_FAULTS = {
    "name": "length(trim(full_name)) between 1 and 200",
    "email": "regexp_full_match(trim(email), '[^@ ]+@[^@ ]+[.][^@ ]+')",
    "repeated_email": "same = 1",
    "role": "matches = 1",
    "date": "regexp_full_match(date_hired, '[0-9]{4}-[0-9]{2}-[0-9]{2}') and try_cast(date_hired as date) is not null",
    "salary": "regexp_full_match(salary, '[0-9]{1,10}([.][0-9]{1,2})?')",
}
_NAMED = ", ".join(f"case when not coalesce({ok}, false) then '{name}' end" for name, ok in _FAULTS.items())
_JUDGED = f""", known as (select lower(title) as t, lower(department) as d, count(*) as matches from roles join departments using (department_id) group by all),
judged as (select f.*, matches, count(*) over (partition by lower(trim(email))) as same from file f left join known on lower(trim(job_title)) = t and lower(trim(f.department)) = d)"""


@query(_FILE + _JUDGED + f" select national_id, concat_ws(',', {_NAMED}) as faults from judged")
def import_faults(spark, sf_dir):
    """Every employee as a row of an import file, and what is wrong with it. The file goes through CSV and back."""
    tables = {n: D.table(spark, sf_dir, n) for n in ("employees", "roles", "departments")}
    rows = tables["employees"].join(tables["roles"], "role_id").join(tables["departments"], "department_id").selectExpr(*D.select(_FIELDS))
    path = shared.folder(spark, "import")
    imports.write(rows, path)
    return imports.faults(imports.read(spark, path), tables["roles"], tables["departments"]).selectExpr("national_id", "array_join(faults, ',') as faults")


_EXCERPTS = f""", cut as (select *, (chain_seq - 1) // {EXCERPT} as excerpt, sha256({_SERIAL} || previous_hash) as recomputed from bad),
held as (select *, recomputed <> entry_hash as mismatch, chain_seq <> coalesce(lag(chain_seq) over w, chain_seq - 1) + 1 as gap, previous_hash <> coalesce(lag(recomputed) over w, previous_hash) as orphan
  from cut window w as (partition by employee_id, excerpt order by chain_seq))"""


@query(BAD + _EXCERPTS + " select employee_id, excerpt, min(chain_seq) as first_seq, count(*) as entries, count(*) filter (mismatch) as mismatches, count(*) filter (gap) as gaps, count(*) filter (orphan) as orphans from held group by 1, 2")
def chain_excerpts(spark, sf_dir):
    """Every chain cut into excerpts, each verified as if it had come alone: its first row is trusted, position and previous
    hash included, so a row missing between two excerpts shows in neither, and all else within one does."""
    rows = _bad_chain(spark, sf_dir).withColumn("excerpt", F.floor((F.col("chain_seq") - 1) / EXCERPT))
    held = CH.links(rows, ("employee_id", "excerpt"), seed=None)
    counts = [F.count_if(F.col(c)).alias(n) for c, n in (("mismatch", "mismatches"), ("gap", "gaps"), ("orphan", "orphans"))]
    return held.groupBy("employee_id", "excerpt").agg(F.min("chain_seq").alias("first_seq"), F.count(F.lit(1)).alias("entries"), *counts)
