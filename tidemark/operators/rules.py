"""Business rules as queries for what violates them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import ordered as O


def decreases(salaries: DataFrame, least: str = "0.70") -> DataFrame:
    """Salaries below `least` of the employee's one before by (effective_date, salary_id); the first is always allowed."""
    rows = O.previous(salaries, ["employee_id"], F.year("effective_date"), ["effective_date", "salary_id"], {"before": "amount"})
    return rows.where(F.col("amount") < F.lit(least).cast("decimal(3,2)") * F.col("before"))


def immutable(ledger: DataFrame, key: str = "national_id") -> DataFrame:
    """UPDATEs that change a key that must not change; null and absent are the same."""
    was, now = (F.get_json_object(c, f"$.{key}") for c in ("old_value_text", "new_value_text"))
    return ledger.where((F.col("action") == "UPDATE") & (F.col("table_name") == "employees") & ~was.eqNullSafe(now)).select("sequence_id", "employee_id")


def own_salary(ledger: DataFrame) -> DataFrame:
    """Salary rows that an actor entered for themselves; actor 0 is the system."""
    return ledger.where("table_name = 'salary_history' AND action = 'INSERT' AND actor_user_id <> 0 AND actor_user_id = employee_id").select("sequence_id", "employee_id")


def out_of_band(current: DataFrame, employees: DataFrame, roles: DataFrame) -> DataFrame:
    """Employees whose current salary (employee_id, amount) lies outside their role's band, ends included in the band."""
    rows = current.join(employees.select("employee_id", "role_id"), "employee_id").join(roles.select("role_id", "band_min", "band_max"), "role_id")
    return rows.where(~F.col("amount").between(F.col("band_min"), F.col("band_max"))).select("employee_id", "role_id", "amount")


def repeated_dates(salaries: DataFrame) -> DataFrame:
    return salaries.groupBy("employee_id", "effective_date").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def batch_errors(batch: DataFrame, most: int = 20, keys: Sequence[str] = ()) -> DataFrame:
    """The faults of each batch, by the keys: too many rows, e-mails that repeat whatever their case."""
    rows = batch.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.lower(F.trim("email"))).alias("emails"), F.count("email").alias("named"))
    return rows.select(*keys, (F.col("n") > most).alias("too_many"), (F.col("emails") < F.col("named")).alias("repeated_email"))


def repeated(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Values of the keys that more than one row has, with their number."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
