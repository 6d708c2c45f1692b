"""State as of a point of the ledger, effective salaries, and what history would have been without some events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import ordered as O

#: Mean days of a year and of a month.
YEAR_DAYS, MONTH_DAYS = 365.2425, 30.4375


def state(ledger: DataFrame, until: Column) -> DataFrame:
    """employee_id, key, value of every employee after the rows where `until` holds; one row for each key.

    A state without keys has no row here; `documents` has one row for it.
    """
    pairs = _live(ledger, until).select("employee_id", "sequence_id", F.explode(X.payload(F.col("new_value_text"))).alias("key", "value"))
    return pairs.groupBy("employee_id", "key").agg(F.max_by("value", "sequence_id").alias("value"))


def _live(ledger: DataFrame, until: Column, blank: str = "none") -> DataFrame:
    """The rows that make up the state: INSERT replaces it, UPDATE merges its payload (a null value overwrites and keeps
    the key), DELETE clears it. So only rows from the last INSERT or after the last of the others count.

    An UPDATE without payload, by `blank`: none clears the state, empty leaves one without keys, keep changes nothing."""
    rows = ledger.where((F.col("table_name") == "employees") & until)
    resets = F.col("action") != "UPDATE"
    if blank != "keep":
        resets = resets | F.col("new_value_text").isNull()
    reset = rows.where(resets).groupBy("employee_id").agg(F.max(F.struct("sequence_id", "action")).alias("reset"))
    stays = (F.col("action") != "DELETE") if blank == "empty" else (F.col("action") == "INSERT")
    live = rows.join(reset, "employee_id", "left").where(F.col("reset").isNull() | (F.col("sequence_id") > F.col("reset.sequence_id")) | ((F.col("sequence_id") == F.col("reset.sequence_id")) & stays))
    return live if blank == "empty" else live.where(F.col("new_value_text").isNotNull())


def documents(ledger: DataFrame, until: Column, blank: str = "none") -> DataFrame:
    """employee_id, state (a map, empty where no key is left): one row for every employee that has a state. The state by
    time takes an UPDATE without payload as none, that by sequence as empty."""
    rows = _live(ledger, until, blank).withColumn("_p", F.coalesce(X.payload(F.col("new_value_text")), F.create_map().cast("map<string,string>")))
    pairs = rows.select("employee_id", "sequence_id", F.explode_outer("_p").alias("key", "value"))
    last = pairs.groupBy("employee_id", "key").agg(F.max_by("value", "sequence_id").alias("value"))
    entries = F.collect_list(F.when(F.col("key").isNotNull(), F.struct("key", "value")))
    return last.groupBy("employee_id").agg(F.map_from_entries(F.array_sort(entries)).alias("state"))


def lookup_status(ledger: DataFrame, asked: DataFrame, until: Column) -> DataFrame:
    """For each asked employee_id: ok, deleted, or never_existed as of `until`."""
    rows = ledger.where((F.col("table_name") == "employees") & until).groupBy("employee_id").agg(F.max_by("action", "sequence_id").alias("last"))
    status = F.when(F.col("last").isNull(), "never_existed").when(F.col("last") == "DELETE", "deleted").otherwise("ok")
    return asked.join(rows, "employee_id", "left").select("employee_id", status.alias("status"))


def enriched(states: DataFrame, roles: DataFrame, departments: DataFrame) -> DataFrame:
    """employee_id, title, department by the state's role_id, Unknown where there is none."""
    role = states.where(F.col("key") == "role_id").select("employee_id", F.expr("try_cast(value as int)").alias("role_id"))
    out = states.select("employee_id").distinct().join(role, "employee_id", "left").join(roles.select("role_id", "title", "department_id"), "role_id", "left").join(departments, "department_id", "left")
    return out.select("employee_id", F.coalesce("title", F.lit("Unknown")).alias("title"), F.coalesce("department", F.lit("Unknown")).alias("department"))


def last_entered_salary(ledger: DataFrame, until: Column) -> DataFrame:
    """Transaction time: the amount of the last salary row entered, whatever its effective date; null after a DELETE."""
    return ledger.where((F.col("table_name") == "salary_history") & until).groupBy("employee_id").agg(F.max_by("amount", "sequence_id").alias("amount"))


def effective_salary(salaries: DataFrame, until: Column) -> DataFrame:
    """Valid time: the amount of the latest effective date, ties by salary_id."""
    return salaries.where(until).groupBy("employee_id").agg(F.max_by("amount", F.struct("effective_date", "salary_id")).alias("amount"))


def without(salaries: DataFrame, skipped: DataFrame, as_of: Column) -> DataFrame:
    """Each employee's salary as it is and as it would be without the rows whose salary_id is in `skipped`.

    employee_id, actual, counterfactual and annual (their difference) on as_of; cumulative: the money paid above the
    counterfactual over all days before as_of, by the mean year; tenure_months: the days so paid, by the mean month.
    Employees without any row before as_of are left out. Both tracks are step functions; the integral is a sum over the
    days between neighbouring dates, so nothing is replayed row by row.
    """
    rows = salaries.join(skipped.select("salary_id").distinct().withColumn("_skip", F.lit(True)), "salary_id", "left").where(F.col("effective_date") <= as_of)
    skip = F.coalesce("_skip", F.lit(False))
    steps = rows.groupBy("employee_id", "effective_date").agg(F.max_by("amount", "salary_id").alias("a"), F.max_by("amount", F.when(~skip, F.col("salary_id"))).alias("c"), F.count_if(~skip).alias("kept"))
    era = F.floor(F.datediff("effective_date", F.lit("1970-01-01").cast("date")) / 366)
    steps = O.carried(steps, ["employee_id"], era, ["effective_date"], F.col("c"), "cf", F.col("kept") > 0).withColumn("cf", F.coalesce("cf", F.lit(0).cast("decimal(12,2)")))
    later = O.previous(steps.withColumn("_down", -F.datediff("effective_date", F.lit("1970-01-01").cast("date"))), ["employee_id"], F.floor(F.col("_down") / 366), ["_down"], {"until": "effective_date"})
    days = F.datediff(F.coalesce("until", as_of), "effective_date")
    gain = F.greatest(F.lit(0).cast("decimal(12,2)"), F.col("a") - F.col("cf"))
    out = later.groupBy("employee_id").agg(F.max_by("a", "effective_date").alias("actual"), F.max_by("cf", "effective_date").alias("counterfactual"), F.sum(gain * days).alias("_money"), F.sum(F.when(gain > 0, days).otherwise(0)).alias("_days"))
    return out.select("employee_id", "actual", "counterfactual", (F.col("actual") - F.col("counterfactual")).alias("annual"), F.round(F.col("_money").cast("double") / YEAR_DAYS, 2).alias("cumulative"), F.round(F.col("_days") / MONTH_DAYS, 1).alias("tenure_months"))


def unknown_ids(salaries: DataFrame, skipped: DataFrame) -> DataFrame:
    """The skipped ids that the ledger does not have: a replay with any is an error."""
    return skipped.join(salaries, "salary_id", "left_anti").select("salary_id")


def delta_summary(action: Column, table: Column, old: Column, new: Column) -> Column:
    """A short text of what a row changed: amounts for salaries; role, department, activity and name for employees."""
    a, b = X.payload(old), X.payload(new)
    parts = F.array_compact(F.array(*[F.when(~a[k].eqNullSafe(b[k]) & F.map_contains_key(b, F.lit(k)), F.concat(F.lit(f"{k}: "), F.coalesce(a[k], F.lit("none")), F.lit(" -> "), F.coalesce(b[k], F.lit("none")))) for k in ("role_id", "department_id", "is_active", "full_name")]))
    return F.when(table == "salary_history", F.concat(action, F.lit(" salary "), F.coalesce(b["amount"], a["amount"], F.lit("none")))).when(action != "UPDATE", F.concat(action, F.lit(" employee"))).otherwise(F.concat_ws(", ", parts))
