"""Ledger and directory searches, joins with dimensions, pages, field differences and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import ordered as O

#: Ids that one window of a numbering looks at.
BUCKET = 1 << 16


def search(ledger: DataFrame, actor: int | None = None, action: str | None = None, table: str | None = None, severity: str | None = None, sequence: int | None = None, employee: int | None = None, blind_index: str | None = None) -> DataFrame:
    """Rows that meet all conditions given. Table names match in part, whatever the case; % and _ stand for any text."""
    out = ledger
    if actor is not None:
        out = out.where(F.col("actor_user_id") == actor)
    if action:
        out = out.where(F.col("action") == action.upper())
    if table:
        out = out.where(F.col("table_name").ilike(f"%{table}%"))
    if severity:
        out = out.where(F.col("severity") == severity.upper())
    if sequence is not None:
        out = out.where(F.col("sequence_id") == sequence)
    if employee is not None:
        out = out.where(of_employee(F.lit(employee)))
    if blind_index is not None:
        out = out.where(sum_or("national_id_blind_index", F.lit(blind_index)))
    return out


def sum_or(key: str, value: Column) -> Column:
    """Whether either payload has this value under the key, as text."""
    return F.coalesce(F.get_json_object("new_value_text", f"$.{key}") == value, F.lit(False)) | F.coalesce(F.get_json_object("old_value_text", f"$.{key}") == value, F.lit(False))


def of_employee(employee: Column) -> Column:
    """By the employee column, by row id on employees, or by the id in a salary payload."""
    on = F.col("table_name")
    return (F.col("employee_id") == employee) | ((on == "employees") & (F.col("row_id") == employee)) | ((on == "salary_history") & sum_or("employee_id", employee.cast("string")))


def with_actor(rows: DataFrame, users: DataFrame) -> DataFrame:
    """Adds actor_name. A row whose actor is unknown stays."""
    named = users.select(F.col("user_id").alias("_user"), F.col("full_name").alias("_name"), F.col("email").alias("_email"))
    out = rows.join(named, F.col("actor_user_id") == F.col("_user"), "left")
    return out.withColumn("actor_name", X.actor_name(F.col("_name"), F.col("_email"), F.col("actor_user_id"))).drop("_user", "_name", "_email")


def page(rows: DataFrame, number: int, size: int, order: str = "sequence_id") -> DataFrame:
    """Page `number` (from 1), newest first."""
    return rows.orderBy(F.col(order).desc()).offset((number - 1) * size).limit(size)


def explorer_page(rows: DataFrame, number: int, size: int, around_seq: int | None = None) -> tuple[DataFrame, int]:
    """A page of the chain explorer (1 to 100 rows) and the count of all rows that the filters leave: a window about a
    sequence narrows what is shown, not what is counted."""
    size = min(max(size, 1), 100)
    shown = rows if around_seq is None else around(rows, around_seq, size)
    return page(shown, number if around_seq is None else 1, size), rows.count()


def newest(rows: DataFrame, order: str, most: int = 50, number: int = 1) -> DataFrame:
    """A page of the newest rows; ties keep the order of all other columns, so that pages do not overlap."""
    return rows.orderBy(F.col(order).desc(), *[F.col(c).desc() for c in sorted(rows.columns) if c != order]).offset((number - 1) * most).limit(most)


def of_actor(actions: DataFrame, actor: int, most: int = 50) -> DataFrame:
    """The actor's last undoable actions, newest first."""
    return newest(actions.where(F.col("actor_user_id") == actor), "action_id", most)


def event_list(events: DataFrame, number: int, size: int) -> DataFrame:
    """A page of security events, newest first, with the count of all."""
    return newest(events, "event_id", size, number).crossJoin(events.agg(F.count(F.lit(1)).alias("total")))


def flag_list(flagged: DataFrame) -> DataFrame:
    """Flags newest first, without those that a root stands for."""
    return flagged.where(F.col("root").isNull() | (F.col("root") == F.col("sequence_id"))).orderBy(F.col("sequence_id").desc())


def cursor_page(rows: DataFrame, size: int, before: int | None = None, order: str = "sequence_id") -> DataFrame:
    """The newest `size` rows before a cursor, with next_cursor (null on the last page)."""
    left = rows if before is None else rows.where(F.col(order) < before)
    got = left.orderBy(F.col(order).desc()).limit(size + 1)
    kept = got.orderBy(F.col(order).desc()).limit(size)
    more = got.agg(F.count(F.lit(1)).alias("_n")), kept.agg(F.min(order).alias("_last"))
    return kept.crossJoin(more[0]).crossJoin(more[1]).withColumn("next_cursor", F.when(F.col("_n") > size, F.col("_last"))).drop("_n", "_last")


def pages(total: Column, size: int) -> Column:
    return F.ceil(total / size).cast("long")


def around(rows: DataFrame, sequence: int, limit: int) -> DataFrame:
    """`limit` positions about a sequence."""
    start = max(1, sequence - limit // 2)
    return rows.where(F.col("sequence_id").between(start, start + limit - 1))


def directory(employees: DataFrame, roles: DataFrame, departments: DataFrame, salaries: DataFrame | None = None, with_private: bool = True) -> DataFrame:
    """Employees with role, department and latest salary; without the right to private data, masked."""
    out = employees.join(roles, "role_id").join(departments, "department_id")
    if salaries is not None:
        out = out.join(salaries, "employee_id", "left")
    else:
        out = out.withColumn("amount", F.lit(None).cast("decimal(12,2)"))
    out = out.select("employee_id", "full_name", "email", "title", "department", "is_active", "amount")
    if with_private:
        return out
    return out.withColumns({"full_name": F.concat(F.lit("Employee #"), F.col("employee_id").cast("string")), "email": F.lit("Restricted"), "amount": F.lit(None).cast("decimal(12,2)")})


def find_employees(rows: DataFrame, text: str | None = None, department: str | None = None, active: bool | None = None) -> DataFrame:
    """By id (# and EMP- ignored) or part of name or e-mail; by department unless all; by activity."""
    if text:
        bare = text.strip().lstrip("#").upper().replace("EMP-", "").strip()
        match = F.col("full_name").ilike(f"%{text}%") | F.col("email").ilike(f"%{text}%")
        rows = rows.where(match | (F.col("employee_id") == int(bare)) if bare.isascii() and bare.isdigit() else match)
    if department and department.lower() != "all":
        rows = rows.where(F.col("department").ilike(department))
    return rows if active is None else rows.where(F.col("is_active") == active)


def paged(rows: DataFrame, size: int, order: str = "employee_id") -> DataFrame:
    """Adds page (from 1, in order, `size` rows each) and pages, for every row: no single task numbers them all."""
    out = O.numbered(rows, [], F.floor(F.col(order) / BUCKET), [order], "_n")
    total = rows.agg(pages(F.count(F.lit(1)), size).alias("pages"))
    return out.withColumn("page", F.ceil(F.col("_n") / size)).drop("_n").crossJoin(F.broadcast(total))


def field_changes(ledger: DataFrame) -> DataFrame:
    """sequence_id, key, old, new, change (Added, Removed, Changed) for every key that differs between the payloads."""
    old, new = (F.coalesce(X.payload(F.col(c)), F.create_map().cast("map<string,string>")) for c in ("old_value_text", "new_value_text"))
    rows = ledger.select("sequence_id", old.alias("o"), new.alias("n")).withColumn("key", F.explode(F.array_union(F.map_keys("o"), F.map_keys("n"))))
    has = lambda m: F.map_contains_key(F.col(m), F.col("key"))
    value = lambda m: F.try_element_at(F.col(m), F.col("key"))
    change = F.when(~has("o"), "Added").when(~has("n"), "Removed").when(~value("o").eqNullSafe(value("n")), "Changed")
    return rows.select("sequence_id", "key", value("o").alias("old"), value("n").alias("new"), change.alias("change")).where("change IS NOT NULL")


def change_counts(changes: DataFrame) -> DataFrame:
    """By sequence: how many fields were added, removed and changed, and whether any key has an unusual form."""
    odd = ~F.col("key").rlike("^[A-Za-z_][A-Za-z0-9_]*$")
    kinds = ("Added", "Removed", "Changed")
    return changes.groupBy("sequence_id").agg(*[F.count_if(F.col("change") == k).cast("long").alias(k.lower()) for k in kinds], F.bool_or(odd).alias("anomalous"))


def undo_preview(actions: DataFrame, current: DataFrame) -> DataFrame:
    """For each action (action_id, employee_id, before, after_hash): whether it can be undone, and what that would change.

    allowed: the employee's present state is still the one that the action left, by the digest of its sorted JSON.
    changes: the keys whose value would become another, sorted. Without a present state nothing can be undone.
    """
    rows = actions.join(current.select("employee_id", F.col("state").alias("_now")), "employee_id", "left")
    allowed = F.coalesce(undo_gate(F.col("_now"), F.col("after_hash")), F.lit(False))
    now = F.coalesce("_now", F.create_map().cast("map<string,string>"))
    keys = F.array_sort(F.array_union(F.map_keys(now), F.map_keys("before")))
    differ = F.filter(keys, lambda k: ~F.try_element_at(now, k).eqNullSafe(F.try_element_at(F.col("before"), k)))
    return rows.select("action_id", "employee_id", allowed.alias("allowed"), F.when(allowed, differ).otherwise(F.array().cast("array<string>")).alias("changes"))


def undo_gate(current: Column, snapshot_hash: Column) -> Column:
    """Whether the present state is still the one that an undo was made for."""
    return F.sha2(X.sorted_json(current), 256) == snapshot_hash


def dashboard(employees: DataFrame, ledger: DataFrame, flagged: DataFrame) -> DataFrame:
    """One row of counts, each from one pass over its table."""
    people = employees.agg(F.count_if(F.col("is_active")).alias("active_employees"), F.count(F.lit(1)).alias("total_employees"))
    return people.crossJoin(ledger.agg(F.count(F.lit(1)).alias("ledger_rows"))).crossJoin(flagged.agg(F.count(F.lit(1)).alias("open_flags")))


def statistics(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Count, extremes, mean, exact linear percentiles and population deviation, rounded to 3."""
    p = lambda q: F.percentile(value, F.lit(q))
    figures = {"least": F.min(value), "most": F.max(value), "mean": F.avg(value), "p50": p(0.5), "p95": p(0.95), "p99": p(0.99), "deviation": F.stddev_pop(value)}
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *[F.round(x, 3).alias(n) for n, x in figures.items()])
