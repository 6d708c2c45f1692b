"""What salaries would be, had some ledger rows not been written: two time axes, all employees at once.

A row version of a salary is known from the day it was entered until the day its salary is next written, and holds from
its effective date on. On the diagonal, where a day is judged by what was known on it, a version is one span of days:
from the later of the two starts until its end. Of the spans over a day the one with the latest effective date counts,
then the highest salary id.

Spans are cut into aligned blocks of 1, 2, 4, ... days, at most two of each size, and each block keeps its best version:
a maximum, so that an employee with very many rows is aggregated before it is shuffled. A day finds its salary in the
blocks that hold it, one of each size. Only days where a span begins or ends are asked, so what is left of an employee is
bounded by the calendar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.functions import text as X
from tidemark.operators import ordered as O
from tidemark.operators import replay, search

#: Blocks are of up to 2 ** TOP days, and versions of a salary id are linked in buckets of so many sequences.
TOP, BUCKET = 16, 1 << 16


def day(date: Column) -> Column:
    """Days since 1970."""
    return F.datediff(date.cast("date"), F.lit("1970-01-01").cast("date"))


def salary_events(ledger: DataFrame, as_of: Column) -> DataFrame:
    """employee_id, sequence_id, salary_id, day (entered), amount, effective (day), gone, of the salary rows up to as_of.

    INSERT and UPDATE set a row, DELETE takes it away; a row without a whole amount or id does nothing. The id is that of
    the payload (for a DELETE the old one), the ledger's row id where the payload names none. A date that is none is the
    day of entry. A row entered on an earlier day than one before it counts from the later day.
    """
    rows = ledger.where((F.col("table_name") == "salary_history") & (F.col("created_at") <= as_of) & F.col("action").isin("INSERT", "UPDATE", "DELETE"))
    gone = F.col("action") == "DELETE"
    rows = rows.withColumn("_p", X.payload(F.when(gone, F.col("old_value_text")).otherwise(F.col("new_value_text"))))
    own = F.coalesce(F.map_contains_key("_p", F.lit("salary_history_id")), F.lit(False))
    salary_id = F.when(own, F.expr("try_cast(_p['salary_history_id'] as bigint)")).otherwise(F.col("row_id").cast("long"))
    date = F.expr("case when substring(_p['effective_date'], 1, 10) rlike '^[0-9]{4}-[0-9]{2}-[0-9]{2}$' then try_cast(substring(_p['effective_date'], 1, 10) as date) end")
    rows = rows.select("employee_id", "sequence_id", salary_id.alias("salary_id"), day(F.col("created_at")).alias("_entered"), F.expr("try_cast(_p['amount'] as decimal(12,2))").alias("amount"), day(date).alias("effective"), gone.alias("gone"))
    rows = rows.where(F.col("salary_id").isNotNull() & (F.col("gone") | F.col("amount").isNotNull()))
    rows = O.highest(rows, ["employee_id"], F.floor(F.col("sequence_id") / BUCKET), ["sequence_id"], F.col("_entered"), "day")
    return rows.withColumn("effective", F.coalesce("effective", "_entered")).drop("_entered")


def spans(events: DataFrame, skipped: DataFrame, until: Column) -> DataFrame:
    """employee_id, track, salary_id, amount, effective, since, until (days; until excluded, null while it lasts) of what is
    known and holds, by track: actual, and counterfactual, for which the rows of `skipped` (sequence_id) do not exist."""
    rows = events.join(skipped.select("sequence_id").distinct().withColumn("_skip", F.lit(True)), "sequence_id", "left")
    tracks = F.when(F.col("_skip"), F.array(F.lit("actual"))).otherwise(F.array(F.lit("actual"), F.lit("counterfactual")))
    rows = rows.withColumn("track", F.explode(tracks)).drop("_skip").withColumn("_down", -F.col("sequence_id"))
    rows = O.previous(rows, ["employee_id", "track", "salary_id"], F.floor(F.col("_down") / BUCKET), ["_down"], {"until": "day"})
    rows = rows.where(~F.col("gone")).withColumn("since", F.greatest("day", "effective")).withColumn("until", F.least("until", until + 1))
    return rows.where((F.col("since") < F.col("until"))).select("employee_id", "track", "salary_id", "amount", "effective", "since", "until")


def blocks(since: Column, until: Column) -> Column:
    """The aligned blocks, (size, at) for at * 2 ** size and on, that make up the days from since until before until."""
    named = lambda k: lambda at: F.struct(F.lit(k).alias("size"), at.alias("at"))
    out = []
    for k in range(TOP + 1):
        low, high = F.shiftright(since + ((1 << k) - 1), k), F.shiftright(until, k)
        if k == TOP:
            taken = F.when(low < high, F.sequence(low, high - 1))
        else:
            taken = F.when(low < high, F.array(F.when(low % 2 != 0, low), F.when(high % 2 != 0, high - 1)))
        out.append(F.transform(F.array_compact(F.coalesce(taken, F.array().cast("array<int>"))), named(k)))
    return F.flatten(F.array(*out))


def standing(held: DataFrame, days: DataFrame) -> DataFrame:
    """employee_id, day, actual, counterfactual: the amounts that hold on the days (employee_id, day), null for none."""
    best = F.struct("effective", "salary_id", "amount")
    each = held.withColumn("_b", F.explode(blocks(F.col("since"), F.col("until"))))
    tops = each.groupBy("employee_id", "_b").agg(*[F.max(F.when(F.col("track") == t, best)).alias(t) for t in ("actual", "counterfactual")])
    asked = F.array(*[F.struct(F.lit(k).alias("size"), F.shiftright("day", k).alias("at")) for k in range(TOP + 1)])
    found = days.withColumn("_b", F.explode(asked)).join(tops, ["employee_id", "_b"], "left")
    return found.groupBy("employee_id", "day").agg(F.max("actual")["amount"].alias("actual"), F.max("counterfactual")["amount"].alias("counterfactual"))


def money(ledger: DataFrame, skipped: DataFrame, as_of: Column) -> DataFrame:
    """employee_id, actual, counterfactual (the amounts that hold on as_of, 0 for none), annual (what actual is above it),
    cumulative (the same for every day before as_of, by the mean year), tenure_months (those days, by the mean month)."""
    last = day(as_of)
    held = spans(salary_events(ledger, as_of), skipped, last)
    ends = held.select("employee_id", F.explode(F.array("since", "until", last)).alias("day")).where(F.col("day") <= last).distinct()
    steps = standing(held, ends)
    zero = F.lit(0).cast("decimal(12,2)")
    steps = steps.select("employee_id", "day", *[F.coalesce(c, zero).alias(c) for c in ("actual", "counterfactual")])
    n = F.coalesce(F.lead("day").over(W.partitionBy("employee_id").orderBy("day")), F.col("day")) - F.col("day")
    above = F.greatest(zero, F.col("actual") - F.col("counterfactual"))
    out = steps.withColumn("_n", n).groupBy("employee_id").agg(*[F.max_by(c, "day").alias(c) for c in ("actual", "counterfactual")], F.sum(above * F.col("_n")).alias("_money"), F.sum(F.when(above > 0, F.col("_n")).otherwise(0)).alias("_days"))
    return out.select("employee_id", "actual", "counterfactual", F.greatest(zero, F.col("actual") - F.col("counterfactual")).alias("annual"), F.round(F.col("_money").cast("double") / replay.YEAR_DAYS, 2).alias("cumulative"), F.round(F.col("_days") / replay.MONTH_DAYS, 1).alias("tenure_months"))


def replayed(ledger: DataFrame, skipped: DataFrame, as_of: Column) -> DataFrame:
    """`money` for every employee with a row up to as_of, with skipped and applied (rows), and first_skipped (when)."""
    rows = ledger.where(F.col("created_at") <= as_of).join(skipped.select("sequence_id").distinct().withColumn("_skip", F.lit(True)), "sequence_id", "left")
    skip = F.coalesce("_skip", F.lit(False))
    counts = rows.groupBy("employee_id").agg(F.count_if(skip).alias("skipped"), F.count_if(~skip).alias("applied"), F.min(F.when(skip, F.col("created_at"))).alias("first_skipped"))
    out = counts.join(money(ledger, skipped, as_of), "employee_id", "left")
    zero = {"actual": 0, "counterfactual": 0, "annual": 0, "cumulative": 0.0, "tenure_months": 0.0}
    return out.na.fill(zero)


def documents(ledger: DataFrame, skipped: DataFrame, as_of: Column) -> DataFrame:
    """employee_id, actual, counterfactual: the state of every employee that has one in either track, as maps; null for
    none. An UPDATE without payload changes nothing here."""
    until = F.col("created_at") <= as_of
    kept = ledger.join(skipped.select("sequence_id").distinct(), "sequence_id", "left_anti")
    each = [replay.documents(rows, until, blank="keep").withColumnRenamed("state", name) for rows, name in ((ledger, "actual"), (kept, "counterfactual"))]
    return each[0].join(each[1], "employee_id", "full")


def asked_status(ledger: DataFrame, asked: DataFrame, as_of: Column) -> DataFrame:
    """asked (employee_id, sequence_id) with status: ok, not_in_ledger, not_in_stream (a row of another employee, or after
    as_of), or nothing_asked where sequence_id is null. A replay with any but ok is an error."""
    # A sequence that the ledger has twice is found once.
    named = asked.select(F.col("employee_id").alias("_asked"), F.col("sequence_id").alias("_seq")).distinct()
    both = named.join(ledger, F.col("_seq") == F.col("sequence_id"), "left")
    inside = F.coalesce(search.of_employee(F.col("_asked")), F.lit(False)) & (F.col("created_at") <= as_of)
    found = both.groupBy("_asked", "_seq").agg(F.count("sequence_id").alias("_n"), F.bool_or(F.coalesce(inside, F.lit(False))).alias("_in"))
    status = F.when(F.col("_seq").isNull(), "nothing_asked").when(F.col("_n") == 0, "not_in_ledger").when(F.col("_in"), "ok").otherwise("not_in_stream")
    return found.select(F.col("_asked").alias("employee_id"), F.col("_seq").alias("sequence_id"), status.alias("status"))
