"""Salaries held to the bands of their roles, over the histories of all three: who earned what, held which role, and which
band the role had when something was written.

Writes have positions (`place`) in one order, each its own. A write is judged by all that was written before it, and the
history is taken as it stands: a write outside a band counts for those after it like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import ordered as O
from tidemark.sources import shared

#: Positions lie below 2 ** TOP; within a key, as-of values are found in buckets of so many positions.
TOP, BUCKET = 42, 1 << 16
#: Edits of a role that one key of their join with spans has.
EDITS = 64
COLUMNS = ("place", "kind", "employee_id", "role_id", "amount", "band_min", "band_max")


def _bucket(sign: int = 1) -> Column:
    return F.floor(F.lit(sign) * F.col("place") / BUCKET)


def _as_of(rows: DataFrame, history: DataFrame, key: str, values: list[str]) -> DataFrame:
    """rows with the values that the key's history has just before their position; null where it has none. Both go through
    one exchange by key and bucket, so a key with very many rows is split."""
    held = history.select(key, "place", F.struct(*values).alias("_new"))
    both = rows.withColumn("_asks", F.lit(True)).unionByName(held, allowMissingColumns=True)
    both = O.carried(both, [key], _bucket(), ["place"], F.col("_new"), "_now", F.col("_asks").isNull())
    return both.where("_asks").select(*rows.columns, *[F.col("_now")[v].alias(v) for v in values])


def spans(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows with until: the position at which their keys are next written, 2 ** TOP while they stand."""
    found = O.previous(rows.withColumn("_down", -F.col("place")), keys, F.floor(F.col("_down") / BUCKET), ["_down"], {"until": "place"})
    return found.withColumn("until", F.coalesce("until", F.lit(1 << TOP))).drop("_down")


def _shifted(at: Column, k: Column) -> Column:
    return F.call_function("shiftright", at, k)


def _pieces(since: Column, until: Column, top: int = TOP) -> Column:
    """The aligned blocks (size, at) that make up the positions from since until before until, at most two of each size."""

    def of_size(k: Column) -> Column:
        low, high = _shifted(since + F.call_function("shiftleft", F.lit(1).cast("long"), k) - 1, k), _shifted(until, k)
        odd = lambda n, at: F.when((low < high) & (n % 2 != 0), F.struct(k.alias("size"), at.alias("at")))
        return F.array_compact(F.array(odd(low, low), odd(high, high - 1)))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(top)), of_size))


def _sizes(at: Column, top: int = TOP) -> Column:
    """The block of each size that holds a position."""
    return F.transform(F.sequence(F.lit(0), F.lit(top)), lambda k: F.struct(k.alias("size"), _shifted(at, k).alias("at")))


def current(points: DataFrame, salaries: DataFrame, top: int = TOP) -> DataFrame:
    """points (employee_id, place and others) with the amount that was current then: of the spans of salary rows over it, that
    with the latest effective date, then the highest salary_id. Points at which none stood are left out.

    A salary row stands until its salary_id is written again, for whomever. Its span is cut into blocks and each block keeps
    its best row before anything is shuffled. Positions lie below 2 ** top."""
    until = F.least("until", F.lit(1 << top))
    held = salaries.where(F.col("amount").isNotNull()).withColumn("_b", F.explode(_pieces(F.col("place"), until, top)))
    best = held.groupBy("employee_id", "_b").agg(F.max(F.struct("effective", "salary_id", "amount")).alias("_best"))
    # Spark does not see that the blocks are many times the rows, and would send them to all through the driver.
    found = points.withColumn("_b", F.explode(_sizes(F.col("place"), top))).join(best.hint("merge"), ["employee_id", "_b"])
    return found.groupBy(*points.columns).agg(F.max("_best")["amount"].alias("amount"))


def _timeline(salaries: DataFrame, assignments: DataFrame) -> DataFrame:
    """employee_id, place, until, role_id, amount, moved: what each employee held and earned from a write to the next one of
    either kind; moved: the write is a change of role.

    The current salary changes only where a row of it begins or ends, so it is worked out there alone, and all other
    positions carry it."""
    top = max((assignments.agg(F.max("place")).first()[0] or 0), (salaries.agg(F.max("place")).first()[0] or 0)).bit_length()
    rows = salaries.where(F.col("amount").isNotNull())
    turns = rows.select("employee_id", "place").union(rows.where(F.col("until") < 1 << TOP).select("employee_id", F.col("until").alias("place"))).distinct()
    turns = turns.join(current(turns, salaries, top).hint("merge"), ["employee_id", "place"], "left")
    roles = assignments.select("employee_id", "place", F.col("role_id").alias("_role"), F.coalesce(F.col("role_id") != F.col("_was"), F.lit(False)).alias("moved"), F.lit(1).alias("_kind"))
    both = roles.unionByName(turns.select("employee_id", "place", F.col("amount").alias("_amount"), F.lit(False).alias("moved"), F.lit(0).alias("_kind")), allowMissingColumns=True)
    # Of one position, what is earned comes first.
    both = O.carried(both, ["employee_id"], _bucket(), ["place", "_kind"], F.col("_role"), "role_id", F.col("_kind") == 1)
    both = O.carried(both, ["employee_id"], _bucket(), ["place", "_kind"], F.col("_amount"), "amount", F.col("_kind") == 0)
    down = both.select("employee_id", "place", "role_id", "amount", "moved", (-F.col("place")).alias("_down"), (-F.col("_kind")).alias("_back"))
    out = O.previous(down, ["employee_id"], F.floor(F.col("_down") / BUCKET), ["_down", "_back"], {"until": "place"})
    return out.select("employee_id", "place", F.coalesce("until", F.lit(1 << TOP)).alias("until"), "role_id", "amount", "moved")


def _edits_before(rows: DataFrame, edits: DataFrame, at: str, name: str) -> DataFrame:
    """rows (role_id and others) with the number of the role's edits below the position in column `at`."""
    asks = rows.withColumn("_at", F.col(at)).withColumn("_held", F.lit(0))
    held = edits.select("role_id", F.col("place").alias("_at"), F.col("_i"), F.lit(1).alias("_held"))
    both = asks.unionByName(held, allowMissingColumns=True)
    both = O.carried(both, ["role_id"], F.floor(F.col("_at") / BUCKET), ["_at", "_held"], F.col("_i"), name, F.col("_held") == 1)
    return both.where("_held = 0").select(*rows.columns, F.coalesce(name, F.lit(0)).alias(name))


def _edited(edits: DataFrame, held: DataFrame) -> DataFrame:
    """The violations that edits (role_id, place, band_min, band_max) leave among what is held (employee_id, role_id, amount,
    place, until).

    Edits of a role are numbered, and what is held takes the numbers from the first in its span to the last, cut into runs of
    EDITS: so a join's key has so many edits and those who hold the role then, and nothing else is joined. Pairs are judged
    where they are made."""
    edits = shared.stored(O.numbered(edits, ["role_id"], _bucket(), ["place"], "_i"), "bands-edits")
    held = _edits_before(_edits_before(held, edits, "place", "_low"), edits, "until", "_high").where(F.col("_low") < F.col("_high"))
    run = lambda n: F.floor(n / EDITS).cast("long")
    held = held.select("role_id", "employee_id", "amount", "_low", "_high", F.explode(F.sequence(run(F.col("_low")), run(F.col("_high") - 1))).alias("_run"))
    both = held.join(edits.withColumn("_run", run(F.col("_i") - 1)).hint("merge"), ["role_id", "_run"])
    return both.where((F.col("_i") > F.col("_low")) & (F.col("_i") <= F.col("_high")) & _outside())


def _outside() -> Column:
    return (F.col("amount") < F.col("band_min")) | (F.col("amount") > F.col("band_max"))


def violations(salaries: DataFrame, assignments: DataFrame, bands: DataFrame) -> DataFrame:
    """COLUMNS of every write that leaves an amount outside a band, whose ends belong to it.

    salaries: employee_id, salary_id, amount (null: the row is taken away), effective, place. assignments: employee_id, role_id
    (null: none any more), place. bands: role_id, band_min, band_max (null: without end), place. Other columns are ignored. kind:

    - salary: the amount written, held to the band of the role held then;
    - role: an employee's role changes, the first one (also after none) being no change; the current salary is held to the
      band of the new role;
    - band: a role's band changes; the current salary of each who holds the role is held to the new band.

    Who has no role, no salary or no band is not judged. Rows without employee_id, role_id (of a band) or position are left
    out.
    """
    salaries = salaries.select("employee_id", "salary_id", "amount", "effective", F.col("place").cast("long")).where("employee_id IS NOT NULL AND place IS NOT NULL")
    assignments = assignments.select("employee_id", "role_id", F.col("place").cast("long")).where("employee_id IS NOT NULL AND place IS NOT NULL")
    bands = bands.select("role_id", "band_min", "band_max", F.col("place").cast("long")).where("role_id IS NOT NULL AND place IS NOT NULL")
    ends = F.struct("band_min", "band_max")
    # Each history is linked and written once; all that follows reads the files.
    salaries = shared.stored(spans(salaries, ["salary_id"]), "bands-salaries")
    assignments = shared.stored(O.previous(spans(assignments, ["employee_id"]), ["employee_id"], _bucket(), ["place"], {"_was": "role_id"}), "bands-roles")
    bands = shared.stored(O.previous(bands, ["role_id"], _bucket(), ["place"], {"_was": ends}), "bands-ends")
    written = _as_of(salaries.where("amount IS NOT NULL").select("employee_id", "place", "amount"), assignments, "employee_id", ["role_id"])
    lives = shared.stored(_timeline(salaries, assignments), "bands-lives").where("role_id IS NOT NULL AND amount IS NOT NULL")
    # The row before a change may be one without a role, which is no change: the first role is not judged.
    moved = lives.where("moved").select("employee_id", "place", "role_id", "amount")
    asked = written.where("role_id IS NOT NULL").withColumn("kind", F.lit("salary")).unionByName(moved.withColumn("kind", F.lit("role")))
    asked = _as_of(asked, bands, "role_id", ["band_min", "band_max"]).where(_outside())
    edits = bands.where(F.col("_was").isNotNull() & ~F.col("_was").eqNullSafe(ends)).drop("_was")
    edited = _edited(edits, lives.where(F.col("place") < F.col("until")).drop("moved")).withColumn("kind", F.lit("band"))
    return asked.select(*COLUMNS).unionByName(edited.select(*COLUMNS))
