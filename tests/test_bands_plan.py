from contextlib import redirect_stdout
from io import StringIO

from tidemark.operators import bands as R


def test_blocks_and_runs_are_never_sent_to_all(spark, monkeypatch):
    """A row is many blocks, which Spark's sizes do not show: sent to all tasks they pass through the driver."""
    monkeypatch.setattr(R, "EDITS", 2)
    salaries = spark.createDataFrame([(e, e, 5 * e, 1, 10 + e) for e in range(1, 9)], "employee_id int, salary_id long, amount int, effective int, place long")
    roles = spark.createDataFrame([(e, 1, e) for e in range(1, 9)], "employee_id int, role_id int, place long")
    bands = spark.createDataFrame([(1, i % 7, 20 + i % 5, i) for i in (0, *range(20, 40))], "role_id int, band_min int, band_max int, place long")
    found = R.violations(salaries, roles, bands)
    with redirect_stdout(StringIO()) as out:
        found.explain()
    depth = None
    for line in out.getvalue().splitlines():
        at = len(line) - len(line.lstrip(" :+-"))
        depth = None if depth is not None and at <= depth else depth
        depth = at if depth is None and "BroadcastExchange" in line else depth
        assert depth is None or "Generate" not in line
    wanted = {(i, "band", e, 1, 5 * e, i % 7, 20 + i % 5) for i in range(20, 40) for e in range(1, 9) if not i % 7 <= 5 * e <= 20 + i % 5}
    assert {tuple(r) for r in found.where("kind = 'band'").collect()} == wanted
