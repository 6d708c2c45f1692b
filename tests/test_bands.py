import random

from tidemark.operators import bands as R

SALARIES, ROLES, BANDS = "employee_id int, salary_id long, amount int, effective int, place long", "employee_id int, role_id int, place long", "role_id int, band_min int, band_max int, place long"


def fold(salaries, roles, bands):
    """All writes one after another, over what stood before each."""
    writes = sorted([(r[-1], "salary", r) for r in salaries] + [(r[-1], "role", r) for r in roles] + [(r[-1], "band", r) for r in bands])
    rows, held, band, out = {}, {}, {}, []

    def now(employee):
        own = [(e, i, a) for i, (who, a, e) in rows.items() if who == employee]
        return max(own)[2] if own else None

    def judge(place, kind, employee, role, amount, ends):
        low, high = ends or (None, None)
        if amount is not None and ((low is not None and amount < low) or (high is not None and amount > high)):
            out.append((place, kind, employee, role, amount, low, high))

    for place, kind, r in writes:
        if kind == "salary":
            who, i, amount, date, _ = r
            rows.pop(i, None)
            if amount is not None:
                role = held.get(who)
                if role is not None:
                    judge(place, kind, who, role, amount, band.get(role))
                rows[i] = (who, amount, date)
        elif kind == "role":
            who, role, _ = r
            if held.get(who) is not None and role is not None and role != held[who]:
                judge(place, kind, who, role, now(who), band.get(role))
            held[who] = role
        else:
            role, *ends, _ = r
            if role in band and band[role] != tuple(ends):
                for who, has in held.items():
                    if has == role:
                        judge(place, kind, who, role, now(who), ends)
            band[role] = tuple(ends)
    return sorted(out, key=str)


def found(spark, salaries, roles, bands):
    frames = [spark.createDataFrame(r, s).selectExpr("*", "1 as until", "'x' as _b") for r, s in ((salaries, SALARIES), (roles, ROLES), (bands, BANDS))]
    return sorted(map(tuple, R.violations(*frames).collect()), key=str)


def test_random_histories_equal_a_fold(spark, monkeypatch):
    monkeypatch.setattr(R, "BUCKET", 16)
    rng = random.Random(5)
    for size in (60, 400):
        places = list(range(1, size + 1)) if size < 100 else [rng.randrange(10**6) * size + i for i in range(size)]
        salaries, roles, bands = [], [], []
        for place in places:
            kind = rng.randrange(5)
            if kind < 2:
                salaries.append((rng.randrange(6), rng.randrange(30), rng.choice([None, *range(100)]) if rng.random() < 0.5 else rng.randrange(100), rng.randrange(4), place))
            elif kind < 4:
                roles.append((rng.randrange(6), rng.choice([None, 0, 1, 2]), place))
            else:
                bands.append((rng.randrange(3), rng.choice([None, 20, 40]), rng.choice([None, 50, 70]), place))
        wanted = fold(salaries, roles, bands)
        assert {r[1] for r in wanted} == {"salary", "role", "band"}
        assert found(spark, salaries, roles, bands) == wanted


def test_ends_belong_to_the_band_and_nulls_are_not_judged(spark):
    bands = [(1, 10, 20, 0), (2, None, 15, 1), (None, 0, 0, 2)]
    roles = [(1, 1, 3), (2, 2, 4), (None, 1, 5), (3, 9, 6)]
    salaries = [(1, 1, 10, 1, 10), (1, 2, 20, 2, 11), (1, 3, 21, 3, 12), (2, 4, -5, 1, 13), (2, 5, 16, 2, 14), (3, 6, 99, 1, 15), (None, 7, 99, 1, 16), (4, 8, 99, 1, 17), (1, 9, 99, 1, None)]
    assert found(spark, salaries, roles, bands) == [(12, "salary", 1, 1, 21, 10, 20), (14, "salary", 2, 2, 16, None, 15)]
    assert found(spark, [], [], []) == []
