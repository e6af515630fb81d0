"""Days of puzzles against a list that is walked through draw by draw."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from farstride.operators import schedule

FIRST = datetime.date(2026, 9, 30)


def metres(a, b):
    middle = math.radians((a[1] + b[1]) / 2)
    return math.hypot((b[0] - a[0]) * math.cos(middle), b[1] - a[1]) * 111_195


def walked(days, areas, passing, used, attempts=40):
    used, chosen, out = set(used), [], []
    for n, date, twist in days:
        numbers = schedule.draws(n * 7919)
        near = [at for when, at in chosen if 0 < (date - when).days <= 14]
        for attempt in range(1, attempts + 1):
            pool = [a for a in areas if a[1] not in used and all(metres(p, (a[2], a[3])) > 2500 for p in near)]
            left = next(numbers) * sum(a[4] for a in pool)
            for a in pool:
                left -= a[4]
                if left <= 0:
                    break
            used.add(a[1])
            if (a[0], twist) in passing:
                chosen.append((date, (a[2], a[3])))
                out.append((n, date, twist, a[0], a[1], attempt))
                break
        else:
            raise ValueError
    return out


def fixture(seed):
    rnd = random.Random(seed)
    areas = [(k, f"area {k % 190}", -122.5 + rnd.random(), 37.0 + rnd.random(), rnd.randint(5, 60), k) for k in range(240)]
    passing = {(k, t) for k in range(240) for t in ("rush", "no-bus") if rnd.random() < 0.3}
    days = [(n, FIRST + datetime.timedelta(n - 1), ("rush", "no-bus")[n % 2]) for n in (1, 2, 3, 8, 20, 21)]
    return days, areas, passing


AREA = "area long, name string, lon double, lat double, weight long, ord long"


def test_days_are_those_of_a_list(spark, monkeypatch):
    monkeypatch.setattr(schedule, "LANE", 60)  # four lanes
    days, areas, passing = fixture(4)
    shuffled = random.Random(1).sample(areas, len(areas))
    out = schedule.puzzle_days(
        spark.createDataFrame(days[::-1], "n long, date date, twist string"), spark.createDataFrame(shuffled, AREA).repartition(5),
        spark.createDataFrame(sorted(passing), "area long, twist string"), used={"area 3", "area 77"},
    )
    assert [tuple(r) for r in out.orderBy("n").collect()] == walked(days, areas, passing, {"area 3", "area 77"})


def test_days_that_find_no_area_are_an_error(spark):
    days, areas, _ = fixture(2)
    day, none = spark.createDataFrame(days[:1], "n long, date date, twist string"), spark.createDataFrame([], "area long, twist string")
    with pytest.raises(ValueError, match="after 3 draws"):
        schedule.puzzle_days(day, spark.createDataFrame(areas, AREA), none, attempts=3)
    with pytest.raises(ValueError, match="no area"):
        schedule.puzzle_days(day, spark.createDataFrame(areas[:2], AREA), none)
    assert schedule.puzzle_days(day.filter(F.lit(False)), spark.createDataFrame(areas, AREA), none).count() == 0
