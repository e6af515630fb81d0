"""hop_shapes against the rules applied point by point with shapes of exact numbers, on lines with loops, repeated points and ties."""

import math
import random

import pytest

from farstride.operators import shapes


def spot(p, a, b, floor=0.0):
    """Share of the way from a to b nearest to p (from floor on), and its distance."""
    run = (b[0] - a[0]) ** 2 + (b[1] - a[1]) ** 2
    t = min(1.0, max(0.0, ((p[0] - a[0]) * (b[0] - a[0]) + (p[1] - a[1]) * (b[1] - a[1])) / run)) if run else 0.0
    t = max(t, floor)
    return t, math.dist(p, (a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])))


def ways(line, stops):
    out, last, share = [], 0, 0.0
    for p in stops:
        each = {j: spot(p, line[j], line[j + 1], share if j == last else 0.0) for j in range(last, len(line) - 1)}
        least = min(d for _, d in each.values())
        last = min(j for j, (_, d) in each.items() if d <= least + 30)
        share = each[last][0]
        out.append(last)
    return out


def thinned(line):
    """Recursion over the farthest vertex."""
    if len(line) < 3:
        return line
    a, b = line[0], line[-1]
    run = math.dist(a, b)
    gaps = [abs((b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])) / run if run else math.dist(p, a) for p in line[1:-1]]
    if max(gaps) <= 3:
        return [a, b]
    k = 1 + max(range(len(gaps)), key=lambda i: (round(gaps[i], 9), -i))
    return thinned(line[: k + 1])[:-1] + thinned(line[k:])


def patterns(seed):
    rnd = random.Random(seed)
    out = []
    for p in range(60):
        line = [(0.0, 0.0)]
        for _ in range(rnd.choice([0, 1, 2, 5, 30])):
            line.append(rnd.choice([line[-1], (line[-1][0] + rnd.randint(-200, 300), line[-1][1] + rnd.randint(-150, 150))]))
        if p % 7 == 0:
            line += line[::-1]  # there and back
        stops = [(q[0] + rnd.randint(-25, 25), q[1] + rnd.randint(-25, 25)) for q in sorted(rnd.sample(line, min(len(line), rnd.randint(1, 6))), key=line.index)]
        out.append((p, p % 9, [rnd.randint(0, 12) for _ in stops], stops, line))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_hop_shapes_point_by_point(spark, seed):
    found = patterns(seed)
    sequence = [(p, r, k, n, float(x), float(y)) for p, r, names, stops, _ in found for k, (n, (x, y)) in enumerate(zip(names, stops))]
    sequence += [(100, 1, 0, 50, 0.0, 0.0), (100, 1, 1, 51, None, 0.0), (101, 1, 0, 52, 0.0, 0.0), (101, 1, 1, 53, 5.0, 0.0)]
    lines = [(p, k, float(x), float(y)) for p, *_, line in found for k, (x, y) in enumerate(line)] + [(100, 0, 0.0, 0.0), (100, 1, 9.0, 0.0)]
    want = {}
    for p, r, names, stops, line in found:
        if len(line) >= 2:
            at = ways(line, stops)
            for k, (a, b) in enumerate(zip(at, at[1:])):
                if names[k] != names[k + 1]:
                    want.setdefault((r, names[k], names[k + 1]), thinned([stops[k], *line[a + 1 : b + 1], stops[k + 1]]))
    out = shapes.hop_shapes(spark.createDataFrame(sequence, "pattern long, route long, seq int, stop long, x double, y double"), spark.createDataFrame(lines, "pattern long, seq int, x double, y double"))
    got = {(r.route, r.from_stop, r.to_stop): list(zip(r.xs, r.ys)) for r in out.collect()}
    assert got.keys() == want.keys() and len(want) > 60
    for k in want:
        assert got[k] == [tuple(map(float, p)) for p in want[k]], k


def test_no_patterns(spark):
    none = spark.createDataFrame([], "pattern long, route long, seq int, stop long, x double, y double")
    assert shapes.hop_shapes(none, spark.createDataFrame([], "pattern long, seq int, x double, y double")).count() == 0


def test_tasks_that_cut_grow_in_number(spark, monkeypatch):
    """Groups were dealt to the session's number of tasks, so what a task held grew with the schedule."""
    stops = spark.createDataFrame([(p, 1, k, k + p % 3, 100.0 * k, 0.0) for p in range(60) for k in range(4)], "pattern long, route long, seq int, stop long, x double, y double")
    line = stops.select("pattern", "seq", "x", "y")
    whole = sorted(map(str, shapes.hop_shapes(stops, line).collect()))
    monkeypatch.setattr(shapes, "ROWS", 10)
    out = shapes.hop_shapes(stops, line)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count(", 24), REPARTITION_BY_NUM") == 2 and plan.count("Exchange") == 3  # both sides, and the last aggregation
    assert whole and sorted(map(str, out.collect())) == whole
