"""Exact scores against a plain walk over every cell, and itineraries' lines and legs against the network."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from farstride.operators import itineraries, raster, search

UNIT = 40075016.686 * math.cos(math.radians(37.54))
X = lambda lon: (lon + 180) / 360
Y = lambda lat: 0.5 - math.log(math.tan(math.pi / 4 + math.radians(lat) / 2)) / (2 * math.pi)


def by_hand(points, speed, limit, cell=40.0, reach=250.0, most=4_000_000):
    """Cells one after another, in reading order and back."""
    xs, ys = [X(p[0]) for p in points], [Y(p[1]) for p in points]
    x0, y0 = min(xs) - reach / UNIT, min(ys) - reach / UNIT
    wide, high = max(xs) + reach / UNIT - x0, max(ys) + reach / UNIT - y0
    size = cell / UNIT
    if wide * high / size**2 > most:
        size = math.sqrt(wide * high / most)
    w, h, side = math.ceil(wide / size), math.ceil(high / size), size * UNIT
    single = lambda v: float(np.float32(v))
    times, walked = {}, {}
    for x, y, (*_, cost) in zip(xs, ys, points):
        k = (min(h - 1, math.floor((y - y0) / size)), min(w - 1, math.floor((x - x0) / size)))
        if cost < times.get(k, math.inf):
            times[k], walked[k] = single(cost), 0.0
    for rows, columns, way in ((range(h), range(w), -1), (range(h - 1, -1, -1), range(w - 1, -1, -1), 1)):
        for y in rows:
            for x in columns:
                for dy, dx, d in ((0, way, side), (way, 0, side), (way, way, side * math.sqrt(2)), (way, -way, side * math.sqrt(2))):
                    n = (y + dy, x + dx)
                    if n in times and walked[n] + d <= reach and times[n] + d / speed < times.get((y, x), math.inf) and times[n] + d / speed <= limit:
                        times[y, x], walked[y, x] = single(times[n] + d / speed), single(walked[n] + d)
    return len(times), len(times) * side * side / 1e6


@pytest.mark.parametrize("most", [4_000_000, 300])
def test_scores_are_those_of_cells_taken_one_by_one(spark, most):
    rnd = random.Random(8)
    rows = [(o, -122.5 + rnd.random() * 0.01, 37.54 + rnd.random() * 0.01, rnd.random() * 700) for o in range(4) for _ in range(rnd.randint(1, 40))]
    rows += [(0, -122.5, 37.54, 900.0)]  # over the limit
    reached = spark.createDataFrame(rows, "origin long, lon double, lat double, cost double")
    origins = spark.createDataFrame([(o, 37.54) for o in range(5)], "origin long, lat double")
    got = {r.origin: (r.cells, r.km2) for r in raster.scores(reached, origins, 1.25, 700.0, most=most).collect()}
    want = {o: by_hand([r[1:] for r in rows if r[0] == o and r[3] <= 700], 1.25, 700.0, most=most) for o in range(4)} | {4: (0, 0.0)}
    assert got.keys() == want.keys()
    for o, (cells, km2) in want.items():
        assert got[o][0] == cells and got[o][1] == pytest.approx(km2)


#: A street of six nodes, stops beside the second and fifth, one route there and on to a third stop at the last node.
STREET = [(f"s{k}", -122.5 + 0.01 * k, 37.5) for k in range(6)]
STOPS = [("p1", -122.49, 37.5001), ("p2", -122.46, 37.5001), ("p3", -122.45, 37.5001)]


def network(spark):
    walks = [e for k in range(5) for e in ((f"s{k}", f"s{k + 1}", 0, 900.0), (f"s{k + 1}", f"s{k}", 0, 900.0))]
    walks += [e for s, p in (("s1", "p1"), ("s4", "p2"), ("s5", "p3")) for e in ((s, p, 0, 10.0), (p, s, 0, 10.0))]
    rides = [(f"p{k}", f"r7:{k}", 1, 0.0) for k in (1, 2, 3)] + [(f"r7:{k}", f"p{k}", 3, 0.0) for k in (1, 2, 3)] + [("r7:1", "r7:2", 2, 120.0), ("r7:2", "r7:3", 2, 60.0)]
    edges = spark.createDataFrame([(*e, 7) for e in walks + rides], "src string, dst string, kind int, weight double, route long")
    places = spark.createDataFrame(STREET + STOPS, "node string, lon double, lat double")
    return search.priced(edges, {"speed": 1.0, "wait_s": 0.0, "transfer_s": 60.0}), places


def test_legs_of_an_itinerary(spark):
    costs, places = network(spark)
    seeds = spark.createDataFrame([(1, "s0", 30.0), (2, "s4", 5.0)], "origin long, node string, cost double")
    found = search.Reach(seeds, costs, places, 3600.0, 1.0)
    ends = spark.createDataFrame([(1, 10, "s5", 1140.0, 20.0, False), (2, 20, "s3", 905.0, 0.0, True)], "origin long, goal long, node string, seconds double, walk_m double, snapped boolean")
    starts = spark.createDataFrame([(1, -122.501, 37.5), (2, -122.46, 37.5)], "origin long, lon double, lat double")
    goals = spark.createDataFrame([(10, -122.449, 37.5), (20, -122.47, 37.51)], "goal long, lon double, lat double")
    names = spark.createDataFrame([("p1", "First"), ("p2", "Second"), ("p3", "Third")], "node string, name string")
    shapes = spark.createDataFrame([(7, 1, 2, [-122.49, -122.475, -122.46], [37.5001, 37.6, 37.5001])], "route long, from_stop long, to_stop long, lons array<double>, lats array<double>")
    legs = itineraries.itineraries(found, ends, starts, goals, names, shapes).orderBy("origin", "leg").collect()
    assert [(r.origin, r.leg, r.kind, r.from_stop, r.to_stop, r.hops) for r in legs] == [(1, 1, "walk", None, None, None), (1, 2, "ride", "First", "Third", 2), (1, 3, "walk", None, None, None), (2, 1, "walk", None, None, None)]
    first, ride, last, other = legs
    assert (first.seconds, first.metres, first.lons) == (940.0, 940.0, [-122.501, -122.5, -122.49, -122.49])
    assert (ride.seconds, ride.penalty, ride.route) == (180.0, 0.0, "7")
    assert ride.lons == [-122.49, -122.475, -122.46, -122.45] and ride.lats[1] == 37.6  # its shape, then straight on
    assert (last.seconds, last.lons[-1], last.final_walk_m) == (30.0, -122.449, 20.0)
    assert (other.seconds, other.lons) == (905.0, [-122.46, -122.46, -122.47])  # snapped: it ends at the node
    assert sum(r.seconds + (r.penalty or 0) for r in legs[:3]) == pytest.approx(940 + 180 + 10 + 20)
    bare = itineraries.itineraries(found, ends.filter("origin = 1"), starts, goals, names).filter("kind = 'ride'").first()
    assert bare.lons == [-122.49, -122.46, -122.45]


def test_ways_without_lines_search_no_walks(spark, monkeypatch):
    costs, places = network(spark)
    found = search.Reach(spark.createDataFrame([(1, "s0", 30.0)], "origin long, node string, cost double"), costs, places, 3600.0, 1.0)
    ends = spark.createDataFrame([(1, 10, "s5", 1140.0, 20.0, False)], "origin long, goal long, node string, seconds double, walk_m double, snapped boolean")
    at = [spark.createDataFrame([(k, -122.5, 37.5)], f"{c} long, lon double, lat double") for k, c in ((1, "origin"), (10, "goal"))]
    names = spark.createDataFrame([("p1", "First"), ("p3", "Third")], "node string, name string")
    whole = itineraries.itineraries(found, ends, *at, names).drop("lons", "lats").collect()
    monkeypatch.setattr(search.Roads, "lines", lambda *a: pytest.fail("lines are searched"))
    assert len(whole) == 3 and sorted(itineraries.itineraries(found, ends, *at, names, lined=False).collect()) == sorted(whole)


def test_walks_are_traced_along_edges_that_add_up(spark):
    rnd = random.Random(5)
    at = {f"s{x}_{y}": (x * 0.002, y * 0.002) for x in range(8) for y in range(8)}
    metres = {}
    for a in at:
        for b in at:
            if a < b and abs(at[a][0] - at[b][0]) + abs(at[a][1] - at[b][1]) < 0.003:
                metres[a, b] = metres[b, a] = float(rnd.choice([100, 200, 300]))  # many ways of the same length
    edges = spark.createDataFrame([(a, b, 0, m, 1) for (a, b), m in metres.items()], "src string, dst string, kind int, weight double, route long")
    costs = search.priced(edges, {"speed": 1.0, "wait_s": 0.0, "transfer_s": 0.0})
    places = spark.createDataFrame([(k, *v) for k, v in at.items()], "node string, lon double, lat double")
    seeds = spark.createDataFrame([(1, "s0_0", 7.0), (1, "s1_0", 90.0), (2, "s7_7", 0.0)], "origin long, node string, cost double")
    asks = spark.createDataFrame([(o, n) for o in (1, 2) for n in list(at)[::9]], "origin long, node string")
    want = {(r.origin, r.node): r.cost for r in search.walking(seeds, costs, places, 1500.0, 1.0).collect()}
    seeded = {(1, "s0_0"): 7.0, (1, "s1_0"): 90.0, (2, "s7_7"): 0.0}
    lines = search.walk_lines(asks, seeds, costs, places, 1500.0, 1.0).collect()
    assert len(lines) == asks.join(spark.createDataFrame(list(want), "origin long, node string"), ["origin", "node"]).count()
    for r in lines:
        assert r.nodes[-1] == r.node and [at[n][0] for n in r.nodes] == r.lons
        assert seeded[r.origin, r.nodes[0]] + sum(metres[e] for e in zip(r.nodes, r.nodes[1:])) == pytest.approx(want[r.origin, r.node])
    assert search.walk_lines(asks.filter(F.lit(False)), seeds, costs, places, 1500.0, 1.0).count() == 0


def test_a_shape_is_looked_up_in_one_part(spark, tmp_path):
    from farstride.sources import feeds

    rows = [(r, a, a + 1, [float(r), 0.0], [0.0, float(a)]) for r in range(40) for a in range(25)]
    shapes = spark.createDataFrame(rows, "route long, from_stop long, to_stop long, lons array<double>, lats array<double>")
    feeds.write_shapes(shapes, f"{tmp_path}/shapes", 16)
    one = feeds.shape_of(spark, f"{tmp_path}/shapes", 7, 3, 4, 16)
    assert [tuple(r) for r in one.collect()] == [(7, 3, 4, [7.0, 0.0], [0.0, 3.0])]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan and "PushedFilters: [IsNotNull(route)" in plan
    scan = one._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert scan.selectedPartitions().toString().count("part=") <= 1 or scan.metrics().apply("numFiles").value() == 1
    asked = shapes.filter("route = 3 AND from_stop < 4").select("route", "from_stop", "to_stop")
    assert sorted(r.from_stop for r in feeds.shapes_of(spark, f"{tmp_path}/shapes", asked, 16).collect()) == [0, 1, 2, 3]
    assert feeds.shape_of(spark, f"{tmp_path}/shapes", 99, 3, 4, 16).count() == 0
