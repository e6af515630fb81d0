"""Gates of a day's area: scores under each twist against a heap search that is painted cell by cell, and what the grid rejects."""

import datetime
import heapq
import math
import random
from collections import defaultdict
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from farstride.operators import graph, raster, schedule, score, search
from farstride.plans import catalog, puzzles


@pytest.fixture(scope="module")
def small(tmp_path_factory):
    """Ten rows of street nodes, stops along them, and trips at all hours of all days of the week."""
    rnd, path = random.Random(7), tmp_path_factory.mktemp("gates")
    near = [k for k in range(40) if (k * 104729) % 1000 < 110]
    orders = [(o, rnd.randrange(400), "F", 1.0, datetime.datetime(1995, 1, 2) + datetime.timedelta(o % 7), "1-URGENT") for o in range(300)]
    lines = [(o, p, rnd.choice(near), p, float(rnd.randint(1, 4)), 1.0, "A") for o in range(300) for p in range(1, 5)]
    tables = {
        "customer": pd.DataFrame([(k, k % 25) for k in range(400)], columns=["c_custkey", "c_nationkey"]).astype({"c_nationkey": "int32"}),
        "supplier": pd.DataFrame([(k, f"S{k}") for k in near], columns=["s_suppkey", "s_name"]),
        "orders": pd.DataFrame(orders, columns=["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]).astype({"o_orderdate": "datetime64[us]"}),
        "lineitem": pd.DataFrame(lines, columns=["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag"]).astype({"l_linenumber": "int32"}),
        "nation": pd.DataFrame([(k, f"N{k}") for k in range(25)], columns=["n_nationkey", "n_name"]).astype({"n_nationkey": "int32"}),
    }
    for name, rows in tables.items():
        rows.to_parquet(path / f"{name}.parquet")
    return str(path)


#: Two points among the streets, and one with no street within 300 m.
POINTS = [(0, -122.4795, 37.5041), (1, -122.4303, 37.5012), (40, -122.45, 37.5285)]


@pytest.fixture(scope="module")
def gates(spark, small):
    return puzzles.Gates(spark, small, spark.createDataFrame(POINTS, "area long, lon double, lat double"))


def metres(lon, lat, x, y):
    return math.hypot((x - lon) * 111_195 * math.cos(math.radians(lat)), (y - lat) * 111_195)


def by_heap(edges, routes, places, lon, lat, own):
    """Least costs of streets and stops from a point, over unboarded and boarded states."""
    away = {n: metres(lon, lat, *at) for n, at in places.items() if n[0] == "s"}
    ring = next(r for r in (1, 2, 4, 8, 16) if any(d <= 300 * r for d in away.values()))
    heap, done = [(d / own["speed"], n, 0) for n, d in away.items() if d <= 300 * ring], {}
    heapq.heapify(heap)
    while heap:
        cost, node, boarded = heapq.heappop(heap)
        if (node, boarded) in done or cost > own["limit_s"]:
            continue
        done[node, boarded] = cost
        for e in edges[node]:
            if e.kind == graph.BOARD:
                if own["modes"] is None or routes[e.route] in own["modes"]:
                    heapq.heappush(heap, (cost + (own["transfer_s"] if boarded else 0.0), e.dst, 1))
            else:
                more = e.weight / own["speed"] if e.kind == graph.WALK else 0.0 if e.kind == graph.ALIGHT else e[own["period"]]
                if more is not None:
                    heapq.heappush(heap, (cost + more, e.dst, boarded))
    best = defaultdict(lambda: math.inf)
    for (n, _), c in done.items():
        if n in places:
            best[n] = min(best[n], c)
    return best


def test_scores_are_those_of_a_search_under_each_twist(spark, small, gates):
    """They were a formula of the coordinates, which no network, period, mode, speed or limit had a part in."""
    edges = defaultdict(list)
    for e in catalog.graph_edges(spark, small, ("s_rush", "s_night", "s_weekend")).collect():
        edges[e.src].append(e)
    routes = {r.route: r.mode for r in catalog.view(spark, small, "routes").select("route", catalog.scalars.mode_group("route_type").alias("mode")).collect()}
    places = {r.node: (r.lon, r.lat) for r in catalog.node_places(spark, small).collect()}
    points = spark.createDataFrame(POINTS, "id long, lon double, lat double")
    seen = defaultdict(set)
    for twist, own in puzzles.SETTINGS.items():
        want = {}
        for k, lon, lat in POINTS:
            best = by_heap(edges, routes, places, lon, lat, own)
            at = [(n, c) for n, c in best.items()]
            x, y = ([f(*places[n]) for n, _ in at] for f in (lambda a, _: (a + 180) / 360, lambda _, b: 0.5 - math.log(math.tan(math.pi / 4 + math.radians(b) / 2)) / (2 * math.pi)))
            unit = math.cos(math.radians(lat)) * 40_075_016.686
            col = lambda v: pd.Series(v).to_numpy()
            want[k] = raster.swept_areas([(k, unit, col(x), col(y), col([c for _, c in at]))], own["speed"], own["limit_s"])[0][1]
        got = {r.id: r.km2 for r in gates.scored(points, twist, 3).collect()}
        assert got == pytest.approx(want, abs=0.004)  # two cells may lie on either side of the limit
        for k, v in want.items():
            seen[k].add(round(v, 2))
    assert all(len(v) >= 3 for v in seen.values())  # twists differ


def test_grids_decide_after_probes(spark, gates, monkeypatch):
    """An area whose probes differ is rejected by its grid if a random spot is nearly the best, or if it has too little land."""
    as_if = lambda where, km2: monkeypatch.setattr(gates, "scored", lambda points, twist, many: points.withColumn("km2", F.when(where, km2).otherwise(20.0)))
    near, far = SimpleNamespace(lon=-122.46, lat=37.508), SimpleNamespace(lon=-122.46, lat=37.5285)
    as_if(F.abs(F.col("lon") + 122.46) < 1e-9, 12.0)  # the middle is poor; it's probed, but no point of the grid
    assert gates.probed([near], [0], "rush") == [0] and gates.gridded([near], [0], "rush") == [] and gates.first([near], "rush") is None
    as_if(F.col("lat") < 37.512, 12.0)  # a fifth of the near area is good
    assert gates.probed([far, near, near], range(3), "rush") == [1, 2] and gates.first([far, near, near], "rush") == 1
    as_if(F.col("lat") < 37.5325, 12.0)  # a fifth of the far area is good, but most of it lies beyond the streets
    assert gates.probed([far], [0], "rush") == [0] and gates.gridded([far], [0], "rush") == [] and gates.first([far], "rush") is None


def test_days_without_an_area_are_rows_unless_strict(spark):
    days = spark.createDataFrame([(1, datetime.date(2026, 9, 30), "rush"), (2, datetime.date(2026, 10, 1), "no-bus")], "n long, date date, twist string")
    areas = spark.createDataFrame([(k, f"area {k % 50}", -122.5 + 0.1 * k, 37.5, 5 + k % 7, k) for k in range(60)], "area long, name string, lon double, lat double, weight long, ord long")
    asked = []

    def first(drawn, twist):
        asked.append([r.name for r in drawn])
        return None if twist == "rush" else 2

    got = schedule.puzzle_days(days, areas, first, attempts=20, strict=False).orderBy("n").collect()
    assert [(r.area, r.name, r.attempt) for r in got] == [(None, None, 20), (got[1].area, asked[1][2], 3)]
    assert len(asked[0]) == len(set(asked[0])) == 20 and not set(asked[0]) & set(asked[1])
