"""Rules of the puzzle calendar, places, feeds and pictures on small hand-worked tables."""

import itertools

import pytest
from pyspark.sql import functions as F

from farstride.functions import geo
from farstride.operators import graph, hygiene, places, raster, schedule, score, search
from farstride.plans import puzzles


def test_cycles_have_each_twist_once_and_no_early_repeats():
    names = [t[0] for t in score.TWISTS]
    orders = schedule.cycles(40, len(names))
    assert [" ".join(names[t] for t in o) for o in orders[:3]] == puzzles.ORDERS
    assert all(sorted(o) == list(range(10)) for o in orders)
    assert all(not set(a[-3:]) & set(b[:3]) for a, b in itertools.pairwise(orders))


def test_nth_draw_is_the_generators(spark):
    numbers = list(itertools.islice(schedule.draws(schedule.NODE_SEED), 300))
    got = [r.x for r in spark.range(300).select("id", schedule.nth_draw(F.col("id"), schedule.NODE_SEED).alias("x")).orderBy("id").collect()]
    assert got == numbers and all(0 <= x < 1 for x in got)


def test_running_totals_and_dense_numbers(spark):
    df = spark.createDataFrame([(k, (k * 7) % 5) for k in range(200)], "k long, v long").repartition(7)
    want = list(itertools.accumulate([0] + [(k * 7) % 5 for k in range(199)]))
    assert [r.t for r in graph.running(df, ["k"], "v", "t").orderBy("k").collect()] == want
    assert [r.i for r in graph.dense_ids(df, ["k"], "i").orderBy("k").collect()] == list(range(200))
    assert graph.running(df.limit(0), ["k"], "v", "t").count() == 0


def square(x, y, side):
    at = [(x, y), (x + side, y), (x + side, y + side), (x, y + side)]
    return [{"x1": a[0], "y1": a[1], "x2": b[0], "y2": b[1]} for a, b in zip(at, at[1:] + at[:1])]


def test_last_boundary_wins_and_the_county_stands_in(spark):
    ps = spark.createDataFrame([(1, "A", 0.5, 0.5), (2, "B", 1.5, 1.5), (3, "C", 9.0, 9.0), (4, "North", 2.5, 2.5)], "place long, name string, lon double, lat double")
    schema = "ord long, name string, edges array<struct<x1: double, y1: double, x2: double, y2: double>>"
    cities = spark.createDataFrame([(1, "Old", square(0.0, 0.0, 2.0)), (2, "New", square(0.0, 0.0, 1.0))], schema)
    counties = spark.createDataFrame([(1, "North", square(0.0, 0.0, 4.0))], schema)
    got = {r.place: (r.city, r.label) for r in places.with_city(ps, cities, counties).withColumn("label", places.label("name", "city")).collect()}
    assert got == {1: ("New", "A, New"), 2: ("Old", "B, Old"), 3: ("", "C"), 4: ("North", "North")}


def test_feed_rules(spark):
    st = spark.createDataFrame([(1, 5.0, None), (2, None, 7.0), (3, None, None)], "seq int, arr double, dep double")
    assert [tuple(r)[1:] for r in hygiene.both_times(st).orderBy("seq").collect()] == [(5, 5), (7, 7), (None, None)]
    rows = spark.createDataFrame([("k", 2, "b"), ("k", 1, "a"), ("l", 3, None)], "key string, ord int, v string")
    assert {(r.key, r.v) for r in hygiene.first_rows(rows, ["key"], ["ord"]).collect()} == {("k", "a"), ("l", None)}
    assert {(r.key, r.v) for r in hygiene.later_wins(rows, ["key"], ["ord"]).collect()} == {("k", "b"), ("l", None)}
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        spark.createDataFrame([("NA",)], "x string").select(hygiene.strict_number(F.col("x"))).collect()


def test_destination_beyond_the_limit_ends_at_the_nearest_reached_node(spark):
    reached = spark.createDataFrame([(1, "s1", 100.0), (1, "s2", 880.0)], "origin long, node string, cost double")
    asked = spark.createDataFrame([(1, 7), (1, 8)], "origin long, goal long")
    near = spark.createDataFrame([(7, "s1", 300.0), (7, "s2", 10.0), (8, "s2", 50.0), (8, "s9", 1.0)], "goal long, node string, d double")
    got = {r.goal: (r.node, r.seconds, r.walk_m, r.snapped) for r in search.destinations(reached, asked, near, "goal", 400.0, 900.0, 1.0).collect()}
    assert got == {7: ("s1", 400.0, 300.0, False), 8: ("s2", 880.0, 0.0, True)}


def test_sweeps_in_waves_are_those_cell_by_cell(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    seeds = {(int(x), int(y)): float(c) for x, y, c in zip(rng.integers(0, 18, 12), rng.integers(0, 11, 12), rng.integers(0, 600, 12))}
    df = spark.createDataFrame([(1, x, y, c) for (x, y), c in seeds.items()], "origin long, cx long, cy long, cost double")
    pad, w, h = 8, max(x for x, _ in seeds) + 17, max(y for _, y in seeds) + 17
    time, walk = np.full((h, w), np.inf, dtype=np.float32), np.zeros((h, w))
    for (x, y), c in seeds.items():
        time[y + pad, x + pad] = c
    for sign in (1, -1):
        for y in list(range(1, h - 1))[::sign]:
            for x in list(range(1, w - 1))[::sign]:
                for dy, dx in ((0, -1), (-1, 0), (-1, -1), (-1, 1)):
                    step = 40.0 * (2**0.5 if dx and dy else 1)
                    a, b = y + sign * dy, x + sign * dx
                    if walk[a, b] + step <= 250 and time[a, b] + step / 1.25 < time[y, x] and time[a, b] + step / 1.25 <= 700:
                        time[y, x], walk[y, x] = time[a, b] + step / 1.25, walk[a, b] + step
    want = {(x - pad, y - pad): float(time[y, x]) for y in range(h) for x in range(w) if np.isfinite(time[y, x])}
    low = min(x for x, _ in seeds), min(y for _, y in seeds)
    got = {(r.cx, r.cy): r.cost for r in raster.chamfer(df, 1.25, 700.0).collect()}
    assert low[0] >= 0 and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-3 for k in want)


def test_colours_and_segments(spark):
    shares = spark.createDataFrame([(0.0,), (0.2,), (0.88,), (2.0,)], "t double")
    got = [tuple(round(x, 3) for x in r.c) for r in shares.select(raster.ramp("t").alias("c")).collect()]
    assert got == [(201, 123, 107), (217, 159.5, 125), (111, 179, 138), (47, 143, 106)]
    assert spark.range(1).select(geo.from_segment(F.lit(3.0), F.lit(4.0), 0.0, 0.0, 0.0, 0.0)).first()[0] == 5.0


def test_zipped_feeds(spark, tmp_path):
    import zipfile

    from farstride.sources import feeds

    for feed, text in (("a", "﻿stop_id, stop_lon ,stop_lat\nA, 1.5,NA\nB,,2\n"), ("b", "stop_id,stop_name\n\"C, D\",x\n")):
        with zipfile.ZipFile(tmp_path / f"{feed}.zip", "w") as z:
            z.writestr("inner/stops.txt", text)
            z.writestr("other/stops.txt", "stop_id\nwrong\n")
    got = feeds.read_zipped(spark, f"{tmp_path}/*.zip", "stops").orderBy("feed", "stop_id").collect()
    assert [(r.feed, r.stop_id, r.stop_lon, r.stop_lat, r.stop_name) for r in got] == [("a", "A", "1.5", "NA", None), ("a", "B", None, "2", None), ("b", "C, D", None, None, "x")]
    assert feeds.read_zipped(spark, f"{tmp_path}/*.zip", "trips") is None
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.writestr("stop_times.txt", 'trip_id,arrival_time,departure_time,stop_id,stop_sequence,extra\n"T\n1", 5:00:00,,S,1,x\n')
        z.writestr("agency.txt", "agency_name\nLine\n")
    tables = feeds.load_zipped(spark, f"{tmp_path}/*.zip")
    assert sorted(tables) == ["agency", "stop_times", "stops"]
    assert [tuple(r) for r in tables["stop_times"].collect()] == [("c", "T\n1", "5:00:00", None, "S", "1")]
    assert [tuple(r) for r in tables["agency"].collect()] == [("c", None, "Line")]
    assert "stop_name" not in feeds.read_zipped(spark, f"{tmp_path}/*.zip", "stops", ["stop_id"]).columns
    with zipfile.ZipFile(tmp_path / "d.zip", "w") as z:
        z.writestr("stop_times.txt", "trip_id,stop_id\nT,S\n")
    with pytest.raises(Exception, match="stop_times.txt has no"):
        feeds.read_zipped(spark, f"{tmp_path}/d.zip", "stop_times").collect()


def test_stops_of_a_loop_are_not_placed_backwards():
    import numpy as np

    from farstride.operators import shapes

    line = np.array([[0.0, 0.0], [1000.0, 0.0], [1000.0, 500.0], [0.0, 500.0]])
    stops = np.array([[100.0, 5.0], [900.0, 5.0], [850.0, 5.0], [100.0, 490.0]])
    assert shapes.placed(line, np.array([4]), stops, np.array([4])).tolist() == [0, 0, 0, 2]
    bent = np.array([[0.0, 0.0], [50.0, 2.0], [100.0, 0.0], [150.0, 40.0], [200.0, 0.0]])
    assert shapes.kept(np.vstack([bent, bent[:2]]), np.array([5, 2])).tolist() == [True, False, True, True, True, True, True]


def test_areas_of_one_centre_share_their_grid(spark, tmp_path, monkeypatch):
    import pandas as pd

    pd.DataFrame([(1 + 1000 * k, f"P{k}", 3) for k in range(20)], columns=["p_partkey", "p_name", "p_size"]).to_parquet(tmp_path / "part.parquet")
    pd.DataFrame([(k, 0) for k in range(1600)], columns=["c_custkey", "c_nationkey"]).to_parquet(tmp_path / "customer.parquet")
    pd.DataFrame([(k, f"N{k}") for k in range(25)], columns=["n_nationkey", "n_name"]).to_parquet(tmp_path / "nation.parquet")
    seen, plain = [], puzzles.on_land
    monkeypatch.setattr(puzzles, "on_land", lambda spark, sf, grid: seen.append(grid.count()) or plain(spark, sf, grid))
    got = puzzles.query.__globals__["QUERIES"]["area_land"](spark, str(tmp_path)).collect()
    assert len(got) == 20 and len({(r.possible, r.land) for r in got}) == 1 and seen == [got[0].possible]


def test_fresh_areas_are_not_broadcast(spark):
    import datetime

    day = datetime.date(2020, 1, 1)
    used = spark.createDataFrame([(day, "u", 0.0, 0.0)] * 3, "day date, name string, lon double, lat double")
    rows = [(day + datetime.timedelta(d), n, lon, 0.0) for d, n, lon in ((0, "a", 0.0), (1, "b", 0.0), (14, "c", 0.02), (15, "d", 0.0), (3, "e", 0.03), (3, "u", 5.0), (1, "b", 0.0))]
    new = spark.createDataFrame(rows, "day date, name string, lon double, lat double")
    out = schedule.fresh(new, used)
    assert sorted(r.name for r in out.collect()) == ["a", "d", "e"]
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("BroadcastHashJoin") + plan.count("BroadcastNestedLoopJoin") <= 1  # the used names at most


def test_candidates_of_one_position_share_their_pairs(spark, monkeypatch):
    from farstride.operators import streets

    ps = spark.createDataFrame([(k, 0.0, 0.0) for k in range(30)] + [(99, 1.0, 1.0), (7, 0.0, 0.0)], "id long, lon double, lat double")
    halts = spark.createDataFrame([(k, 0.001, 0.0) for k in range(40)] + [(k, 1.0, 1.0) for k in range(4)], "id long, lon double, lat double")
    met = []
    monkeypatch.setattr(score, "cell_join", lambda *a: met.append(streets.cell_join(*a)) or met[-1])
    got = {r.id: r.weight for r in score.candidates(ps, halts).collect()}
    assert got == {k: 60 if k == 7 else 40 for k in range(30)}  # place 7 has two rows
    assert met[0].count() == 2


def scattered(spark, origins=5, side=150, seeds=40):
    import random

    rnd = random.Random(8)
    rows = {(o, rnd.randrange(-side, side), rnd.randrange(side // (o + 1) + 1)): float(rnd.randrange(650)) for o in range(origins) for _ in range(seeds)}
    return rows, spark.createDataFrame([(*k, c) for k, c in rows.items()], "origin long, cx long, cy long, cost double")


def test_steps_are_reduced_where_they_are_made(spark):
    rows, df = scattered(spark)
    want = {}
    for (o, x, y), c in rows.items():
        for dx, dy, d in raster.offsets():
            if c + d / 1.25 <= 700:
                want[o, x + dx, y + dy] = min(c + d / 1.25, want.get((o, x + dx, y + dy), 1e9))
    out = raster.splat(df, 1.25, 700.0)
    got = out.select("*").collect()
    assert {(r.origin, r.cx, r.cy): r.cost for r in got} == want and len(got) == len(want)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("HashAggregate") < plan.index("Generate explode(") < plan.index("Exchange")


def test_grids_swept_side_by_side_are_those_swept_alone(spark, monkeypatch):
    _, df = scattered(spark, side=40)
    df = df.withColumn("cell", F.when(F.col("origin") == 2, 55.0).otherwise(40.0))
    swept = lambda: sorted(tuple(r) for r in raster.chamfer(df, 1.25, 700.0).collect())
    monkeypatch.setattr(raster, "ORIGINS", 1)
    alone = swept()
    monkeypatch.setattr(raster, "ORIGINS", 100)
    assert swept() == alone
    monkeypatch.setattr(raster, "SWEPT", 12_000)
    assert swept() == alone


def test_pointers_see_what_is_painted_and_nothing_is_broadcast(spark):
    rows, df = scattered(spark)
    size = raster.CELL_M / spark.range(1).select(geo.meters_per_mercator_unit(F.lit(37.54))).first()[0]
    middle = lambda c: (F.col(c) + 20_000.5) * size
    df = df.withColumns({"cx": F.col("cx") + 20_000, "cy": F.col("cy") + 20_000})
    grid = spark.range(6).select(F.col("id").alias("origin")).crossJoin(spark.range(-160, 160, 3).select(F.col("id").alias("px"))).crossJoin(spark.range(-8, 90, 3).select(F.col("id").alias("py")))
    points = grid.select("origin", "px", "py", geo.mercator_lon(middle("px")).alias("lon"), geo.mercator_lat(middle("py")).alias("lat"), F.lit(37.54).alias("lat0"))
    points = spark.createDataFrame(points.unionByName(points.limit(50)).collect(), points.schema)
    out = raster.painted_at(points, df, 1.25, 700.0)
    want = sorted((r.origin, r.px, r.py, r.cost or -1) for r in raster.look_up(points, raster.splat(df, 1.25, 700.0)).collect())
    assert sorted((r.origin, r.px, r.py, r.cost or -1) for r in out.collect()) == want and len({r[3] for r in want}) > 50
    assert "Broadcast" not in out._jdf.queryExecution().sparkPlan().toString()
