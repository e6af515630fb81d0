"""Hand-worked fixtures of the schedule, map and score rules."""

import random

import pytest
from pyspark.sql import functions as F

from farstride.functions import geo, scalars
from farstride.operators import graph, raster, score, search, shapes, streets, transit


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_fastest_hops_by_period(spark):
    times = [("T1", 1, "A", "07:00:00"), ("T1", 2, "B", None), ("T1", 3, "C", "07:10:00"), ("T2", 1, "A", "25:00:00"), ("T2", 2, "B", "25:04:00"), ("T2", 3, "C", "25:09:00"),
             ("T3", 1, "A", "09:00:00"), ("T3", 2, "B", "09:07:00"), ("T3", 3, "B", "09:07:00"), ("T3", 4, "C", "09:08:00"), ("T4", 1, "C", "12:00:00"), ("T4", 2, "D", "11:59:00")]
    st = spark.createDataFrame(times, "trip string, seq int, stop string, at string").withColumn("t", scalars.gtfs_seconds("at"))
    st = transit.interpolate(st)
    trips = spark.createDataFrame([("T1", "R1", "WK"), ("T2", "R1", "WK"), ("T3", "R1", "SU"), ("T4", "R2", "XX")], "trip string, route string, service string")
    days = "monday string, tuesday string, wednesday string, thursday string, friday string, saturday string, sunday string"
    calendar = spark.createDataFrame([("WK", *"1111100"), ("SU", *"0000011")], f"service_id string, {days}")
    added = spark.createDataFrame([("XX", "20261128", "1")], "service_id string, date string, exception_type string")
    hops = transit.fastest_hops(transit.raw_hops(st.withColumns({"arr": F.col("t"), "dep": F.col("t")})), trips, transit.day_types(calendar, added))
    assert {tuple(r) for r in hops.collect()} == {
        ("R1", "A", "B", 240, 300, None, None, 420, 240), ("R1", "B", "C", 60, 300, None, None, 60, 300), ("R2", "C", "D", 0, None, None, None, 0, None),
    }


@pytest.mark.parametrize(("kind", "group"), [(3, 0), (11, 0), (700, 0), (9999, 0), (1, 1), (12, 1), (109, 1), (405, 1), (0, 2), (7, 2), (900, 2), (1300, 2), (4, 3), (1000, 3), (1200, 3)])
def test_mode_groups(spark, kind, group):
    assert one(spark, scalars.mode_group(F.lit(kind))) == group


def test_interpolation_carries_the_last_and_leaves_leading_blanks(spark):
    rows = [("t", i, v) for i, v in enumerate([None, 1.0, None, 3.0, None])]
    got = transit.interpolate(spark.createDataFrame(rows, "trip string, seq int, t double")).orderBy("seq").collect()
    assert [r.t for r in got] == [None, 1, 2, 3, 3]


def test_distances_and_projection(spark):
    p, q = (-122.4056, 37.7852), (-122.2712, 37.8044)
    assert one(spark, geo.haversine(*p, *q)) == pytest.approx(12000.8256, abs=1e-3)
    assert one(spark, geo.meters_between(*p, *q)) == pytest.approx(12000.8181, abs=1e-3)
    assert one(spark, geo.mercator_x(p[0])) == pytest.approx(0.159984444) and one(spark, geo.mercator_y(p[1])) == pytest.approx(0.386484737)
    assert one(spark, geo.meters_per_mercator_unit(p[1])) == pytest.approx(31671818.895)
    assert one(spark, geo.mercator_lat(geo.mercator_y(p[1]))) == pytest.approx(p[1])


def test_service_area(spark):
    points = [(-122.4056, 37.7852, True), (-122.27, 37.87, True), (-121.4944, 38.5816, False), (-122.03, 36.97, False), (-121.74, 38.54, False)]
    for lon, lat, inside in points:
        assert one(spark, geo.in_polygon(lon, lat, geo.SERVICE_AREA)) is inside


@pytest.mark.parametrize(("x", "y", "d"), [(0, 0, 0), (0, 65535, 1431655765), (65535, 65535, 2863311530), (65535, 0, 4294967295), (32768, 32768, 2147483648), (12345, 54321, 1555040834)])
def test_hilbert(spark, x, y, d):
    assert one(spark, geo.hilbert(F.lit(x), F.lit(y))) == d


def test_percentiles_and_quantiles(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (4.0,)], "v double")
    assert {r.v: r.pct for r in score.percentiles(df, "v").collect()} == {1: 0, 2: 25, 4: 75}
    assert {r.share: r.v for r in score.quantiles(df, "v", (0.5, 0.75, 1.0)).collect()} == {0.5: 2, 0.75: 4, 1.0: 4}


def test_guesses(spark):
    got = [one(spark, scalars.tile_colour(scalars.pct_of_best(F.lit(float(x)), F.lit(200.0)))) for x in (190, 160, 120, 100, 250)]
    assert got == ["green", "yellow", "orange", "red", "green"]
    assert [one(spark, scalars.band_minutes(F.lit(m))) for m in (15, 45, 50, 90, 95, 180, 181)] == [5, 5, 10, 10, 15, 15, 30]
    assert one(spark, scalars.day_number(F.lit("2026-10-02").cast("date"), "2026-09-30")) == 3


def test_puzzle_grid_and_steps(spark):
    assert spark.sql(score.puzzle_grid()).count() == 138
    assert len(raster.offsets()) == 113


SEARCH = [("s0", "s1", 0, 1000.0), ("s1", "s0", 0, 1000.0), ("s0", "p0", 0, 0.0), ("p0", "s0", 0, 0.0), ("s1", "p1", 0, 0.0), ("p1", "s1", 0, 0.0), ("p0", "r0", 1, 0.0), ("r0", "p0", 3, 0.0), ("p1", "r1", 1, 0.0), ("r1", "p1", 3, 0.0), ("r0", "r1", 2, 300.0)]


@pytest.mark.parametrize(("wait", "s1"), [(0.0, 300), (600.0, 900), (720.0, 1000)])
def test_search_prefers_the_cheaper_way(spark, wait, s1):
    edges = spark.createDataFrame([(*e, 7) for e in SEARCH], "src string, dst string, kind int, weight double, route long")
    seeds = spark.createDataFrame([(1, "s0", 0.0)], "origin long, node string, cost double")
    costs = search.priced(edges, {"speed": 1.0, "wait_s": wait, "transfer_s": 300.0})
    labels = search.search(seeds, costs, 3600.0)
    best = {r.node: r.cost for r in search.best(labels).collect()}
    assert best["s0"] == 0 and best["p0"] == 0 and best["s1"] == s1 and best["p1"] == s1
    places = spark.createDataFrame([("s0", 0.0, 0.0), ("p0", 0.0, 0.0), ("s1", 0.009, 0.0), ("p1", 0.009, 0.0)], "node string, lon double, lat double")
    found = search.Reach(seeds, costs, places, 3600.0, 1.0)
    assert {r.node: r.cost for r in found.best.collect()} == {n: c for n, c in best.items() if n[0] != "r"}
    target = spark.createDataFrame([(1, "s1")], "origin long, node string")
    for path in (search.paths(labels, target), found.paths(target)):
        assert search.legs(path).agg(F.sum(F.coalesce("seconds", F.lit(0.0)) + F.coalesce("penalty", F.lit(0.0)))).first()[0] == s1


def test_reach_agrees_with_the_search_on_a_network(spark):
    """Streets in a lattice with random lengths, four routes with several stops, all street nodes as origins."""
    rnd = random.Random(3)
    at = {(x, y): f"s{x}_{y}" for x in range(7) for y in range(6)}
    edges = []
    for (x, y), a in at.items():
        for b in (at.get((x + 1, y)), at.get((x, y + 1))):
            if b and rnd.random() < 0.9:
                m = rnd.uniform(80, 400)
                edges += [(a, b, 0, m), (b, a, 0, m)]
    for p in range(8):
        s = rnd.choice(list(at.values()))
        edges += [(s, f"p{p}", 0, 20.0), (f"p{p}", s, 0, 20.0)]
        home = s.removeprefix("s").split("_")
        at[f"p{p}"] = tuple(map(int, home))
    for r in range(4):
        stops = rnd.sample(range(8), 4)
        edges += [e for p in stops for e in ((f"p{p}", f"r{r}:{p}", 1, 0.0), (f"r{r}:{p}", f"p{p}", 3, 0.0))]
        edges += [(f"r{r}:{a}", f"r{r}:{b}", 2, rnd.uniform(30, 120)) for a, b in zip(stops, stops[1:])]
    graph_ = spark.createDataFrame([(*e, 7) for e in edges], "src string, dst string, kind int, weight double, route long")
    costs = search.priced(graph_, {"speed": 1.0, "wait_s": 0.0, "transfer_s": 60.0})
    places = spark.createDataFrame([(k, v[0] * 0.002, v[1] * 0.002) if isinstance(v, tuple) else (v, k[0] * 0.002, k[1] * 0.002) for k, v in at.items()], "node string, lon double, lat double")
    origins = places.filter("node like 's%'").select(F.col("node").alias("origin"), "lon", "lat")
    seeds = origins.select("origin", F.col("origin").alias("node"), F.lit(0.0).alias("cost"))
    want = {(r.origin, r.node): r.cost for r in search.best(search.search(seeds, costs, 900.0)).collect() if r.node[0] != "r"}
    found = search.Reach(seeds, costs, places, 900.0, 1.0)
    got = {(r.origin, r.node): r.cost for r in found.best.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    far = found.best.groupBy("origin").agg(F.max(F.struct("cost", "node")).alias("f")).select("origin", "f.node", "f.cost")
    legs = search.legs(found.paths(far.select("origin", "node"))).groupBy("origin").agg(F.sum(F.coalesce("seconds", F.lit(0.0)) + F.coalesce("penalty", F.lit(0.0))).alias("s"))
    for r in far.join(legs, "origin").collect():
        assert r.s == pytest.approx(r.cost, abs=1.0)  # legs of less than half a second are left out


def test_search_without_the_mode_walks(spark):
    edges = spark.createDataFrame([(*e, 7) for e in SEARCH], "src string, dst string, kind int, weight double, route long")
    modes = spark.createDataFrame([(7, 0)], "route long, mode int")
    costs = search.priced(edges, {"speed": 1.0, "wait_s": 0.0, "transfer_s": 300.0}, [1], modes)
    seeds = spark.createDataFrame([(1, "s0", 0.0)], "origin long, node string, cost double")
    assert {r.node: r.cost for r in search.best(search.search(seeds, costs, 3600.0)).collect()} == {"s0": 0, "p0": 0, "s1": 1000, "p1": 1000}


def test_components_and_snapping(spark):
    nodes = spark.createDataFrame([(i, -122.0 + i * 0.001, 37.0) for i in range(6)], "node long, lon double, lat double")
    edges = spark.createDataFrame([(1, 0), (1, 2), (4, 5)], "u long, v long")
    assert {r.node: r.component for r in streets.components(nodes, edges).collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 4}
    stops = spark.createDataFrame([(9, -121.9991, 37.0), (8, -121.0, 37.0)], "id long, lon double, lat double")
    near = streets.snap(stops, nodes.withColumnRenamed("node", "id")).collect()
    assert [(r.id, r.other) for r in near] == [(9, 1)]


def test_splat_covers_chamfer(spark):
    cells = spark.createDataFrame([(1, 0, 0, 0.0), (1, 3, 1, 50.0), (1, 9, 9, 10.0)], "origin long, cx long, cy long, cost double")
    a = {(r.cx, r.cy): r.cost for r in raster.splat(cells, 1.25, 700.0).collect()}
    b = {(r.cx, r.cy): r.cost for r in raster.chamfer(cells, 1.25, 700.0).collect()}
    assert b.keys() <= a.keys() and all(b[k] >= a[k] - 1e-3 for k in b)


def test_codes(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([5, 3, 300, -7])], "i long, v long")
    coded = graph.delta_coded(df, "v", "i")
    assert [r.value for r in graph.delta_decoded(coded, "i").orderBy("i").collect()] == [5, 3, 300, -7]
    assert one(spark, scalars.varint_bytes(F.lit(127))) == 1 and one(spark, scalars.varint_bytes(F.lit(128))) == 2


def test_hop_shapes_are_cut_between_stops(spark):
    stops = spark.createDataFrame([(1, 5, 0, 10, 0.0, 0.0), (1, 5, 1, 11, 100.0, 0.0), (1, 5, 2, 12, 100.0, 100.0)], "pattern long, route long, seq int, stop long, x double, y double")
    line = spark.createDataFrame([(1, 0, 0.0, 1.0), (1, 1, 50.0, 30.0), (1, 2, 100.0, 1.0), (1, 3, 100.0, 100.0)], "pattern long, seq int, x double, y double")
    got = {(r.from_stop, r.to_stop): list(zip(r.xs, r.ys)) for r in shapes.hop_shapes(stops, line).collect()}
    assert got[(10, 11)][0] == (0, 0) and (50, 30) in got[(10, 11)] and got[(11, 12)][-1] == (100, 100)


def test_latest_request_on_a_stream(spark, tmp_path):
    from farstride.streaming import requests

    source = str(tmp_path / "in")
    spark.createDataFrame([(1, 1, "a"), (1, 3, "b"), (2, 2, "c")], "session long, request long, what string").write.parquet(source)
    stream = spark.readStream.schema("session long, request long, what string").parquet(source)
    requests.serve(stream, lambda df: df, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(60)
    assert {(r.session, r.request) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(1, 3), (2, 2)}


def test_feed_reader(spark, tmp_path):
    from farstride.sources import feeds

    (tmp_path / "stops.txt").write_text("﻿stop_id, stop_lon ,stop_lat\nA, 1.5,NA\nB,,2\n")
    rows = feeds.read_feeds(spark, {"f": str(tmp_path)}, "stops", ("stop_id",)).orderBy("stop_id").collect()
    assert [(r.stop_id, r.stop_lon, r.stop_lat) for r in rows] == [("f:A", "1.5", "NA"), ("f:B", None, "2")]
    assert feeds.read_table(spark, str(tmp_path), "shapes") is None
