"""Registered queries against brute force on small tables, with every origin, event and supplier."""

import datetime
import heapq
import random
from collections import defaultdict

import pandas as pd
import pytest
from pyspark.sql import functions as F

from farstride.operators import graph, search, transit
from farstride.plans import catalog


@pytest.fixture(scope="module")
def small(tmp_path_factory):
    """Two rows of street nodes with stops along them, and events of users with all last digits."""
    rnd, path = random.Random(5), tmp_path_factory.mktemp("small")
    # supplier keys whose stops lie on the two rows of streets
    near = [k for k in range(400) if (k * 104729) % 1000 < 40][:12]
    orders = [(o, rnd.randrange(80), "F", 1.0, datetime.datetime(1995, 1, 2) + datetime.timedelta(o % 7), "1-URGENT") for o in range(40)]
    lines = [(o, p, rnd.choice(near), p, float(rnd.randint(1, 9)), 1.0, "A") for o in range(40) for p in range(1, 5)]
    tables = {
        "customer": pd.DataFrame([(k, k % 25) for k in range(80)], columns=["c_custkey", "c_nationkey"]).astype({"c_nationkey": "int32"}),
        "supplier": pd.DataFrame([(k, f"S{k}") for k in near], columns=["s_suppkey", "s_name"]),
        "orders": pd.DataFrame(orders, columns=["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]).astype({"o_orderdate": "datetime64[us]"}),
        "lineitem": pd.DataFrame(lines, columns=["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag"]).astype({"l_linenumber": "int32"}),
        "nation": pd.DataFrame([(k, f"N{k}") for k in range(25)], columns=["n_nationkey", "n_name"]).astype({"n_nationkey": "int32"}),
        "region": pd.DataFrame([(0, "R")], columns=["r_regionkey", "r_name"]),
        "part": pd.DataFrame([(1, "P")], columns=["p_partkey", "p_name"]),
        "events": pd.DataFrame([(k, k % 20) for k in range(60)], columns=["event_id", "user_id"]),
    }
    for name, rows in tables.items():
        rows.to_parquet(path / f"{name}.parquet")
    return str(path)


def test_isochrones_start_at_every_street_node_with_the_default_limit(spark, small):
    out = defaultdict(list)
    for e in search.priced(catalog.graph_edges(spark, small), search.PARAMS).collect():
        out[e.src].append((e.dst, e.kind, e.cost0, e.cost1))
    want = {}
    for origin in range(80):
        heap, done = [(0.0, f"s{origin}", 0)], {}
        while heap:
            cost, node, boarded = heapq.heappop(heap)
            if (node, boarded) in done:
                continue
            done[node, boarded] = cost
            want[origin, node] = min(cost, want.get((origin, node), cost))
            for dst, kind, c0, c1 in out[node]:
                total = cost + (c1 if boarded else c0)
                if total <= search.PARAMS["limit_s"]:
                    heapq.heappush(heap, (total, dst, 1 if kind == graph.BOARD else boarded))
    got = {(r.origin, r.node): r.cost for r in catalog.QUERIES["isochrone_nodes"](spark, small).collect()}
    assert max(want.values()) > 900 and any(n.startswith("r") for _, n in want)
    want = {k: c for k, c in want.items() if not k[1].startswith("r")}  # results are of streets and stops; route nodes lie between them
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 0.006 for k in want)


def test_itineraries_of_every_origin(spark, small):
    far = {r.origin: r.cost for r in catalog.QUERIES["isochrone_nodes"](spark, small).groupBy("origin").agg(F.max("cost").alias("cost")).collect()}
    got = {r.origin: r.seconds for r in catalog.QUERIES["path_cost"](spark, small).collect()}
    assert len(got) == 80 and all(abs(got[k] - far[k]) < 0.02 for k in far)


def test_every_event_is_rastered(spark, small):
    users = {k % 20 for k in range(60)}
    for name in ("raster_seed", "raster_splat", "reach_km2", "time_bands", "chamfer_cells"):
        assert {r.origin for r in catalog.QUERIES[name](spark, small).select("origin").distinct().collect()} == users
    assert {(r.origin, r.cost) for r in catalog.QUERIES["raster_seed"](spark, small).collect()} == {(k % 20, float(k)) for k in range(60)}


def test_ways_far_north_stay(spark, tmp_path):
    """Ways of parts with high numbers lie beyond any latitude bound; their SQL has none."""
    rows = [(o, k, base + 3 * k + 17, k, 1.0, 1.0) for o, base in enumerate((0, 120_000, 1_200_000)) for k in (1, 2, 3)]
    columns = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    pd.DataFrame(rows, columns=columns).astype({"l_linenumber": "int32"}).to_parquet(tmp_path / "lineitem.parquet")
    pd.DataFrame([(1, "P")], columns=["p_partkey", "p_name"]).to_parquet(tmp_path / "part.parquet")
    for name in ("valid_ways", "simplified_ways"):
        assert {r.way for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()} == {0, 1, 2}
    assert {r.u // 120_000 for r in catalog.QUERIES["distinct_edges"](spark, str(tmp_path)).collect()} == {0, 1, 10}


def test_hops_exchange_and_sort_stop_times_once(spark, small):
    """The view names a trip twice, which hid from Spark that windows over it need no second exchange."""
    found = catalog.raw_hops(spark, small)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort ") == 1
    want = transit.raw_hops(catalog.filled(spark, small).withColumns({"arr": F.col("t"), "dep": F.col("t")}))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    times = [(1, k, s, t) for k, (s, t) in enumerate([(1, None), (2, 0.0), (3, None), (3, None), (4, 90.0), (5, 60.0), (6, None), (7, None)])] + [(2, 0, 1, None), (2, 1, 2, None)]
    stop_times = spark.createDataFrame(times, "trip long, seq int, stop long, t double")
    filled = transit.interpolate(stop_times)
    want = transit.raw_hops(filled.withColumns({"arr": F.col("t"), "dep": F.col("t")}))
    got = transit.timed_hops(stop_times)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) == [(1, 2, 3, 30.0, 0), (1, 3, 4, 30.0, 0), (1, 4, 5, 0.0, 0), (1, 5, 6, 0.0, 0), (1, 6, 7, 0.0, 0)]
