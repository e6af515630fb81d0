"""Searches of many origins: what is exchanged, and that the size of groups and of their parts changes nothing."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from farstride.operators import search
from farstride.plans import catalog


@pytest.fixture(scope="module")
def lattice(spark):
    """Streets of two towns with a stop each, far from each other, and a route between them."""
    rnd = random.Random(9)
    at = {f"s{t}_{x}_{y}": (t * 0.5 + x * 0.002, y * 0.002) for t in range(2) for x in range(5) for y in range(5)} | {"p0": (0.0, 0.0), "p1": (0.5, 0.0)}
    walks = [(a, b, 0, rnd.uniform(80, 400)) for a in at for b in at if a[0] == b[0] == "s" and 0 < abs(at[a][0] - at[b][0]) + abs(at[a][1] - at[b][1]) < 0.003]
    walks += [e for t in range(2) for e in ((f"s{t}_0_0", f"p{t}", 0, 20.0), (f"p{t}", f"s{t}_0_0", 0, 20.0))]
    rides = [e for p in range(2) for e in ((f"p{p}", f"r1:{p}", 1, 0.0), (f"r1:{p}", f"p{p}", 3, 0.0))] + [("r1:0", "r1:1", 2, 100.0)]
    edges = spark.createDataFrame([(*e, 1) for e in walks + rides], "src string, dst string, kind int, weight double, route long")
    places = spark.createDataFrame([(k, *v) for k, v in at.items()], "node string, lon double, lat double")
    seeds = places.filter("node like 's%'").select(F.col("node").alias("origin"), "node", F.lit(0.0).alias("cost"))
    return seeds, search.priced(edges, {"speed": 1.0, "wait_s": 0.0, "transfer_s": 60.0}), places


def test_what_is_reached_is_not_exchanged(spark, lattice, monkeypatch):
    seeds, costs, places = lattice
    found = search.Reach(seeds, costs, places, 900.0, 1.0)
    out = found.best
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" in plan and plan.index("FlatMapGroups") < plan.index("Exchange")  # searching comes after all exchanges
    rows = sorted(tuple(r) for r in out.collect())
    assert len({r[:2] for r in rows}) == len(rows) and any(r[3] and r[0][1] != r[1][1] for r in rows)
    want = {(r.origin, r.node): r.cost for r in search.best(search.search(seeds, costs, 900.0)).collect() if r.node[0] != "r"}
    assert {r[:2] for r in rows} == want.keys() and all(r[2] == pytest.approx(want[r[:2]]) for r in rows)
    far = {}
    for origin, node, cost, ridden in rows:
        far[origin] = max(far.get(origin, (-1.0, "", None)), (cost, node, ridden))
    assert {r.origin: (r.cost, r.node, r.ridden) for r in found.farthest().collect()} == far
    asked = spark.createDataFrame([r[:2] for r in rows[::37]] + [("s0_0_0", "s9_9_9")], "origin string, node string")
    assert sorted(tuple(r) for r in found.costs_of(asked).collect()) == rows[::37]
    # only origins near stops are searched for first walks, and groups of any size give the same
    assert found.roads.near(seeds, places.filter("node = 'p1'").select("node")).filter("origin like 's0%'").count() == 0
    monkeypatch.setattr(search, "ORIGINS", 1)
    assert sorted(tuple(r) for r in found.best.collect()) == rows


@pytest.mark.parametrize(("only", "ends"), [(None, "all"), ("p", "all"), (None, "farthest"), (None, "asked")])
def test_a_lot_is_searched_in_parts(only, ends, monkeypatch):
    rnd = random.Random(2)
    names = [f"s{k}" for k in range(30)] + ["p1"]
    rows = [(search.SEED, o, rnd.choice(names), None, rnd.uniform(0, 50), k > 1, float(o)) for o in range(7) for k in range(4)]
    rows += [(search.ROAD, None, rnd.choice(names), rnd.choice(names), rnd.uniform(10, 90), None, None) for _ in range(120)]
    rows += [(search.ASK, rnd.randrange(7), n, None, None, None, None) for n in (*names[::5], "s99")]
    types = [pa.int32(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.bool_(), pa.float64()]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["part", "origin", "node", "dst", "cost", "ridden", "home"])
    found = lambda: sorted(tuple(r.values()) for b in search.Lot([batch], 200.0).found(only, ends) for r in b.to_pylist())
    whole = found()
    monkeypatch.setattr(search, "CELLS", 1)
    monkeypatch.setattr(search, "BATCH", 3)
    assert whole and found() == whole


def test_ways_to_the_farthest_nodes_need_no_table_of_all_that_is_reached(spark, lattice, monkeypatch):
    seeds, costs, places = lattice
    found = search.Reach(seeds, costs, places, 900.0, 1.0)
    far = {r.origin: r.cost for r in found.best.groupBy("origin").agg(F.max("cost").alias("cost")).collect()}
    monkeypatch.setattr(search.Reach, "best", property(lambda self: pytest.fail("all rows are made")))
    legs = search.legs(catalog.farthest(found)).groupBy("origin").agg(F.sum(F.coalesce("seconds", F.lit(0.0)) + F.coalesce("penalty", F.lit(0.0))).alias("s")).collect()
    assert {r.origin for r in legs} == far.keys() and all(r.s == pytest.approx(far[r.origin], abs=1.0) for r in legs)


def test_labels_and_walks_that_become_many_rows_are_dealt_to_tasks(spark, lattice, monkeypatch):
    """Both are small tables, which one task read, joined and sorted before."""
    seeds, costs, places = lattice
    plans, save = [], search.Tables.save
    monkeypatch.setattr(search.Tables, "save", lambda self, df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or save(self, df))
    monkeypatch.setattr(search, "WALKS", 20)
    walks = costs.filter("kind = 0").count()
    found = search.search(seeds, costs, 900.0).count()
    rounds = [p for p in plans if "Union" in p]
    assert found and len(rounds) > 3 and all("hashpartitioning(node" in p and "REPARTITION_BY_NUM" in p for p in rounds)
    plan = search.Roads(costs, places, 900.0, 1.0).costs(seeds)._jdf.queryExecution().executedPlan().toString()
    dealt = [int(n) for n in re.findall(r"hashpartitioning\(src#\d+, (\d+)\), REPARTITION_BY_NUM", plan)]
    assert dealt == [-(-walks // 20)]


def test_rounds_reduce_costs_without_sorting(spark, lattice, monkeypatch):
    """A least of costs with predecessors was sorted for in each round; those are looked up afterwards, and lead back in ever earlier rounds."""
    seeds, costs, _ = lattice
    plans, save = [], search.Tables.save
    monkeypatch.setattr(search.Tables, "save", lambda self, df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or save(self, df))
    labels = search.relaxed(seeds, costs, 900.0)
    rounds = [p for p in plans if "Union" in p]
    assert len(rounds) > 3 and not any("SortAggregate" in p for p in rounds)
    cost = {(r.origin, r.node, r.boarded): (r.cost, r.round) for r in labels.collect()}
    edges = {(e.src, e.dst): (e.cost0, e.cost1, e.kind) for e in costs.collect()}
    for r in search.predecessors(labels, costs, labels).collect():
        fits = []
        for (src, dst), (c0, c1, kind) in edges.items():
            for boarded in (0, 1) if dst == r.node else ():
                at = cost.get((r.origin, src, boarded))
                if at and at[1] == r.round - 1 and at[0] + (c1 if boarded else c0) == r.cost and (1 if kind == search.BOARD else boarded) == r.boarded:
                    fits.append((src, boarded))
        assert (r.pred, r.pred_boarded) == (min(fits) if r.round else (None, None))
