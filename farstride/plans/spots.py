"""Queries about spots: scores, percentiles and ways to a destination. Every nation is a spot, every region a destination."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import geo, scalars
from ..operators import graph, itineraries, raster, schedule, score, search, streets
from ..operators.iterate import Tables, checkpointed
from ..sources import feeds
from ..sources.surrogate import oracle, view
from .catalog import LIMIT, SPEED, graphed, hops, node_places, scheduled, query, reach, rounded, samples, street_points

RINGS = (1, 2, 4, 8, 16)
#: Radius of first streets and of a destination, in metres.
SEED_M, CLICK_M = 300.0, 400.0

SPOTS = "SELECT CAST(n_nationkey AS BIGINT) AS spot, CAST(n_regionkey AS BIGINT) AS region, -122.5e0 + ((n_nationkey * 7919) % 1000) * 8e-5 AS lon, 37.5e0 + ((n_nationkey * 104729) % 1000) * 7.6e-5 AS lat FROM nation"
GOALS = "SELECT CAST(r_regionkey AS BIGINT) AS region, -122.48e0 + ((r_regionkey * 7919 + 300) % 1000) * 5e-5 AS lon, 37.51e0 + ((r_regionkey * 104729 + 500) % 1000) * 5e-5 AS lat FROM region"


def at_latitude(lon1, lat1, lon2, lat2) -> str:
    return f"sqrt(pow(({lon2} - {lon1}) * 111195.0 * cos(radians({lat1})), 2) + pow(({lat2} - {lat1}) * 111195.0, 2))"


def ringed(points: str, key: str, radius: float, others: str, other: str) -> str:
    ring = " ".join(f"WHEN d <= {radius * r} THEN {r}" for r in RINGS)
    near = f"SELECT a.{key}, b.{other}, {at_latitude('a.lon', 'a.lat', 'b.lon', 'b.lat')} AS d FROM {points} a, {others} b"
    return f"SELECT {key}, {other}, d FROM (SELECT *, min(ring) OVER (PARTITION BY {key}) AS least FROM (SELECT *, CASE {ring} END AS ring FROM ({near})) WHERE ring IS NOT NULL) WHERE ring = least"


def reach_sql(body: str, ride: str = "weight", boards: str = "true", transfer: float = 300.0, **extra: str) -> str:
    """Least costs d(origin, node, boarded, cost) from all spots by recursion, then body over best(origin, node, cost)."""
    after = "CASE WHEN e.kind = 1 THEN 1 ELSE d.boarded END"
    step = "d.cost + CASE WHEN e.kind = 1 AND d.boarded = 0 THEN e.cost0 ELSE e.cost1 END"
    costs = f"SELECT src, dst, kind, CASE kind WHEN 0 THEN weight / {SPEED!r} WHEN 1 THEN 0.0 WHEN 2 THEN {ride} ELSE 0.0 END AS cost0, CASE kind WHEN 0 THEN weight / {SPEED!r} WHEN 1 THEN {transfer} WHEN 2 THEN {ride} ELSE 0.0 END AS cost1 FROM edges WHERE (kind <> 1 OR {boards}) AND (kind <> 2 OR {ride} IS NOT NULL)"
    recursion = (
        f"d(origin, node, boarded, cost) USING KEY (origin, node, boarded) AS (SELECT spot, 's' || node, 0, CAST(d / {SPEED!r} AS DOUBLE) FROM first_streets UNION SELECT d.origin, e.dst, {after}, min({step}) FROM d JOIN costs e ON e.src = d.node "
        f"LEFT JOIN recurring.d r ON r.origin = d.origin AND r.node = e.dst AND r.boarded = {after} WHERE {step} <= {LIMIT} AND (r.cost IS NULL OR {step} < r.cost) GROUP BY 1, 2, 3) "
    )
    ends = {"best": f"SELECT origin, node, min(cost) AS cost FROM d WHERE cost <= {LIMIT} AND node NOT LIKE 'r%' GROUP BY origin, node"} | extra
    tail = ", ".join(f"{k} AS MATERIALIZED ({v})" for k, v in ends.items())
    whole = graphed("@@" + body, spots=SPOTS, first_streets=ringed("spots", "spot", SEED_M, "street_nodes", "node"), costs=costs)
    return whole.replace("WITH ", "WITH RECURSIVE ", 1).replace(" @@", f", {recursion}, {tail} ", 1)


def table(spark, sf, sql: str, *names: str):
    for n in names:
        spark.read.parquet(f"{sf}/{n}.parquet").createOrReplaceTempView(n)
    return spark.sql(sql)


def spots(spark, sf):
    return table(spark, sf, SPOTS, "nation")


def near_streets(spark, sf, at):
    """The street nodes that a search from each of at (id, lon, lat) begins with: (id, node, d)."""
    return streets.ring_search(at, street_points(spark, sf), SEED_M, RINGS).select("id", F.col("other").alias("node"), "d")


def first_streets(spark, sf):
    return near_streets(spark, sf, spots(spark, sf).select(F.col("spot").alias("id"), "lon", "lat")).withColumnRenamed("id", "spot")


@query("spot_seeds", oracle("SELECT spot, node, round(d, 3) AS d FROM seeds", "street_nodes", spots=SPOTS, seeds=ringed("spots", "spot", SEED_M, "street_nodes", "node")))
def _(spark, sf):
    return rounded(first_streets(spark, sf), "d")


def from_points(spark, sf, at, **settings):
    """A search from all of at (id, lon, lat)."""
    speed = settings.get("speed", SPEED)
    seeds = near_streets(spark, sf, at).select(F.col("id").alias("origin"), F.concat(F.lit("s"), F.col("node")).alias("node"), (F.col("d") / speed).alias("cost"))
    return reach(spark, sf, seeds, **settings)


def from_spots(spark, sf, **settings):
    return from_points(spark, sf, spots(spark, sf).select(F.col("spot").alias("id"), "lon", "lat"), **settings)


def exact_scores(spark, sf, at, **settings):
    """(origin, km2, cells, nodes) of all of at (id, lon, lat), as the two sweeps paint it."""
    limit, speed = settings.get("limit_s", LIMIT), settings.get("speed", SPEED)
    found = from_points(spark, sf, at, **settings).best.select("origin", "node", "cost").join(node_places(spark, sf), "node")
    return raster.scores(found, at.select(F.col("id").alias("origin"), "lat"), speed, limit)


def reached(found):
    return found.best.filter(F.col("cost") <= LIMIT).select("origin", "node", "cost")


NODES = "SELECT origin, node, round(cost, 2) AS cost FROM best"


@query("spot_reach", reach_sql(NODES))
def _(spark, sf):
    return rounded(reached(from_spots(spark, sf)), "cost", digits=2)


@query("spot_period", reach_sql(NODES, ride="s_rush"))
def _(spark, sf):
    return rounded(reached(from_spots(spark, sf, period="s_rush")), "cost", digits=2)


@query("spot_modes", reach_sql(NODES, boards="route IN (SELECT route FROM routes WHERE route_type IN (1, 4))"))
def _(spark, sf):
    return rounded(reached(from_spots(spark, sf, modes=[1, 3])), "cost", digits=2)


@query("spot_one_seat", reach_sql(NODES, transfer=LIMIT))
def _(spark, sf):
    return rounded(reached(from_spots(spark, sf, transfer_s=LIMIT)), "cost", digits=2)


PLACES = "SELECT 's' || node AS node, lon, lat FROM street_nodes UNION ALL SELECT 'p' || stop, lon, lat FROM stops"
CELL = "SELECT origin, CAST(floor((lon + 180) / 360 / size) AS BIGINT) AS cx, CAST(floor((0.5 - ln(tan(pi() / 4 + radians(lat) / 2)) / (2 * pi())) / size) AS BIGINT) AS cy, min(cost) AS cost FROM (SELECT b.*, p.lon, p.lat, 40 / (cos(radians(s.lat)) * 40075016.686) AS size FROM best b JOIN places USING (node) p JOIN spots s ON s.spot = b.origin) GROUP BY 1, 2, 3"
STEPS = "SELECT * FROM (VALUES " + ", ".join(f"({a}, {b}, {d!r})" for a, b, d in raster.offsets()) + ") o(dx, dy, d)"
PAINTED = f"SELECT origin, cx + dx AS cx, cy + dy AS cy, min(cost + d / {SPEED!r}) AS cost FROM cells, steps WHERE cost + d / {SPEED!r} <= {LIMIT} GROUP BY 1, 2, 3"
SCORED = {
    "places": PLACES, "cells": CELL.replace("JOIN places USING (node) p", "JOIN places p ON p.node = b.node"), "steps": STEPS, "painted": PAINTED,
    "km": "SELECT origin, count(*) * 0.0016e0 AS km2 FROM painted GROUP BY origin",
    "facts": "SELECT origin, count(*) AS nodes, count(*) FILTER (node LIKE 'p%') AS stops FROM best GROUP BY origin",
    "began": "SELECT spot AS origin, count(*) AS seeds FROM first_streets GROUP BY spot",
}


def scores(spark, sf):
    """Square kilometres that each spot reaches, with the stops and first streets (spots that reach nothing have none)."""
    found = reached(from_spots(spark, sf)).join(node_places(spark, sf), "node").join(spots(spark, sf).select(F.col("spot").alias("origin"), F.col("lat").alias("lat0")), "origin")
    area = raster.area_km2(raster.splat(raster.seed_cells(found), SPEED, LIMIT)).select("origin", "km2")
    facts = found.groupBy("origin").agg(F.count("*").alias("nodes"), F.count_if(F.col("node").startswith("p")).alias("stops"))
    seeds = first_streets(spark, sf).groupBy(F.col("spot").alias("origin")).agg(F.count("*").alias("seeds"))
    return area.join(facts, "origin").join(seeds, "origin")


@query("spot_scores", reach_sql("SELECT origin, round(km2, 4) AS km2, nodes, stops, seeds FROM km JOIN facts USING (origin) JOIN began USING (origin)", **SCORED))
def _(spark, sf):
    return rounded(scores(spark, sf), "km2", digits=4)


@query("spot_exact_scores")
def _(spark, sf):
    """As spot_scores, by the two sweeps: a spot that reaches nothing has 0."""
    return rounded(exact_scores(spark, sf, spots(spark, sf).select(F.col("spot").alias("id"), "lon", "lat")), "km2", digits=4)


def sampled(spark, sf):
    """(i, id, node, lon, lat): the 2,000 street nodes (with replacement) at which a score distribution is sampled."""
    nodes = graph.dense_ids(view(spark, sf, "street_nodes"), ["node"], "id")
    count = nodes.agg(F.count("*").alias("nodes"))  # one row
    picks = spark.range(2000).withColumnRenamed("id", "i").crossJoin(F.broadcast(count)).select("i", F.floor(schedule.nth_draw(F.col("i"), schedule.NODE_SEED) * F.col("nodes")).alias("id"))
    return picks.join(nodes, "id").select("i", "id", "node", "lon", "lat")


def sampled_scores(spark, sf):
    """(i, km2) of the sampled street nodes at rush hour, to 0.01 km2; a node that is drawn again is searched once."""
    drawn = checkpointed(sampled(spark, sf))
    at = drawn.groupBy("node").agg(F.first("lon").alias("lon"), F.first("lat").alias("lat")).select(F.col("node").alias("id"), "lon", "lat")
    found = exact_scores(spark, sf, at, period="s_rush").select(F.col("origin").alias("node"), (F.floor(F.col("km2") * 100 + 0.5) / 100).alias("km2"))
    return drawn.join(found, "node").select("i", "km2")


@query("score_distribution")
def _(spark, sf):
    """The sorted scores of the sampled nodes."""
    return graph.dense_ids(sampled_scores(spark, sf), ["km2", "i"], "place").select("place", "km2")


@query("spot_percentiles", reach_sql("SELECT origin, round(km2, 2) AS km2, round(100.0 * (SELECT count(*) FROM km b WHERE round(b.km2, 2) < round(a.km2, 2)) / (SELECT count(*) FROM km), 6) AS pct FROM km a", **SCORED))
def _(spark, sf):
    own = scores(spark, sf).select("origin", F.round("km2", 2).alias("km2"))
    return rounded(own.join(score.percentiles(own, "km2"), "km2").select("origin", "km2", "pct"), "pct", digits=6)


DESTINED = {
    "goals": GOALS,
    "near_goals": f"SELECT a.region, b.node, {at_latitude('a.lon', 'a.lat', 'b.lon', 'b.lat')} AS d FROM goals a, street_nodes b",
    "ends": f"SELECT s.spot, n.region, 's' || n.node AS node, b.cost, n.d, b.cost + n.d / {SPEED!r} AS total FROM spots s JOIN (SELECT * FROM (SELECT *, min(ring) OVER (PARTITION BY region) AS least FROM (SELECT *, CASE "
    + " ".join(f"WHEN d <= {CLICK_M * r} THEN {r}" for r in RINGS)
    + f" END AS ring FROM near_goals) WHERE ring IS NOT NULL) WHERE ring = least AND d <= {CLICK_M}) n ON n.region = s.region JOIN best b ON b.origin = s.spot AND b.node = 's' || n.node",
    "chosen": f"SELECT spot, region, min(total) AS total, arg_min(node, (total, node)) AS by_time, arg_min(d, (total, node)) AS walk, arg_min(node, (d, node)) AS by_way, arg_min(cost, (d, node)) AS near_cost FROM ends GROUP BY spot, region",
}
CHOSEN = f"SELECT spot, region, CASE WHEN total > {LIMIT} THEN by_way ELSE by_time END AS node, round(CASE WHEN total > {LIMIT} THEN near_cost ELSE total END, 2) AS seconds, round(CASE WHEN total > {LIMIT} THEN 0 ELSE walk END, 3) AS walk_m, total > {LIMIT} AS snapped FROM chosen"


def destinations(spark, sf):
    """The search from all spots, and the node where each spot's way to its region's destination ends."""
    found = from_spots(spark, sf)
    goals = table(spark, sf, GOALS, "region").select(F.col("region").alias("id"), "lon", "lat")
    near = streets.ring_search(goals, street_points(spark, sf), CLICK_M, RINGS).select(F.col("id").alias("region"), F.concat(F.lit("s"), F.col("other")).alias("node"), "d")
    asked = spots(spark, sf).select(F.col("spot").alias("origin"), "region")
    return found, search.destinations(reached(found), asked, near, "region", CLICK_M, LIMIT, SPEED)


@query("spot_destinations", reach_sql(CHOSEN, **DESTINED))
def _(spark, sf):
    out = destinations(spark, sf)[1].withColumnRenamed("origin", "spot")
    return rounded(rounded(out, "seconds", digits=2), "walk_m")


def ticked(sql: str) -> str:
    """A search's SQL in whole microseconds, times 4,096, plus one an edge: ties go to fewer edges, exactly."""
    tick = "CAST(round({} * 1e6) AS BIGINT) * 4096"
    sql = sql.replace(f"CAST(d / {SPEED!r} AS DOUBLE)", tick.format(f"d / {SPEED!r}"))
    sql = sql.replace("costs AS (SELECT src,", f"costs AS (SELECT src, dst, kind, {tick.format('cost0')} + 1 AS cost0, {tick.format('cost1')} + 1 AS cost1 FROM (SELECT src,").replace("IS NOT NULL))", "IS NOT NULL)))")
    top = f"CAST({LIMIT} * 1000000 * 4096 + 4095 AS BIGINT)"
    sql = sql.replace(f"<= {LIMIT} AND (r.cost IS NULL", f"<= {top} AND (r.cost IS NULL")
    return sql.replace(f"min(cost) AS cost FROM d WHERE cost <= {LIMIT}", f"(min(cost) // 4096) / 1e6 AS cost FROM d WHERE cost <= {top}")


WAY = {
    "final": f"SELECT spot, CASE WHEN total > {LIMIT} THEN by_way ELSE by_time END AS node, CASE WHEN total > {LIMIT} THEN 0 ELSE walk END AS walk FROM chosen",
    "before": "SELECT n.origin, n.node, n.boarded, min((m.node, m.boarded)) AS pred FROM d n JOIN costs e ON e.dst = n.node JOIN d m ON m.origin = n.origin AND m.node = e.src AND n.boarded = CASE WHEN e.kind = 1 THEN 1 ELSE m.boarded END"
    " WHERE m.cost + CASE WHEN e.kind = 1 AND m.boarded = 0 THEN e.cost0 ELSE e.cost1 END = n.cost GROUP BY ALL",
    "way(spot, node, boarded, i)": "SELECT f.spot, f.node, arg_min(d.boarded, (d.cost // 4096, d.boarded)), 0 FROM final f JOIN d ON d.origin = f.spot AND d.node = f.node GROUP BY ALL UNION ALL SELECT w.spot, b.pred[1], b.pred[2], i + 1 FROM way w JOIN before b ON b.origin = w.spot AND b.node = w.node AND b.boarded = w.boarded",
    "placed": "SELECT w.*, (d.cost // 4096) / 1e6 AS cost, CASE WHEN w.node LIKE 'r%' THEN split_part(substr(w.node, 2), ':', 1) END AS line FROM way w JOIN d ON d.origin = w.spot AND d.node = w.node AND d.boarded = w.boarded",
    "step": "SELECT *, lag(node) OVER o AS b, lead(node) OVER o AS a, lag(cost) OVER o AS cost_b, lag(line) OVER o IS DISTINCT FROM line OR lag(node) OVER o IS NULL AS turn FROM placed WINDOW o AS (PARTITION BY spot ORDER BY i DESC)",
    "numbered": "SELECT *, sum(turn::INT) OVER (PARTITION BY spot ORDER BY i DESC) AS leg FROM step",
    "leg": "SELECT spot, leg, max(line) AS route, arg_max(b, i) AS b, arg_min(a, i) AS a, CASE WHEN leg = 1 THEN 0 ELSE arg_max(cost, i) END AS begin, arg_min(cost, i) AS end, arg_max(cost, i) - arg_max(cost_b, i) AS penalty, count(*) - 1 AS hops FROM numbered GROUP BY spot, leg",
    "timed_leg": f"SELECT l.*, l.end - l.begin + CASE WHEN route IS NULL AND leg = max(leg) OVER (PARTITION BY spot) THEN f.walk / {SPEED!r} ELSE 0 END AS seconds, f.walk FROM leg l JOIN final f USING (spot)",
}
ITINERARY = (
    f"SELECT spot, CAST(row_number() OVER (PARTITION BY spot ORDER BY leg) AS INT) AS leg, CASE WHEN route IS NULL THEN 'walk' ELSE 'ride' END AS kind, route, x.name AS from_stop, y.name AS to_stop, CASE WHEN route IS NOT NULL THEN hops END AS hops, round(seconds, 2) AS seconds,"
    f" CASE WHEN route IS NOT NULL THEN round(penalty, 2) END AS penalty, CASE WHEN route IS NULL THEN round(seconds * {SPEED!r}, 1) END AS metres, round(walk, 2) AS final_walk_m"
    " FROM timed_leg LEFT JOIN stops x ON route IS NOT NULL AND b = 'p' || x.stop LEFT JOIN stops y ON route IS NOT NULL AND a = 'p' || y.stop WHERE route IS NOT NULL OR seconds > 0.5"
)


def hop_lines(spark, sf):
    """Shapes of hops in degrees: through a point beside the middle, for the pairs of stops whose numbers differ by an even one; others have none."""
    at = view(spark, sf, "stops").select("stop", "lon", "lat")
    a, b = (at.select(*(F.col(c).alias(f"{c}_{k}") for c in ("stop", "lon", "lat"))) for k in "ab")
    pairs = hops(spark, sf).select("route", F.col("from_stop").alias("stop_a"), F.col("to_stop").alias("stop_b")).filter((F.col("stop_a") - F.col("stop_b")) % 2 == 0).join(a, "stop_a").join(b, "stop_b")
    middle = lambda c: (F.col(f"{c}_a") + F.col(f"{c}_b")) / 2 + 1e-4
    line = lambda c: F.array(f"{c}_a", middle(c), f"{c}_b").alias(f"{c}s")
    return pairs.select("route", F.col("stop_a").alias("from_stop"), F.col("stop_b").alias("to_stop"), line("lon"), line("lat"))


SHAPED = "SELECT route, from_stop, to_stop, round((a.lon + b.lon) / 2 + 1e-4, 6) AS lon, round((a.lat + b.lat) / 2 + 1e-4, 6) AS lat FROM hops JOIN stops a ON a.stop = from_stop JOIN stops b ON b.stop = to_stop WHERE (from_stop - to_stop) % 2 = 0 AND route = to_stop"


@query("shape_lookup", scheduled(SHAPED, "stops"))
def _(spark, sf):
    """Middle points of the hops to the stop whose number is the route's, looked up in a stored table of shapes."""
    path = f"{Tables(spark).root}/shapes"
    feeds.write_shapes(hop_lines(spark, sf), path)
    found = feeds.shapes_of(spark, path, hops(spark, sf).filter("route = to_stop"))
    return found.select("route", "from_stop", "to_stop", *(F.round(F.get(f"{c}s", F.lit(1)), 6).alias(c) for c in ("lon", "lat")))


def spot_ways(spark, sf, lined=True):
    found, ends = destinations(spark, sf)
    goals = table(spark, sf, GOALS, "region").withColumnRenamed("region", "goal")
    names = view(spark, sf, "stops").select(graph.node_name("p", "stop").alias("node"), "name")
    return itineraries.itineraries(found, ends.withColumnRenamed("region", "goal"), spots(spark, sf).withColumnRenamed("spot", "origin"), goals, names, hop_lines(spark, sf) if lined else None, lined)


@query("spot_itineraries", ticked(reach_sql(ITINERARY, **DESTINED, **WAY)))
def _(spark, sf):
    legs = spot_ways(spark, sf, lined=False).select(F.col("origin").alias("spot"), "leg", "kind", "route", "from_stop", "to_stop", "hops", "seconds", "penalty", "metres", "final_walk_m")
    return rounded(rounded(legs, "seconds", "penalty", "final_walk_m", digits=2), "metres", digits=1)


@query("spot_itinerary_lines")
def _(spark, sf):
    """One line for each leg, as a picture draws it."""
    return spot_ways(spark, sf).select(F.col("origin").alias("spot"), "leg", "kind", "lons", "lats")


@query("spot_itinerary_seconds", reach_sql(f"SELECT spot, round(CASE WHEN total > {LIMIT} THEN near_cost ELSE total END, 2) AS seconds FROM chosen", **DESTINED))
def _(spark, sf):
    found, ends = destinations(spark, sf)
    legs = search.legs(found.paths(ends.select("origin", "node")))
    spent = legs.groupBy("origin").agg(F.sum(F.coalesce("seconds", F.lit(0.0)) + F.coalesce("penalty", F.lit(0.0))).alias("spent"))
    whole = F.coalesce("spent", F.lit(0.0)) + F.col("walk_m") / SPEED
    return ends.join(spent, "origin", "left").select(F.col("origin").alias("spot"), F.round(whole, 2).alias("seconds"))
