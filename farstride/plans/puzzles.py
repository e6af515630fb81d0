"""Queries of the daily puzzle: calendar of twists, candidate areas, probes, grids on land, pictures, guesses."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geo, scalars
from ..operators import raster, schedule, score, search, streets
from ..operators.iterate import checkpointed
from ..sources.surrogate import oracle, view
from ..streaming import game, requests
from .catalog import cells, flat, graph_edges, halt_points, node_places, query, rounded, street_points
from .catalog import GRID as RASTER
from .spots import RINGS, SEED_M, sampled

#: First day, and the areas' radius, grid step, least share on land, and gates.
FIRST_DAY, RADIUS_M, STEP_M = "2026-09-30", 1000, 150
MIN_LAND_SHARE, MIN_BEST_KM2, MAX_PROBE_RATIO = 0.6, 10.0, 0.9

#: The first three cycles as the generator's rule gives them, worked out apart from this code.
ORDERS = [
    "long-haul rush bus-only sore-feet quick-trip saturday rail-strike no-bus late-night one-seat",
    "rail-strike sore-feet rush late-night saturday long-haul one-seat no-bus bus-only quick-trip",
    "long-haul saturday sore-feet one-seat quick-trip bus-only rail-strike no-bus rush late-night",
]
CALENDAR = "SELECT CAST(strftime(DATE '2026-09-30' + CAST(n - 1 AS INTEGER), '%Y-%m-%d') AS VARCHAR) AS day, CAST(n AS BIGINT) AS n, twist FROM (VALUES " + ", ".join(f"({10 * c + k + 1}, '{t}')" for c, o in enumerate(ORDERS) for k, t in enumerate(o.split())) + ") t(n, twist)"


DATES = "SELECT DISTINCT DATE '2026-09-30' + CAST(o_orderkey % 30 AS INT) AS date FROM orders"


@query("twist_calendar", f"SELECT day, n, twist FROM ({CALENDAR}) WHERE day IN (SELECT CAST(CAST(date AS DATE) AS VARCHAR) FROM ({DATES}))")
def _(spark, sf):
    """The twist of each day that has an order, in the first thirty."""
    spark.read.parquet(f"{sf}/orders.parquet").createOrReplaceTempView("orders")
    days = spark.sql(DATES).withColumn("n", scalars.day_number("date", FIRST_DAY).cast("long"))
    out = schedule.scheduled(days, [t[0] for t in score.TWISTS], 30)
    return out.select(F.date_format("date", "yyyy-MM-dd").alias("day"), "n", "twist")


def pool(spark, sf):
    """Areas that a day may have: weighted neighbourhoods, in the order of their numbers."""
    places = view(spark, sf, "places").filter(F.col("type").isin("suburb", "neighbourhood")).select(F.col("place").alias("id"), "lon", "lat", F.concat_ws(" ", "name", "place").alias("name"))
    weights = score.candidates(places.select("id", "lon", "lat"), halt_points(spark, sf))
    return places.join(weights, "id").select(F.col("id").alias("area"), "name", "lon", "lat", F.col("weight").cast("long").alias("weight"), F.col("id").alias("ord"))


#: What a day's score is under each twist: the standard settings and the twist's own.
SETTINGS = {
    twist: {"period": f"s_{period or 'rush'}", "limit_s": 60.0 * (limit or 45), "speed": (speed or 5) / 3.6, "transfer_s": 60.0 * (transfer or 5), "wait_s": 0.0, "modes": modes}
    for twist, period, limit, speed, transfer, modes in score.TWISTS
}
#: Grids that are scored at once at most: one at first, then more each time.
GRIDS = 9


class Gates:
    """The gates of a day's area, in the generator's order: probes, points on land, and the whole grid; each point is scored by a search under the day's twist.

    Streets, walks and rides are stored once, for all areas (area, lon, lat) that may be asked for.
    """

    def __init__(self, spark, sf, areas):
        self.spark, self.sf = spark, sf
        first = SEED_M * RINGS[-1]
        edges = graph_edges(spark, sf, tuple(sorted({own["period"] for own in SETTINGS.values()})))
        mode_of = view(spark, sf, "routes").select("route", scalars.mode_group("route_type").alias("mode"))
        self.net = search.Network(edges, node_places(spark, sf), SETTINGS, mode_of, areas, RADIUS_M + first)
        # no other street is within the widest ring around a point
        streets_here = self.net.places.filter(F.col("node").startswith("s"))
        self.streets = checkpointed(streets_here.select(F.substring("node", 2, 20).cast("long").alias("id"), "lon", "lat"))

    def scored(self, points, twist, many):
        """points (id, lon, lat, ...; about many) with km2, the area that is reached from each under the twist."""
        near = streets.ring_search(points.select("id", "lon", "lat"), self.streets, SEED_M, RINGS)
        near = near.select(F.col("id").alias("origin"), F.concat(F.lit("s"), F.col("other")).alias("node"), "d")
        areas = self.net.areas(points.select(F.col("id").alias("origin"), "lat"), near, twist, many)
        return points.join(areas.withColumnRenamed("origin", "id"), "id")

    def areas(self, drawn, places):
        return self.spark.createDataFrame([(k, drawn[k].lon, drawn[k].lat) for k in places], "draw long, lon double, lat double")

    def probed(self, drawn, places, twist):
        """Those of places in drawn whose area's probes have a good spot and differ enough."""
        ring = score.probes(self.areas(drawn, places), "draw", 0.6 * RADIUS_M)
        scored = self.scored(ring.withColumn("id", F.col("draw") * 7 + F.col("k") + 1), twist, 7 * len(places))
        return sorted(r.draw for r in score.probe_gate(scored, "draw", MIN_BEST_KM2, MAX_PROBE_RATIO).filter("passed").collect())

    def gridded(self, drawn, places, twist):
        """Those of places in drawn whose area has enough points on land, of which the best is good and the upper median well below it; scores are rounded before they are compared."""
        grid = spread_out(self.areas(drawn, places), "draw")
        land = checkpointed(grid.join(on_land(self.spark, self.sf, grid, self.streets), ["lon", "lat"]))
        side = 2 * RADIUS_M // STEP_M + 1
        possible = sum(x * x + y * y <= RADIUS_M * RADIUS_M for x in range(-RADIUS_M, RADIUS_M + 1, STEP_M) for y in range(-RADIUS_M, RADIUS_M + 1, STEP_M))
        enough = land.groupBy("draw").agg(F.count("*").alias("land")).filter(F.col("land") >= possible * MIN_LAND_SHARE).select("draw")
        number = (F.col("draw") * side + (F.col("dy") + RADIUS_M) / STEP_M) * side + (F.col("dx") + RADIUS_M) / STEP_M
        scored = self.scored(land.join(F.broadcast(enough), "draw").withColumn("id", number.cast("long")), twist, possible * len(places))  # a few areas
        rounded_km2 = scored.withColumn("km2", F.floor(F.col("km2") * 100 + 0.5) / 100)
        return sorted(r.draw for r in score.puzzle_summary(rounded_km2, "draw").filter("passed").collect())

    def first(self, drawn, twist):
        """The place of the first of drawn rows (lon, lat) that meets all gates, or None. All draws of a day are probed at once; grids follow as they are needed."""
        left, many = self.probed(drawn, range(len(drawn)), twist), 1
        while left:
            if met := self.gridded(drawn, left[:many], twist):
                return met[0]
            left, many = left[many:], min(GRIDS, 3 * many)
        return None


@query("puzzle_days")
def _(spark, sf):
    """A day for each nation: areas are drawn by weight, without those used before or near recent days', until one meets the day's gates; a day whose draws all fail has none."""
    days = spark.read.parquet(f"{sf}/nation.parquet").select((F.col("n_nationkey") + 1).cast("long").alias("n"))
    days = days.withColumn("date", F.date_add(F.lit(FIRST_DAY).cast("date"), (F.col("n") - 1).cast("int")))
    areas = checkpointed(pool(spark, sf))
    days = schedule.scheduled(days, [t[0] for t in score.TWISTS], 30)
    return schedule.puzzle_days(days, areas, Gates(spark, sf, areas).first, recent_m=600.0, strict=False)  # the streets cover some 8 km


IMUL = lambda a, b: f"(CAST({a} AS HUGEINT) * ({b}) & 4294967295)"
MIXED = f"SELECT i, (xor(t2, t2 >> 14)) / 4294967296.0 AS r FROM (SELECT i, xor((t1 + {IMUL('xor(t1, t1 >> 7)', '61 | t1')}) & 4294967295, t1) AS t2 FROM (SELECT i, CAST({IMUL('xor(s, s >> 15)', '1 | s')} AS BIGINT) AS t1 FROM (SELECT i, CAST((24301 + CAST(i + 1 AS HUGEINT) * 1831565813) & 4294967295 AS BIGINT) AS s FROM range(2000) r(i))))"


@query("sampled_nodes", oracle("SELECT i, CAST(floor(r * (SELECT count(*) FROM street_nodes)) AS BIGINT) AS id, node, round(lon, 6) AS lon, round(lat, 6) AS lat FROM mixed JOIN (SELECT *, row_number() OVER (ORDER BY node) - 1 AS id FROM street_nodes) k ON k.id = CAST(floor(r * (SELECT count(*) FROM street_nodes)) AS BIGINT)", "street_nodes", mixed=MIXED))
def _(spark, sf):
    return rounded(sampled(spark, sf), "lon", "lat", digits=6)


AREAS = "SELECT CAST(CAST(o_orderdate AS DATE) AS DATE) AS day, 'area ' || (o_custkey % 400) AS name, -122.5e0 + ((o_custkey * 7919) % 1000) * 8e-4 AS lon, 37.5e0 + ((o_custkey * 104729) % 1000) * 7.6e-4 AS lat, o_orderkey AS k, o_orderstatus AS status FROM orders"
USED = "SELECT day, name || ' used' AS name, lon, lat FROM areas WHERE status = 'P'"
OPEN = "SELECT day, CASE WHEN k % 89 = 7 THEN name || ' used' ELSE name END AS name, lon, lat, k FROM areas"


@query("fresh_areas", oracle(f"SELECT k, name FROM open a WHERE NOT EXISTS (SELECT 1 FROM used b WHERE b.name = a.name) AND NOT EXISTS (SELECT 1 FROM used b WHERE a.day > b.day AND a.day <= b.day + 14 AND {flat('a', 'b')} <= 2500)", areas=AREAS, used=USED, open=OPEN))
def _(spark, sf):
    spark.read.parquet(f"{sf}/orders.parquet").createOrReplaceTempView("orders")
    spark.sql(AREAS).createOrReplaceTempView("areas")
    return schedule.fresh(spark.sql(OPEN), spark.sql(USED)).select("k", "name")


# --- grids of an area ----------------------------------------------------------------------------------------------

CENTRES = "SELECT place, lon, lat FROM places WHERE type IN ('suburb', 'neighbourhood')"
WET = "SELECT n_nationkey AS box, -122.5e0 + (n_nationkey % 5) * 16e-3 AS x, 37.5e0 + floor(n_nationkey / 5) * 15e-3 AS y FROM nation"
OFFSETS = f"SELECT dx, dy FROM range(-{RADIUS_M}, {RADIUS_M + 1}, {STEP_M}) a(dx), range(-{RADIUS_M}, {RADIUS_M + 1}, {STEP_M}) b(dy) WHERE dx * dx + dy * dy <= {RADIUS_M * RADIUS_M}"
SPREAD = "SELECT place, dx, dy, round(c.lon + dx / (111195.0 * cos(radians(c.lat))), 5) AS lon, round(c.lat + dy / 111195.0, 5) AS lat FROM centres c, offsets"
FROM = "sqrt(pow((n.lon - g.lon) * 111195.0 * cos(radians(g.lat)), 2) + pow((n.lat - g.lat) * 111195.0, 2))"
DRY = "NOT EXISTS (SELECT 1 FROM wet w WHERE g.lon >= w.x + 2e-3 AND g.lon < w.x + 8e-3 AND ((w.y + 2e-3 > g.lat) <> (w.y + 8e-3 > g.lat)))"
LANDED = f"SELECT g.place, g.dx, g.dy FROM spread g WHERE EXISTS (SELECT 1 FROM street_nodes n WHERE n.lat BETWEEN g.lat - 3e-3 AND g.lat + 3e-3 AND n.lon BETWEEN g.lon - 4e-3 AND g.lon + 4e-3 AND {FROM} <= {STEP_M}) AND {DRY}"


#: Centres whose grids a task makes.
SPREAD_AT_ONCE = 5_000


def spread_out(centres, key):
    """Grid points around centres (key, lon, lat), rounded to 5 decimals: (key, dx, dy, lon, lat)."""
    offsets = F.explode(F.array(*(F.struct(F.lit(x).alias("dx"), F.lit(y).alias("dy")) for y in range(-RADIUS_M, RADIUS_M + 1, STEP_M) for x in range(-RADIUS_M, RADIUS_M + 1, STEP_M) if x * x + y * y <= RADIUS_M * RADIUS_M)))
    # a small table becomes many rows: it is dealt out first
    dealt = centres.select(key, "lon", "lat").repartition(max(1, -(-centres.count() // SPREAD_AT_ONCE)), key)
    points = dealt.select(key, "lon", "lat", offsets.alias("o"))
    lon, lat = geo.offset_point("lon", "lat", "o.dx", "o.dy")
    return points.select(key, "o.dx", "o.dy", F.round(lon, 5).alias("lon"), F.round(lat, 5).alias("lat"))


def centres(spark, sf):
    view(spark, sf, "places")
    return spark.sql(CENTRES)


def area_grids(spark, sf):
    """Grid points of all areas, rounded to 5 decimals: (place, dx, dy, lon, lat)."""
    return spread_out(centres(spark, sf).select("place", "lon", "lat"), "place")


def on_land(spark, sf, grid, nodes=None):
    """Points (lon, lat) of a grid within a step of a street node (of nodes, if given), and not in water: each distinct point once."""
    points = grid.select("lon", "lat").distinct().withColumn("id", F.struct("lon", "lat"))
    near = streets.cell_join(points, street_points(spark, sf) if nodes is None else nodes, float(STEP_M), 0.004, geo.meters_from).select("id").distinct()
    spark.read.parquet(f"{sf}/nation.parquet").createOrReplaceTempView("nation")
    sides = F.expr("array(struct(x + 2e-3 AS x1, y + 2e-3 AS y1, x + 8e-3 AS x2, y + 2e-3 AS y2), struct(x + 8e-3 AS x1, y + 2e-3 AS y1, x + 8e-3 AS x2, y + 8e-3 AS y2), struct(x + 8e-3 AS x1, y + 8e-3 AS y1, x + 2e-3 AS x2, y + 8e-3 AS y2), struct(x + 2e-3 AS x1, y + 8e-3 AS y1, x + 2e-3 AS x2, y + 2e-3 AS y2))")
    # water polygons are dealt to the map tiles that they touch
    wet, tiles = spark.sql(WET).withColumn("edges", sides), geo.tile("lon", "lat", 14)
    corner = lambda dx, dy, i: F.floor(geo.tile(F.col("x") + dx, F.col("y") + dy, 14)[i])
    wet = wet.withColumn("tx", F.explode(F.sequence(corner(2e-3, 0.0, 0), corner(8e-3, 0.0, 0)))).withColumn("ty", F.explode(F.sequence(corner(0.0, 8e-3, 1), corner(0.0, 2e-3, 1))))
    points = near.select("id", "id.lon", "id.lat").withColumns({"tx": F.floor(tiles[0]), "ty": F.floor(tiles[1])})
    under = points.join(F.broadcast(wet.select("tx", "ty", "edges")), ["tx", "ty"]).filter(geo.in_rings("lon", "lat", "edges")).select("id").distinct()  # a few rows for each nation
    return points.join(under, "id", "left_anti").select("lon", "lat")


@query(
    "area_land",
    oracle(
        f"SELECT place, possible, coalesce(land, 0) AS land, coalesce(land, 0) >= {MIN_LAND_SHARE} * possible AS enough FROM (SELECT place, count(*) AS possible FROM spread GROUP BY place) LEFT JOIN (SELECT place, count(*) AS land FROM landed GROUP BY place) USING (place)",
        "places", "street_nodes", centres=CENTRES, wet=WET, offsets=OFFSETS, spread=SPREAD, landed=LANDED,
    ),
)
def _(spark, sf):
    """Possible points of each area's grid, and those on land; areas with one centre share their grid."""
    places = centres(spark, sf).withColumn("centre", F.struct("lon", "lat"))
    grid = checkpointed(spread_out(places.select("centre", "lon", "lat").distinct(), "centre"))
    dry = on_land(spark, sf, grid).withColumn("dry", F.lit(1))
    counts = grid.join(dry, ["lon", "lat"], "left").groupBy("centre").agg(F.count("*").alias("possible"), F.count("dry").alias("land"))
    out = places.join(counts, "centre").groupBy("place").agg(F.sum("possible").alias("possible"), F.sum("land").alias("land"))
    return out.select("place", "possible", "land", (F.col("land") >= F.col("possible") * MIN_LAND_SHARE).alias("enough"))


@query("area_grids", oracle("SELECT place, CAST(dx AS INT) AS dx, CAST(dy AS INT) AS dy, lon, lat FROM spread", "places", centres=CENTRES, offsets=OFFSETS, spread=SPREAD))
def _(spark, sf):
    return area_grids(spark, sf).select("place", "dx", "dy", "lon", "lat")


RING = "SELECT place, k, CASE WHEN k < 0 THEN lon ELSE lon + 600 * cos(k / 6.0 * 2 * pi()) / (111195.0 * cos(radians(lat))) END AS lon, CASE WHEN k < 0 THEN lat ELSE lat + 600 * sin(k / 6.0 * 2 * pi()) / 111195.0 END AS lat FROM centres, range(-1, 6) r(k)"
PROBED = "SELECT place, k, 12 + 9 * sin(lon * 900) + 2 * cos(lat * 1100) AS km2 FROM ring"


@query("area_probes", oracle(f"SELECT place, count(*) AS probes, round(max(km2), 4) AS best, round(min(km2) / max(km2), 6) AS ratio, max(km2) >= {MIN_BEST_KM2} AND min(km2) / max(km2) <= {MAX_PROBE_RATIO} AS passed FROM probed GROUP BY place", "places", centres=CENTRES, ring=RING, probed=PROBED))
def _(spark, sf):
    """The middle and six points around it, scored by a stand-in, and the gate they must pass."""
    view(spark, sf, "places")
    ring = score.probes(spark.sql(CENTRES), "place", 0.6 * RADIUS_M)
    scored = ring.withColumn("km2", 12 + 9 * F.sin(F.col("lon") * 900) + 2 * F.cos(F.col("lat") * 1100))
    out = score.probe_gate(scored, "place", MIN_BEST_KM2, MAX_PROBE_RATIO)
    return out.select("place", "probes", F.round("best", 4).alias("best"), F.round("ratio", 6).alias("ratio"), "passed")


# --- pictures ----------------------------------------------------------------------------------------------------

HEAT = "SELECT CAST((event_id * 7919) % 2000 - 1000 AS DOUBLE) AS x, CAST((event_id * 104729) % 2000 - 1000 AS DOUBLE) AS y, 40 + value % 60 AS value, CAST(user_id % 20 AS BIGINT) AS area FROM events WHERE event_type IS NOT NULL AND value IS NOT NULL"
FULL = 2 * 3.141592653589793 * raster.SIGMA_M * raster.SIGMA_M / (STEP_M * STEP_M)
STEP = lambda a, b, x: f"(least(1.0, greatest(0.0, (({x}) - {a}) / {b - a!r})))"
SMOOTH = lambda a, b, x: f"({STEP(a, b, x)} * {STEP(a, b, x)} * (3 - 2 * {STEP(a, b, x)}))"


@query(
    "heatmap_picture",
    oracle(
        f"SELECT area, px, py, round(blend, 5) AS blend, round(edge * {SMOOTH(0.12, 0.55, f'weight / {FULL!r}')}, 6) AS alpha FROM (SELECT *, 1 - {SMOOTH(960.0, 1020.0, 'sqrt(pow((px + 0.5) * 50, 2) + pow((py + 0.5) * 50, 2))')} AS edge FROM (SELECT area, px, py, sum(w * value) / sum(w) AS blend, sum(w) AS weight FROM (SELECT area, px, py, value, exp(-d2 / (2 * 90.0 * 90.0)) AS w FROM (SELECT *, pow((px + 0.5) * 50 - x, 2) + pow((py + 0.5) * 50 - y, 2) AS d2 FROM (SELECT area, x, y, value, CAST(floor(x / 50) AS BIGINT) + a AS px, CAST(floor(y / 50) AS BIGINT) + b AS py FROM heat, range(-6, 7) r(a), range(-6, 7) s(b))) WHERE d2 <= 72900.0) GROUP BY 1, 2, 3)) WHERE edge * {SMOOTH(0.12, 0.55, f'weight / {FULL!r}')} > 0",
        heat=HEAT,
    ),
)
def _(spark, sf):
    """Blend and opacity of the pixels of each area's picture: thin where points are few, feathered at the rim."""
    spark.read.parquet(f"{sf}/events.parquet").createOrReplaceTempView("events")
    out = raster.picture(spark.sql(HEAT), "area", 50.0, RADIUS_M, STEP_M)
    return out.select("area", "px", "py", F.round("value", 5).alias("blend"), F.round("alpha", 6).alias("alpha"))


RAMPED = " ".join(f"WHEN t <= {b} THEN round({p} + {q - p} * (t - {a}) / {b - a!r}, 4)" for (a, (p, *_)), (b, (q, *_)) in zip(raster.RAMP, raster.RAMP[1:], strict=False))


@query("heat_colours", oracle(f"SELECT event_id, CASE {RAMPED} ELSE {float(raster.RAMP[-1][1][0])} END AS red FROM (SELECT event_id, (value % 110) / 100.0 AS t FROM events WHERE value IS NOT NULL)"))
def _(spark, sf):
    t = spark.read.parquet(f"{sf}/events.parquet").filter("value IS NOT NULL").selectExpr("event_id", "(value % 110) / 100.0 AS t")
    return t.select("event_id", F.round(raster.ramp("t")["red"], 4).alias("red"))


@query("cell_lookup", oracle("SELECT p.origin, p.event_id, round(c.cost, 3) AS cost FROM (SELECT CAST(user_id AS BIGINT) AS origin, event_id, CAST(floor((lon + 180) / 360 / size) AS BIGINT) AS cx, CAST(floor((0.5 - ln(tan(pi() / 4 + radians(lat) / 2)) / (2 * pi())) / size) AS BIGINT) AS cy FROM (SELECT user_id, event_id, -122.5e0 + ((event_id * 7919) % 1000) * 8e-5 + 1e-3 AS lon, 37.5e0 + ((event_id * 104729) % 1000) * 7.6e-5 AS lat, 40 / (cos(radians(37.54e0)) * 40075016.686) AS size FROM events)) p LEFT JOIN painted c ON c.origin = p.origin AND c.cx = p.cx AND c.cy = p.cy", **RASTER))
def _(spark, sf):
    """The travel time under each pointer: its cell's value, none outside what was painted."""
    spark.read.parquet(f"{sf}/events.parquet").createOrReplaceTempView("events")
    pointers = spark.sql("SELECT CAST(user_id AS BIGINT) AS origin, event_id, -122.5e0 + ((event_id * 7919) % 1000) * 8e-5 + 1e-3 AS lon, 37.5e0 + ((event_id * 104729) % 1000) * 7.6e-5 AS lat, 37.54e0 AS lat0 FROM events")
    return rounded(raster.painted_at(pointers, cells(spark, sf), 1.25, 700.0).select("origin", "event_id", "cost"), "cost")


# --- guesses -----------------------------------------------------------------------------------------------------

TRIED = "SELECT CAST(user_id AS BIGINT) AS player, event_id, CAST((event_id * 7919) % 2400 - 1200 AS DOUBLE) AS dx, CAST((event_id * 104729) % 2400 - 1200 AS DOUBLE) AS dy, event_type = 'click' AS water, value AS km2 FROM events"


@query("valid_guesses", oracle("SELECT player, event_id FROM (SELECT *, row_number() OVER (PARTITION BY player ORDER BY event_id) AS k FROM tried WHERE km2 IS NOT NULL AND sqrt(dx * dx + dy * dy) <= 1000 AND NOT coalesce(water, false)) WHERE k <= 3", tried=TRIED))
def _(spark, sf):
    spark.read.parquet(f"{sf}/events.parquet").createOrReplaceTempView("events")
    return score.valid_guesses(spark.sql(TRIED).filter("km2 IS NOT NULL"), float(RADIUS_M)).select("player", "event_id")


@query("share_texts", oracle("SELECT player, 'Day ' || (1 + player % 30) || chr(10) || string_agg(tile, '' ORDER BY event_id) || ' ' || CAST(CAST(floor(max(pct) + 0.5) AS BIGINT) AS VARCHAR) || '%' AS text FROM (SELECT *, CASE WHEN pct >= 95 THEN 'G' WHEN pct >= 80 THEN 'Y' WHEN pct >= 60 THEN 'O' ELSE 'R' END AS tile FROM (SELECT player, event_id, least(100.0, km2) AS pct, row_number() OVER (PARTITION BY player ORDER BY event_id) AS k FROM tried WHERE km2 IS NOT NULL) WHERE k <= 3) GROUP BY player", tried=TRIED))
def _(spark, sf):
    spark.read.parquet(f"{sf}/events.parquet").createOrReplaceTempView("events")
    tried = spark.sql(TRIED).filter("km2 IS NOT NULL").select("player", F.col("event_id").alias("moment"), "km2", F.concat(F.lit("Day "), (1 + F.col("player") % 30).cast("string")).alias("title"))
    return score.share_texts(tried, F.lit(100.0)).select("player", "text")


@query("period_index", "SELECT CAST(c_custkey AS BIGINT) AS id, p AS period, CAST(coalesce(list_position(['rush', 'midday', 'evening', 'weekend', 'night'], p), 0) - 1 AS INT) AS idx FROM (SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN 'rush' WHEN 1 THEN 'midday' WHEN 2 THEN 'evening' WHEN 3 THEN 'weekend' WHEN 4 THEN 'night' WHEN 5 THEN 'never' END AS p FROM customer)")
def _(spark, sf):
    names = F.array(*(F.lit(x) for x in (*scalars.PERIODS, "never")))
    k = F.col("c_custkey")
    rows = spark.read.parquet(f"{sf}/customer.parquet").select(k.cast("long").alias("id"), F.get(names, (k % 7).cast("int")).alias("period"))
    return rows.withColumn("idx", scalars.period_index("period"))


@query("seeded_cells", oracle("SELECT origin, count(*) AS cells, max(cx) - min(cx) + 15 AS width, max(cy) - min(cy) + 15 AS height FROM cells GROUP BY origin", **RASTER))
def _(spark, sf):
    """The grid that holds each origin's cells with a margin of the walking reach."""
    return raster.extents(cells(spark, sf))


BOXED = "SELECT origin, (((max(lon) - min(lon)) / 360 * unit + 500) * ((max(my) - min(my)) * unit + 500)) AS area FROM (SELECT *, cos(radians(lat0)) * 40075016.686 AS unit, 0.5 - ln(tan(pi() / 4 + radians(lat) / 2)) / (2 * pi()) AS my FROM reached) GROUP BY origin, unit"


@query("cell_sizes", oracle("SELECT origin, round(greatest(40.0, sqrt(area / 4000000)), 4) AS cell, round(greatest(40.0, sqrt(area / 5000)), 4) AS coarse FROM boxed", **RASTER, boxed=BOXED))
def _(spark, sf):
    """Metres of a cell by origin, under the standard bound and a small one."""
    spark.read.parquet(f"{sf}/events.parquet").createOrReplaceTempView("events")
    found = spark.sql(RASTER["reached"])
    both = raster.cell_size(found).join(raster.cell_size(found, most=5000).withColumnRenamed("cell", "coarse"), "origin")
    return both.select("origin", F.round("cell", 4).alias("cell"), F.round("coarse", 4).alias("coarse"))


CORNERS = "SELECT origin, cx, cy, round(cx * size * 360 - 180, 7) AS west, round((cx + 1) * size * 360 - 180, 7) AS east, round(degrees(atan(sinh(pi() * (1 - 2 * cy * size)))), 7) AS north, round(degrees(atan(sinh(pi() * (1 - 2 * (cy + 1) * size)))), 7) AS south FROM (SELECT origin, cx, cy, 40 / (cos(radians(37.54e0)) * 40075016.686) AS size FROM cells)"


@query("cell_corners", oracle(CORNERS, **RASTER))
def _(spark, sf):
    out = raster.with_corners(cells(spark, sf), F.lit(37.54))
    return out.select("origin", "cx", "cy", *(F.round(c, 7).alias(c) for c in ("west", "east", "north", "south")))


# --- requests and documents of settings ----------------------------------------------------------------------------

ANSWERED = "SELECT CAST(user_id AS BIGINT) AS session, event_id AS request, value FROM events WHERE event_type <> 'view'"


@query("fresh_answers", oracle("SELECT session, request, value FROM answered a WHERE request = (SELECT max(event_id) FROM events e WHERE e.user_id = a.session)", answered=ANSWERED))
def _(spark, sf):
    spark.read.parquet(f"{sf}/events.parquet").createOrReplaceTempView("events")
    return requests.fresh(spark.sql(ANSWERED), spark.sql("SELECT CAST(user_id AS BIGINT) AS session, event_id AS request FROM events")).select("session", "request", "value")


TYPED = "SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN (c_custkey % 100) || '.25,-' || (c_custkey % 200) || '.5' WHEN 1 THEN '91.0,0' WHEN 2 THEN '12' WHEN 3 THEN 'here,there' ELSE (c_custkey % 80) || ',' || (c_custkey % 170) END AS typed FROM customer"


@query("typed_points", oracle("SELECT id, CASE WHEN ok THEN lon END AS lon, CASE WHEN ok THEN lat END AS lat FROM (SELECT *, coalesce(n = 2 AND lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180, false) AS ok FROM (SELECT id, len(string_split(typed, ',')) AS n, try_cast(string_split(typed, ',')[1] AS DOUBLE) AS lat, try_cast(string_split(typed, ',')[2] AS DOUBLE) AS lon FROM typed))", typed=TYPED))
def _(spark, sf):
    spark.read.parquet(f"{sf}/customer.parquet").createOrReplaceTempView("customer")
    lon, lat = scalars.parse_lat_lon("typed")
    return spark.sql(TYPED).select("id", lon.alias("lon"), lat.alias("lat"))


@query("event_settings", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def _(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


BUILT = "SELECT CAST(CAST(o_orderdate AS DATE) AS {text}) AS date, 'g' || (o_orderkey % 3) AS build, count(*) AS n FROM orders GROUP BY 1, 2"


@query("rebuilt_days", oracle("SELECT date, max(n) AS n, 'old' AS source FROM built WHERE build = 'g1' GROUP BY date UNION ALL SELECT date, max(n), 'new' FROM built WHERE build <> 'g1' AND date NOT IN (SELECT date FROM built WHERE build = 'g1') GROUP BY date", built=BUILT.format(text="VARCHAR")))
def _(spark, sf):
    """Earlier days stay only if they were made on the present build of the graph."""
    spark.read.parquet(f"{sf}/orders.parquet").createOrReplaceTempView("orders")
    built = spark.sql(BUILT.format(text="STRING"))
    kept = score.of_build(built, "build", "g1").groupBy("date").agg(F.max("n").alias("n")).withColumn("source", F.lit("old"))
    new = built.filter("build <> 'g1'").groupBy("date").agg(F.max("n").alias("n")).withColumn("source", F.lit("new"))
    return score.merge_by_date(kept, new)


#: Views place a pin (in water for every fifth), clicks send it, purchases with a value are answers.
MOVES = (
    "SELECT CAST(user_id AS BIGINT) AS player, event_id AS moment, CASE event_type WHEN 'view' THEN 'place' WHEN 'click' THEN 'submit' ELSE 'answer' END AS kind, CASE WHEN event_type = 'view' THEN event_id END AS pin, event_id % 5 = 0 AS water, value AS km2"
    " FROM events WHERE event_type IN ('view', 'click') OR (event_type = 'purchase' AND value IS NOT NULL)"
)


@query("game_guesses")
def _(spark, sf):
    """Settled guesses of each user, from the moves that their events stand for: a pin's number is its longitude, and an answer is for the pin that was placed last."""
    spark.read.parquet(f"{sf}/events.parquet").createOrReplaceTempView("events")
    placed = F.last("pin", ignorenulls=True).over(W.partitionBy("player").orderBy("moment").rowsBetween(W.unboundedPreceding, 0))
    moves = spark.sql(MOVES).withColumn("lon", F.when(F.col("kind") == "answer", placed).otherwise(F.col("pin")).cast("double"))
    events = moves.select("player", "moment", "kind", "lon", F.lit(0.0).alias("lat"), "km2", (~F.col("water")).alias("valid"), F.lit(60.0).alias("best"))
    return game.played(events).select("player", "guess", F.col("lon").cast("long").alias("moment"), "km2", "pct", "over")
