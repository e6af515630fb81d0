"""Queries about feeds, places, geometry and the documents that are written from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, scalars
from ..operators import graph, hygiene, places
from ..sources import feeds as sources
from ..sources.surrogate import oracle, view
from .catalog import graph_edges, graphed, hops, query, raw_hops, rounded, scheduled

# --- hygiene -----------------------------------------------------------------------------------------------------

CLOCKS = "SELECT trip, seq, stop, CASE WHEN stop % 3 <> 0 THEN t END AS arr, CASE WHEN stop % 4 <> 0 THEN t + 30 END AS dep FROM timed"


@query("feed_times", oracle("SELECT trip, seq, CAST(coalesce(arr, dep) AS DOUBLE) AS arr, CAST(coalesce(dep, arr) AS DOUBLE) AS dep FROM clocks", "timed", clocks=CLOCKS))
def _(spark, sf):
    view(spark, sf, "timed")
    return hygiene.both_times(spark.sql(CLOCKS)).select("trip", "seq", F.col("arr").cast("double"), F.col("dep").cast("double"))


FEEDS = "SELECT feed || ':' || (s_suppkey % 60) AS stop, feed, s_suppkey AS ord, CASE WHEN s_suppkey % 7 = 0 THEN 'none' ELSE '1.5' END AS lon, CASE WHEN s_suppkey % 11 = 0 THEN '' ELSE CAST(s_suppkey AS {text}) END AS lat FROM (SELECT 'a' AS feed, * FROM supplier UNION ALL SELECT 'b' AS feed, * FROM supplier WHERE s_nationkey < 9)"


@query("feed_stops", oracle("SELECT stop, feed, ord, try_cast(lon AS DOUBLE) AS lon, try_cast(lat AS DOUBLE) AS lat FROM (SELECT *, row_number() OVER (PARTITION BY stop ORDER BY feed, ord) AS k FROM feeds) WHERE k = 1 AND try_cast(lon AS DOUBLE) IS NOT NULL AND try_cast(lat AS DOUBLE) IS NOT NULL", feeds=FEEDS.format(text="VARCHAR")))
def _(spark, sf):
    spark.read.parquet(f"{sf}/supplier.parquet").createOrReplaceTempView("supplier")
    # the first of repeated stops counts, even one without a place
    return hygiene.located(hygiene.first_rows(spark.sql(FEEDS.format(text="STRING")), ["stop"], ["feed", "ord"])).select("stop", "feed", "ord", "lon", "lat")


def packed(rows):
    """An archive for each nation, with the stops that its suppliers are: a byte-order mark, spaces in the header, commas and line ends in names, and columns that nobody asks for."""
    import io
    import zipfile

    import pandas as pd

    def pack(key, pdf):
        table = pd.DataFrame({"stop_id": pdf["s_suppkey"].astype(str), " stop_name": [f'{n}, "{a}"\nplatform' for n, a in zip(pdf["s_name"], pdf["s_nationkey"], strict=True)], "zone": "z", "stop_lon": pdf["s_suppkey"] * 0.5, "stop_lat": ""})
        table.loc[pdf["s_suppkey"].to_numpy() % 3 == 0, "stop_lat"] = "37.5"
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as archive:
            archive.writestr("feed/readme.txt", "")
            if key[0] % 5 != 4:
                archive.writestr("feed/stops.txt", "\ufeff" + table.sort_values("stop_id").to_csv(index=False))
        return pd.DataFrame({"path": [f"in/{key[0]}.zip"], "content": [out.getvalue()]})

    return rows.groupBy("s_nationkey").applyInPandas(pack, "path string, content binary")


@query("zipped_stops", "SELECT CAST(s_nationkey AS VARCHAR) AS feed, CAST(s_suppkey AS VARCHAR) AS stop_id, CAST(s_suppkey * 0.5 AS DOUBLE) AS stop_lon, CASE WHEN s_suppkey % 3 = 0 THEN 37.5e0 END AS stop_lat, s_name || ', \"' || s_nationkey || '\"' || chr(10) || 'platform' AS stop_name FROM supplier WHERE s_nationkey % 5 <> 4")
def _(spark, sf):
    """Stops out of zipped feeds: one archive a nation; some have no such member."""
    rows = spark.read.parquet(f"{sf}/supplier.parquet").select("s_suppkey", "s_name", "s_nationkey")
    found = sources.unzipped(packed(rows), "stops")
    return found.select("feed", "stop_id", F.col("stop_lon").cast("double"), F.col("stop_lat").cast("double"), "stop_name")


ROUTES = "SELECT route, CASE WHEN route % 7 <> 0 THEN CAST(agency AS BIGINT) END AS agency, CASE WHEN route % 3 = 0 THEN 'R' || route WHEN route % 3 = 1 THEN '' END AS short, CASE WHEN route % 2 = 0 THEN 'Line ' || route ELSE '' END AS long, CASE WHEN route % 4 = 0 THEN 'FF00AA' WHEN route % 4 = 1 THEN 'red' END AS colour FROM routes"
AGENCIES = "SELECT CAST(n_nationkey AS BIGINT) AS agency, CASE WHEN n_nationkey % 5 <> 4 THEN n_name END AS name, n_nationkey AS ord FROM nation UNION ALL SELECT CAST(n_nationkey AS BIGINT), CASE WHEN n_nationkey % 2 = 0 THEN 'again' END, n_nationkey + 100 FROM nation WHERE n_nationkey % 3 = 0"
#: A feed whose agencies have no ids.
NAMELESS = "SELECT CAST(NULL AS BIGINT) AS agency, r_name AS name, -r_regionkey AS ord FROM region"


LABELS = (
    "SELECT route, agency, name, coalesce(nullif(short, ''), nullif(long, ''), name) AS label, CASE WHEN regexp_full_match(coalesce(colour, ''), '[0-9a-fA-F]{6}') THEN '#' || colour ELSE 'by mode' END AS colour"
    " FROM (SELECT r.* REPLACE (coalesce(CAST(r.agency AS VARCHAR), d) AS agency), (SELECT max(coalesce(name, id)) FROM (SELECT coalesce(CAST(agency AS VARCHAR), d) AS id, name, ord FROM agencies) x WHERE id = coalesce(CAST(r.agency AS VARCHAR), d)"
    " AND ord = (SELECT max(ord) FROM agencies y WHERE coalesce(CAST(y.agency AS VARCHAR), d) = x.id)) AS own FROM named r, (SELECT CASE WHEN count(agency) > 0 THEN CAST((SELECT agency FROM agencies ORDER BY ord LIMIT 1) AS VARCHAR) ELSE (SELECT name FROM agencies ORDER BY ord LIMIT 1) END AS d FROM agencies)), LATERAL (SELECT coalesce(own, agency) AS name)"
)


def labelled(spark, sf, agencies: str):
    view(spark, sf, "routes")
    for n in ("nation", "region"):
        spark.read.parquet(f"{sf}/{n}.parquet").createOrReplaceTempView(n)
    rows = hygiene.with_default_agency(spark.sql(ROUTES), spark.sql(agencies))
    return rows.select("route", "agency", "name", scalars.route_label("short", "long", "name").alias("label"), scalars.route_colour("colour", F.lit("by mode")).alias("colour"))


@query("route_labels_without_ids", oracle(LABELS, "routes", named=ROUTES, agencies=NAMELESS))
def _(spark, sf):
    return labelled(spark, sf, NAMELESS)


@query(
    "route_labels",
    oracle(
        LABELS,
        "routes", named=ROUTES, agencies=AGENCIES,
    ),
)
def _(spark, sf):
    return labelled(spark, sf, AGENCIES)


TWO = "SELECT route, from_stop, to_stop, seconds, CASE WHEN (from_stop + to_stop) % 3 = 0 THEN 'b' ELSE 'a' END AS feed FROM hops UNION ALL SELECT route, from_stop, to_stop, seconds + 1, 'c' FROM hops WHERE from_stop % 2 = 0"


@query("later_feed_wins", scheduled("SELECT route, from_stop, to_stop, round(seconds, 3) AS seconds, feed FROM (SELECT *, row_number() OVER (PARTITION BY route, from_stop, to_stop ORDER BY feed DESC) AS k FROM two) WHERE k = 1", two=TWO))
def _(spark, sf):
    hops(spark, sf).createOrReplaceTempView("hops")
    return rounded(hygiene.later_wins(spark.sql(TWO), ["route", "from_stop", "to_stop"], ["feed"]).select("route", "from_stop", "to_stop", "seconds", "feed"), "seconds")


# --- geometry ----------------------------------------------------------------------------------------------------

BENT = "SELECT route, from_stop, to_stop, -122.5e0 + (from_stop % 10) * 1e-3 AS x, 37.5e0 + (to_stop % 10) * 1e-3 AS y FROM hops WHERE (route + from_stop + to_stop) % 3 <> 0"


@query(
    "hop_geometry",
    scheduled(
        "SELECT h.route, h.from_stop, h.to_stop, x IS NULL AS straight, round(CASE WHEN x IS NULL THEN a.lon ELSE x END, 6) AS x_first, round(CASE WHEN x IS NULL THEN b.lon ELSE x + 2e-3 END, 6) AS x_last, round(CASE WHEN x IS NULL THEN a.lat ELSE y END, 6) AS y_first, CASE WHEN x IS NULL THEN 2 ELSE 3 END AS points, sum(CASE WHEN x IS NULL THEN 2 ELSE 3 END) OVER (ORDER BY h.route, h.from_stop, h.to_stop ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - CASE WHEN x IS NULL THEN 2 ELSE 3 END AS first_point FROM hops h LEFT JOIN bent USING (route, from_stop, to_stop) JOIN stops a ON a.stop = h.from_stop JOIN stops b ON b.stop = h.to_stop",
        "stops", bent=BENT,
    ),
)
def _(spark, sf):
    own = hops(spark, sf)
    own.createOrReplaceTempView("hops")
    bent = spark.sql(BENT).select("route", "from_stop", "to_stop", F.expr("array(x, x + 1e-3, x + 2e-3)").alias("xs"), F.expr("array(y, y, y)").alias("ys"))
    out = hygiene.with_geometry(own, bent, view(spark, sf, "stops")).withColumn("points", F.size("xs"))
    out = graph.running(out, ["route", "from_stop", "to_stop"], "points", "first_point")
    return out.select("route", "from_stop", "to_stop", "straight", F.round(F.get("xs", F.lit(0)), 6).alias("x_first"), F.round(F.element_at("xs", -1), 6).alias("x_last"), F.round(F.get("ys", F.lit(0)), 6).alias("y_first"), "points", "first_point")


@query("csr_offsets", graphed("SELECT src, degree, sum(degree) OVER (ORDER BY src ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - degree AS first_edge FROM (SELECT src, count(*) AS degree FROM edges GROUP BY src)"))
def _(spark, sf):
    return graph.running(graph.degrees(graph_edges(spark, sf)), ["src"], "degree", "first_edge")


@query("compact_nodes", oracle("SELECT node, row_number() OVER (ORDER BY node) - 1 AS id FROM street_nodes WHERE x % 3 <> 1", "street_nodes"))
def _(spark, sf):
    return graph.dense_ids(view(spark, sf, "street_nodes").filter("x % 3 <> 1").select("node"), ["node"], "id")


# --- places ------------------------------------------------------------------------------------------------------

#: Squares of cities and counties, as (ord, name, level, x, y, side); later ones lie over earlier ones.
SQUARES = "SELECT n_nationkey AS ord, n_name AS name, 8 AS level, -122.5e0 + (n_nationkey % 5) * 16e-3 AS x, 37.5e0 + floor(n_nationkey / 5) * 15e-3 AS y, 2e-2 AS side FROM nation WHERE n_nationkey % 6 <> 2 UNION ALL SELECT r_regionkey, r_name, 6, -122.51e0 + r_regionkey * 2e-2, 37.49e0, 45e-3 FROM region"
EDGES = "array(struct(x AS x1, y AS y1, x + side AS x2, y AS y2), struct(x + side AS x1, y AS y1, x + side AS x2, y + side AS y2), struct(x + side AS x1, y + side AS y1, x AS x2, y + side AS y2), struct(x AS x1, y + side AS y1, x AS x2, y AS y2))"
INSIDE = "((b.y > p.lat) <> (b.y + b.side > p.lat)) AND ((p.lon < b.x + b.side) <> (p.lon < b.x))"


@query(
    "places_with_city",
    oracle(
        "SELECT place, name, type, city, CASE WHEN city <> '' AND city <> name THEN name || ', ' || city ELSE name END AS label FROM (SELECT place, name, type, coalesce(max(city), max(county), '') AS city FROM (SELECT p.place, p.name, p.type, (SELECT arg_max(b.name, b.ord) FROM squares b WHERE b.level = 8 AND " + INSIDE + ") AS city, (SELECT arg_max(b.name, b.ord) FROM squares b WHERE b.level = 6 AND " + INSIDE + ") AS county FROM places p) GROUP BY place, name, type)",
        "places", squares=SQUARES,
    ),
)
def _(spark, sf):
    for n in ("nation", "region"):
        spark.read.parquet(f"{sf}/{n}.parquet").createOrReplaceTempView(n)
    rings = spark.sql(SQUARES).withColumn("edges", F.expr(EDGES))
    of = lambda level: rings.filter(F.col("level") == level).select("ord", "name", "edges")
    named = places.with_city(view(spark, sf, "places").select("place", "name", "type", "lon", "lat"), of(8), of(6))
    return named.select("place", "name", "type", "city", places.label("name", "city").alias("label"))


#: The same squares as an extract has them: relations with tags, and ways of a side or two, some of them turned round; a way of another boundary that closes nothing.
SIDES = {
    "relations": "SELECT level || '/' || ord AS boundary, CASE WHEN level = 8 AND ord % 9 = 8 THEN 'maritime' ELSE 'administrative' END AS kind, name, CAST(level AS STRING) AS level, ord, x, y, side FROM squares",
    "corners": "SELECT boundary, k AS way, array(k, (k + 1) % 4) AS cs, ord, x, y, side FROM relations LATERAL VIEW explode(array(0, 3)) AS k UNION ALL SELECT boundary, 1, array(1, 2, 3), ord, x, y, side FROM relations UNION ALL SELECT boundary, 9, array(7, 8), ord, x, y, side FROM relations WHERE ord % 2 = 0",
    "way_points": "SELECT boundary, way, transform(CASE WHEN (ord + way) % 2 = 0 THEN cs ELSE reverse(cs) END, c -> struct(CAST(c AS BIGINT) AS node, x + CASE WHEN c IN (1, 2) THEN side ELSE 0 END AS lon, y + CASE WHEN c IN (2, 3) THEN side ELSE 0 END AS lat)) AS points FROM corners",
}
TAGGED = INSIDE + " AND NOT (b.level = 8 AND b.ord % 9 = 8)"


@query(
    "places_in_assembled_rings",
    oracle(
        "SELECT place, name, type, city FROM (SELECT place, name, type, coalesce(max(city), max(county), '') AS city FROM (SELECT p.place, p.name, p.type, (SELECT arg_max(b.name, b.ord) FROM squares b WHERE b.level = 8 AND " + TAGGED + ") AS city, (SELECT arg_max(b.name, b.ord) FROM squares b WHERE b.level = 6 AND " + INSIDE + ") AS county FROM places p WHERE type IN ('suburb', 'neighbourhood')) GROUP BY place, name, type)",
        "places", squares=SQUARES,
    ),
)
def _(spark, sf):
    """Places of a neighbourhood's kind with the city around them, its rings assembled from open ways."""
    for n in ("nation", "region"):
        spark.read.parquet(f"{sf}/{n}.parquet").createOrReplaceTempView(n)
    spark.sql(SQUARES).createOrReplaceTempView("squares")
    for n, sql in SIDES.items():
        spark.sql(sql).createOrReplaceTempView(n)
    relations = spark.table("relations")
    assembled = places.ring_edges(places.rings(spark.table("way_points"))).select("boundary", "edges").join(relations.select("boundary", "ord"), "boundary")
    of = lambda level: places.administrative(relations, level).join(assembled, "boundary").select("ord", "name", "edges")
    own = places.neighbourhood_places(view(spark, sf, "places").select("place", "name", "type", "lon", "lat"))
    return places.with_city(own, of(places.CITY_LEVEL), of(places.COUNTY_LEVEL)).select("place", "name", "type", "city")


# --- documents that are written ----------------------------------------------------------------------------------


@query(
    "graph_facts",
    oracle(
        "SELECT round(min(lon), 5) AS west, round(min(lat), 5) AS south, round(max(lon), 5) AS east, round(max(lat), 5) AS north, round(avg(lat), 6) AS lat0, count(*) AS nodes, (SELECT string_agg(n_name, '|' ORDER BY n_name) FROM (SELECT DISTINCT n_name FROM nation JOIN routes ON agency = n_nationkey)) AS agencies, (SELECT string_agg(CAST(m AS VARCHAR), '|' ORDER BY m) FROM (SELECT DISTINCT CASE route_type WHEN 1 THEN 1 WHEN 0 THEN 2 WHEN 4 THEN 3 ELSE 0 END AS m FROM routes)) AS modes FROM street_nodes",
        "street_nodes", "routes",
    ),
)
def _(spark, sf):
    """What a document about the graph says: its box, middle, agencies and modes."""
    nations = spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_nationkey").alias("agency"), "n_name")
    routes = view(spark, sf, "routes")
    box = view(spark, sf, "street_nodes").agg(*(F.round(f(c), 5).alias(n) for f, c, n in ((F.min, "lon", "west"), (F.min, "lat", "south"), (F.max, "lon", "east"), (F.max, "lat", "north"))), F.round(F.avg("lat"), 6).alias("lat0"), F.count("*").alias("nodes"))
    agencies = routes.join(nations, "agency").agg(F.array_join(F.array_sort(F.collect_set("n_name")), "|").alias("agencies"))
    modes = routes.agg(F.array_join(F.transform(F.array_sort(F.collect_set(scalars.mode_group("route_type"))), lambda m: m.cast("string")), "|").alias("modes"))
    return box.crossJoin(agencies).crossJoin(modes)  # one row each


@query("agencies_by_stops", scheduled("SELECT agency, stops, row_number() OVER (ORDER BY stops DESC, agency) AS place FROM (SELECT agency, count(*) AS stops FROM (SELECT DISTINCT agency, stop FROM (SELECT agency, from_stop AS stop FROM raw_hops JOIN trips USING (trip) JOIN routes USING (route) UNION ALL SELECT agency, to_stop FROM raw_hops JOIN trips USING (trip) JOIN routes USING (route))) GROUP BY agency)", "routes"))
def _(spark, sf):
    own = raw_hops(spark, sf).join(view(spark, sf, "trips"), "trip").join(view(spark, sf, "routes"), "route")
    served = own.select("agency", F.col("from_stop").alias("stop")).union(own.select("agency", "to_stop")).distinct()
    return graph.dense_ids(served.groupBy("agency").agg(F.count("*").alias("stops")).withColumn("less", -F.col("stops")), ["less", "agency"], "place").select("agency", "stops", (F.col("place") + 1).alias("place"))


POINTS = "SELECT c_custkey AS id, -122.5e0 + ((c_custkey * 7919) % 1000) * 8e-5 AS lon, 37.5e0 + ((c_custkey * 104729) % 1000) * 7.6e-5 AS lat, CAST((c_custkey * 31) % 400 - 200 AS DOUBLE) AS dx, CAST((c_custkey * 17) % 300 - 150 AS DOUBLE) AS dy FROM customer"
K = geo.EARTH_RADIUS_M * 3.141592653589793 / 180


@query(
    "point_math",
    oracle(
        f"SELECT id, round(lon * {K!r} * cos(radians(37.54)), 3) AS x, round(lat * {K!r}, 3) AS y, round(lon + dx / (111195.0 * cos(radians(lat))), 7) AS east, round(lat + dy / 111195.0, 7) AS north, CAST(round_even(dx / 4, 0) AS DOUBLE) AS to_even, CAST(floor(dx / 4 + 0.5) AS DOUBLE) AS half_up, round(dx / 7, 5) AS five, round(t * t * (3 - 2 * t), 9) AS smooth, round(sqrt(pow(dx - u * 100, 2) + pow(dy - u * 50, 2)), 6) AS from_segment FROM (SELECT *, least(1.0, greatest(0.0, (dx + 100) / 200)) AS t, least(1.0, greatest(0.0, (dx * 100 + dy * 50) / 12500)) AS u FROM points)",
        points=POINTS,
    ),
)
def _(spark, sf):
    spark.read.parquet(f"{sf}/customer.parquet").createOrReplaceTempView("customer")
    p = spark.sql(POINTS)
    x, y = geo.local_meters("lon", "lat", 37.54)
    east, north = geo.offset_point("lon", "lat", "dx", "dy")
    return p.select(
        "id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"), F.round(east, 7).alias("east"), F.round(north, 7).alias("north"), F.rint(F.col("dx") / 4).alias("to_even"),
        scalars.half_up(F.col("dx") / 4).cast("double").alias("half_up"), F.round(F.col("dx") / 7, 5).alias("five"), F.round(scalars.smoothstep(-100.0, 100.0, "dx"), 9).alias("smooth"),
        F.round(geo.from_segment("dx", "dy", 0.0, 0.0, 100.0, 50.0), 6).alias("from_segment"),
    )


@query(
    "circle_points",
    oracle("SELECT spot, CAST(i AS INT) AS i, round(lon + 1000 * cos(i / 64.0 * 2 * pi()) / (111195.0 * cos(radians(lat))), 7) AS x, round(lat + 1000 * sin(i / 64.0 * 2 * pi()) / 111195.0, 7) AS y FROM spots, range(65) r(i)", spots="SELECT n_nationkey AS spot, -122.5e0 + n_nationkey * 3e-3 AS lon, 37.5e0 + n_nationkey * 2e-3 AS lat FROM nation"),
)
def _(spark, sf):
    spark.read.parquet(f"{sf}/nation.parquet").createOrReplaceTempView("nation")
    p = spark.sql("SELECT n_nationkey AS spot, -122.5e0 + n_nationkey * 3e-3 AS lon, 37.5e0 + n_nationkey * 2e-3 AS lat FROM nation")
    return p.select("spot", F.posexplode(geo.circle("lon", "lat", 1000.0)).alias("i", "at")).select("spot", "i", F.round("at.x", 7).alias("x"), F.round("at.y", 7).alias("y"))
