"""Schedule- and street-shaped views over the star-schema tables, in SQL that both Spark and the oracle read.

Deterministic integer arithmetic stands in for feeds that can't be had offline; the operators take plain DataFrames,
so real feeds plug in unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

#: The stops of the schedule are 40 of the suppliers, since stop times choose among 40; halts are all of them.
#: name -> (tables and views it reads, SQL); {dow} is the day of the week with Monday 0.
VIEWS = {
    "stops": "SELECT s_suppkey AS stop, -122.5e0 + ((s_suppkey * 7919) % 1000) * 8e-5 AS lon, 37.5e0 + ((s_suppkey * 104729) % 1000) * 7.6e-5 AS lat, s_name AS name FROM supplier WHERE s_suppkey < 40",
    "halts": "SELECT s_suppkey AS stop, -122.5e0 + ((s_suppkey * 7919) % 1000) * 8e-5 AS lon, 37.5e0 + ((s_suppkey * 104729) % 1000) * 7.6e-5 AS lat, s_name AS name FROM supplier",
    "routes": "SELECT DISTINCT c_nationkey * 4 + o_custkey % 4 AS route, c_nationkey AS agency, CASE CAST(o_custkey % 4 AS INT) WHEN 0 THEN 3 WHEN 1 THEN 1 WHEN 2 THEN 0 ELSE 4 END AS route_type FROM orders JOIN customer ON o_custkey = c_custkey",
    "trips": "SELECT o_orderkey AS trip, c_nationkey * 4 + o_custkey % 4 AS route, {dow} AS service FROM orders JOIN customer ON o_custkey = c_custkey",
    "timed": "SELECT l_orderkey AS trip, l_suppkey % 40 AS stop, l_returnflag AS flag, row_number() OVER w AS seq, ((l_orderkey * 37) % 26) * 3600 + sum(l_quantity * 60) OVER w AS t, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
    "stop_times": "SELECT trip, stop, seq, CASE WHEN flag = 'N' AND seq > 1 AND seq < n THEN NULL ELSE CAST(t AS DOUBLE) END AS t FROM timed",
    "street_nodes": "SELECT c_custkey AS node, c_custkey % 40 AS x, CAST(floor(c_custkey / 40.0) AS BIGINT) AS y, -122.5e0 + (c_custkey % 40) * 2e-3 AS lon, 37.5e0 + floor(c_custkey / 40.0) * 2e-3 AS lat FROM customer",
    "pairs": "SELECT a.node AS u, b.node AS v FROM street_nodes a JOIN street_nodes b ON b.node = a.node + 1 AND a.x < 39 UNION ALL SELECT a.node AS u, b.node AS v FROM street_nodes a JOIN street_nodes b ON b.node = a.node + 40",
    "street_edges": "SELECT u, v, CAST(120 + (u * 31 + v * 17) % 180 AS DOUBLE) AS m FROM pairs WHERE (u * 31 + v * 17) % 11 <> 0",
    "ways": "SELECT l_orderkey AS way, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS ord, l_partkey AS node, -122.5e0 + (l_partkey % 40) * 2e-3 AS lon, 37.5e0 + floor(l_partkey / 40.0) * 2e-3 AS lat FROM lineitem",
    "way_tags": "SELECT o_orderkey AS way, CASE o_orderpriority WHEN '1-URGENT' THEN 'motorway' WHEN '2-HIGH' THEN 'residential' WHEN '3-MEDIUM' THEN 'service' WHEN '5-LOW' THEN NULL ELSE 'footway' END AS highway, CASE o_orderstatus WHEN 'F' THEN 'yes' WHEN 'O' THEN '' ELSE 'no' END AS foot, CASE WHEN o_custkey % 5 = 0 THEN 'private' ELSE '' END AS access, CASE WHEN o_custkey % 3 = 0 THEN 'driveway' ELSE '' END AS service, CASE WHEN o_custkey % 7 = 0 THEN 'sidewalk' ELSE '' END AS footway FROM orders",
    "places": "SELECT p_partkey AS place, p_name AS name, CASE p_size % 3 WHEN 0 THEN 'suburb' WHEN 1 THEN 'neighbourhood' ELSE 'town' END AS type, -122.5e0 + ((p_partkey * 7919) % 1000) * 8e-5 AS lon, 37.5e0 + ((p_partkey * 104729) % 1000) * 7.6e-5 AS lat FROM part",
    "samples": "SELECT event_id, user_id, ts, value AS km2, -122.5e0 + ((event_id * 7919) % 1000) * 8e-5 AS lon, 37.5e0 + ((event_id * 104729) % 1000) * 7.6e-5 AS lat FROM events",
}
DOW = {"spark": "weekday(o_orderdate)", "oracle": "(isodow(o_orderdate) - 1)"}
NEEDS = {"stop_times": ["timed"], "pairs": ["street_nodes"], "street_edges": ["street_nodes", "pairs"]}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view over the tables of a folder."""
    for t in TABLES:
        if t in VIEWS[name] or any(t in VIEWS[n] for n in NEEDS.get(name, [])):
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    for n in [*NEEDS.get(name, []), name]:
        out = spark.sql(VIEWS[n].format(dow=DOW["spark"]))
        out.createOrReplaceTempView(n)
    return out


#: The order of the stops of a trip.
IN_TRIP = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


def ordered_stop_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view stop_times with the columns of its order: windows by trip over IN_TRIP neither exchange nor sort it again, as they do where the view names the trip twice."""
    w = W.partitionBy("trip").orderBy(*IN_TRIP)
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("trip"), *IN_TRIP, (F.col("l_suppkey") % 40).alias("stop"), (F.col("l_returnflag") == "N").alias("flag"))
    spent = F.sum(F.col("l_quantity") * 60).over(w.rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumns({"seq": F.row_number().over(w), "spent": spent, "final": F.lead(F.lit(True)).over(w).isNull()})
    blank = F.col("flag") & (F.col("seq") > 1) & ~F.col("final")
    t = F.when(blank, None).otherwise(((F.col("trip") * 37) % 26) * 3600 + F.col("spent"))
    return rows.select("trip", *IN_TRIP, "stop", "seq", t.cast("double").alias("t"))


def oracle(body: str, *names: str, **extra: str) -> str:
    """body over the named views (and further common table expressions), as one statement for the oracle."""
    wanted: list[str] = []
    for n in names:
        wanted += [x for x in [*NEEDS.get(n, []), n] if x not in wanted]
    ctes = [f"{n} AS ({VIEWS[n].format(dow=DOW['oracle'])})" for n in wanted] + [f"{n} AS ({sql})" for n, sql in extra.items()]
    return f"WITH {', '.join(ctes)} {body}" if ctes else body
