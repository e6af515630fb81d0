"""Bounded least-time search over the multimodal graph, for all origins at once.

search() relaxes any graph by joins. reach() is for many origins: what lies behind an origin's first boarding depends on the
origin only through the stop where it boards, so walks are searched around each origin, rides once from each stop, and both are joined.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import MERCATOR_CIRCUMFERENCE_M, METRES_PER_DEGREE, grid_cell, meters_between
from . import raster
from .graph import ALIGHT, BOARD, RIDE, WALK
from .iterate import Tables

#: Defaults of a query: limits and penalties in seconds, speed in metres a second.
PARAMS = {"limit_s": 2700.0, "speed": 5 / 3.6, "transfer_s": 300.0, "wait_s": 0.0}
#: Origins that share a group, about; pairs of a node and an origin that a task holds at once; rows of a batch that it hands on.
ORIGINS, CELLS, BATCH = 256, 1 << 22, 100_000
#: Rows that a join's side is broadcast with at most; tasks of a search; walks that a task copies to their groups; labels that a task relaxes.
SMALL, TASKS, WALKS, LABELS = 1_000_000, 4000, 250_000, 4096
#: What a row of a group is.
SEED, ROAD, ASK, LEG, POINT = 0, 1, 2, 3, 4
#: Origins whose areas a task paints.
LOT = 16


def priced(edges: DataFrame, params: dict, modes: list[int] | None = None, mode_of: DataFrame | None = None, period: str | None = None) -> DataFrame:
    """Edges with their cost before and after the first boarding: (src, dst, kind, cost0, cost1).

    period: column of ride seconds to use (null: no service). modes: allowed mode groups, by mode_of (route, mode).
    """
    if modes is not None:
        kept = mode_of.filter(F.col("mode").isin(modes)).select("route")
        edges = edges.filter(F.col("kind") != BOARD).unionByName(edges.filter(F.col("kind") == BOARD).join(kept, "route", "left_semi").select(*edges.columns))
    ride = F.col(period) if period else F.col("weight")
    base = F.when(F.col("kind") == WALK, F.col("weight") / params["speed"]).when(F.col("kind") == RIDE, ride).when(F.col("kind") == ALIGHT, 0.0)
    cost0 = F.when(F.col("kind") == BOARD, params["wait_s"]).otherwise(base)
    cost1 = F.when(F.col("kind") == BOARD, params["transfer_s"]).otherwise(base)
    return edges.select("src", "dst", "kind", cost0.alias("cost0"), cost1.alias("cost1")).filter(F.col("cost0").isNotNull())


def relaxed(seeds: DataFrame, edges: DataFrame, limit: float | str) -> DataFrame:
    """Least cost of every (origin, node, boarded) within limit (or each edge's, if it names a column), and the round that found it; seeds: (origin, node, cost), edges: stored.

    Each round relaxes the labels that the round before improved; rounds end when none improves. Seeds above the limit stay, but lead nowhere.
    Rounds keep costs only, as numbers are reduced without sorting; predecessors() has the rest.
    """
    key = ["origin", "node", "boarded"]
    rounds = Tables(seeds.sparkSession)
    labels = rounds.save(seeds.groupBy("origin", "node").agg(F.min("cost").alias("cost")).select("origin", "node", F.lit(0).alias("boarded"), "cost", F.lit(0).alias("round")))
    none, k = F.lit(None), 0
    while many := (front := labels.filter(F.col("round") == k)).count():
        k += 1
        # a table of labels is small, and would be read by one task, but each label has many edges
        step = front.repartition(max(8, -(-many // LABELS)), "node").join(edges.withColumnRenamed("src", "node"), "node")
        cost = F.col("cost") + F.when(F.col("boarded") == 0, F.col("cost0")).otherwise(F.col("cost1"))
        new = step.select("origin", F.col("dst").alias("node"), boarded_after().alias("boarded"), none.cast("double").alias("cost"), none.cast("int").alias("round"), cost.alias("found"), *([limit] if isinstance(limit, str) else [])).filter(F.col("found") <= (F.col(limit) if isinstance(limit, str) else limit)).drop("limit")
        both = labels.withColumn("found", none.cast("double")).unionByName(new).groupBy(*key).agg(F.min("cost").alias("cost"), F.min("round").alias("round"), F.min("found").alias("found"))
        # an equal cost keeps the earlier round's label, so only strict improvements are relaxed again
        better = F.col("cost").isNull() | (F.col("found") < F.col("cost"))
        labels = rounds.save(both.select(*key, F.when(better, F.col("found")).otherwise(F.col("cost")).alias("cost"), F.when(better, k).otherwise(F.col("round")).alias("round")))
        rounds.keep_last(1)
    return labels


def boarded_after():
    return F.when(F.col("kind") == BOARD, 1).otherwise(F.col("boarded"))


def predecessors(labels: DataFrame, edges: DataFrame, states: DataFrame) -> DataFrame:
    """States (origin, node, boarded, cost, round) of labels with their (pred, pred_boarded): a neighbour of an earlier round whose cost and edge add up to their own, the first by name.

    An edge that costs something leads from a lesser cost, so it serves too if its start was improved later by less than a sum can tell; null at a seed.
    """
    before = labels.select("origin", F.col("node").alias("pred"), F.col("boarded").alias("pred_boarded"), F.col("cost").alias("before"), F.col("round").alias("then"))
    into = edges.select(F.col("src").alias("pred"), F.col("dst").alias("node"), "kind", "cost0", "cost1")
    step = states.filter(F.col("round") > 0).join(into, "node").join(before, ["origin", "pred"])
    cost = F.when(F.col("pred_boarded") == 0, F.col("cost0")).otherwise(F.col("cost1"))
    after = F.when(F.col("kind") == BOARD, 1).otherwise(F.col("pred_boarded"))
    fits = (after == F.col("boarded")) & (F.col("before") + cost == F.col("cost")) & ((F.col("then") < F.col("round")) | (F.col("before") < F.col("cost")))
    via = F.min(F.struct((F.col("then") + 1 != F.col("round")).alias("late"), "pred", "pred_boarded")).alias("via")
    found = step.filter(fits).groupBy("origin", "node", "boarded").agg(via)
    key = ["origin", "node", "boarded"]
    return states.join(found, key, "left").select(*states.columns, "via.pred", "via.pred_boarded")


def search(seeds: DataFrame, edges: DataFrame, limit: float) -> DataFrame:
    """Least cost of every (origin, node, boarded) within limit, with a predecessor (pred, pred_boarded); seeds: (origin, node, cost)."""
    tables = Tables(seeds.sparkSession)
    edges = tables.save(edges)
    labels = relaxed(seeds, edges, limit)
    return tables.save(predecessors(labels, edges, labels).drop("round"))


def small(df: DataFrame) -> DataFrame:
    """A stored table as a broadcast side if it has SMALL rows at most; else joins shuffle it."""
    return F.broadcast(df) if df.count() <= SMALL else df


class Field:
    """Least costs from each of some origins (columns) to the nodes of a group, over roads in order of their starts, and the round in which each was found.

    Pairs of a node and an origin are relaxed, so only those that the round before improved are looked at.
    """

    def __init__(self, node: np.ndarray, column: np.ndarray, first: np.ndarray, shape: tuple[int, int], roads: tuple[np.ndarray, np.ndarray, np.ndarray], limit: float):
        self.src, self.dst, self.length = roads
        width = shape[1]
        begin = np.searchsorted(self.src, np.arange(shape[0] + 1))
        cost, self.round = np.full(shape[0] * width, np.inf), np.zeros(shape[0] * width, dtype=np.int32)
        front = node * width + column
        np.minimum.at(cost, front, first)
        front, k = np.unique(front), 0
        while len(front):
            k += 1
            at, who = front // width, front % width
            roads_of = begin[at + 1] - begin[at]
            of = np.repeat(np.arange(len(front)), roads_of)
            road = np.arange(len(of)) + (begin[at] - np.cumsum(roads_of) + roads_of)[of]
            to, through = self.dst[road] * width + who[of], cost[front][of] + self.length[road]
            better = (through <= limit) & (through < cost[to])
            to, through = to[better], through[better]
            np.minimum.at(cost, to, through)
            front = np.unique(to)
            self.round[front] = k
        self.cost, self.round = cost.reshape(shape), self.round.reshape(shape)
        self.into = np.argsort(self.dst, kind="stable")

    def before(self, node: int, origin: int) -> int:
        """The node from which a node got its cost; of equals the first by name. -1 at a seed."""
        if not self.round[node, origin]:
            return -1
        edges = self.into[slice(*np.searchsorted(self.dst, [node, node + 1], sorter=self.into))]
        src = self.src[edges]
        fits = (self.cost[src, origin] + self.length[edges] == self.cost[node, origin]) & (self.round[src, origin] < self.round[node, origin])
        return int(src[fits].min())  # names are in order


def coded(*columns: pa.ChunkedArray) -> tuple[pa.Array, list[np.ndarray]]:
    """The distinct values of some columns in order, and the columns as places among them."""
    whole = pa.chunked_array([c for column in columns for c in column.chunks], type=columns[0].type).combine_chunks().dictionary_encode()
    order = pc.sort_indices(whole.dictionary)
    rank = np.empty(len(order), dtype=np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    return whole.dictionary.take(order), np.split(rank[whole.indices.to_numpy(zero_copy_only=False)], np.cumsum([len(c) for c in columns])[:-1])


class Lot:
    """Seeds, roads and asked ends of the origins that a task searches from, in parts of at most CELLS pairs of a node and an origin."""

    def __init__(self, batches: Iterable[pa.RecordBatch], limit: float):
        rows = pa.Table.from_batches(list(batches))
        self.limit = limit
        seeds, self.roads, asks = (rows.filter(pc.equal(rows["part"], part)) for part in (SEED, ROAD, ASK))
        self.names, (self.node, src, dst, self.end) = coded(seeds["node"], self.roads["node"], self.roads["dst"], asks["node"])
        self.origins, (self.origin, self.asker) = coded(seeds["origin"], asks["origin"])
        self.cost, self.ridden = seeds["cost"].to_numpy(), seeds["ridden"].to_numpy().astype(np.int64)
        self.seeds, order = seeds, np.argsort(src, kind="stable")
        self.by_start = src[order], dst[order], self.roads["cost"].to_numpy()[order]
        # neighbours are searched together: their nodes are the same
        height = np.full(len(self.origins), np.inf)
        np.minimum.at(height, self.origin, seeds["home"].to_numpy())
        self.order = np.argsort(height, kind="stable")

    def parts(self, kinds: int) -> Iterator[tuple[np.ndarray, Field]]:
        """Some origins, and the field of as many columns for their walks (and as many again for their rides, if kinds is 2)."""
        many = max(1, CELLS // (kinds * len(self.names)))
        column = np.empty(len(self.origins), dtype=np.int64)
        for a in range(0, len(self.origins), many):
            some = self.order[a : a + many]
            column[:] = -1
            column[some] = np.arange(len(some))
            mine = np.flatnonzero(column[self.origin] >= 0)
            yield some, Field(self.node[mine], column[self.origin[mine]] + self.ridden[mine] * len(some), self.cost[mine], (len(self.names), kinds * len(some)), self.by_start, self.limit)

    def found(self, only: str | None, ends: str) -> Iterator[pa.RecordBatch]:
        """(origin, node, cost, ridden) of the cheaper of walking and riding; ends: all nodes (whose names start with only), those asked or the farthest."""
        ok = np.ones(len(self.names), dtype=bool) if only is None else pc.starts_with(self.names, only).to_numpy(zero_copy_only=False)
        for some, field in self.parts(2 if self.ridden.any() else 1):
            walk, ride = field.cost[:, : len(some)], field.cost[:, len(some) :]
            ridden = ride < walk if ride.size else np.zeros(walk.shape, dtype=bool)  # walking wins ties
            cost = np.where(ridden, ride, walk) if ride.size else walk
            if ends == "asked":
                column = np.full(len(self.origins), -1)
                column[some] = np.arange(len(some))
                mine = column[self.asker] >= 0
                i, j = self.end[mine], column[self.asker[mine]]
                near = np.isfinite(cost[i, j])
                i, j = i[near], j[near]
            elif ends == "farthest":
                known = np.where(np.isfinite(cost), cost, -np.inf)[::-1]  # of equals the last by name
                i, j = len(known) - 1 - known.argmax(axis=0), np.arange(len(some))
            else:
                i, j = np.nonzero(np.isfinite(cost) & ok[:, None])
            for b in range(0, len(i), BATCH):
                u, v = i[b : b + BATCH], j[b : b + BATCH]
                yield pa.RecordBatch.from_arrays([self.origins.take(some[v]), self.names.take(u), pa.array(cost[u, v]), pa.array(ridden[u, v])], ["origin", "node", "cost", "ridden"])


class Roads:
    """Walks between placed nodes, by tiles as wide as anyone can walk within limit; stored once. edges: priced, places: (node, lon, lat)."""

    def __init__(self, edges: DataFrame, places: DataFrame, limit: float, speed: float):
        tables = Tables(edges.sparkSession)
        self.limit, self.places = limit, places
        walks = edges.filter(F.col("kind") == WALK).select("src", "dst", F.col("cost0").alias("cost"))
        a, b = (places.select(F.col("node").alias(end), F.col("lon").alias(f"lon_{end}"), F.col("lat").alias(f"lat_{end}")) for end in ("src", "dst"))
        walks = tables.save(walks.join(a, "src").join(b, "dst"))
        # an edge may be shorter than the straight line between its ends: then more of them fit in the limit
        straight = meters_between("lon_src", "lat_src", "lon_dst", "lat_dst")
        stretch = walks.agg(F.max(straight / F.greatest(F.col("cost") * speed, F.lit(1.0)))).first()[0] or 1.0
        size = max(limit * speed * max(1.0, stretch), 1.0) / METRES_PER_DEGREE * 2  # of longitude, up to 60 degrees of latitude
        self.tile = lambda lon, lat: [c.alias(n) for c, n in zip(grid_cell(lon, lat, size), ("tx", "ty"), strict=True)]
        self.walks, self.shares = walks.select("*", *self.tile("lon_src", "lat_src")), max(1, -(-walks.count() // WALKS))

    def around(self, tiled: DataFrame, *keys: str) -> DataFrame:
        """The tiles (tx, ty) of each of keys in tiled, and their neighbours."""
        near = F.explode(F.expr("flatten(transform(sequence(-1, 1), i -> transform(sequence(-1, 1), j -> struct(i AS i, j AS j))))"))
        tiles = tiled.select(*keys, "tx", "ty").distinct().withColumn("c", near)
        return tiles.select(*keys, (F.col("tx") + F.col("c.i")).alias("tx"), (F.col("ty") + F.col("c.j")).alias("ty")).distinct()

    def tiled(self, df: DataFrame) -> DataFrame:
        return df.join(self.places.select("node", "lon", "lat", *self.tile("lon", "lat")), "node")

    def near(self, seeds: DataFrame, nodes: DataFrame) -> DataFrame:
        """The seeds from which any of nodes may be in reach."""
        tiles = Tables(seeds.sparkSession).save(self.around(self.tiled(nodes)))
        return self.tiled(seeds).join(small(tiles), ["tx", "ty"], "left_semi").select(*seeds.columns)

    def run(self, seeds: DataFrame, work, schema: str, asks: DataFrame | None = None, lined: bool = False) -> DataFrame:
        """work on the Lot of each group of about ORIGINS origins; seeds: (origin, node, cost) and perhaps ridden, asks: (origin, node).

        Origins are dealt by the tiles of their own seeds. A group has all seeds of its origins and the walks of the tiles around them, so it is bounded
        by what its origins reach, and an origin's rows come out of one task: they needn't be exchanged.
        """
        tables, limit = Tables(seeds.sparkSession), self.limit
        ridden = F.col("ridden") if "ridden" in seeds.columns else F.lit(False)
        at = tables.save(self.tiled(seeds.select("origin", "node", "cost", ridden.alias("ridden"))))
        home = at.groupBy("origin").agg(F.min(F.struct("ridden", "tx", "ty", "lat")).alias("h")).select("origin", F.col("h.tx").alias("hx"), F.col("h.ty").alias("hy"), F.col("h.lat").alias("home"))
        lots = tables.save(home.groupBy("hx", "hy").agg(F.ceil(F.count("*") / ORIGINS).alias("lots")))
        key = ["hx", "hy", "lot"]
        home = tables.save(home.join(small(lots), ["hx", "hy"]).select("origin", "home", "hx", "hy", F.pmod(F.xxhash64("origin"), F.col("lots")).alias("lot")))
        own = at.join(home, "origin")
        tiles = tables.save(self.around(own, *key))
        null = lambda kind: F.lit(None).cast(kind)
        of, ends = seeds.schema["origin"].dataType, ["lon_src", "lat_src", "lon_dst", "lat_dst"] if lined else []
        here = [*(F.col(c).alias(f"{c}_src") for c in ("lon", "lat")), *(null("double").alias(f"{c}_dst") for c in ("lon", "lat"))] if lined else []
        rows = own.select(*key, F.lit(SEED).alias("part"), "origin", "node", null("string").alias("dst"), "cost", "ridden", "home", *here)
        # walks are stored in few files, and a tile's go to many groups; those of tiles that no group asks for stay where they are
        tiles = small(tiles)
        roads = self.walks.join(tiles.select("tx", "ty").distinct(), ["tx", "ty"], "left_semi").repartition(self.shares, "src").join(tiles, ["tx", "ty"])
        rows = rows.unionByName(roads.select(*key, F.lit(ROAD).alias("part"), null(of).alias("origin"), F.col("src").alias("node"), "dst", "cost", null("boolean").alias("ridden"), null("double").alias("home"), *ends))
        if asks is not None:
            none = [null("double").alias(c) for c in ends]
            rows = rows.unionByName(asks.join(home, "origin").select(*key, F.lit(ASK).alias("part"), "origin", "node", null("string").alias("dst"), null("double").alias("cost"), null("boolean").alias("ridden"), "home", *none))

        def search_lot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from work(Lot(batches, limit))

        tasks = min(TASKS, 2 * (lots.agg(F.sum("lots")).first()[0] or 1))  # a number of our own: these tasks aren't merged
        return rows.repartition(tasks, *key).groupBy(*key).applyInArrow(search_lot, schema)

    def costs(self, seeds: DataFrame, only: str | None = None, ends: str = "all", asks: DataFrame | None = None) -> DataFrame:
        """(origin, node, cost, ridden) of every node within limit, of those whose names start with only, of asks (ends: asked), or of the farthest one (ends: farthest)."""
        schema = f"origin {seeds.schema['origin'].dataType.simpleString()}, node string, cost double, ridden boolean"
        return self.run(seeds, lambda lot: lot.found(only, ends), schema, asks)

    def lines(self, asks: DataFrame, seeds: DataFrame) -> DataFrame:
        """The way of each asked walk (origin, node): (origin, node, cost, nodes, lons, lats), from the seed on; seeds of other origins are left out.

        Nothing is stored by the search: a node's predecessor is a neighbour whose cost and edge add up to its own, found within the group that searches.
        """
        asks = Tables(asks.sparkSession).save(asks.select("origin", "node").distinct())
        kind = seeds.schema["origin"].dataType.simpleString()
        schema = f"origin {kind}, node string, cost double, nodes array<string>, lons array<double>, lats array<double>"

        def trace(lot: Lot) -> Iterator[pa.RecordBatch]:
            lon, lat = np.zeros((2, len(lot.names)))
            src, dst = (coded(pa.chunked_array([lot.names]), lot.roads[c])[1][1] for c in ("node", "dst"))
            for place, c in ((lon, "lon"), (lat, "lat")):
                place[src], place[dst] = lot.roads[f"{c}_src"].to_numpy(), lot.roads[f"{c}_dst"].to_numpy()
                place[lot.node] = lot.seeds[f"{c}_src"].to_numpy()
            for some, field in lot.parts(1):
                rows = []
                for j, origin in enumerate(some):
                    for end in lot.end[lot.asker == origin]:
                        if np.isfinite(field.cost[end, j]):
                            way = [int(end)]
                            while (node := field.before(way[-1], j)) >= 0:
                                way.append(node)
                            way = way[::-1]
                            rows.append((lot.origins[origin].as_py(), lot.names[end].as_py(), field.cost[end, j], lot.names.take(way).to_pylist(), lon[way].tolist(), lat[way].tolist()))
                if rows:
                    types = [lot.origins.type, pa.string(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.float64()), pa.list_(pa.float64())]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["origin", "node", "cost", "nodes", "lons", "lats"])

        return self.run(seeds.join(asks.select("origin").distinct(), "origin", "left_semi"), trace, schema, asks, lined=True)


def walking(seeds: DataFrame, edges: DataFrame, places: DataFrame, limit: float, speed: float) -> DataFrame:
    """Least walking cost (origin, node, cost) of every node within limit; seeds: (origin, node, cost), edges: priced, places: (node, lon, lat)."""
    return Roads(edges, places, limit, speed).costs(seeds).drop("ridden")


def walk_lines(asks: DataFrame, seeds: DataFrame, edges: DataFrame, places: DataFrame, limit: float, speed: float) -> DataFrame:
    """The ways of asked walks, as Roads.lines has them."""
    return Roads(edges, places, limit, speed).lines(asks, seeds)


def paths(labels: DataFrame, targets: DataFrame) -> DataFrame:
    """(origin, target, step, node, boarded, cost) back from each (origin, node) of targets, over labels of search(); the cheaper state, unboarded on ties."""
    tables = Tables(labels.sparkSession)
    state = labels.groupBy("origin", "node").agg(F.min(F.struct("cost", "boarded")).alias("s"))
    at = targets.join(state, ["origin", "node"]).select("origin", F.col("node").alias("target"), "node", F.col("s.boarded").alias("boarded"))
    found, k = [], 0
    while True:
        at = tables.save(at.join(labels, ["origin", "node", "boarded"]).withColumn("step", F.lit(k)))
        found.append(at.select("origin", "target", "step", "node", "boarded", "cost"))
        if at.isEmpty():
            break
        at = at.filter(F.col("pred").isNotNull()).select("origin", "target", F.col("pred").alias("node"), F.col("pred_boarded").alias("boarded"))
        k += 1
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def arrivals(first: DataFrame, legs: DataFrame, limit: float) -> DataFrame:
    """(origin, alight, cost, board): the earliest arrival by rides at each stop; first: (origin, board, walk), legs: (board, alight, ride)."""
    total = F.col("walk") + F.col("ride")
    arrived = first.join(small(legs), "board").filter(total <= limit).groupBy("origin", "alight").agg(F.min(F.struct(total.alias("cost"), "board")).alias("m"))
    return arrived.select("origin", "alight", "m.cost", "m.board")


class Reach:
    """Least costs within limit from all origins. best has (origin, node, cost, ridden) of streets and stops, the cheaper of walking and riding.

    seeds: (origin, node, cost), edges: priced, places: (node, lon, lat) of streets and stops.
    Every ride is walk to a stop, rides and walks between stops, and walk from the last stop; the three parts are exact, and so is their least sum.
    First walks are stored to stops only. The last walk is one search from all stops where an origin arrives, with its arrival times as first costs,
    in the task that also walks from the origin itself; so rows of (origin, node) are neither exchanged nor stored.
    """

    def __init__(self, seeds: DataFrame, edges: DataFrame, places: DataFrame, limit: float, speed: float):
        tables = Tables(seeds.sparkSession)
        self.seeds, self.limit, self.speed = tables.save(seeds.select("origin", "node", "cost")), limit, speed
        edges, self.places = tables.save(edges), tables.save(places)
        self.roads = Roads(edges, self.places, limit, speed)
        stops = self.places.filter(F.col("node").startswith("p")).select("node")
        self.stop_seeds = stops.select(F.col("node").alias("origin"), "node", F.lit(0.0).alias("cost"))
        self.from_stop = tables.save(self.roads.costs(self.stop_seeds).select(F.col("origin").alias("stop"), "node", "cost"))
        between = self.from_stop.filter(F.col("node").startswith("p") & (F.col("stop") != F.col("node"))).select(F.col("stop").alias("src"), F.col("node").alias("dst"), F.lit(WALK).alias("kind"), F.col("cost").alias("cost0"), F.col("cost").alias("cost1"))
        self.hubs = tables.save(edges.filter(F.col("kind") != WALK).unionByName(between))
        self.first = tables.save(self.roads.costs(self.roads.near(self.seeds, stops), only="p").filter(F.col("cost") <= limit).select("origin", F.col("node").alias("board"), F.col("cost").alias("walk")))
        used = self.first.select(F.col("board").alias("origin"), F.col("board").alias("node")).distinct().withColumn("cost", F.lit(0.0))
        self.rides = relaxed(used, self.hubs, limit)
        legs = self.rides.filter(F.col("node").startswith("p") & (F.col("boarded") == 1)).select(F.col("origin").alias("board"), F.col("node").alias("alight"), F.col("cost").alias("ride"))
        self.arrived = tables.save(arrivals(self.first, legs, limit))
        rides = self.arrived.select("origin", F.col("alight").alias("node"), "cost", F.lit(True).alias("ridden"))
        self.starts = self.seeds.withColumn("ridden", F.lit(False)).unionByName(rides)

    @property
    def best(self) -> DataFrame:
        return self.roads.costs(self.starts)

    def farthest(self) -> DataFrame:
        """(origin, node, cost, ridden): where each origin's cost is greatest, the last by name of equals."""
        return self.roads.costs(self.starts, ends="farthest")

    def costs_of(self, targets: DataFrame) -> DataFrame:
        """(origin, node, cost, ridden) of those of targets (origin, node) that are reached; only their origins are searched from."""
        asks = Tables(targets.sparkSession).save(targets.select("origin", "node").distinct())
        return self.roads.costs(self.starts.join(asks.select("origin").distinct(), "origin", "left_semi"), ends="asked", asks=asks)

    def ends(self, targets: DataFrame) -> DataFrame:
        """(origin, node, cost, alight, board, ride_cost) of targets (origin, node; cost and ridden, where known): where the last ride ends and the first begins, null for mere walks."""
        known = targets.select("origin", "node", "cost", "ridden") if "ridden" in targets.columns else self.costs_of(targets)
        known = Tables(targets.sparkSession).save(known)
        last = known.filter("ridden").select("origin", "node").join(self.arrived.withColumnRenamed("cost", "ride_cost"), "origin")
        last = last.join(self.from_stop.select(F.col("stop").alias("alight"), "node", F.col("cost").alias("last")), ["alight", "node"])
        via = last.groupBy("origin", "node").agg(F.min(F.struct((F.col("ride_cost") + F.col("last")).alias("sum"), "alight", "board", "ride_cost")).alias("m"))
        return known.drop("ridden").join(via.select("origin", "node", "m.alight", "m.board", "m.ride_cost"), ["origin", "node"], "left")

    def paths(self, targets: DataFrame) -> DataFrame:
        """(origin, target, step, node, boarded, cost) back from each (origin, node) of targets, by the stops and route nodes passed; a walk is one step."""
        tables = Tables(targets.sparkSession)
        ends = tables.save(self.ends(targets))
        starts = self.first.withColumnRenamed("walk", "offset")
        chain = ends.filter(F.col("alight").isNotNull()).select("origin", F.col("node").alias("target"), "board", F.col("alight").alias("node"), F.lit(1).alias("boarded"))
        chain = chain.join(starts, ["origin", "board"])
        row = lambda df, step, boarded: df.select("origin", "target", step.cast("int").alias("step"), "node", boarded.cast("int").alias("boarded"), "cost")
        out = [row(ends.withColumn("target", F.col("node")), F.lit(0), F.when(F.col("alight").isNull(), 0).otherwise(1))]
        k = 1
        while True:
            here = self.rides.join(chain.select(F.col("board").alias("origin"), "node", "boarded").distinct(), ["origin", "node", "boarded"], "left_semi")
            rides = predecessors(self.rides, self.hubs, here).withColumnRenamed("origin", "board").drop("round")
            chain = tables.save(chain.join(rides, ["board", "node", "boarded"]))
            if chain.isEmpty():
                break
            # a stop that is the target itself has the walk's step already
            out.append(row(chain.filter((F.col("node") != F.col("target")) | F.lit(k > 1)).withColumn("cost", F.col("cost") + F.col("offset")), F.lit(k), F.col("boarded")))
            chain = chain.filter(F.col("pred").isNotNull()).select("origin", "target", "board", "offset", F.col("pred").alias("node"), F.col("pred_boarded").alias("boarded"))
            k += 1
        start = ends.select("origin", F.col("node").alias("target"), F.lit(k).alias("step"), F.lit("").alias("node"), F.lit(0).alias("boarded"), F.lit(0.0).alias("cost"))
        found = out[0]
        for more in [*out[1:], start]:
            found = found.unionByName(more)
        return found


def best(labels: DataFrame) -> DataFrame:
    """Least cost of each (origin, node) over both boarding states."""
    return labels.groupBy("origin", "node").agg(F.min("cost").alias("cost"))


def destinations(reached: DataFrame, asked: DataFrame, near: DataFrame, goal: str, radius: float, limit: float, speed: float) -> DataFrame:
    """Where each asked (origin, goal) ends: the near node (goal, node, d) that is reached and gives the earliest arrival, or the nearest one if no walk from there meets the limit."""
    ends = asked.join(near.filter(F.col("d") <= radius), goal).join(reached, ["origin", "node"])
    ends = ends.withColumn("total", F.col("cost") + F.col("d") / speed)
    quick, close = F.min(F.struct("total", "node", "d")).alias("q"), F.min(F.struct("d", "node", "cost")).alias("c")
    late = F.col("q.total") > limit
    return ends.groupBy("origin", goal).agg(quick, close).select(
        "origin", goal, F.when(late, F.col("c.node")).otherwise(F.col("q.node")).alias("node"), F.when(late, F.col("c.cost")).otherwise(F.col("q.total")).alias("seconds"),
        F.when(late, 0.0).otherwise(F.col("q.d")).alias("walk_m"), late.alias("snapped"),
    )


def legs(path: DataFrame) -> DataFrame:
    """Legs of paths: runs of steps on one route or on foot, with their seconds, board penalty and stops passed; very short ones drop out."""
    from pyspark.sql import Window as W

    w = W.partitionBy("origin", "target").orderBy(F.desc("step"))
    ride = F.col("node").startswith("r")
    line = F.when(ride, F.split("node", ":")[0])
    rows = path.withColumns({"line": line, "before": F.lag("cost").over(w), "line_before": F.lag(line).over(w), "first": F.lag("cost").over(w).isNull()})
    turn = (F.col("first") | ~F.col("line").eqNullSafe(F.col("line_before"))).cast("int")
    rows = rows.withColumn("leg", F.sum(turn).over(w.rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.withColumn("spent", F.coalesce(F.col("cost") - F.col("before"), F.col("cost")))
    board = ride & F.col("line_before").isNull()
    out = rows.groupBy("origin", "target", "leg").agg(
        F.first("line", ignorenulls=True).alias("line"), F.sum(F.when(~board, F.col("spent"))).alias("seconds"), F.sum(F.when(board, F.col("spent"))).alias("penalty"), F.count("*").alias("nodes")
    )
    return out.filter((F.coalesce("seconds", F.lit(0.0)) >= 0.5) | (F.coalesce("penalty", F.lit(0.0)) > 0))


class Network:
    """A graph that is searched again and again from a few origins, under named settings: its walks and the rides between all stops are stored once.

    edges: (src, dst, kind, weight, route and the periods' columns), places: (node, lon, lat) of streets and stops; settings: name -> limit_s, speed, transfer_s, wait_s,
    modes (of mode_of) and period. No search begins farther than metres from centres (lon, lat), so walks that no one comes to are left out.
    """

    def __init__(self, edges: DataFrame, places: DataFrame, settings: dict[str, dict], mode_of: DataFrame, centres: DataFrame, metres: float):
        tables, self.settings = Tables(edges.sparkSession), settings
        edges, self.limit_of = tables.save(edges), {}
        for own in settings.values():
            self.limit_of[own["speed"]] = max(own["limit_s"], self.limit_of.get(own["speed"], 0.0))
        stop = F.col("node").startswith("p")
        walks = edges.filter(F.col("kind") == WALK)
        a, b = (places.select(F.col("node").alias(end), F.col("lon").alias(f"lon_{end}"), F.col("lat").alias(f"lat_{end}")) for end in ("src", "dst"))
        straight = meters_between("lon_src", "lat_src", "lon_dst", "lat_dst") / F.greatest(F.col("weight"), F.lit(1.0))
        stretch = walks.join(a, "src").join(b, "dst").agg(F.max(straight)).first()[0] or 1.0
        far = metres + max(1.0, stretch) * max(speed * limit for speed, limit in self.limit_of.items())
        sides = [f(c).alias(f"{f.__name__}_{c}") for c in ("lon", "lat") for f in (F.min, F.max)]
        box = centres.select("lon", "lat").unionByName(places.filter(stop).select("lon", "lat")).agg(*sides).first()
        north = far / METRES_PER_DEGREE
        top = min(89.0, max(abs(box.min_lat), abs(box.max_lat)) + north) if box.min_lat is not None else 0.0
        east = north / math.cos(math.radians(top))
        inside = lambda c, by: F.col(c).between((box[f"min_{c}"] or 0.0) - by, (box[f"max_{c}"] or 0.0) + by)
        self.places = tables.save(places.filter(inside("lon", east) & inside("lat", north)))
        self.held = F.broadcast if self.places.count() <= SMALL else lambda df: df  # as small() has it, asked once
        here = lambda end: self.held(self.places.select(F.col("node").alias(end)))
        walks = tables.save(walks.join(here("src"), "src", "left_semi").join(here("dst"), "dst", "left_semi"))
        self.stops = self.places.filter(stop).select("node")
        seeds = self.stops.select(F.col("node").alias("origin"), "node", F.lit(0.0).alias("cost"))
        self.roads, between = {}, {}
        for speed, limit in self.limit_of.items():
            self.roads[speed] = roads = Roads(priced(walks, {"speed": speed, "wait_s": 0.0, "transfer_s": 0.0}), self.places, limit, speed)
            apart = roads.costs(seeds, only="p").filter(F.col("origin") != F.col("node"))
            between[speed] = tables.save(apart.select(F.col("origin").alias("src"), F.col("node").alias("dst"), F.lit(WALK).alias("kind"), F.col("cost").alias("cost0"), F.col("cost").alias("cost1")))
        # rides under all settings are searched at once: a node's name begins with its setting's
        tagged = lambda name, c: F.concat(F.lit(f"{name}|"), c)
        hubs = [
            rides.unionByName(between[own["speed"]]).withColumns({c: tagged(name, c) for c in ("src", "dst")}).withColumn("limit", F.lit(own["limit_s"]))
            for name, own in settings.items()
            for rides in [priced(edges.filter(F.col("kind") != WALK), own, own["modes"], mode_of, own["period"])]
        ]
        starts = [self.stops.select(tagged(name, "node").alias("origin"), tagged(name, "node").alias("node"), F.lit(0.0).alias("cost")) for name in settings]
        labels = relaxed(reduce(DataFrame.unionByName, starts), tables.save(reduce(DataFrame.unionByName, hubs)), "limit")
        parts = {"board": F.substring_index("origin", "|", -1), "alight": F.substring_index("node", "|", -1)}
        rides = labels.filter(F.substring_index("node", "|", -1).startswith("p") & (F.col("boarded") == 1))
        self.legs = tables.save(rides.select(F.substring_index("node", "|", 1).alias("setting"), *(c.alias(n) for n, c in parts.items()), F.col("cost").alias("ride")))

    def areas(self, points: DataFrame, near: DataFrame, setting: str, many: int) -> DataFrame:
        """(origin, km2) that each of points (origin, lat) reaches within the setting's limit, 0 where that is nothing; near: (origin, node, d), the streets where its search begins.
        many: how many points there are, about.

        Origins are numbers, those of neighbours near each other: LOT of them in a row are searched and painted together, in a task that has the walks around their streets, and
        around all stops where rides from near there end. So only the areas come out of it.
        """
        own, lot = self.settings[setting], F.floor(F.col("origin") / LOT).alias("lot")
        limit, speed, roads = own["limit_s"], own["speed"], self.roads[own["speed"]]
        tables = Tables(near.sparkSession)
        places = self.places.select("node", "lon", "lat", *roads.tile("lon", "lat"))
        seeds = tables.save(near.select(lot, "origin", "node", (F.col("d") / speed).alias("cost")).join(self.held(places), "node"))
        walked = roads.around(seeds, "lot")
        boards = F.broadcast(walked).join(places.filter(F.col("node").startswith("p")), ["tx", "ty"]).select("lot", F.col("node").alias("board"))
        legs = tables.save(boards.join(self.legs.filter((F.col("setting") == setting) & (F.col("ride") <= limit)), "board").select("lot", "board", "alight", "ride"))
        ends = roads.around(legs.select("lot", F.col("alight").alias("node")).distinct().join(places, "node"), "lot")
        tiles = walked.unionByName(ends).distinct()  # a few for each lot
        none = lambda **kinds: [F.lit(None).cast(kind).alias(c) for c, kind in kinds.items()]
        ends_at = [F.lit(None).cast("double").alias(f"{c}_dst") for c in ("lon", "lat")]
        rows = seeds.select("lot", F.lit(SEED).alias("part"), "origin", "node", *none(dst="string"), "cost", F.col("lon").alias("lon_src"), F.col("lat").alias("lat_src"), *ends_at)
        walks = roads.walks.join(F.broadcast(tiles), ["tx", "ty"])
        rows = rows.unionByName(walks.select("lot", F.lit(ROAD).alias("part"), *none(origin="long"), F.col("src").alias("node"), "dst", "cost", "lon_src", "lat_src", "lon_dst", "lat_dst"))
        rows = rows.unionByName(legs.select("lot", F.lit(LEG).alias("part"), *none(origin="long"), F.col("board").alias("node"), F.col("alight").alias("dst"), F.col("ride").alias("cost"), *none(lon_src="double", lat_src="double"), *ends_at))
        rows = rows.unionByName(points.select(lot, F.lit(POINT).alias("part"), F.col("origin").cast("long").alias("origin"), *none(node="string", dst="string", cost="double", lon_src="double"), F.col("lat").alias("lat_src"), *ends_at))

        def paint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(list(batches))
            seeds, roads, legs, points = (rows.filter(pc.equal(rows["part"], part)) for part in (SEED, ROAD, LEG, POINT))
            names, (node, src, dst, board, alight) = coded(seeds["node"], roads["node"], roads["dst"], legs["node"], legs["dst"])
            origins, (origin, point) = coded(seeds["origin"], points["origin"])
            x, y, lat = np.full((3, max(len(names), len(origins))), np.nan)
            for at, table, end in ((src, roads, "src"), (dst, roads, "dst"), (node, seeds, "src")):
                x[at] = (table[f"lon_{end}"].to_numpy() + 180) / 360
                y[at] = 0.5 - np.log(np.tan(np.pi / 4 + np.radians(table[f"lat_{end}"].to_numpy()) / 2)) / (2 * np.pi)
            lat[point] = points["lat_src"].to_numpy()
            order, ride, cost = np.argsort(src, kind="stable"), legs["cost"].to_numpy(), seeds["cost"].to_numpy()
            by_start = src[order], dst[order], roads["cost"].to_numpy()[order]
            placed, many, out = np.isfinite(x[: len(names)]), max(1, CELLS // max(1, len(names))), []
            for a in range(0, len(origins), many):
                shape = (len(names), min(many, len(origins) - a))
                mine = np.flatnonzero((origin >= a) & (origin < a + many))
                walk = Field(node[mine], origin[mine] - a, cost[mine], shape, by_start, limit).cost
                arrived = np.full(shape, np.inf)
                np.minimum.at(arrived, alight, np.where(walk[board] <= limit, walk[board], np.inf) + ride[:, None])
                stop, who = np.nonzero(arrived <= limit)
                best = np.minimum(walk, Field(stop, who, arrived[stop, who], shape, by_start, limit).cost)
                for j in range(shape[1]):
                    here = np.flatnonzero((best[:, j] <= limit) & placed)
                    if len(here):
                        out.append((a + j, math.cos(math.radians(lat[a + j])) * MERCATOR_CIRCUMFERENCE_M, x[here], y[here], best[here, j]))
            km2 = np.zeros(len(origins))
            for k, area, *_ in raster.swept_areas(out, speed, limit):
                km2[k] = area
            yield pa.RecordBatch.from_arrays([pa.array(origins.to_numpy(zero_copy_only=False), pa.int64()), pa.array(km2)], ["origin", "km2"])

        return rows.repartition(min(TASKS, 2 * -(-many // LOT)), "lot").groupBy("lot").applyInArrow(paint, "origin long, km2 double")
