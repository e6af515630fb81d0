"""Readers of schedule folders, ways, places and documents of settings; writers that merge."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.streets import valid_refs, walkable

#: Columns that a schedule table must have; further ones are read as they come.
REQUIRED = {
    "agency": ["agency_name"], "routes": ["route_id", "route_type"], "trips": ["route_id", "trip_id", "service_id"],
    "stops": ["stop_id", "stop_lon", "stop_lat"], "stop_times": ["trip_id", "arrival_time", "departure_time", "stop_id", "stop_sequence"],
}


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame | None:
    """One CSV table of strings: header names are stripped, only empty text is null; None if the feed hasn't it."""
    from pyspark.errors import AnalysisException

    try:
        df = spark.read.csv(f"{folder}/{name}.txt", header=True, inferSchema=False, nullValue="", nanValue="\x00", ignoreLeadingWhiteSpace=True, encoding="UTF-8")
    except AnalysisException:
        return None
    df = df.toDF(*(c.strip().lstrip("﻿") for c in df.columns))
    missing = set(REQUIRED.get(name, [])) - set(df.columns)
    if missing:
        raise ValueError(f"{folder}/{name}.txt has no {sorted(missing)}")
    return df


def read_feeds(spark: SparkSession, folders: dict[str, str], name: str, keys: tuple[str, ...]) -> DataFrame | None:
    """The same table of several feeds, with a column feed; the key columns get the feed's name before them."""
    out = None
    for feed, folder in sorted(folders.items()):
        df = read_table(spark, folder, name)
        if df is None:
            continue
        df = df.withColumns({"feed": F.lit(feed), **{k: F.concat_ws(":", F.lit(feed), F.trim(k)) for k in keys}})
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


#: Columns that a feed's tables are read with; others stay unread.
USED = {
    "agency": ["agency_id", "agency_name"], "routes": ["route_id", "agency_id", "route_type", "route_short_name", "route_long_name", "route_color"],
    "trips": ["route_id", "trip_id", "service_id", "shape_id"], "calendar": ["service_id", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"],
    "calendar_dates": ["service_id", "date", "exception_type"], "stops": ["stop_id", "stop_lon", "stop_lat", "stop_name"],
    "stop_times": ["trip_id", "arrival_time", "departure_time", "stop_id", "stop_sequence"], "shapes": ["shape_id", "shape_pt_sequence", "shape_pt_lon", "shape_pt_lat"],
}


def load_feed(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables that a feed has, with the columns that are used."""
    found = {name: read_table(spark, folder, name) for name in USED}
    return {name: df.select(*(c for c in USED[name] if c in df.columns)) for name, df in found.items() if df is not None}


def archives(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the zipped feeds at a path (a glob); Spark reads them, so they may lie in any store."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def opened(content: bytes, name: str):
    """The first member called `name`.txt in any folder, as text without a byte-order mark; None if there is none."""
    archive = zipfile.ZipFile(io.BytesIO(content))
    member = next((m for m in archive.namelist() if m.rsplit("/", 1)[-1] == f"{name}.txt"), None)
    return member and io.TextIOWrapper(archive.open(member), encoding="utf-8-sig", newline="")


def unzipped(found: DataFrame, name: str, columns: list[str] | None = None) -> DataFrame | None:
    """One table out of archives (path, content): feed (the archive's name) and the asked columns, as strings; None if no archive has it.

    Only the asked columns leave the task that reads an archive, in batches of rows. Quoted fields may hold commas and line ends; names in headers are stripped;
    only empty fields are null; a column that an archive hasn't is null; stop times without one of their columns are an error.
    """
    columns = columns or USED[name]

    @F.udf("boolean")
    def there(content):
        return opened(content, name) is not None

    if found.filter(there("content")).isEmpty():
        return None

    def rows(parts):
        for pdf in parts:
            for where, content in zip(pdf["path"], pdf["content"], strict=True):
                text = opened(content, name)
                if text is None:
                    continue
                feed, needed = where.rsplit("/", 1)[-1].removesuffix(".zip"), set(REQUIRED[name] if name == "stop_times" else ())
                for chunk in pd.read_csv(text, dtype=str, skipinitialspace=True, keep_default_na=False, na_values=[""], usecols=lambda c: c.strip() in {*columns, *needed}, chunksize=10_000):
                    chunk.columns = [c.strip() for c in chunk.columns]
                    if needed - set(chunk.columns):
                        raise ValueError(f"{where}: {name}.txt has no {sorted(needed - set(chunk.columns))}")
                    yield chunk.reindex(columns=columns).astype(object).where(lambda x: x.notna(), None).assign(feed=feed)[["feed", *columns]]

    return found.mapInPandas(rows, ", ".join(f"`{c}` string" for c in ["feed", *columns]))


def read_zipped(spark: SparkSession, path: str, name: str, columns: list[str] | None = None) -> DataFrame | None:
    return unzipped(archives(spark, path), name, columns)


def load_zipped(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """All tables that the zipped feeds at a path have, with the columns that are used."""
    found = {name: read_zipped(spark, path, name) for name in USED}
    return {name: df for name, df in found.items() if df is not None}


def read_ways(spark: SparkSession, path: str, bbox: tuple[float, float, float, float]) -> DataFrame:
    """Points (way, ord, node, lon, lat, highway, ...) of the walkable ways that begin in the box, whole; the tag filter reaches the Parquet scan."""
    return valid_refs(spark.read.parquet(path).filter(F.col("highway").isNotNull()).filter(walkable()), bbox)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def itinerary_geojson(legs: DataFrame) -> DataFrame:
    """A line feature for each leg with xs and ys."""
    points = F.arrays_zip("xs", "ys")
    line = F.struct(F.lit("LineString").alias("type"), F.transform(points, lambda p: F.array(p["xs"], p["ys"])).alias("coordinates"))
    props = F.struct(*(c for c in legs.columns if c not in ("xs", "ys")))
    return legs.select(F.to_json(F.struct(F.lit("Feature").alias("type"), line.alias("geometry"), props.alias("properties"))).alias("feature"))


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """The graph as two Parquet tables, each clustered by its first column."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.sortWithinPartitions("src", "dst").write.mode("overwrite").parquet(f"{path}/edges")


#: Parts of a table of shapes; a lookup reads the parts of its keys.
PARTS = 64
SHAPE_KEY = ("route", "from_stop", "to_stop")


def part_of(*key, parts: int = PARTS):
    return F.pmod(F.xxhash64(*(k.cast("long") for k in key)), F.lit(parts)).cast("int")


def write_shapes(shapes: DataFrame, path: str, parts: int = PARTS) -> None:
    """Shapes of hops (route, from_stop, to_stop, ...) by parts of their key's hash, each sorted by key."""
    keyed = shapes.withColumn("part", part_of(*map(F.col, SHAPE_KEY), parts=parts))
    keyed.repartition("part").sortWithinPartitions("part", *SHAPE_KEY).write.mode("overwrite").partitionBy("part").parquet(path)


def shape_of(spark: SparkSession, path: str, route: int, from_stop: int, to_stop: int, parts: int = PARTS) -> DataFrame:
    """The shape of one hop: one part is read, and within it only the row groups that may hold the key."""
    key = dict(zip(SHAPE_KEY, map(F.lit, (route, from_stop, to_stop)), strict=True))
    found = spark.read.parquet(path).filter(F.col("part") == part_of(*key.values(), parts=parts))
    for name, value in key.items():
        found = found.filter(F.col(name) == value)
    return found.drop("part")


def shapes_of(spark: SparkSession, path: str, hops: DataFrame, parts: int = PARTS) -> DataFrame:
    """The shapes of hops (route, from_stop, to_stop), joined by part and key; where the hops are few, only their parts are read."""
    asked = hops.select(*SHAPE_KEY).withColumn("part", part_of(*map(F.col, SHAPE_KEY), parts=parts))
    return spark.read.parquet(path).join(asked, ["part", *SHAPE_KEY]).drop("part")
