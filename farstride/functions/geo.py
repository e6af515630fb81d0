"""Column builders for points on the earth: distances, projections, tiles, containment, Hilbert order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the data model.
EARTH_RADIUS_M = 6_371_008.8
METRES_PER_DEGREE = 111_195.0
MERCATOR_CIRCUMFERENCE_M = 40_075_016.686
SERVICE_AREA = [
    (-123.60, 38.78), (-123.00, 38.87), (-122.62, 38.67), (-122.10, 38.70), (-121.95, 38.55), (-121.60, 38.33),
    (-121.56, 38.10), (-121.55, 37.54), (-121.40, 37.40), (-121.21, 36.95), (-121.50, 36.89), (-121.85, 37.05),
    (-122.15, 37.25), (-122.30, 37.10), (-122.60, 37.10), (-122.75, 37.60), (-123.20, 38.00), (-123.75, 38.80),
]


def col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def haversine(lon1, lat1, lon2, lat2) -> Column:
    lon1, lat1, lon2, lat2 = (F.radians(col(x)) for x in (lon1, lat1, lon2, lat2))
    half = lambda x: F.sin(x / 2) * F.sin(x / 2)
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(half(lat2 - lat1) + F.cos(lat1) * F.cos(lat2) * half(lon2 - lon1)))


def meters_between(lon1, lat1, lon2, lat2) -> Column:
    """Flat distance about the mean latitude."""
    lon1, lat1, lon2, lat2 = (col(x) for x in (lon1, lat1, lon2, lat2))
    dx = (lon2 - lon1) * METRES_PER_DEGREE * F.cos(F.radians((lat1 + lat2) / 2))
    dy = (lat2 - lat1) * METRES_PER_DEGREE
    return F.sqrt(dx * dx + dy * dy)


def meters_from(lon1, lat1, lon2, lat2) -> Column:
    """Flat distance about the first point's latitude."""
    lon1, lat1, lon2, lat2 = (col(x) for x in (lon1, lat1, lon2, lat2))
    dx, dy = (lon2 - lon1) * METRES_PER_DEGREE * F.cos(F.radians(lat1)), (lat2 - lat1) * METRES_PER_DEGREE
    return F.sqrt(dx * dx + dy * dy)


def local_meters(lon, lat, lat0) -> tuple[Column, Column]:
    """Equirectangular x, y about a latitude."""
    k = EARTH_RADIUS_M * 3.141592653589793 / 180
    return col(lon) * k * F.cos(F.radians(col(lat0))), col(lat) * k


def mercator_x(lon) -> Column:
    return (col(lon) + 180) / 360


def mercator_y(lat) -> Column:
    return 0.5 - F.ln(F.tan(F.lit(0.7853981633974483) + F.radians(col(lat)) / 2)) / 6.283185307179586


def mercator_lon(x) -> Column:
    return col(x) * 360 - 180


def mercator_lat(y) -> Column:
    return F.degrees(F.atan(F.sinh(3.141592653589793 * (1 - 2 * col(y)))))


def meters_per_mercator_unit(lat) -> Column:
    return F.cos(F.radians(col(lat))) * MERCATOR_CIRCUMFERENCE_M


def offset_point(lon, lat, dx, dy) -> tuple[Column, Column]:
    """A point dx metres east and dy metres north."""
    return col(lon) + col(dx) / (METRES_PER_DEGREE * F.cos(F.radians(col(lat)))), col(lat) + col(dy) / METRES_PER_DEGREE


def circle(lon, lat, radius: float, steps: int = 64) -> Column:
    """Points x, y of a closed ring of `steps` sides around a point, from the east on."""
    angle = lambda i: i.cast("double") / steps * 6.283185307179586
    east, north = (lambda i: offset_point(lon, lat, radius * F.cos(angle(i)), 0.0)[0]), (lambda i: offset_point(lon, lat, 0.0, radius * F.sin(angle(i)))[1])
    return F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: F.struct(east(i).alias("x"), north(i).alias("y")))


def from_segment(x, y, x1: float, y1: float, x2: float, y2: float) -> Column:
    """Distance from the nearest point of a segment."""
    x, y, dx, dy = col(x), col(y), x2 - x1, y2 - y1
    size = dx * dx + dy * dy
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((x - x1) * dx + (y - y1) * dy) / size)) if size else F.lit(0.0)
    return F.sqrt(F.pow(x - x1 - t * dx, 2) + F.pow(y - y1 - t * dy, 2))


def tile(lon, lat, zoom: int = 14) -> tuple[Column, Column]:
    """Fractional tile coordinates; their floors name the tile."""
    n = float(1 << zoom)
    r = F.radians(col(lat))
    return (col(lon) + 180) / 360 * n, (1 - F.ln(F.tan(r) + 1 / F.cos(r)) / 3.141592653589793) / 2 * n


def grid_cell(lon, lat, size: float) -> tuple[Column, Column]:
    return F.floor(col(lon) / size), F.floor(col(lat) / size)


def in_polygon(lon, lat, ring: list[tuple[float, float]]) -> Column:
    """Even-odd containment in a constant ring, with its bounding box first. Horizontal edges are never crossed."""
    lon, lat = col(lon), col(lat)
    odd = F.lit(False)
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
        if y1 != y2:
            crosses = (F.lit(y1) > lat) != (F.lit(y2) > lat)
            odd = odd != (crosses & (lon < x1 + (lat - y1) * (x2 - x1) / (y2 - y1)))
    xs, ys = zip(*ring, strict=True)
    return lon.between(min(xs), max(xs)) & lat.between(min(ys), max(ys)) & odd


def in_rings(x, y, edges: str) -> Column:
    """Even-odd containment over all edges (array of x1, y1, x2, y2) of a row's rings."""

    def crossed(odd, e):
        hit = (e["y1"] > col(y)) != (e["y2"] > col(y))
        at = F.when(e["y1"] != e["y2"], e["x1"] + (col(y) - e["y1"]) * (e["x2"] - e["x1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)))
        return F.when(hit & (col(x) < at), ~odd).otherwise(odd)

    return F.aggregate(edges, F.lit(False), crossed)


def hilbert(x: Column, y: Column, bits: int = 16) -> Column:
    """Distance along the Hilbert curve of integer coordinates, one quadrant for each bit."""
    place = F.lit(0).cast("long")
    x, y = x.cast("long"), y.cast("long")
    state = F.struct(x.alias("x"), y.alias("y"), place.alias("d"))
    top = 1 << (bits - 1)

    def step(s, b):
        side = F.call_function("shiftright", F.lit(top), b).cast("long")
        rx = F.when(s["x"].bitwiseAND(side) > 0, 1).otherwise(0).cast("long")
        ry = F.when(s["y"].bitwiseAND(side) > 0, 1).otherwise(0).cast("long")
        d = s["d"] + side * side * (3 * rx).bitwiseXOR(ry)
        full = (1 << bits) - 1
        fx = F.when((ry == 0) & (rx == 1), full - s["x"]).otherwise(s["x"])
        fy = F.when((ry == 0) & (rx == 1), full - s["y"]).otherwise(s["y"])
        return F.struct(F.when(ry == 0, fy).otherwise(fx).alias("x"), F.when(ry == 0, fx).otherwise(fy).alias("y"), d.alias("d"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(bits - 1)), state, step)["d"]
