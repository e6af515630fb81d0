"""Geometry of hops: stops are located along a trip's shape, and the shape is cut between them.

Both rules are applied to many lines side by side: the k-th stop of all patterns is located at once, and all lines are simplified level by level.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values, in metres: slack for an earlier segment, and the tolerance of simplification.
SNAP_SLACK, TOLERANCE = 30.0, 3.0
#: Stops of patterns that a task cuts at once, about; tasks that cut.
ROWS, TASKS = 50_000, 4000


def heads(sizes: np.ndarray) -> np.ndarray:
    """Where each of consecutive runs of these sizes starts."""
    return np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)


def kept(points: np.ndarray, sizes: np.ndarray, tolerance: float = TOLERANCE) -> np.ndarray:
    """Which vertices of consecutive lines (of these sizes, two at least) stay: a stretch whose farthest vertex is over the tolerance from its chord is parted there.

    A level looks at every open stretch of every line; those that are parted make the next level.
    """
    begin = heads(sizes)
    keep = np.zeros(len(points), dtype=bool)
    keep[begin] = keep[begin + sizes - 1] = True
    left, right = begin, begin + sizes - 1
    while True:
        wide = right - left > 1
        left, right = left[wide], right[wide]
        if not len(left):
            return keep
        inner = right - left - 1
        of = np.repeat(np.arange(len(left)), inner)
        at = np.arange(inner.sum()) - np.repeat(heads(inner), inner) + left[of] + 1
        chord = points[right] - points[left]
        length = np.sqrt((chord * chord).sum(axis=1, keepdims=True))
        along = np.divide(chord, length, out=np.zeros_like(chord), where=length > 0)[of]  # nothing runs along a chord without length
        off = points[at] - points[left][of]
        gap = np.sqrt(np.square(off - (off * along).sum(axis=1, keepdims=True) * along).sum(axis=1))
        most = np.maximum.reduceat(gap, heads(inner))
        first = np.minimum.reduceat(np.where(gap == most[of], at, len(points)), heads(inner))
        far = first[most > tolerance]
        keep[far] = True
        left, right = np.concatenate([left[most > tolerance], far]), np.concatenate([far, right[most > tolerance]])


def placed(lines: np.ndarray, line_sizes: np.ndarray, stops: np.ndarray, stop_sizes: np.ndarray, slack: float = SNAP_SLACK) -> np.ndarray:
    """The segment, within its own line, of each stop of consecutive patterns, each with a line of its own.

    A stop goes to the first segment that comes within slack of the least distance, among those from the last stop's on, and there not before the last stop's place.
    """
    begin, count = heads(line_sizes), line_sizes - 1
    ends = np.ones(len(lines), dtype=bool)
    ends[begin + line_sizes - 1] = False
    start, step = lines[ends], np.diff(lines, axis=0)[ends[:-1]] if len(lines) else lines
    norm = (step * step).sum(axis=1)
    seg_begin, number = heads(count), np.arange(count.sum()) - np.repeat(heads(count), count)
    now, share = np.zeros(len(count), dtype=np.int64), np.zeros(len(count))
    out, stop_begin = np.zeros(len(stops), dtype=np.int64), heads(stop_sizes)
    for k in range(int(stop_sizes.max(initial=0))):
        who = np.flatnonzero(stop_sizes > k)  # patterns with a k-th stop
        n = count[who]
        mine = np.repeat(np.arange(len(who)), n)
        seg = np.repeat(seg_begin[who], n) + np.arange(n.sum()) - np.repeat(heads(n), n)
        target = stops[stop_begin[who] + k][mine]
        dot = ((target - start[seg]) * step[seg]).sum(axis=1)
        t = np.divide(dot, norm[seg], out=np.zeros(len(seg)), where=norm[seg] > 0).clip(0, 1)
        here = number[seg] == now[who][mine]
        t = np.where(here, np.maximum(t, share[who][mine]), t)
        gap = np.sqrt(np.square(start[seg] + t[:, None] * step[seg] - target).sum(axis=1))
        gap[number[seg] < now[who][mine]] = np.inf
        least = np.minimum.reduceat(gap, heads(n))
        pick = np.minimum.reduceat(np.where(gap <= least[mine] + slack, number[seg], len(seg)), heads(n))
        now[who], share[who] = pick, t[heads(n) + pick]
        out[stop_begin[who] + k] = pick
    return out


def cut(stops: pd.DataFrame, shape: pd.DataFrame) -> pd.DataFrame:
    """Hop lines of many patterns; patterns without a shape of two points, or with a stop without a place, have none."""
    names = ["route", "from_stop", "to_stop", "pattern", "place", "xs", "ys"]
    shape = shape.sort_values(["s_pattern", "s_seq"])
    size = shape.groupby("s_pattern").size()
    unplaced = stops.loc[stops[["x", "y"]].isna().any(axis=1), "pattern"]
    stops = stops[stops["pattern"].isin(size.index[size >= 2]) & ~stops["pattern"].isin(unplaced)].sort_values(["pattern", "seq"])
    if not len(stops):
        return pd.DataFrame({n: [] for n in names})
    shape = shape[shape["s_pattern"].isin(stops["pattern"])]
    line_sizes, stop_sizes = (x.groupby(c).size().to_numpy() for x, c in ((shape, "s_pattern"), (stops, "pattern")))
    line, at = shape[["s_x", "s_y"]].to_numpy(float), stops[["x", "y"]].to_numpy(float)
    segment = placed(line, line_sizes, at, stop_sizes) + np.repeat(heads(line_sizes), stop_sizes)  # now a row of line
    pattern, stop = stops["pattern"].to_numpy(), stops["stop"].to_numpy()
    a = np.flatnonzero((pattern[1:] == pattern[:-1]) & (stop[1:] != stop[:-1]))
    if not len(a):
        return pd.DataFrame({n: [] for n in names})
    # each hop: its first stop, the shape's vertices after that stop's segment up to the next one's, its second stop
    inner = segment[a + 1] - segment[a]
    sizes = inner + 2
    of, place = np.repeat(np.arange(len(a)), sizes), np.arange(sizes.sum()) - np.repeat(heads(sizes), sizes)
    points = line[np.minimum(segment[a][of] + place, len(line) - 1)]
    points[heads(sizes)], points[heads(sizes) + sizes - 1] = at[a], at[a + 1]
    keep = kept(points, sizes)
    stay = np.add.reduceat(keep.astype(np.int64), heads(sizes))
    xs, ys = (np.split(points[keep, i], np.cumsum(stay)[:-1]) for i in (0, 1))
    return pd.DataFrame({"route": stops["route"].to_numpy()[a], "from_stop": stop[a], "to_stop": stop[a + 1], "pattern": pattern[a], "place": a, "xs": xs, "ys": ys})


def hop_shapes(sequence: DataFrame, shapes: DataFrame) -> DataFrame:
    """(route, from_stop, to_stop, xs, ys) of the hops of each pattern; sequence: (pattern, route, seq, stop, x, y) in metres, shapes: (pattern, seq, x, y). The smallest pattern of a hop counts, and there its first place."""
    schema = "route long, from_stop long, to_stop long, pattern long, place long, xs array<double>, ys array<double>"
    # many patterns share a group of bounded size; tasks grow in number, not in what they hold
    groups = max(8, sequence.count() // ROWS)
    tasks = min(TASKS, groups)
    sequence = sequence.withColumn("group", F.pmod(F.xxhash64("pattern"), F.lit(groups))).repartition(tasks, "group")
    lines = shapes.select(*(F.col(c).alias(f"s_{c}") for c in ("pattern", "seq", "x", "y"))).withColumn("s_group", F.pmod(F.xxhash64("s_pattern"), F.lit(groups))).repartition(tasks, "s_group")
    cuts = sequence.groupBy("group").cogroup(lines.groupBy("s_group")).applyInPandas(cut, schema)
    first = cuts.groupBy("route", "from_stop", "to_stop").agg(F.min_by(F.struct("xs", "ys"), F.struct("pattern", "place")).alias("s"))
    return first.select("route", "from_stop", "to_stop", "s.xs", "s.ys")
