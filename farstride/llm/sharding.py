"""Sharding by histogram sort, in DataFrame functions only.

Rows are ordered by a key: a hash of the text, then a hash of doc_id. Splitters of this order are found
without sorting: each round counts, over all partitions, the exact bytes below candidate boundaries (probes)
inside the intervals that still hold a splitter, and refines only those intervals, until each splitter is
within the tolerance of its target. Then all rows are exchanged once.

Equal texts are neighbours in this order, so a group of copies stays in one shard unless it straddles a
target by more than the tolerance; then the group is split by doc_id, so a hot group spreads over shards.

Defined cases: a null text has the text size 0 and counts as the empty text; a null doc_id is a key like any
other; repeated rows (same text and doc_id) have one key and stay in one shard; an empty table gives an empty
result; columns named like the results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Scratch, table

#: Bits by which a round refines an interval: 2 ** BITS probes for each splitter.
BITS, KEY_BITS = 9, 63
OVERHEAD = 16


def keyed(docs: DataFrame) -> DataFrame:
    """Adds size, text_crc32 and the two parts of the sort key, __k1 and __k2."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumns({
        "size": (F.octet_length(text) + OVERHEAD).cast("long"),
        "text_crc32": F.crc32(text.cast("binary")),
        "__k1": F.shiftrightunsigned(F.xxhash64(text), 1),
        "__k2": F.shiftrightunsigned(F.xxhash64("doc_id"), 1),
    })


def histogram(rows: DataFrame, key: str, known: int, intervals: list[tuple], fixed: bool) -> dict:
    """Bytes and rows of each child interval of the given ones: {(k1 if fixed, prefix): [(child, bytes, rows, lowest key)]}.

    At most 2 ** BITS rows come back for each of the (number of shards - 1) splitters at most.
    """
    bits = min(BITS, KEY_BITS - known)
    prefix = F.shiftright(key, KEY_BITS - known) if known else F.lit(0).cast("long")
    child = F.shiftright(key, KEY_BITS - known - bits)
    if fixed:
        wanted = rows.filter(F.col("__k1").isin(sorted({i[0] for i in intervals})))
        groups = [F.col("__k1").alias("a")]
    else:
        wanted, groups = rows, [F.lit(0).cast("long").alias("a")]
    if known:
        wanted = wanted.filter(prefix.isin(sorted({i[1] for i in intervals})))
    out: dict = {}
    for r in wanted.groupBy(*groups, prefix.alias("p"), child.alias("c")).agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.min("__k1").alias("lo"), F.max("__k1").alias("hi")).collect():
        out.setdefault((r.a, r.p), []).append((r.c, r.b, r.n, r.lo, r.hi))
    return {k: sorted(v) for k, v in out.items()}


def splitters(rows: DataFrame, shards: int, tolerance: float) -> list[tuple[int, int]]:
    """Lower keys (k1, k2) of shards 1, 2, ...; rows has size, __k1 and __k2."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    goal = {j: total * j / shards for j in range(1, shards)}
    slack = tolerance * total / shards
    done: dict[int, tuple[int, int]] = {}
    #: splitter -> (k1 when it is fixed, prefix, exact bytes below the interval)
    open_ = {j: (0, 0, 0) for j in goal} if total else {}
    inside: dict[int, tuple] = {}
    for key, fixed in (("__k1", False), ("__k2", True)):
        known = 0
        while open_ and known < KEY_BITS:
            counted = histogram(rows, key, known, [x[:2] for x in open_.values()], fixed)
            bits = min(BITS, KEY_BITS - known)
            shift = KEY_BITS - known - bits
            for j, (k1, prefix, below) in list(open_.items()):
                for child, size, n, lo, hi in counted[(k1, prefix)]:
                    if below + size < goal[j]:
                        below += size
                        continue
                    start, end = child << shift, (child + 1) << shift
                    near = min((goal[j] - below, start), (below + size - goal[j], end))
                    if near[0] <= slack or n == 1 or (shift == 0 and fixed):
                        done[j] = (k1, near[1]) if fixed else (near[1], 0)
                        del open_[j]
                    elif not fixed and lo == hi:
                        inside[j] = (lo, 0, below)
                        del open_[j]
                    else:
                        open_[j] = (k1, child, below)
                    break
            known += bits
        open_, inside = inside, {}
    return [done[j] for j in sorted(done)]


def shard_of(cuts: list[tuple[int, int]]) -> Column:
    """The number of splitters at or below the row's key."""
    out = F.lit(0)
    for k1, k2 in cuts:
        out = out + ((F.col("__k1") > k1) | ((F.col("__k1") == k1) & (F.col("__k2") >= k2))).cast("int")
    return out


def shard(docs: DataFrame, shards: int = 40, tolerance: float = 0.01, lanes: int = 64) -> DataFrame:
    """docs with size, text_crc32, shard and slot.

    tolerance: how far the bytes below a splitter may be from their target, as a share of a shard, while
    groups of equal texts stay whole. lanes: parts of a shard within which slots are counted, so that no
    task needs a whole shard; slots run on from lane to lane without a gap.
    """
    docs = keyed(docs.drop("size", "text_crc32", "shard", "slot"))
    rows = Scratch(docs.sparkSession).save(docs.select("size", "__k1", "__k2"), "keys")
    number = shard_of(splitters(rows, shards, tolerance)).cast("int")
    lane = F.pmod(F.xxhash64("__k1", "__k2"), F.lit(lanes))
    lanes_of = rows.groupBy(number.alias("shard"), lane.alias("__lane")).count()
    before = F.sum("count").over(W.partitionBy("shard").orderBy("__lane").rowsBetween(W.unboundedPreceding, -1))
    offsets = lanes_of.select("shard", "__lane", F.coalesce(before, F.lit(0)).alias("__before"))
    placed = docs.withColumns({"shard": number, "__lane": lane})
    within = F.row_number().over(W.partitionBy("shard", "__lane").orderBy("__k1", "__k2"))
    # offsets has shards * lanes rows at most, whatever the size of docs
    return (
        placed.withColumn("__n", within)
        .join(F.broadcast(offsets), ["shard", "__lane"])
        .withColumn("slot", F.col("__before") + F.col("__n") - 1)
        .drop("__n", "__before", "__lane", "__k1", "__k2")
    )


def op7_sharding(spark, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


QUERIES = {"op7_histogram_sort_sharding": op7_sharding}
ORACLE: dict[str, str] = {}
