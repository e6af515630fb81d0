"""Approximate nearest neighbours by cosine, with shifted space-filling curves.

Unit vectors are projected by CURVES random orthonormal maps to DIMS dimensions, shifted, and put in the order of
their place on a Hilbert curve; Spark range-partitions each order and numbers it. A query looks at the `width`
rows before and after it in every order; what the windows find is merged and ranked by exact cosine.

width is measured, not guessed: for CALIBRATE queries (a bounded number, chosen by a hash of their id) the true
neighbours are found by a scan of all vectors, and width is the distance within which the given share of them (target, above the
recall to reach) lies in at least one order. The scan is linear in the table; the index holds every vector.

Equal vectors are one class in the index. Only its k + 1 smallest ids can appear in a result of k, so a class
keeps those, and queries with equal vectors are searched once.

Defined cases: null and zero vectors, vectors with a null or non-finite component, and vectors of another length than
most take no part; ties go to the smaller id; a repeated row is one candidate; with fewer than k candidates all
are returned; an empty table gives an empty result; other columns are ignored.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Scratch, table

CURVES, DIMS, BITS, SEED = 16, 12, 5, 7
CALIBRATE, TARGET = 128, 0.96
#: Rows of an order that are compared at once.
BLOCK = 2_048


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each row of integer coordinates on the Hilbert curve (by Gray-code rotations of the bit planes)."""
    x = cells.astype(np.int64).copy()
    dims = x.shape[1]
    for b in range(bits - 1, 0, -1):
        high, low = 1 << b, (1 << b) - 1
        for i in range(dims):
            on = (x[:, i] & high) != 0
            swap = np.where(on, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(on, low, swap)
            x[:, i] ^= swap
    x = np.bitwise_xor.accumulate(x, axis=1)
    flips = np.zeros(len(x), dtype=np.int64)
    for b in range(bits - 1, 0, -1):
        flips ^= np.where((x[:, -1] >> b) & 1, (1 << b) - 1, 0)
    x ^= flips[:, None]
    place = np.zeros(len(x), dtype=np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            place = (place << 1) | ((x[:, i] >> b) & 1)
    return place


def maps(size: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Projection and shift of each curve."""
    rng = np.random.default_rng(SEED)
    dims = min(DIMS, size)
    return [(np.linalg.qr(rng.normal(size=(size, dims)))[0] * np.sqrt(size), rng.random(dims)) for _ in range(CURVES)]


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def places(v: np.ndarray, curves: list) -> np.ndarray:
    out = []
    for project, shift in curves:
        at = np.clip((v @ project + 4 + shift) / 9, 0, 1 - 1e-9)
        out.append(hilbert((at * (1 << BITS)).astype(np.int64), BITS))
    return np.stack(out, axis=1)


def matrix(column) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64).reshape(len(column), -1)


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """id and v (doubles) of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(key).cast("long").alias("id"), v.alias("v")).dropna()
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter(~bad & F.exists("v", lambda x: x != 0))
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("v") == (common.n if common else 0))


def nearest(block: pd.DataFrame, q: np.ndarray, mask: np.ndarray, k: int) -> list[np.ndarray]:
    """For each query, rows of block with the k largest cosines among the masked; ties (to 12 digits) to the smaller cid."""
    score = np.where(mask, np.round(q @ matrix(block["u"]).T, 12), -9)
    cid, out = block["cid"].to_numpy(), []
    for s in score:
        near = np.flatnonzero(s >= np.partition(s, -k)[-k]) if len(s) > k else np.arange(len(s))
        near = near[s[near] > -9]
        out.append(near[np.lexsort((cid[near], -s[near]))][:k])
    return out


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding", target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest of each row of queries (a subset of vectors)."""
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession)
    rows = scratch.save(usable(vectors, key, vector), "rows")
    asked = scratch.save(rows.join(queries.select(F.col(key).cast("long").alias("id")).distinct(), "id", "left_semi"), "asked")
    first = F.row_number().over(W.partitionBy("v").orderBy("id"))
    kept = rows.distinct().withColumn("n", first).filter(F.col("n") <= k + 1)
    classes = kept.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"), F.min("id").alias("cid"))
    wanted = asked.select("v").distinct().withColumn("wanted", F.lit(True))
    classes = classes.join(wanted, "v", "left").withColumn("wanted", F.coalesce("wanted", F.lit(False)))

    def place(parts):
        curves = None
        for pdf in parts:
            if len(pdf):
                u = unit(matrix(pdf["v"]))
                curves = curves or maps(u.shape[1])
                yield pd.DataFrame({"cid": pdf["cid"], "ids": pdf["ids"], "v": pdf["v"], "wanted": pdf["wanted"], "u": list(u), "places": list(places(u, curves))})

    classes = scratch.save(classes.mapInPandas(place, "cid long, ids array<long>, v array<double>, wanted boolean, u array<double>, places array<long>"), "classes")
    # number each order: place within its range partition, plus the rows of the partitions before
    keyed = classes.select("cid", "wanted", F.posexplode("places").alias("curve", "place"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = scratch.save(keyed.repartitionByRange(parts, "curve", "place", "cid").sortWithinPartitions("curve", "place", "cid").withColumn("at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("at", 33)
    sizes = ordered.groupBy(part.alias("part"), "curve").agg(F.count("*").alias("n"), F.min("at").alias("at")).collect()  # partitions + curves at most
    before, offsets = {}, []
    for r in sorted(sizes, key=lambda r: (r.curve, r.part)):
        offsets.append((r.part, r.curve, before.get(r.curve, 0) - r["at"]))
        before[r.curve] = before.get(r.curve, 0) + r.n
    offset = spark.createDataFrame(offsets, "part long, curve int, shift long")
    ranks = ordered.withColumn("part", part).join(F.broadcast(offset), ["part", "curve"]).select("cid", "wanted", "curve", (F.col("at") + F.col("shift")).alias("rank"))
    ranks = scratch.save(ranks, "ranks")
    width = calibrate(classes, ranks, scratch, k, target)

    block = F.floor(F.col("rank") / BLOCK)
    spread = F.explode(F.sequence(F.floor((F.col("rank") - width) / BLOCK), F.floor((F.col("rank") + width) / BLOCK)))
    body = ranks.select("cid", "curve", "rank", block.alias("block")).join(classes.select("cid", "u"), "cid")
    seek = ranks.filter("wanted").select("cid", "curve", "rank", spread.alias("block")).join(classes.filter("wanted").select("cid", "u"), "cid")
    seek = seek.select(*(F.col(c).alias(f"q_{c}") for c in ("cid", "curve", "block", "rank", "u")))

    def compare(_, own, ask):
        if not len(own) or not len(ask):
            return pd.DataFrame({"q": [], "c": []}, dtype="int64")
        mask = np.abs(ask["q_rank"].to_numpy()[:, None] - own["rank"].to_numpy()[None, :]) <= width
        found = nearest(own, matrix(ask["q_u"]), mask, k + 1)
        cid = own["cid"].to_numpy()
        return pd.DataFrame({"q": np.repeat(ask["q_cid"].to_numpy(), [len(x) for x in found]), "c": cid[np.concatenate(found)] if found else []})

    pairs = body.groupBy("curve", "block").cogroup(seek.groupBy("q_curve", "q_block")).applyInPandas(compare, "q long, c long").distinct()
    vectors_of = classes.select(F.col("cid").alias("c"), F.col("v").alias("vc"), "ids")
    pairs = pairs.join(vectors_of, "c").join(classes.filter("wanted").select(F.col("cid").alias("q"), F.col("v").alias("vq")), "q")

    def score(parts):
        for pdf in parts:
            if len(pdf):
                a, b = matrix(pdf["vq"]), matrix(pdf["vc"])
                cosine = (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))
                yield pd.DataFrame({"q": pdf["q"], "ids": pdf["ids"], "score": cosine})

    scored = pairs.mapInPandas(score, "q long, ids array<long>, score double").select("q", F.explode("ids").alias("c"), "score")
    best = F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "c"))
    scored = scored.withColumn("n", best).filter(F.col("n") <= k + 1)  # one of them may be the query itself
    member = classes.filter("wanted").select(F.col("cid").alias("q"), "v")
    asked = asked.select("id", "v").distinct().join(member, "v").select("q", "id")
    rank = F.row_number().over(W.partitionBy("id").orderBy(F.desc("score"), "c"))
    out = asked.join(scored, "q").filter(F.col("id") != F.col("c")).withColumn("rank", rank).filter(F.col("rank") <= k)
    return out.select(F.col("id").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("c").alias(key), "score")


def calibrate(classes: DataFrame, ranks: DataFrame, scratch: Scratch, k: int, target: float) -> int:
    """Rows before and after a query within which a share `target` of true neighbours lies in some order."""
    spark = classes.sparkSession
    some = classes.filter("wanted").orderBy(F.xxhash64("cid"), "cid").limit(CALIBRATE).select("cid", "u").collect()
    if not some:
        return 1
    q = spark.sparkContext.broadcast((np.array([r.cid for r in some]), np.array([r.u for r in some])))

    def scan(parts):
        for pdf in parts:
            if len(pdf):
                ids, u = q.value
                found = nearest(pdf, u, pdf["cid"].to_numpy()[None, :] != ids[:, None], k)
                s = u @ matrix(pdf["u"]).T
                yield pd.DataFrame([(ids[i], pdf["cid"].iloc[j], s[i, j]) for i, x in enumerate(found) for j in x], columns=["q", "c", "s"])

    near = classes.select("cid", "u").mapInPandas(scan, "q long, c long, s double")
    near = near.withColumn("n", F.row_number().over(W.partitionBy("q").orderBy(F.desc("s"), "c"))).filter(F.col("n") <= k)
    near = scratch.save(near, "near")
    a = ranks.select(F.col("cid").alias("q"), "curve", F.col("rank").alias("ra"))
    b = ranks.select(F.col("cid").alias("c"), "curve", F.col("rank").alias("rb"))
    near = F.broadcast(near)  # CALIBRATE * k pairs at most
    apart = near.join(a, "q").join(b, ["c", "curve"]).groupBy("q", "c").agg(F.min(F.abs(F.col("ra") - F.col("rb"))).alias("d"))
    d = sorted(r.d for r in apart.collect())  # CALIBRATE * k numbers at most
    return max(1, int(d[min(len(d) - 1, int(np.ceil(target * len(d))))])) if d else 1


def op6_neighbours(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


QUERIES = {"op6_shifted_curve_neighbours": op6_neighbours}
ORACLE: dict[str, str] = {}
