"""Hard negatives by inner product: ball trees with bounds above and below.

Each anchor's positives are its k nearest rows of the same label; its negatives, for each positive, the nearest rows of another label whose score lies
within a window that the positive's score sets. Both are one search: the first k rows, by score, in a window [low, high], on one side of a label test.

Rows are dealt to blocks: pivots (a bounded sample by hash of the id, PIVOTS at most) gather near rows, and a pivot's rows are salted into blocks of
about BLOCK. A block becomes a ball tree (halved along its widest axis down to LEAF rows). For a node with centre c and radius r every row x has

    q.c - |q| r <= q.x <= q.c + |q| r

so, for a lot of asks at once, a node is left by those for which it lies outside the window, holds only rows of the wrong side of the label test, or lies
strictly beneath their present kth score (ties must be seen, as the smaller id wins). First every ask searches the block that its own pivot points to;
what it finds there is a floor for the search of all blocks. Asks go to blocks in lots of LOT, so a task holds one block and one
lot; the asks are the given query set, against all rows in blocks. Bounds have a slack above the rounding errors; scores are exact integers.

Equal vectors of one label are one class. Only its k + 1 smallest ids can be in a result, so a class keeps those, and its anchors ask once.

Defined cases: rows with a null id, label or vector, or a null or non-finite component take no part, nor do empty vectors; vectors of different lengths have no score
together; a repeated row is one row; a row of the anchor's own id and label is never its positive, one of its id and another label counts as another row; an anchor without another row of its label has no rows, and a
positive without a row in its window has none; an empty table gives an empty result; other columns are ignored. Scores must fit a long.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Scratch, table

PIVOTS, BLOCK, LOT, LEAF = 64, 16_384, 2_048, 128
#: Exact integers in doubles.
EXACT = 1 << 53
LOW, HIGH = -(1 << 62), 1 << 62


def matrix(column) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.int64).reshape(len(column), -1)


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of integer rows: in doubles where their sums are exact there."""
    if not len(a) or not len(b) or not a.shape[1]:
        return np.zeros((len(a), len(b)), dtype=np.int64)
    largest = lambda x: float(np.abs(x.astype(np.float64)).max())
    if largest(a) * largest(b) * a.shape[1] < EXACT:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


class Tree:
    """A ball tree over rows; nodes are ranges of the order that building leaves them in."""

    def __init__(self, vectors: np.ndarray, labels: np.ndarray):
        self.order = np.arange(len(vectors))
        self.nodes: list[tuple[int, int, int, int]] = []  # first row, end, left and right child (-1: leaf)
        floats, todo = vectors.astype(np.float64), [(0, len(vectors), -1, 0)]
        while todo:
            lo, hi, parent, side = todo.pop()
            if parent >= 0:
                self.nodes[parent] = (*self.nodes[parent][: 2 + side], len(self.nodes), *self.nodes[parent][3 + side :])
            own = self.order[lo:hi]
            self.nodes.append((lo, hi, -1, -1))
            if hi - lo > LEAF:
                axis = int(np.ptp(floats[own], axis=0).argmax())
                half = (hi - lo) // 2
                self.order[lo:hi] = own[np.argpartition(floats[own, axis], half)]
                me = len(self.nodes) - 1
                todo += [(lo, lo + half, me, 0), (lo + half, hi, me, 1)]
        self.centre = np.stack([floats[self.order[lo:hi]].mean(axis=0) for lo, hi, *_ in self.nodes])
        self.radius = np.array([np.sqrt(np.square(floats[self.order[lo:hi]] - c).sum(axis=1)).max() for (lo, hi, *_), c in zip(self.nodes, self.centre, strict=True)])
        # the one label of a node, -1 where it has several
        self.label = np.array([x[0] if (x == x[0]).all() else -1 for x in (labels[self.order[lo:hi]] for lo, hi, *_ in self.nodes)])


def first(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def search_block(rows: pd.DataFrame, asks: pd.DataFrame, k: int, same: bool) -> tuple[pd.DataFrame, int]:
    """The first k rows of a block for each ask, as far as they reach its floor; and how many scores were computed."""
    names = {x: i for i, x in enumerate(pd.unique(pd.concat([rows["label"], asks["label"]])))}
    labels, wanted = rows["label"].map(names).to_numpy(), asks["label"].map(names).to_numpy()
    v, q, ids = matrix(rows["v"]), matrix(asks["v"]), rows["id"].to_numpy()
    low, high, kth = asks["low"].to_numpy(), asks["high"].to_numpy(), asks["floor"].to_numpy().copy()
    tree = Tree(v, labels)
    norm = np.sqrt(np.square(q.astype(np.float64)).sum(axis=1))
    middle = q.astype(np.float64) @ tree.centre.T
    spread = norm[:, None] * tree.radius[None, :]
    slack = 1 + 1e-9 * (np.abs(middle) + spread + norm[:, None] * np.sqrt(np.square(tree.centre).sum(axis=1)))
    upper, lower = middle + spread + slack, middle - spread - slack
    found = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))] * len(asks)
    scored, todo = 0, [(0, np.arange(len(asks)))]
    while todo:
        node, who = todo.pop()
        lo, hi, left, right = tree.nodes[node]
        keep = (upper[who, node] >= low[who]) & (lower[who, node] <= high[who]) & (upper[who, node] >= kth[who])
        if tree.label[node] >= 0:
            keep &= (wanted[who] == tree.label[node]) == same
        who = who[keep]
        if not len(who):
            continue
        if left >= 0:  # the side that most asks lean to comes first, so that kth rises early
            nearer = (upper[who, left] >= upper[who, right]).mean() >= 0.5
            todo += [(right, who), (left, who)] if nearer else [(left, who), (right, who)]
            continue
        own = tree.order[lo:hi]
        score = exact(q[who], v[own])
        scored += score.size
        fits = ((labels[own][None, :] == wanted[who][:, None]) == same) & (score >= low[who, None]) & (score <= high[who, None]) & (score >= kth[who, None])
        for j in np.flatnonzero(fits.any(axis=1)):
            a, hits = who[j], np.flatnonzero(fits[j])
            i, s = np.concatenate([found[a][0], ids[own[hits]]]), np.concatenate([found[a][1], score[j, hits]])
            best = first(i, s, k)
            found[a] = i[best], s[best]
            if len(best) == k:
                kth[a] = max(kth[a], s[best[-1]])
    counts = [len(i) for i, _ in found]
    out = {"ask": np.repeat(asks["ask"].to_numpy(), counts), "id": np.concatenate([i for i, _ in found]), "score": np.concatenate([s for _, s in found])}
    return pd.DataFrame(out), scored


def usable(vectors: DataFrame, key: str, vector: str, label) -> DataFrame:
    """id, label and v (integers) of the rows that take part, once each."""
    v = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(key).cast("long").alias("id"), label.alias("label"), v.alias("x")).dropna().filter(F.size("x") > 0)
    rows = rows.filter(~F.exists("x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    return rows.select("id", "label", F.transform("x", lambda x: F.floor(x * 256)).alias("v")).distinct()


def dealt(classes: DataFrame, scratch: Scratch) -> DataFrame:
    """classes with pivot (the nearest of a bounded sample) and block."""
    sample = classes.select("v").orderBy(F.xxhash64("cid"), "cid").limit(PIVOTS).collect()  # PIVOTS vectors at most
    by_size: dict[int, np.ndarray] = {}
    for r in sample:
        by_size.setdefault(len(r.v), []).append(r.v)
    shared = scratch.broadcast({n: np.array(x, dtype=np.float64) for n, x in by_size.items()})

    def nearest(parts):
        for pdf in parts:
            size, pivot = pdf["v"].map(len).to_numpy(), np.full(len(pdf), -1)
            for n, at in shared.value.items():
                mine = np.flatnonzero(size == n)
                if len(mine):
                    x = matrix(pdf["v"].iloc[mine]).astype(np.float64)
                    pivot[mine] = (2 * x @ at.T - np.square(at).sum(axis=1)).argmax(axis=1)
            yield pdf.assign(pivot=pivot, size=size)

    schema = "cid long, label string, v array<long>, ids array<long>, wanted boolean, pivot int, size int"
    placed = scratch.save(classes.select("cid", "label", "v", "ids", "wanted").mapInPandas(nearest, schema), "placed")
    blocks = placed.groupBy("size", "pivot").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    salt = F.pmod(F.xxhash64("cid", "label"), F.col("blocks"))
    return placed.join(blocks, ["size", "pivot"]).withColumn("block", salt)


def search(asks: DataFrame, rows: DataFrame, k: int, same: bool, scratch: Scratch, name: str) -> DataFrame:
    """(ask, id, score): the first k for each of asks (ask, label, v, low, high, size, pivot, block) among rows (id, label, v, size, pivot, block)."""
    place = ["size", "pivot", "block"]
    schema = "ask string, id long, score long"
    lots = max(1, -(-asks.count() // LOT))
    lot = F.pmod(F.xxhash64("ask"), F.lit(lots)).cast("int")
    where = rows.groupBy(*place).agg(F.count("*").alias("rows"))
    where = scratch.save(where.groupBy("size").agg(F.collect_list(F.struct("pivot", "block")).alias("at")), f"{name}_blocks")

    def run(asked: DataFrame, meet: DataFrame) -> DataFrame:
        def compare(mine: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
            if not len(mine) or not len(own):
                return pd.DataFrame({"ask": [], "id": [], "score": []}).astype({"ask": str, "id": "int64", "score": "int64"})
            return search_block(own, mine, k, same)[0]

        keys = [*place, "lot"]
        mine = asked.select(*keys, "ask", "label", "v", "low", "high", "floor")
        found = mine.groupBy(*keys).cogroup(meet.select(*keys, "id", "label", "v").groupBy(*keys)).applyInPandas(compare, schema)
        best = F.row_number().over(W.partitionBy("ask").orderBy(F.desc("score"), "id"))
        return found.withColumn("n", best).filter(F.col("n") <= k)

    # at home: the rows of the asks' own blocks, for the lots that come there
    asks = asks.withColumn("lot", lot)
    here = scratch.save(asks.select(*place, "lot").distinct(), f"{name}_lots")
    home = scratch.save(run(asks.withColumn("floor", F.lit(LOW)), rows.join(here, place)), f"{name}_home")
    floors = home.filter(F.col("n") == k).select("ask", F.col("score").alias("floor"))
    asks = asks.drop("pivot", "block").join(floors, "ask", "left").fillna({"floor": LOW})
    spread = asks.join(where, "size").withColumn("b", F.explode("at")).select("*", "b.pivot", "b.block")
    every = rows.withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(lots - 1))))
    return scratch.save(run(spread, every), name)


def mine(vectors: DataFrame, anchor, positives: int = 5, negatives: int = 3, low_pct: int = 50, high_pct: int = 95, key: str = "vec_id", vector: str = "embedding", label=None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score; anchor: a condition on id, label: a column, by default the one of that name."""
    scratch = Scratch(vectors.sparkSession)
    label = (F.col("label") if label is None else label).cast("string")
    rows = scratch.save(usable(vectors, key, vector, label), "rows")
    anchors = scratch.save(rows.filter(anchor), "anchors")
    kept = positives + 1
    nth = F.row_number().over(W.partitionBy("label", "v").orderBy("id"))
    classes = rows.withColumn("n", nth).filter(F.col("n") <= kept).groupBy("label", "v").agg(F.array_sort(F.collect_list("id")).alias("ids"), F.min("id").alias("cid"))
    wanted = anchors.select("label", "v").distinct().withColumn("wanted", F.lit(True))
    classes = classes.join(wanted, ["label", "v"], "left").withColumn("wanted", F.coalesce("wanted", F.lit(False)))
    placed = scratch.save(dealt(classes, scratch), "blocks")
    each = scratch.save(placed.select("label", "v", "size", "pivot", "block", F.explode("ids").alias("id")), "each")
    # a class asks for its anchors; its name tells apart classes that share a smallest id
    named = F.concat_ws(":", F.col("cid"), F.xxhash64("label", "v"))
    asks = scratch.save(placed.filter("wanted").select(named.alias("ask"), "label", "v", "size", "pivot", "block"), "asks")
    near = search(asks.withColumns({"low": F.lit(LOW), "high": F.lit(HIGH)}), each, kept, True, scratch, "positives")

    of = anchors.join(asks.select("ask", "label", "v"), ["label", "v"]).select("ask", F.col("id").alias("anchor_id"))
    rank = F.row_number().over(W.partitionBy("anchor_id", "ask").orderBy(F.desc("score"), "id"))
    pairs = of.join(near.drop("n"), "ask").filter(F.col("id") != F.col("anchor_id")).withColumn("n", rank).filter(F.col("n") <= positives)
    pairs = scratch.save(pairs.select("ask", "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "pairs")

    # whole-number bounds of low_pct * p <= 100 * n <= high_pct * p
    p = F.col("positive_score")
    window = pairs.select("ask", "positive_score").distinct()
    window = window.withColumns({"low": F.expr(f"-((-{low_pct} * positive_score - pmod(-{low_pct} * positive_score, 100L)) DIV 100L)"), "high": F.expr(f"({high_pct} * positive_score - pmod({high_pct} * positive_score, 100L)) DIV 100L")})
    windows = window.filter(F.col("low") <= F.col("high")).join(asks, "ask")
    windows = scratch.save(windows.withColumn("ask", F.concat_ws("/", "ask", "positive_score")), "windows")
    hard = search(windows, each, negatives, False, scratch, "negatives")
    hard = hard.select("ask", F.col("n").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = pairs.withColumn("ask", F.concat_ws("/", "ask", p)).join(hard, "ask")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_ball_tree_negatives(spark, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, label=moved)


QUERIES = {"op12_ball_tree_negatives": op12_ball_tree_negatives}
#: Whole-number form of the contract, on all rows: every anchor meets every row once.
ORACLE = {
    "op12_ball_tree_negatives": """
    WITH r AS (SELECT DISTINCT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(x::DOUBLE * 256) FOR x IN embedding] AS v
               FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
    s AS (SELECT a.id AS anchor_id, b.id AS id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
          FROM r a JOIN r b ON len(a.v) = len(b.v) WHERE a.id % 50 = 0 AND (a.id <> b.id OR a.label <> b.label)),
    p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
          QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
    SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
    QUALIFY rank <= 3
    """
}
