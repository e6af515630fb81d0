"""Exact Jaccard join of documents on word shingles, with prefix filters under several global token orders.

For sets of n shingles that overlap by the threshold, the first n - ceil(t n) + 1 shingles of both (the prefix)
share one under ANY order of all shingles; sets of sizes a and b share at least ceil(t (a + b) / (1 + t)) - ceil(t max(a, b)) + 1
prefix shingles, as those they share beyond the prefixes lie in the rest of one of them. ORDERS different orders are used; each puts frequent shingles last, by
classes from a count sketch of the whole corpus, and shuffles each class by another hash. The first order's prefixes
propose pairs; Spark intersects them with the pairs that share that many prefix shingles in each other order; only what is left is verified on whole sets.

1. Texts with the same words are one class, represented by the smallest doc_id.
2. Prefix shingles of the first order form buckets; those with one document are dropped.
3. Leader rounds: each document is tried against one leader of its buckets, so a group of many near copies
   becomes one component in a number of comparisons that is linear in its size. The first leader is the document with most
   frequent shingles, which is the closest to all others of a group; later ones are random.
4. The rest exactly: for each bucket, all pairs across different components. Pairs within one component need no
   comparison: their documents are reachable from each other already.

Links found are verified, and links not compared lie inside components, so the components are exact.

Defined cases: a text without words (or null) has an empty set and links with nothing; a text of fewer words than a
shingle is one shingle; rows with the same doc_id are one node (linked if any of their texts are), rows with a null doc_id
take no part and have a null component; an empty table gives an empty result; columns other than the key and
the text are ignored.
"""

import hashlib
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Scratch, U, batches, join_bytes, mix, ngram_hashes, table, word_hashes, words
from .components import components

WORDS, PERCENT = 5, 80
#: Token orders; leader rounds; counters in each of the sketch's two rows; slices in which sketches are summed.
ORDERS, LEADER_ROUNDS, WIDTH, SLICES = 3, 2, 1 << 20, 16
SEEDS = mix(np.arange(1, 9, dtype=np.uint64))
#: Ids that are broadcast at most (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 200_000


def shingles(texts: list, n: int = WORDS) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Hash of each shingle, the text of each, and a digest of each text's words."""
    low = [t.translate(LOWER) if t else b"" for t in texts]
    buf, starts = join_bytes(low)
    a, b = words(buf)
    h = word_hashes(buf, a, b)
    doc = np.searchsorted(starts, a, side="right") - 1
    grams = ngram_hashes(h, n)
    whole = doc[: len(grams)] == doc[n - 1 :] if len(grams) else np.zeros(0, dtype=bool)
    count = np.bincount(doc, minlength=len(texts))
    short = np.flatnonzero((count > 0) & (count < n))
    digests = [hashlib.blake2b(b" ".join(t.split()), digest_size=16).digest() for t in low]
    extra = np.array([int.from_bytes(digests[i][:8], "little") for i in short], dtype=np.uint64)
    return np.concatenate([grams[whole], extra]), np.concatenate([doc[: len(grams)][whole], short]), digests


def sets(texts: list, n: int = WORDS):
    """(index, sorted distinct shingles, digest) of each text."""
    for a, b in batches(texts):
        h, doc, digests = shingles(texts[a:b], n)
        order = np.argsort(doc, kind="stable")
        h, cut = h[order], np.searchsorted(doc[order], np.arange(b - a + 1))
        for i in range(b - a):
            yield a + i, np.unique(h[cut[i] : cut[i + 1]]), digests[i]


def slots(h: np.ndarray, width: int) -> list[np.ndarray]:
    return [(mix(h ^ SEEDS[6 + row]) % U(width)).astype(np.int64) + row * width for row in range(2)]


def sketch(docs: DataFrame, n: int, width: int) -> np.ndarray:
    """Count-min sketch (2 x width) of all shingles of all rows."""

    def count(parts):
        total = np.zeros(2 * width, dtype=np.int64)
        for pdf in parts:
            texts = pdf["text"].tolist()
            for a, b in batches(texts):
                for at in slots(shingles(texts[a:b], n)[0], width):
                    total += np.bincount(at, minlength=2 * width)
        for k, part in enumerate(np.split(total, SLICES)):
            yield pd.DataFrame({"slice": [k], "counts": [zlib.compress(part.astype("<u4").tobytes(), 1)]})

    def add(key, pdf):
        total = np.sum([np.frombuffer(zlib.decompress(x), "<u4").astype(np.int64) for x in pdf["counts"]], axis=0)
        return pd.DataFrame({"slice": [key[0]], "counts": [total.astype("<i8").tobytes()]})

    parts = docs.select("text").mapInPandas(count, "slice int, counts binary").groupBy("slice").applyInPandas(add, "slice int, counts binary").collect()
    parts = [np.frombuffer(r.counts, "<i8") for r in sorted(parts, key=lambda r: r.slice)]
    return np.concatenate(parts) if parts else np.zeros(2 * width, dtype=np.int64)


def classes(counts: np.ndarray) -> np.ndarray:
    """Frequency class of each sketch counter: 0 within the sketch's noise, then by powers of two.

    A shingle has the lower class of its two counters, so two deviations of noise in each are enough.
    """
    noise = np.median(counts)
    above = np.maximum(counts - noise - 2 * np.sqrt(noise), 1) / 4
    return np.maximum(np.floor(np.log2(above)), 0).astype(np.uint8)


def order_keys(h: np.ndarray, klass: np.ndarray, order: int) -> np.ndarray:
    """Place of each shingle in an order: class first, then hash."""
    width = len(klass) // 2
    of = np.minimum(*(klass[at] for at in slots(h, width))).astype(np.uint64)
    return (of << U(58)) | (mix(h ^ SEEDS[order]) >> U(6))


def prefix(keys: np.ndarray, percent: int) -> np.ndarray:
    size = len(keys) - (percent * len(keys) + 99) // 100 + 1
    return np.sort(np.partition(keys, size - 1)[:size]).astype(np.int64) if len(keys) else keys.astype(np.int64)


def hub(keys: np.ndarray) -> int:
    """Eight times the mean frequency class of a set: of near copies, the one that has most in common with the others has the largest."""
    return int(8 * (keys >> U(58)).mean()) if len(keys) else 0


def overlap(a: Column, b: Column, percent: int) -> Column:
    """Shingles that sets of sizes a and b share at least if they link."""
    return F.ceil((a + b) * percent / F.lit(100.0 + percent) - 1e-9)


def reachable(a: Column, at_a: Column, b: Column, at_b: Column, percent: int) -> Column:
    """Whether sets of sizes a and b can link if they share the shingles at these places of their orders.

    Shingles before it are shared only with those before it, and those after it only with those after it.
    """
    return F.least(at_a, at_b) + 1 + F.least(a - at_a - 1, b - at_b - 1) >= overlap(a, b, percent)


def least_shared(a, b, percent: int):
    """Prefix shingles that sets of sizes a and b share if they link (numbers or columns)."""
    if isinstance(a, Column):
        return overlap(a, b, percent) - F.ceil(F.greatest(a, b) * percent / F.lit(100.0) - 1e-9) + 1
    return -(-(a + b) * percent // (100 + percent)) - -(-max(a, b) * percent // 100) + 1


def asked(a: Column, b: Column, percent: int) -> Column:
    """How many shared prefix shingles a candidate pair must show: a quarter of what linked sets share in their whole prefixes."""
    return F.ceil(least_shared(a, b, percent) / 4)


def early(a: Column, at_a: Column, b: Column, at_b: Column, percent: int) -> Column:
    """Whether these places come early enough to be among the first shingles that linked sets of sizes a and b share.

    The first k of at least o shared shingles have o - k more after them in both sets, so they lie within the first a - o + k and b - o + k.
    """
    rest = overlap(a, b, percent) - asked(a, b, percent)
    return (at_a < a - rest) & (at_b < b - rest)


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def shared_enough(a: str, b: str, need: Column) -> Column:
    """Whether two arrays of half hashes can be of prefixes that share `need` shingles: distinct ones whose halves are equal count as often as they were."""
    slack = F.size(a) - F.size(F.array_distinct(a))
    return F.size(F.array_intersect(a, b)) + slack >= F.greatest(F.lit(1), need)


class Join:
    """The steps of one join, over shared scratch tables."""

    def __init__(self, docs: DataFrame, key: str, text: str, n: int, percent: int, width: int, scratch: Scratch | None = None):
        self.spark, self.scratch = docs.sparkSession, scratch or Scratch(docs.sparkSession)
        self.docs = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).cast("binary").alias("text"))
        self.n, self.percent = n, percent
        self.klass = self.scratch.broadcast(classes(sketch(self.docs, n, width)))  # 2 x width bytes

    def prefixes(self) -> DataFrame:
        n, percent, klass = self.n, self.percent, self.klass

        def extract(parts):
            for pdf in parts:
                ids = pdf["doc"].tolist()
                found = ((ids[i], d, order_keys(s, klass.value, 0)) for i, s, d in sets(pdf["text"].tolist(), n))
                rows = [(doc, d, len(keys), hub(keys), prefix(keys, percent)) for doc, d, keys in found]
                yield pd.DataFrame(rows, columns=["doc", "digest", "n", "hub", "prefix"]).astype({"doc": "Int64"})

        return self.docs.mapInPandas(extract, "doc long, digest binary, n long, hub int, prefix array<long>")

    def few(self, df: DataFrame) -> DataFrame:
        """df as a broadcast side if it has BROADCAST_IDS rows (of a few numbers) at most; else joins shuffle it."""
        return F.broadcast(df) if df.count() <= BROADCAST_IDS else df

    def filtered(self, pairs: DataFrame, name: str) -> DataFrame:
        """Those of the pairs (a, b) that also share enough prefix shingles in every further order."""
        n, percent, klass, scratch = self.n, self.percent, self.klass, self.scratch
        pairs = scratch.save(pairs, f"{name}_all")
        ids = pairs.select(F.col("a").alias("doc")).union(pairs.select("b")).distinct()
        ids = scratch.save(ids, f"{name}_ids")

        def extract(parts):
            for pdf in parts:
                rows, ids_ = [], pdf["doc"].tolist()
                for i, s, _ in sets(pdf["text"].tolist(), n):
                    halves = [prefix(order_keys(s, klass.value, k), percent).astype(np.int32) for k in range(1, ORDERS)]
                    rows.append((ids_[i], len(s), *halves))
                yield pd.DataFrame(rows, columns=["doc", "n", *(f"o{k}" for k in range(1, ORDERS))])

        orders = self.docs.join(self.few(ids), "doc", "left_semi").mapInPandas(extract, "doc long, n long, " + ", ".join(f"o{k} array<int>" for k in range(1, ORDERS)))
        # a doc_id may stand at several texts: a pair stays if any of them pass
        orders = scratch.save(orders, f"{name}_orders")
        side = lambda x: orders.select(*(F.col(c).alias(x if c == "doc" else f"{c}_{x}") for c in orders.columns))
        need = least_shared(F.col("n_a"), F.col("n_b"), percent)
        met = pairs.join(side("a"), "a").join(side("b"), "b")
        for k in range(1, ORDERS):
            met = met.filter(shared_enough(f"o{k}_a", f"o{k}_b", need))
        out = scratch.save(met.select("a", "b").distinct(), f"{name}_pairs")
        scratch.drop(f"{name}_all", f"{name}_ids", f"{name}_orders")
        return out

    def verified(self, pairs: DataFrame, name: str) -> DataFrame:
        """Those of the pairs (a, b) that link. Compressed texts of both sides meet once for each pair that all orders let through."""
        n, percent, scratch = self.n, self.percent, self.scratch
        pairs = self.filtered(pairs, name)

        def packed(parts):
            for pdf in parts:
                yield pdf.assign(text=[zlib.compress(t or b"", 1) for t in pdf["text"]])

        left = self.docs.join(self.few(pairs.withColumnRenamed("a", "doc")), "doc").mapInPandas(packed, "doc long, text binary, b long")
        chosen = self.few(pairs.select(F.col("b").alias("doc")).distinct())
        right = self.docs.join(chosen, "doc", "left_semi").mapInPandas(packed, "doc long, text binary")
        both = left.toDF("a", "text_a", "b").join(right.toDF("b", "text_b"), "b")

        def compare(parts):
            last, known = None, None
            for pdf in parts:
                keep = []
                for packed_a, b, text in zip(pdf["text_a"], pdf["b"], pdf["text_b"], strict=True):  # one text at a time is unpacked
                    if (b, text) != last:  # rows come sorted by b
                        last, known = (b, text), next(sets([zlib.decompress(text)], n))[1]
                    keep.append(linked(next(sets([zlib.decompress(packed_a)], n))[1], known, percent))
                yield pdf.loc[keep, ["a", "b"]]

        out = scratch.save(both.mapInPandas(compare, "a long, b long").distinct(), f"{name}_links")
        scratch.drop(f"{name}_pairs")
        return out

    def sized(self, a, b):
        return F.least(a, b) * 100 >= F.greatest(a, b) * self.percent

    def run(self) -> tuple[DataFrame, DataFrame]:
        """Rows (doc, digest, n) of all documents, and (node, component) of representatives with links."""
        scratch = self.scratch
        found = scratch.save(self.prefixes(), "prefixes")
        rows = scratch.save(found.select("doc", "digest", "n"), "rows")
        # one prefix for each different text
        classed = found.groupBy("digest").agg(F.min("doc").alias("rep"), F.first("n").alias("n"), F.first("hub").alias("hub"), F.first("prefix").alias("prefix"))
        index = classed.filter(F.col("rep").isNotNull()).select("rep", "n", "hub", F.posexplode("prefix").alias("at", "token")).repartition("token")
        led = self.leaders(index, 0)
        buckets = scratch.save(index.join(led, "token"), "buckets0")  # with all columns, so that both sides read one exchange
        scratch.drop("prefixes")
        links, comps = None, None
        for r in range(LEADER_ROUNDS):
            tried = buckets.filter((F.col("rep") != F.col("lead.rep")) & self.sized(F.col("n"), F.col("lead.n")))
            tried = tried.filter(reachable(F.col("n"), F.col("at"), F.col("lead.n"), F.col("lead.at"), self.percent))
            if comps is not None:
                tried = tried.filter(F.col("comp") != F.col("lead.comp"))
            votes = tried.groupBy(F.col("rep").alias("a"), F.col("lead.rep").alias("b")).agg(F.count("*").alias("count"), F.first(least_shared(F.col("n"), F.col("lead.n"), self.percent)).alias("need"))
            # b may not lead all buckets they share, so this only picks what is worth trying; the last step is exact
            votes = votes.filter(F.col("count") * 2 >= F.col("need"))
            best = votes.groupBy("a").agg(F.max_by("b", F.struct("count", -F.col("b"))).alias("b"))
            new = self.verified(best, f"round{r}")
            links = new if links is None else links.unionByName(new)
            comps = scratch.save(components(links, scratch, f"star{r}_"), f"comps{r}")
            # only buckets that still hold several components go on
            now = self.with_components(buckets.select("token", "rep", "n", "at"), comps).repartition("token")
            buckets = scratch.save(now.join(self.leaders(now, r + 1), "token"), f"buckets{r + 1}")
            scratch.drop(f"buckets{r}")
        most = (
            buckets.groupBy("token", "comp").agg(F.count("*").alias("size"))
            .groupBy("token").agg(F.max_by("comp", F.struct("size", "comp")).alias("most"))
        )
        mixed = buckets.select("token", "rep", "n", "at", "comp").join(most, "token")
        left = mixed.filter(F.col("comp") != F.col("most")).select("token", F.col("rep").alias("a"), F.col("n").alias("na"), F.col("at").alias("pa"), F.col("comp").alias("ca"))
        right = mixed.select("token", F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("at").alias("pb"), F.col("comp").alias("cb"), "most")
        rest = left.join(right, "token").filter((F.col("ca") != F.col("cb")) & ((F.col("cb") == F.col("most")) | (F.col("a") < F.col("b"))) & self.sized(F.col("na"), F.col("nb")))
        places = F.col("na"), F.col("pa"), F.col("nb"), F.col("pb"), self.percent
        rest = rest.filter(reachable(*places) & early(*places))
        # every bucket that two components share is here, so this counts all early shingles that a pair shares
        rest = rest.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count("*").alias("shared"), F.first(asked(F.col("na"), F.col("nb"), self.percent)).alias("need"))
        links = links.unionByName(self.verified(rest.filter(F.col("shared") >= F.col("need")).select("a", "b"), "rest"))
        return rows, components(links, scratch, "last")

    def leaders(self, buckets: DataFrame, r: int) -> DataFrame:
        """token and lead (one of its documents, another one in each round) of the buckets that need comparisons."""
        comp = "comp" if "comp" in buckets.columns else "rep"
        fields = F.struct("rep", "n", "at", F.col(comp).alias("comp"))
        random = F.xxhash64("rep", F.lit(r))
        first = F.struct(-F.col("hub"), random) if "hub" in buckets.columns else random
        led = buckets.groupBy("token").agg(F.min(comp).alias("low"), F.max(comp).alias("high"), F.min_by(fields, first).alias("lead"))
        return led.filter(F.col("low") != F.col("high")).select("token", "lead")

    def with_components(self, buckets: DataFrame, comps: DataFrame) -> DataFrame:
        named = comps.select(F.col("node").alias("rep"), F.col("component"))
        return buckets.join(self.few(named), "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component")


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = WORDS, percent: int = PERCENT, width: int = WIDTH, scratch: Scratch | None = None) -> DataFrame:
    """key, n_shingles and component_id of each row."""
    join = Join(docs, key, text, n, percent, width, scratch)
    rows, comps = join.run()
    reps = rows.groupBy("digest").agg(F.min("doc").alias("rep"))
    out = rows.join(reps, "digest").join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    own = F.when(F.col("doc").isNull() | (F.col("n") == 0), F.col("doc")).otherwise(F.coalesce("component", "rep"))
    return out.select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), own.alias("component_id"))


def op4_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


QUERIES = {"op4_ngram_jaccard_join": op4_jaccard}
ORACLE = {
    "op4_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
t AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM s),
links AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
either AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
c(doc_id, c) USING KEY (doc_id) AS (SELECT doc_id, doc_id FROM s UNION SELECT e.b, min(c.c) FROM c JOIN either e ON e.a = c.doc_id LEFT JOIN recurring.c r ON r.doc_id = e.b WHERE c.c < r.c GROUP BY e.b)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, c AS component_id FROM s JOIN c USING (doc_id)
"""
}
