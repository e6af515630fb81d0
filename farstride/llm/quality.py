"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(threshold_k - w.x): one weight vector over hashed text features is shared by all grades,
with ordered thresholds (the first is free, each further one adds a positive step). Features are the distinct
words (runs of letters, lower-cased) and distinct runs of other signs of the whole text, hashed into BUCKETS, with
values of unit length, times the size of the log-odds with which the feature splits the rated documents at some threshold
(smoothed, so that rare features without evidence stay small). Full-batch gradients are summed over the cluster in each round; the driver holds only the
weights (BUCKETS floats) and takes Adam steps.

Ratings: grade 0 for toxic = 1, else 1 for quality = 0 and 2 for quality = 1; a row with neither teaches nothing.
max_rated bounds the rated documents that the model is fitted on (chosen by a hash of doc_id, about that many
at most); every document is scored.

Defined cases: a null or empty text has no features and gets the grade shares of the thresholds alone; without any
rating the model is flat (all grades equally probable); repeated rows score alike; several ratings of one document
all count; columns named like the results are replaced.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, batches, join_bytes, mix, table, word_hashes

BUCKETS, GRADES, MAX_RATED = 1 << 16, 3, 20_000
ROUNDS, RATE, RIDGE, SCALE = 40, 0.1, 1e-5, 8.0
#: Documents added on both sides of each threshold before a feature's odds are taken.
PRIOR = 5.0


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.r_[False, mask, False]))
    return edge[0::2], edge[1::2]


def features(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of each distinct feature, ordered by text."""
    buf, starts = join_bytes(texts)
    upper = (buf >= 65) & (buf <= 90)
    low = np.where(upper, buf + 32, buf).astype(np.uint8)
    letter = (low >= 128) | ((low >= 97) & (low <= 122))
    keys = []
    for salt, mask in ((1, letter), (2, ~letter & (low > 32) & ~((low >= 48) & (low <= 57)))):
        a, b = runs(mask)
        h = mix(word_hashes(low, a, b) + np.uint64(salt)) % np.uint64(BUCKETS)
        keys.append((np.searchsorted(starts, a, side="right") - 1) * BUCKETS + h.astype(np.int64))
    key = np.unique(np.concatenate(keys))
    return key % BUCKETS, key // BUCKETS


def links(score: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """P(grade <= k), one column for each k, with the last one 1."""
    z = np.clip(thresholds[None, :] - score[:, None], -30, 30)
    return np.c_[1 / (1 + np.exp(-z)), np.ones(len(score))]


def gradient(w: np.ndarray, thresholds: np.ndarray, grade: np.ndarray, bucket: np.ndarray, of: np.ndarray) -> tuple:
    """Of the log-likelihood: by weight, by threshold; and the log-likelihood. of: index of each feature's text."""
    n = len(grade)
    value = (SCALE / np.sqrt(np.maximum(np.bincount(of, minlength=n), 1)))[of]
    below = links(np.bincount(of, weights=w[bucket] * value, minlength=n), thresholds)
    below0 = np.c_[np.zeros(n), below]
    rows = np.arange(n)
    p = np.maximum(below0[rows, grade + 1] - below0[rows, grade], 1e-12)
    slope = below0 * (1 - below0)
    by_score = -(slope[rows, grade + 1] - slope[rows, grade]) / p
    by_threshold = np.zeros(len(thresholds))
    for k in range(len(thresholds)):
        by_threshold[k] = (slope[:, k + 1] / p)[grade == k].sum() - (slope[:, k + 1] / p)[grade == k + 1].sum()
    return np.bincount(bucket, weights=by_score[of] * value, minlength=BUCKETS), by_threshold, np.log(p).sum()


def strengths(counts: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """How strongly each feature parts the grades at some threshold; counts: documents by grade and bucket, docs: by grade."""
    low, n_low = np.cumsum(counts, axis=0)[:-1], np.cumsum(docs)[:-1, None]
    high, n_high = counts.sum(axis=0) - low, docs.sum() - n_low
    # the prior is shared by the two sides in proportion to their documents, so no evidence gives no odds
    rate = (low + high) / max(docs.sum(), 1)
    rate_low = (low + PRIOR * rate) / (n_low + PRIOR)
    rate_high = (high + PRIOR * rate) / (n_high + PRIOR)
    odds = np.abs(np.log((rate_low + 1e-12) / (rate_high + 1e-12)))
    sure = np.sqrt(np.minimum(low, rate * n_low) + np.minimum(high, rate * n_high) + np.abs(low - rate * n_low))
    return (odds * np.minimum(1, sure / 10)).max(axis=0)


def summed(parts: DataFrame) -> list[np.ndarray]:
    """Sums of the arrays of numbers in g, of fixed length, by four tasks; a bounded number of bytes."""

    def add(pdf):
        return pd.DataFrame({"g": [np.sum([np.frombuffer(y, "<f8") for y in pdf["g"]], axis=0).tobytes()]})

    keyed = parts.withColumn("k", F.pmod(F.spark_partition_id(), F.lit(4)))
    return [np.frombuffer(r.g, "<f8") for r in keyed.groupBy("k").applyInPandas(add, "g binary").collect()]


def fit(rated: DataFrame, grades: int = GRADES, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds from rated (text, grade)."""
    spark = rated.sparkSession

    def extract(parts):
        for pdf in parts:
            texts = [t.encode("utf-8", "replace") if t else b"" for t in pdf["text"]]
            for a, b in batches(texts):
                bucket, of = features(texts[a:b])
                yield pd.DataFrame({"grade": [pdf["grade"].iloc[a:b].to_numpy("<i4").tobytes()], "bucket": [bucket.astype("<i4").tobytes()], "of": [of.astype("<i4").tobytes()]})

    table_ = Scratch(spark).save(rated.select("text", "grade").mapInPandas(extract, "grade binary, bucket binary, of binary"), "features")
    count = np.zeros(grades)
    for r in rated.groupBy("grade").count().collect():
        count[r.grade] = r["count"]
    if not count.sum():
        count += 1

    def tally(parts):
        total = np.zeros((grades, BUCKETS))
        for pdf in parts:
            for g, b, o in zip(*([np.frombuffer(y, "<i4") for y in pdf[c]] for c in ("grade", "bucket", "of")), strict=True):
                total += np.bincount(g[o].astype(np.int64) * BUCKETS + b, minlength=grades * BUCKETS).reshape(grades, BUCKETS)
        yield pd.DataFrame({"g": [total.astype("<f8").tobytes()]})

    strength = strengths(sum(summed(table_.mapInPandas(tally, "g binary")), np.zeros(grades * BUCKETS)).reshape(grades, BUCKETS), count)
    share = np.clip(np.cumsum((count + 0.5) / (count + 0.5).sum())[:-1], 1e-4, 1 - 1e-4)
    first = np.log(share / (1 - share))
    # parameters: weights, first threshold, logs of the steps between thresholds
    x = np.r_[np.zeros(BUCKETS), first[0], np.log(np.maximum(np.diff(first), 1e-3))]
    m, v, total = np.zeros_like(x), np.zeros_like(x), max(count.sum(), 1)
    for step in range(1, rounds + 1):
        w, steps = x[:BUCKETS] * strength, np.exp(x[BUCKETS + 1 :])
        thresholds = x[BUCKETS] + np.r_[0, np.cumsum(steps)]
        shared = spark.sparkContext.broadcast((w, thresholds))

        def partial(parts, shared=shared):
            gw, gt, n = np.zeros(BUCKETS), np.zeros(grades - 1), 0
            for pdf in parts:
                for g, b, o in zip(pdf["grade"], pdf["bucket"], pdf["of"], strict=True):
                    a, t, _ = gradient(*shared.value, *(np.frombuffer(y, "<i4") for y in (g, b, o)))
                    gw, gt, n = gw + a, gt + t, n + 1
            if n:
                yield pd.DataFrame({"g": [np.r_[gw, gt].astype("<f8").tobytes()]})

        sums = summed(table_.mapInPandas(partial, "g binary"))
        shared.unpersist()
        if not sums:
            break
        g = np.sum(sums, axis=0)
        tail = np.cumsum(g[BUCKETS:][::-1])[::-1]
        g = np.r_[g[:BUCKETS] * strength / total - RIDGE * x[:BUCKETS], tail[0] / total, tail[1:] * steps / total]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x = x + RATE * (1 - 0.9 * step / rounds) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return (x[:BUCKETS] * strength).astype(np.float32), x[BUCKETS] + np.r_[0, np.cumsum(np.exp(x[BUCKETS + 1 :]))]


def predict(texts: list, w: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """P(grade <= k) of each text."""
    bucket, of = features(texts)
    n = np.maximum(np.bincount(of, minlength=len(texts)), 1)
    return links(np.bincount(of, weights=w[bucket], minlength=len(texts)) * SCALE / np.sqrt(n), thresholds)


def grade(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], tail: int = GRADES - 1, keep_from: float = 0.5, text: str = "text") -> DataFrame:
    """docs with expected_grade, p_tail (probability of grade `tail` or better) and keep (p_tail >= keep_from)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("expected_grade", "p_tail", "keep")

    @F.pandas_udf("expected_grade double, p_tail double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for column in parts:
            texts = [t.encode("utf-8", "replace") if t else b"" for t in column]
            below = [predict(texts[a:b], *shared.value) for a, b in batches(texts)]
            below = np.concatenate(below) if below else np.zeros((0, GRADES))
            yield pd.DataFrame({"expected_grade": (1 - below[:, :-1]).sum(axis=1), "p_tail": 1 - below[:, tail - 1]})

    out = docs.withColumn("__q", score(F.col(text)))
    return out.select(*docs.columns, "__q.expected_grade", "__q.p_tail", (F.col("__q.p_tail") >= keep_from).alias("keep"))


def ratings(labels: DataFrame) -> DataFrame:
    """doc_id and grade of each row of the labels table that says something."""
    g = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    return labels.select("doc_id", g.cast("int").alias("grade")).dropna()


def rated_documents(docs: DataFrame, labels: DataFrame, max_rated: int = MAX_RATED) -> DataFrame:
    """text and grade of about max_rated ratings at most."""
    given = ratings(labels)
    part = min(1.0, max_rated / max(given.count(), 1))
    some = given.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(part * (1 << 20)))
    return docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("text", "grade")  # max_rated pairs of numbers


def op1_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(rated_documents(docs, table(spark, sf_dir, "labels")))
    return grade(docs.select("doc_id", "text"), model).drop("text")


QUERIES = {"op1_ordinal_quality": op1_quality}
ORACLE: dict[str, str] = {}
