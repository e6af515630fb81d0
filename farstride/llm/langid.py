"""Language identification as a mixture over a document's words.

Each learned language gives a word the likelihood of its byte n-grams (hashed, add-half smoothed). A document
is a mixture of languages with unknown proportions; expectation-maximisation estimates them from its words.
Then language sets of growing size (in order of proportion) are refitted, and the set with the best penalised
log-likelihood (BIC: half a log of the word count for each further language) is kept. lang_pred is the language
with the largest proportion of that set, score its proportion.

Counts of n-grams are taken over all labelled training documents; the model is (languages x BUCKETS), a bounded
table. Defined cases: null text or text without a letter gives `und`, score 0 and an empty set; without any
training rows all documents get `und`; rows with null lang are never learned from; ties go to the language
that sorts first; repeated rows are predicted alike; columns named like the results are replaced.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, U, batches, join_bytes, table, unused

#: Hash buckets of n-grams; sizes of n-grams in bytes (a word has a blank before and after it).
BUCKETS, SIZES = 1 << 16, (2, 3, 4)
NO_LETTER = regex.compile(r"[^\p{L}]+")
EM_ROUNDS, REFIT_ROUNDS = 12, 5


def features(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For lower-cased words of all texts: bucket of each n-gram, word of each n-gram, text of each word.

    Words are runs of letters; every other character counts as a blank.
    """
    clean = [t if t.isascii() else NO_LETTER.sub(" ", t) for t in (t.lower() if t else "" for t in texts)]
    buf, starts = join_bytes([t.encode("utf-8", "replace") for t in clean])
    letter = (buf >= 128) | ((buf >= 97) & (buf <= 122))
    b = np.where(letter, buf, 32).astype(np.uint64)
    edge = np.flatnonzero(np.diff(np.r_[False, letter, False]))
    first, last = edge[0::2], edge[1::2]
    word = np.cumsum(np.r_[letter[0], letter[1:] & ~letter[:-1]]) - 1  # of each byte from its first letter on
    padded = np.r_[U(32), b, U(32), U(32), U(32)]  # padded[i] is the byte before byte i
    grams, of = [], []
    value = padded[: len(b)].copy()
    for n in range(2, max(SIZES) + 1):
        value = (value << U(8)) | padded[n - 1 : n - 1 + len(b)]
        if n not in SIZES:
            continue
        # the n-gram that starts one byte before byte i lies in i's word and its two blanks
        inside = letter.copy()
        for k in range(1, n - 1):  # bytes i .. i+n-3 are letters, the last may be the blank after
            inside[: len(b) - k] &= letter[k:] if k < n - 1 else True
            inside[len(b) - k :] = False
        at = np.flatnonzero(inside)
        h = (value[at] + U(n)) * U(0x9E3779B97F4A7C15)
        grams.append((h >> U(48)).astype(np.int64) & (BUCKETS - 1))
        of.append(word[at])
    doc = np.searchsorted(starts, first, side="right") - 1
    return np.concatenate(grams), np.concatenate(of), doc


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages and log-probabilities (BUCKETS x languages) from all rows of docs whose lang isn't null."""

    def count(parts):
        for pdf in parts:
            for name, own in pdf.groupby("lang"):
                total = np.zeros(BUCKETS, dtype=np.int64)
                texts = own["text"].tolist()
                for a, b in batches(texts):
                    total += np.bincount(features(texts[a:b])[0], minlength=BUCKETS)
                yield pd.DataFrame({"lang": [name], "counts": [total.astype("<i8").tobytes()]})

    def add(key, pdf):
        total = np.sum([np.frombuffer(x, "<i8") for x in pdf["counts"]], axis=0)
        return pd.DataFrame({"lang": [key[0]], "part": [0], "counts": [total.astype("<i8").tobytes()]})

    labelled = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).dropna()
    partial = labelled.mapInPandas(count, "lang string, counts binary").withColumn("part", F.pmod(F.spark_partition_id(), F.lit(16)))
    # two rounds of sums: a task adds the tables (of fixed size) of a sixteenth of the partitions
    once = partial.groupBy("lang", "part").applyInPandas(lambda key, pdf: add(key, pdf).assign(part=key[1]), "lang string, part int, counts binary")
    summed = {r.lang: np.frombuffer(r.counts, "<i8") for r in once.groupBy("lang").applyInPandas(add, "lang string, part int, counts binary").collect()}
    langs = sorted(summed)
    if not langs:
        return [], np.zeros((BUCKETS, 0), dtype=np.float32)
    counts = np.stack([summed[x] for x in langs], axis=1) + 0.5
    return langs, np.log(counts / counts.sum(axis=0)).astype(np.float32)


def em(like: np.ndarray, doc: np.ndarray, pi: np.ndarray, rounds: int, first: np.ndarray, has: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of each document after some rounds, and the log-likelihood (without the words' own scale)."""
    n = np.bincount(doc, minlength=len(pi))[:, None]
    for _ in range(rounds):
        r = like * pi[doc]
        r /= r.sum(axis=1, keepdims=True)
        pi = pi.copy()
        pi[has] = np.add.reduceat(r, first, axis=0) / n[has]
    total = np.zeros(len(pi))
    total[has] = np.add.reduceat(np.log((like * pi[doc]).sum(axis=1)), first)
    return pi, total


def infer(texts: list, langs: list[str], logp: np.ndarray) -> list[tuple]:
    """(lang_pred, score, languages of the chosen set) of each text."""
    grams, word, doc = features(texts)
    size, count = len(langs), int(doc.shape[0])
    out = [("und", 0.0, [])] * len(texts)
    if not count or not size:
        return out
    ll = np.stack([np.bincount(word, weights=logp[grams, k], minlength=count) for k in range(size)], axis=1)
    like = np.maximum(np.exp(ll - ll.max(axis=1, keepdims=True)), 1e-12)
    has, first = np.unique(doc, return_index=True)
    n = np.bincount(doc, minlength=len(texts))
    full, _ = em(like, doc, np.full((len(texts), size), 1 / size), EM_ROUNDS, first, has)
    order = np.argsort(-full, axis=1, kind="stable")
    best, chosen, share = np.full(len(texts), -np.inf), np.ones(len(texts), dtype=int), np.zeros((len(texts), size))
    for k in range(1, size + 1):  # up to all learned languages
        pi = np.zeros_like(full)
        np.put_along_axis(pi, order[:, :k], np.maximum(np.take_along_axis(full, order[:, :k], axis=1), 1e-6), axis=1)
        pi /= pi.sum(axis=1, keepdims=True)
        pi, fit = em(like, doc, pi, REFIT_ROUNDS if k > 1 else 0, first, has)
        value = fit - 0.5 * (k - 1) * np.log(np.maximum(n, 2))
        better = value > best + 1e-9
        best[better], chosen[better], share[better] = value[better], k, pi[better]
    top = np.argmax(share, axis=1)
    for i in has:
        out[i] = (langs[top[i]], float(min(1.0, share[i, top[i]])), [langs[j] for j in order[i, : chosen[i]]])
    return out


def predictor(spark, model: tuple[list[str], np.ndarray]):
    """A column function of a text: a struct of lang_pred, score and langs."""
    shared = spark.sparkContext.broadcast(model)  # languages x BUCKETS floats

    @F.pandas_udf("lang_pred string, score double, langs array<string>")
    def predict(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        langs, logp = shared.value
        for column in parts:
            texts = column.tolist()
            rows = [row for a, b in batches(texts) for row in infer(texts[a:b], langs, logp)]
            yield pd.DataFrame(rows, columns=["lang_pred", "score", "langs"])

    return predict


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text") -> DataFrame:
    """docs with lang_pred, score and langs (the chosen set, largest proportion first)."""
    found = unused(docs, "found")
    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score", "langs")]
    told = docs.withColumn(found, predictor(docs.sparkSession, model)(F.col(text)))
    return told.select(*kept, *(f"{found}.{c}" for c in ("lang_pred", "score", "langs")))


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    held = F.coalesce(held, F.lit(False))
    model = train(docs.filter(~held))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "langs")


QUERIES = {"op3_language_mixture": op3_language_id}
ORACLE: dict[str, str] = {}
