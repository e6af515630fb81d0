"""Language-model scores: the probability of a text under all its subword segmentations.

The pieces and their first weights come from an existing vocabulary file (its scores are ranks; a piece's first weight is
1 / (rank + RANK_SHIFT)). Expectation-maximisation over the counts of all training words then gives the pieces'
probabilities: EM_ROUNDS passes over the distinct training words, with forward and backward sums in log space.
A text is a sequence of words, each a lattice of pieces after a word-start mark, and one end. No piece crosses a word
start, so the probability of a text, summed over all segmentations, is the product over its words and its end.

The table of all words (with count and lattice score) grows with the corpus and stays distributed. A bounded number
(HOT) of the most frequent words is broadcast; all other words of a text meet their scores by a join on the word.

Base score: add-half unigram of whole words, as the query's contract has it.

Defined cases: null text is empty (one end token); texts are scored whole, at any length; without training rows
all counts are 0; repeated rows are scored alike (and counted as often as they appear); no piece fails a word, as
single bytes are pieces; columns other than the key and the text are ignored.
"""

from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BYTE, LOWER, Scratch, U, mix, table

HOT, EM_ROUNDS, RANK_SHIFT, SMOOTH = 1 << 16, 2, 10.0, 0.05
#: Weight of the arc over a whole word.
WHOLE = 0.7
MARK, MULTIPLIER, SLOTS = "▁".encode(), 0xD1342543DE82EF95, 22
#: What a hash may be: the beginning of a piece, or a piece.
BEGINS, ENTIRE = 1, 2
#: Words of at most so many bytes are scored together by length: of so many bytes in all, out of batches put together to as many.
SHORT, TOGETHER, GATHERED = 64, 1 << 19, 1 << 20
#: Bytes of a longer word whose arcs are held at once.
STRETCH = 1 << 15
#: Distinct words that a task counts before it hands them on.
HELD = 400_000


class Pieces:
    """Subword pieces by a hash of their bytes; single bytes are always pieces."""

    def __init__(self, surfaces: list[bytes], weights: np.ndarray):
        place: dict[bytes, int] = {}
        total: list[float] = []
        for s, w in zip(surfaces, weights, strict=True):
            if s in place:
                total[place[s]] += w
            else:
                place[s] = len(total)
                total.append(w)
        self.longest = max(map(len, place))
        hashes = np.array([self.running(s)[-1] for s in place], dtype=np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.weights = hashes[order], np.array(total)[order]
        surfaces = list(place)
        self.surfaces = [surfaces[i] for i in order]
        self.kinds = np.zeros(1 << SLOTS, dtype=np.uint8)
        begins = {h for s in place for h in self.running(s)}
        self.kinds[self.slot(np.fromiter(begins, np.uint64, len(begins)))] = BEGINS
        self.kinds[self.slot(self.hashes)] = ENTIRE
        self.set(self.weights, 0.0)

    @staticmethod
    def running(surface: bytes, values: list[int] = BYTE.tolist()) -> list[int]:
        """The hashes of a surface's beginnings, itself the last."""
        return list(accumulate((values[b] for b in surface), lambda h, x: (h * MULTIPLIER + x) & (2**64 - 1)))

    @staticmethod
    def slot(h: np.ndarray) -> np.ndarray:
        return (mix(h) >> U(64 - SLOTS)).astype(np.int64)

    def kind(self, h: np.ndarray) -> np.ndarray:
        """ENTIRE where a hash may be a piece's, BEGINS where it may be that of a piece's beginning only, else 0."""
        return self.kinds[self.slot(h)]

    def set(self, counts: np.ndarray, ends: float) -> None:
        counts = counts + SMOOTH
        self.logp = np.log(counts / (counts.sum() + ends + SMOOTH))
        self.end = float(np.log((ends + SMOOTH) / (counts.sum() + ends + SMOOTH)))

    def find(self, h: np.ndarray, kind: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are pieces', and those pieces; kind: their kinds, where known."""
        at = np.flatnonzero((self.kind(h) if kind is None else kind) == ENTIRE)
        p = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
        real = self.hashes[p] == h[at]
        return at[real], p[real]


def vocabulary(path: str) -> tuple[list[bytes], np.ndarray]:
    """Surfaces and first weights of the pieces of a sentencepiece file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    surfaces, weights = [bytes([b]) for b in range(256)], [1e-6] * 256
    for i in range(sp.get_piece_size()):
        s = sp.id_to_piece(i).encode()
        if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or MARK in s[1:]):
            surfaces.append(s)
            weights.append(1 / (max(0.0, -sp.get_score(i)) + RANK_SHIFT))
    return surfaces, np.array(weights)


def same_length(words: list[bytes], pieces: Pieces, weights: np.ndarray | None, counts: np.ndarray | None) -> np.ndarray:
    """Log-probability of words of one length; adds expected piece counts times weights to counts."""
    a = np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1)
    n, size = a.shape
    value, m = BYTE[np.ascontiguousarray(a.T)], U(MULTIPLIER)
    alpha = np.full((size + 1, n), -np.inf)
    alpha[0] = 0
    arcs = []
    for i in range(size):
        # from a start on, only words whose bytes still begin a piece are looked at
        at, h = np.arange(n), value[i]
        for j in range(i + 1, min(size, i + pieces.longest) + 1):
            if j > i + 1:
                h = h * m + value[j - 1, at]
            kind = pieces.kind(h)
            live = np.flatnonzero(kind)
            if len(live) < len(at):
                at, h, kind = at[live], h[live], kind[live]
            if not len(at):
                break
            real, p = pieces.find(h, kind)
            if len(real):
                to = at[real]
                alpha[j, to] = np.logaddexp(alpha[j, to], alpha[i, to] + pieces.logp[p])
                if counts is not None:
                    arcs.append((i, j, to, p))
    if counts is not None:
        beta = np.full((size + 1, n), -np.inf)
        beta[size] = 0
        shares = []
        for i, j, at, p in reversed(arcs):
            step = pieces.logp[p] + beta[j, at]
            beta[i, at] = np.logaddexp(beta[i, at], step)
            shares.append(weights[at] * np.exp(alpha[i, at] + step - alpha[size, at]))
        if arcs:
            counts += np.bincount(np.concatenate([p for *_, p in reversed(arcs)]), np.concatenate(shares), len(counts))
    return alpha[size]


def arcs_into(value: np.ndarray, lo: int, hi: int, pieces: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of a word that end at lo + 1 to hi, by end and length: their starts, themselves, and where those of each end begin."""
    base = max(0, lo - pieces.longest)
    part = value[base:hi]
    h, found = np.zeros(len(part), dtype=np.uint64), []
    for length in range(1, min(len(part), pieces.longest) + 1):
        h = h[: len(part) - length + 1] * U(MULTIPLIER) + part[length - 1 :]
        i, p = pieces.find(h)
        inside = i + base + length > lo
        i, p = i[inside] + base, p[inside]
        found.append((i + length, i, p))
    end, start, p = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(end, kind="stable")
    return start[order], p[order], np.searchsorted(end[order], np.arange(lo + 1, hi + 2))


def long_word(word: bytes, pieces: Pieces, weight: float, counts: np.ndarray | None, stretch: int = STRETCH) -> float:
    """The same for one long word, position by position. Only one stretch's arcs and sums are held, and the sums that reach into each
    stretch; the way back, which needs all forward sums, makes those of a stretch again."""
    value, size, reach = BYTE[np.frombuffer(word, np.uint8)], len(word), pieces.longest

    def forward(lo: int, hi: int, into: np.ndarray):
        """Sums of positions lo - reach to hi from those of lo - reach to lo, and the arcs."""
        start, p, cut = arcs_into(value, lo, hi, pieces)
        alpha = np.r_[into, np.full(hi - lo, -np.inf)]
        at, gain, cut = start - (lo - reach), pieces.logp[p], cut.tolist()
        for j in range(hi - lo):
            a, b = cut[j], cut[j + 1]
            alpha[reach + 1 + j] = np.logaddexp.reduce(alpha[at[a:b]] + gain[a:b])
        return alpha, at, p, gain, cut

    first = np.full(reach + 1, -np.inf)
    first[reach] = 0
    kept, last = [], first
    for lo in range(0, size, stretch):
        if counts is not None:
            kept.append(last)
        last = forward(lo, min(size, lo + stretch), last)[0][-reach - 1 :]
    total = float(last[-1])
    beta_in = np.full(reach + 1, -np.inf)
    beta_in[reach] = 0
    for lo in reversed(range(0, size, stretch) if counts is not None else ()):
        hi = min(size, lo + stretch)
        alpha, at, p, gain, cut = forward(lo, hi, kept.pop())
        beta = np.full(len(alpha), -np.inf)
        tail = min(len(beta), reach + 1)  # positions of later stretches' arcs that start here or before
        beta[-tail:] = beta_in[-tail:]
        for j in range(hi - lo - 1, -1, -1):
            a, b = cut[j], cut[j + 1]
            step = gain[a:b] + beta[reach + 1 + j]
            beta[at[a:b]] = np.logaddexp(beta[at[a:b]], step)
            counts[p[a:b]] += weight * np.exp(alpha[at[a:b]] + step - total)
        beta_in = beta[: reach + 1]
    return total


def lattice(words: list[bytes], pieces: Pieces, weights: np.ndarray | None = None, counts: np.ndarray | None = None) -> np.ndarray:
    """Natural log-probability of each word, over all its segmentations."""
    out = np.zeros(len(words))
    by: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by.setdefault(len(w), []).append(i)
    for size, ids in by.items():
        if size > SHORT:
            for i in ids:
                out[i] = long_word(MARK + words[i], pieces, 1.0 if weights is None else weights[i], counts)
            continue
        many = TOGETHER // (size + len(MARK))
        for a in range(0, len(ids), many):
            some = ids[a : a + many]
            out[some] = same_length([MARK + words[i] for i in some], pieces, None if weights is None else weights[some], counts)
    return out


def gathered(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches of words, put together to about GATHERED bytes: few words of one length cost as much as many."""
    held, size = [], 0
    for pdf in parts:
        held.append(pdf)
        size += sum(map(len, pdf["word"]))
        if size > GATHERED:
            yield pd.concat(held, ignore_index=True)
            held, size = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


def word_table(docs: DataFrame) -> DataFrame:
    """Every word of docs (text, held) with its count in rows that aren't held."""

    def count(parts):
        def rows(c):
            return pd.DataFrame({"word": list(c), "c": list(c.values())})

        held: Counter = Counter()
        for pdf in parts:
            for text, out in zip(pdf["text"], pdf["held"], strict=True):
                if text:
                    ws = text.translate(LOWER).split()
                    if out:
                        for w in ws:
                            held.setdefault(w, 0)
                    else:
                        held.update(ws)
                if len(held) > HELD:
                    yield rows(held)
                    held = Counter()
        yield rows(held)

    return docs.select("text", "held").mapInPandas(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def train(words: DataFrame, ends: int, path: str) -> Pieces:
    """Pieces with probabilities from all training words (word, c)."""
    spark = words.sparkSession
    pieces = Pieces(*vocabulary(path))
    for _ in range(EM_ROUNDS):
        shared = spark.sparkContext.broadcast(pieces)  # the vocabulary file's size

        def expect(parts, shared=shared):
            total = np.zeros(len(shared.value.logp))
            for pdf in gathered(parts):
                lattice(pdf["word"].tolist(), shared.value, pdf["c"].to_numpy(dtype=float), total)
            yield pd.DataFrame({"g": [total.astype("<f8").tobytes()]})

        def add(pdf):
            return pd.DataFrame({"g": [np.sum([np.frombuffer(x, "<f8") for x in pdf["g"]], axis=0).tobytes()]})

        parts = words.filter("c > 0").mapInPandas(expect, "g binary").withColumn("k", F.pmod(F.spark_partition_id(), F.lit(8)))
        sums = [np.frombuffer(r.g, "<f8") for r in parts.groupBy("k").applyInPandas(add, "g binary").collect()]  # 8 tables of the vocabulary's size
        pieces.set(np.sum(sums, axis=0) if sums else np.zeros(len(pieces.logp)), float(ends))
        shared.unpersist()
    return pieces


def lm_scores(docs: DataFrame, held: Column, path: str, key: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of each row. held: rows not learned from."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text"), F.coalesce(held, F.lit(False)).alias("held"))
    counted = scratch.save(word_table(rows), "words")
    ends = rows.filter(~F.col("held")).count()
    seen = counted.agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    n, v = (seen.n or 0) + ends, seen.v + (ends > 0)
    pieces = train(counted, ends, path)
    shared = spark.sparkContext.broadcast(pieces)

    def score_words(parts):
        for pdf in gathered(parts):
            if len(pdf):
                whole = np.log(np.maximum(WHOLE * pdf["c"].to_numpy() / max(n, 1), 1e-300))
                parted = np.log(1 - WHOLE) + lattice(pdf["word"].tolist(), shared.value)
                yield pdf.assign(lp=np.logaddexp(whole, parted) / np.log(10))

    scored = scratch.save(counted.mapInPandas(score_words, "word binary, c long, lp double"), "scores")
    scratch.drop("words")
    top = scored.orderBy(F.desc("c"), "word").limit(hot).collect()  # hot rows at most
    floor = n + 0.5 * (v + 1)
    frequent = spark.sparkContext.broadcast({bytes(r.word): (r.lp, float(np.log10((r.c + 0.5) / floor)), r.c > 0) for r in top})
    end = (float(np.log10(WHOLE * ends / max(n, 1) + (1 - WHOLE) * np.exp(pieces.end))), float(np.log10((ends + 0.5) / floor)), ends > 0)

    def framed(out):
        x = pd.DataFrame(out, columns=COLUMNS)
        # a missing id (only rows of sums have one) must not turn numbers into floats
        return x.assign(key=x["key"].astype("Int64") if kind in ("bigint", "int") else x["key"].astype(object), held=x["held"].astype("boolean"))

    def look_up(parts):
        """For each text a row of sums over its frequent words, and a row for each other word."""
        known = frequent.value
        for pdf in parts:
            out = []
            for row, text, own, out_of in zip(pdf["row"], pdf["text"], pdf["key"].astype(object), pdf["held"], strict=True):
                score, base, n_known = end[0], end[1], int(end[2])
                ws = Counter(text.translate(LOWER).split()) if text else {}
                n_tokens = 1 + sum(ws.values())
                for w, tf in ws.items():
                    if (x := known.get(w)) is None:
                        out.append((row, w, tf, 0, 0, 0.0, 0.0, None, None))
                    else:
                        score, base, n_known = score + tf * x[0], base + tf * x[1], n_known + tf * x[2]
                # no word has a blank; such keys spread these rows evenly over the join
                out.append((row, b" %d" % row, 0, n_tokens, n_known, base, score, own, out_of))
                if len(out) > 100_000:
                    yield framed(out)
                    out = []
            yield framed(out)

    # rows are numbered once, where their words are looked up; the row of sums carries what the result needs of them
    kind = rows.schema["key"].dataType.simpleString()
    schema = f"row long, word binary, tf long, n_tokens long, n_known long, base double, score double, key {kind}, held boolean"
    pieces_of = rows.withColumn("row", F.monotonically_increasing_id()).mapInPandas(look_up, schema)
    joined = pieces_of.join(scored, "word", "left")
    c, tf = F.coalesce("c", F.lit(0)), F.col("tf")
    sums = joined.groupBy("row").agg(
        F.max_by(F.struct("key", "held"), "n_tokens").alias("own"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + F.when(c > 0, tf).otherwise(0)).alias("n_known"),
        F.sum(F.col("base") + F.when(tf > 0, tf * F.log10((c + 0.5) / floor)).otherwise(0.0)).alias("base_score"),
        F.sum(F.col("score") + F.coalesce(tf * F.col("lp"), F.lit(0.0))).alias("score"),
    )
    return sums.select(F.col("own.key").alias(key), F.col("own.held").alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


COLUMNS = ["row", "word", "tf", "n_tokens", "n_known", "base", "score", "key", "held"]


def op8_lattice(spark, sf_dir: str) -> DataFrame:
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 1
    return lm_scores(table(spark, sf_dir, "documents"), held, public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op8_lattice_likelihood": op8_lattice}
ORACLE: dict[str, str] = {}
