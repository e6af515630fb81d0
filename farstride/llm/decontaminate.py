"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

The CGK random walk maps edit distance to Hamming distance: at step j it writes the byte it stands on, and moves on by
a random bit that depends on (j, byte). A hash of a window is the bytes written at some random steps of its walk.
Windows of the size of an item start at every word of a text; the walk from a start reads the same bytes for items of
any size, so one walk serves all items. Item windows are hashed at each of the item's words, so a window that meets an item anywhere
proposes the alignment of the whole item. WALKS has the length and number of walks (each with its own moves) and the samplings of each walk's
bits by the size of an item: short items have short walks, which stop inside them. They are sized by trial so that an item with EDITS edits a byte
is proposed with a probability of RECALL; the tests measure that by size and edit rate. Windows of a whole item can't reach that: of walks over 32 bytes with an edit
in every tenth, nearly all differ in most steps. Short windows of other items agree by chance, in proportion to the number of items; that is what the signatures are for.

Proposals are verified exactly, in three steps, the first of which handles whole arrays of them. An edit changes at most three of an item's trigrams, so
a part of the text that holds the item with k edits lacks at most 3 k of them. The trigrams of each item, and of each stretch of a text, are bits of a
signature; proposals whose surroundings lack more bits are dropped (items over SIGNED bytes pass). Then, an item with at most k edits keeps at least t of any k + t disjoint pieces unchanged, within
2 k bytes of their places; where fewer are found, no match is possible. Then the least
edit distance between the item and any part of the text around the alignment is computed; at most EDITS times the item's bytes are accepted.

Texts and items are lower-cased, with one blank between words. Items are broadcast in groups of bounded size, each of which
reads the documents once; documents aren't shuffled.

Defined cases: null or empty texts and items, and items of fewer than MIN_BYTES bytes, match nothing; of an item's places in a text, the
one with fewest edits (then the first) is given; repeated rows of documents are reported each, repeated items once for each distinct
(item_id, text); empty tables give an empty result; other columns are ignored.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, U, batches, join_bytes, mix, table

EDITS, RECALL, MIN_BYTES = 0.1, 0.99, 20
#: Least bytes of an item, steps of a walk (it reads about half as many bytes), sampled steps, walks, and samplings of each walk.
WALKS = ((0, 16, 8, 6, 3), (48, 32, 16, 3, 2))
STEPS, BLOOM = max(w[1] for w in WALKS), 1 << 22
GROUP_BYTES = 8 << 20
#: Words of a signature, bytes of text that have one, longest item that has one, text bytes searched at once (plus MARGIN on both sides), and pairs tested at once.
SIGNATURE, BLOCK, SIGNED, SLICE, PAIRS = 8, 16, 512, 1 << 18, 1 << 16
MARGIN = 2 * SIGNED


def walks(steps: int, sampled: int, count: int, samplings: int) -> list[tuple[np.ndarray, list[np.ndarray]]]:
    """Moves (steps x bytes) of each walk, and the sampled steps of each of its samplings."""
    rng = np.random.default_rng(11)
    return [(rng.integers(0, 2, size=(steps, 256)), [np.sort(rng.choice(steps, sampled, replace=False)) for _ in range(samplings)]) for _ in range(count)]


def hashes(buf: np.ndarray, at: np.ndarray, walk: tuple) -> list[np.ndarray]:
    """Hashes of the sampled bytes of the walk from each position, one array a sampling; buf has STEPS bytes more than the last position."""
    moves, samplings = walk
    at, out = at.copy(), [np.zeros(len(at), dtype=np.uint64) for _ in samplings]
    for j in range(max(int(s[-1]) for s in samplings) + 1):
        byte = buf.take(at)
        for h, sampled in zip(out, samplings, strict=True):
            if j in sampled:
                h *= U(0x9FB21C651E98DF25)
                h += byte
        at += moves[j].take(byte)
    return out


def normalise(text: str | None) -> bytes:
    return " ".join(text.lower().split()).encode("utf-8", "replace") if text else b""


def word_starts(buf: np.ndarray) -> np.ndarray:
    """Bytes after a blank or a line feed (texts have blanks only; one line feed ends each)."""
    gap = (buf == 32) | (buf == 10)
    return np.flatnonzero(~gap & np.r_[True, gap[:-1]])


def signatures(buf: np.ndarray, of: np.ndarray, count: int) -> np.ndarray:
    """SIGNATURE words (rows) of each of `count` owners: a bit for each trigram that starts at a byte of theirs; of has each trigram's owner, -1 for none."""
    bits = np.zeros((count, 64 * SIGNATURE), dtype=bool)
    gram = buf[:-2].astype(np.uint32) << 16 | buf[1:-1].astype(np.uint32) << 8 | buf[2:]
    bits[of[of >= 0], (gram * np.uint32(0x9E3779B1) >> np.uint32(16))[of >= 0] % (64 * SIGNATURE)] = True
    return np.ascontiguousarray(np.packbits(bits, axis=1).view(np.uint64).T)


class Stretches:
    """Signatures of all stretches of blocks of some text: those of 1, 2, 4, ... blocks, of which two make up any other."""

    def __init__(self, buf: np.ndarray):
        self.blocks = -(-len(buf) // BLOCK)
        level = signatures(np.r_[buf, np.full(2, 10, dtype=np.uint8)], np.arange(len(buf)) // BLOCK, self.blocks)
        levels, step = [level], 1
        while 2 * step * BLOCK <= 2 * MARGIN:
            level = level.copy()
            level[:, : max(0, self.blocks - step)] |= levels[-1][:, step:]
            levels.append(level)
            step *= 2
        self.words = np.stack(levels, axis=1).reshape(SIGNATURE, -1)

    def having(self, wanted: np.ndarray, item: np.ndarray, lo: np.ndarray, hi: np.ndarray, lacking: np.ndarray) -> np.ndarray:
        """Places of pairs whose stretch (bytes lo to hi) lacks at most `lacking` bits of wanted[:, item]."""
        first, last = np.clip(lo, 0, None) // BLOCK, np.minimum(hi // BLOCK, self.blocks - 1)
        level = np.frexp(np.maximum(last - first + 1, 1))[1].astype(np.int64) - 1
        a, b = level * self.blocks + first, level * self.blocks + np.maximum(first, last - (1 << level) + 1)
        left = np.arange(len(item))
        n = np.zeros(len(item), dtype=np.int64)
        for words in (range(3), range(3, SIGNATURE)):
            for w in words:
                here = self.words[w]
                n += np.bitwise_count(wanted[w].take(item) & ~(here.take(a) | here.take(b)))
            keep = np.flatnonzero(n <= lacking)
            left, item, a, b, n, lacking = (x.take(keep) for x in (left, item, a, b, n, lacking))
        return left


def least_edits(item: bytes, text: bytes) -> tuple[int, int]:
    """Least edit distance between item and any part of text, and the first end of such a part (bit-parallel)."""
    size = len(item)
    masks: dict[int, int] = {}
    for i, b in enumerate(item):
        masks[b] = masks.get(b, 0) | 1 << i
    full, top = (1 << size) - 1, 1 << (size - 1)
    up, down, score, best, end = full, 0, size, size, 0
    for j, b in enumerate(text):
        eq = masks.get(b, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph, mh = down | (full & ~(xh | up)), up & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = (ph << 1) & full, (mh << 1) & full
        up, down = mh | (full & ~(xv | ph)), ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


def pieces(item: bytes, slack: int) -> tuple[int, list[tuple[int, bytes]]]:
    """How many of the pieces (place, bytes) a copy with `slack` edits keeps at least."""
    kept = 1 + slack // 2
    cuts = [len(item) * i // (slack + kept) for i in range(slack + kept + 1)]
    return kept, [(a, item[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


class Index:
    """Hashes of all word starts of some items."""

    def __init__(self, items: list[tuple[int, bytes]], edits: float):
        self.items, self.edits = items, edits
        self.pieces = [pieces(t, int(edits * len(t))) for _, t in items]
        buf, starts = join_bytes([t for _, t in items])
        every = word_starts(buf)
        of = np.searchsorted(starts, every, side="right") - 1
        padded = np.r_[buf, np.full(STEPS, 10, dtype=np.uint8)]
        self.size = np.array([len(t) for _, t in items])
        self.slack = (edits * self.size).astype(np.int64)
        small = self.size <= SIGNED
        self.lacking = np.where(small, 3 * self.slack, 64 * SIGNATURE)
        owner = np.repeat(np.arange(len(items)), self.size + 1)[:-2]
        ends = starts[1:][owner] - 1
        inner = small[owner] & (np.arange(len(owner)) + 2 < ends)
        self.signed = signatures(buf, np.where(inner, owner, -1), len(items))
        size = self.size[of]
        self.tables = []
        for (least, steps, sampled, count, samplings), most in zip(WALKS, [w[0] for w in WALKS[1:]] + [np.inf], strict=True):
            # a walk must not read past its item: its last part belongs to earlier windows
            inside = (size >= least) & (size < most) & (every + steps // 2 <= starts[of + 1] - 1)
            at, item = every[inside], of[inside]
            if not len(at):
                continue
            tables = []
            for walk in walks(steps, sampled, count, samplings):
                sides = []
                for h in hashes(padded, at, walk):
                    order = np.argsort(h, kind="stable")
                    maybe = np.zeros(BLOOM, dtype=bool)
                    maybe[(mix(h) >> U(42)).astype(np.int64)] = True
                    sides.append((h, h[order], order, maybe))
                tables.append((walk, sides))
            self.tables.append((item, at - starts[item], tables))

    def proposals(self, texts: list[bytes]) -> list[tuple[int, int, int]]:
        """Sorted (text, item, start of the item in the text, which may lie before it)."""
        buf, starts = join_bytes(texts)
        every = word_starts(buf)
        out = []
        for a in range(0, len(buf), SLICE):
            base = max(0, a - MARGIN)
            padded = np.r_[buf[base : a + SLICE + MARGIN], np.full(STEPS, 10, dtype=np.uint8)]
            stretches = Stretches(padded[:-STEPS])
            at = every[np.searchsorted(every, a) : np.searchsorted(every, a + SLICE)] - base
            for items, offsets, tables in self.tables:
                before: list[tuple[np.ndarray, np.ndarray]] = []  # hashes of text and items of the samplings so far
                for walk, sides in tables:
                    for h, side in zip(hashes(padded, at, walk), sides, strict=True):
                        for own, w in self.pairs(h, side, before):
                            item, start = items.take(w), at.take(own) - offsets.take(w)
                            slack = self.slack.take(item)
                            keep = stretches.having(self.signed, item, start - 2 * slack, start + self.size.take(item) + 3 * slack, self.lacking.take(item))
                            doc = np.searchsorted(starts, at[own[keep]] + base, side="right") - 1
                            out.append(np.stack([doc, item[keep], start[keep] + base - starts[doc]], axis=1))
                        before.append((h, side[0]))
        return list(map(tuple, np.unique(np.concatenate(out), axis=0).tolist())) if out else []

    def pairs(self, h: np.ndarray, side: tuple, before: list[tuple[np.ndarray, np.ndarray]]):
        """Lots of (word of the text, word of an item), by place, with equal hashes here and in no sampling before."""
        _, keys, order, maybe = side
        hit = np.flatnonzero(maybe[(mix(h) >> U(42)).astype(np.int64)])
        first = np.searchsorted(keys, h[hit], "left")
        n = np.searchsorted(keys, h[hit], "right") - first
        hit, first, n = hit[n > 0], first[n > 0], n[n > 0]
        total = np.cumsum(n)
        a = 0
        while a < len(hit):
            b = max(a + 1, int(np.searchsorted(total, total[a] - n[a] + PAIRS)))
            m = n[a:b]
            own, w = np.repeat(hit[a:b], m), order.take(np.arange(m.sum()) + np.repeat(first[a:b] - np.cumsum(m) + m, m))
            for text, item in before:
                new = np.flatnonzero(text.take(own) != item.take(w))
                own, w = own.take(new), w.take(new)
            if len(own):
                yield own, w
            a = b

    def possible(self, text: bytes, item: int, start: int, slack: int) -> bool:
        """Whether the item can lie in the text with at most slack edits, aligned to start .. start + slack (each up to slack off)."""
        least, parts = self.pieces[item]
        left = len(parts)
        for place, piece in parts:
            if text.find(piece, max(0, start + place - 2 * slack), max(0, start + place + len(piece) + 3 * slack)) >= 0:
                least -= 1
                if not least:
                    return True
            left -= 1
            if left < least:
                return False
        return False

    def matches(self, texts: list[bytes]):
        """(text, item, start, edits) of each item (by its place in items) found in each text, at its best place."""
        best: dict[tuple[int, int], tuple[int, int]] = {}
        ready: dict[tuple[int, int], int] = {}
        for doc, item, start in self.proposals(texts):
            key, pattern = (doc, item), self.items[item][1]
            slack = int(self.edits * len(pattern))
            if best.get(key, (1,))[0] == 0 or ready.get(key, -len(pattern)) >= start:
                continue  # nothing better, or the last region covers this one
            ready[key] = start + slack  # alignments up to there lie within the region
            if not self.possible(texts[doc], item, start, slack):
                continue
            lo, hi = max(0, start - 2 * slack), start + len(pattern) + 3 * slack
            region = texts[doc][lo:hi]
            exact = region.find(pattern)
            edits, end = (0, exact + len(pattern)) if exact >= 0 else least_edits(pattern, region)
            if edits <= slack:
                back = len(pattern) if exact >= 0 else least_edits(pattern[::-1], region[:end][::-1])[1]
                best[key] = min(best.get(key, (edits, lo + end - back)), (edits, lo + end - back))
        for (doc, item), (edits, start) in sorted(best.items()):
            yield doc, item, start, edits

    def find(self, texts: list[bytes]):
        """The same with item ids."""
        for doc, item, start, edits in self.matches(texts):
            yield doc, self.items[item][0], start, edits


def contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", edits: float = EDITS, scratch: Scratch | None = None) -> DataFrame:
    """key, item_id, start (byte of the normalised text), edits and item_bytes of each item found in each row."""
    spark, scratch = docs.sparkSession, scratch or Scratch(docs.sparkSession)
    wanted = items.select(F.col("item_id").cast("long"), "text").dropna().distinct()
    total = wanted.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = -(-total // GROUP_BYTES)
    schema = "key long, item_id long, start long, edits int, item_bytes int"
    out = spark.createDataFrame([], schema)
    for g in range(groups):
        some = wanted.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == g).collect()  # about GROUP_BYTES at most
        texts = sorted((r.item_id, normalise(r.text)) for r in some)
        texts = [x for x in texts if len(x[1]) >= MIN_BYTES]
        if not texts:
            continue
        shared = scratch.broadcast(Index(texts, edits))

        def search(parts, shared=shared):
            index = shared.value
            for pdf in parts:
                keys, found, rows = pdf["key"].tolist(), [normalise(t) for t in pdf["text"]], []
                for a, b in batches(found):
                    rows += [(keys[a + d], *index.items[i], s, e) for d, i, s, e in index.matches(found[a:b])]
                yield pd.DataFrame([(k, i, s, e, len(t)) for k, i, t, s, e in rows], columns=["key", "item_id", "start", "edits", "item_bytes"]).astype({"key": "Int64"})

        out = out.unionByName(docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInPandas(search, schema))
    return out.withColumnRenamed("key", key)


def op9_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op9_cgk_decontamination": op9_decontamination}
ORACLE: dict[str, str] = {}
