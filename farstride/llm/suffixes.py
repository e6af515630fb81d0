"""Removal of byte strings that already start in an earlier document, by sorting sampled suffixes.

The window of SPAN bytes at a position is sampled at one suffix inside it: the one whose first GRAM bytes have the least hash
among the window's SPAN - GRAM + 1 suffixes (the first of equals). The sample depends on the window's bytes alone, so it is a cover with the property
for which a difference cover of residues is used: equal windows are sampled at the same offset, and
two suffixes need comparison only after their sampled suffixes have the same name.

1. Every window's sampled suffix gets its name (the hash of its first GRAM bytes); names met in one document only drop out.
2. The others are dealt by name. Within a name the remaining suffixes (all windows sampled there, by their offset) are
   sorted, and neighbours with equal SPAN bytes form runs; each run keeps its smallest doc_id.
3. Windows whose run has a smaller doc_id are removed from their document, with all bytes they cover.

A name that very many rows share would be one large group. The windows of such names (at most HOT_NAMES of them) are dealt by the
window's own hash instead, in packs: a task first settles what it holds (of equal windows, all but the smallest doc_id are removed there),
so of a window that half of all documents share, each task hands on one row. Both kinds go through one exchange.

Texts with the same bytes are compared once: all but the smallest doc_id lose every byte (from SPAN bytes on).

Defined cases: null text is empty; texts shorter than SPAN keep all; rows with a null doc_id lose nothing and remove nothing; rows with one doc_id
are never compared with each other; an empty table gives an empty result; columns other than the key and the text are ignored.
"""

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE, Scratch, U, batches, join_bytes, mix, table

SPAN, GRAM = 50, 20
#: Rows that a task sorts at once; rows of a name beyond which its windows are dealt one by one, and how many such names there are at most.
ROWS, HOT, HOT_NAMES = 40_000, 2_000, 1 << 20
#: Shared names are a bitmap of so many bits; what it lets through by chance has nobody to meet.
BITS, SLICE = 1 << 27, 1 << 20
MULTIPLIER = 0xD1342543DE82EF95


def rolling(b: np.ndarray, size: int) -> np.ndarray:
    """Hash of the size bytes from each position (positions where they all exist)."""
    power, have, length = BYTE[b], None, 0
    done, step = None, 1
    # binary method: powers of two of the length, joined from the left
    while step <= size:
        if size & step:
            if done is None:
                done, length = power, step
            else:
                n = min(len(done), max(0, len(power) - length))
                done = done[:n] * U(pow(MULTIPLIER, step, 2**64)) + power[length : length + n]
                length += step
        n = max(0, len(power) - step)
        power = power[:n] * U(pow(MULTIPLIER, step, 2**64)) + power[step : step + n]
        step *= 2
    return mix(done)


def samples(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Runs of windows with one sampled suffix: name, text, first window, windows, offset of the sample in the first window; and the bytes."""
    buf, starts = join_bytes(texts)
    width = SPAN - GRAM + 1
    value = rolling(buf, GRAM)
    n = len(value) - width + 1
    none = np.zeros(0, dtype=np.int64)
    if n <= 0:
        return none.astype(U), none, none, none, none, buf, starts
    h, at, size = value, np.arange(len(value), dtype=np.int32), 1
    while size < width:
        step = min(size, width - size)
        a, b = h[: len(h) - step], h[step:]
        later = b < a
        h, at = np.where(later, b, a), np.where(later, at[step:], at[: len(at) - step])
        size += step
    doc = np.repeat(np.arange(len(texts)), np.diff(starts))[:n]
    start = np.arange(n)
    inside = start + SPAN <= starts[doc + 1] - 1
    start, doc, at = start[inside], doc[inside], at[:n][inside]
    if not len(start):
        return none.astype(U), none, none, none, none, buf, starts
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)])
    count = np.diff(np.r_[new, len(start)])
    return value[at[new]], doc[new], start[new], count, at[new] - start[new], buf, starts


def names(pdf: pd.DataFrame):
    texts, ids = pdf["text"].tolist(), pdf["doc"].to_numpy()
    for a, b in batches(texts):
        name, doc, *_ = samples(texts[a:b])
        yield pd.DataFrame({"name": name.astype(np.int64), "doc": ids[a:b][doc]})


def spots(h: np.ndarray) -> np.ndarray:
    return (mix(h.astype(np.uint64)) % U(BITS)).astype(np.int64)


def bitmap(shared: DataFrame) -> np.ndarray:
    """BITS bits, packed, with one for each name."""

    def spot(parts):
        for pdf in parts:
            at = spots(pdf["name"].to_numpy())
            yield pd.DataFrame({"slice": (at // SLICE).astype("int32"), "at": (at % SLICE).astype("int32")})

    def pack(key, pdf):
        bits = np.zeros(SLICE, dtype=bool)
        bits[pdf["at"].to_numpy()] = True
        return pd.DataFrame({"slice": [key[0]], "bits": [np.packbits(bits).tobytes()]})

    rows = shared.select("name").mapInPandas(spot, "slice int, at int").groupBy("slice").applyInPandas(pack, "slice int, bits binary")
    out = np.zeros(BITS // 8, dtype=np.uint8)
    for r in rows.collect():  # BITS / 8 bytes at most
        out[r.slice * (SLICE // 8) : (r.slice + 1) * (SLICE // 8)] = np.frombuffer(r.bits, np.uint8)
    return out


def windows(context: list[bytes], name: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every window of the contexts: a key (its bytes, its sample's name and offset), its row, its place in the row."""
    buf, starts = join_bytes(context)
    count = np.diff(starts) - SPAN  # join_bytes adds a byte to each
    row = np.repeat(np.arange(len(context)), count)
    first = np.r_[0, np.cumsum(count)[:-1]]
    place = np.arange(len(row)) - np.repeat(first, count)
    h = rolling(buf, SPAN)[starts[:-1][row] + place]
    return mix(h ^ mix(name.astype(np.uint64)[row] + (offset[row] - place).astype(np.uint64))), row, place


def runs(doc: np.ndarray, start: np.ndarray, row: np.ndarray, place: np.ndarray) -> pd.DataFrame:
    """doc, first and count of runs of consecutive windows to remove."""
    order = np.lexsort((place, row))
    row, place = row[order], place[order]
    new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1)]) if len(row) else np.zeros(0, dtype=int)
    return pd.DataFrame({"doc": doc[row[new]], "first": start[row[new]] + place[new], "count": np.diff(np.r_[new, len(row)])})


def smallest(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by (key, doc), the first of each key in it, and which rows (in that order) have a larger doc than their key's first."""
    order = np.lexsort((doc, key))
    key, doc = key[order], doc[order]
    new = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, dtype=bool)
    return order, new, doc > (doc[new][np.cumsum(new) - 1] if len(key) else doc)


def same_bytes(buf: np.ndarray, at: np.ndarray, new: np.ndarray) -> bool:
    """Whether neighbours of one key have the same SPAN bytes."""
    pairs = np.flatnonzero(~new)
    for part in np.array_split(pairs, len(pairs) // 100_000 + 1):
        if len(part) and not (buf[at[part][:, None] + np.arange(SPAN)] == buf[at[part - 1][:, None] + np.arange(SPAN)]).all():
            return False
    return True


def compare(pdf: pd.DataFrame) -> pd.DataFrame:
    """Sorts all windows of some names; those equal to a window of a smaller doc are to be removed."""
    doc, context = pdf["doc"].to_numpy(), pdf["context"].tolist()
    key, row, place = windows(context, pdf["name"].to_numpy(), pdf["offset"].to_numpy())
    order, new, gone = smallest(key, doc[row])
    row, place = row[order], place[order]
    buf, starts = join_bytes(context)
    if not same_bytes(buf, starts[row] + place, new):  # two windows of one hash: their bytes are the keys
        key = np.array([(buf[i : i + SPAN].tobytes() + b".") for i in (starts[row] + place).tolist()])
        order, new, gone = smallest(np.unique(key, return_inverse=True)[1], doc[row])
        row, place = row[order], place[order]
    return runs(doc, pdf["start"].to_numpy(), row[gone], place[gone])


def spans(runs_: list, size: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by the windows (first, count)."""
    out: list[list[int]] = []
    for first, count in sorted(runs_):
        end = first + count - 1 + SPAN
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([first, end])
    return [(a, min(b, size)) for a, b in out]


#: Rows of the one exchange: the context of a name, or a pack of windows (docs, firsts) with their keys, or of windows to remove (no keys).
DEALT = "bucket long, name long, doc long, start long, offset long, context binary, keys array<long>, docs array<long>, firsts array<long>"
COLUMNS = [c.split()[0] for c in DEALT.split(", ")]
#: Windows of frequent names that a task settles at once.
SETTLED = 500_000


def lost(doc: np.ndarray, first: np.ndarray) -> pd.DataFrame:
    """doc, first and count of runs of single windows to remove."""
    ids, row = np.unique(doc, return_inverse=True)
    return runs(ids, np.zeros(len(ids), dtype=np.int64), row, first)


def packs(by: np.ndarray, buckets: int, **arrays: np.ndarray) -> pd.DataFrame:
    """A row for each bucket, chosen by a hash of `by`, with its part of the arrays."""
    bucket = (mix(by.astype(np.uint64)) % U(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cut = np.flatnonzero(np.diff(bucket[order])) + 1
    out = {name: np.split(x[order], cut) if len(order) else [] for name, x in arrays.items()}
    return pd.DataFrame({"bucket": bucket[order][np.r_[0, cut]] if len(order) else bucket, "name": 0, "doc": 0, "start": 0, "offset": 0, "context": None, "keys": None} | out)


def settle(parts: list[tuple], buckets: int) -> pd.DataFrame:
    """Packs of windows (key, doc, first): of equal ones only the smallest doc goes on to meet others, the rest is to be removed."""
    key, doc, first = (np.concatenate(x) for x in zip(*parts, strict=True))
    order, _, gone = smallest(key, doc)
    key, doc, first = key[order], doc[order], first[order]
    on = ~gone
    return pd.concat([packs(key[on], buckets, keys=key[on], docs=doc[on], firsts=first[on]), packs(doc[gone], buckets, docs=doc[gone], firsts=first[gone])])[COLUMNS]


def resolve(pdf: pd.DataFrame) -> pd.DataFrame:
    """What is to be removed of one bucket."""
    packed, keyed = pdf["docs"].notna(), pdf["keys"].notna()
    out = [] if packed.all() else [compare(pdf[~packed])]
    for own, open_ in ((pdf[keyed], True), (pdf[packed & ~keyed], False)):
        if len(own):
            doc, first = np.concatenate(own["docs"].tolist()), np.concatenate(own["firsts"].tolist())
            if open_:
                order, _, gone = smallest(np.concatenate(own["keys"].tolist()), doc)
                doc, first = doc[order][gone], first[order][gone]
            out.append(lost(doc, first))
    return pd.concat(out)


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, kept text (binary), n_bytes, n_removed and spans (start and end of each maximal removed run) of each row."""
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("doc"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"))
    digests = scratch.save(rows.filter("doc is not null").select("doc", F.unhex(F.sha2("text", 256)).alias("digest")), "digests")
    least = digests.groupBy("digest").agg(F.min("doc").alias("owner"), F.count("*").alias("n")).filter("n > 1")
    # copies of a text that a smaller doc_id has: (doc, digest)
    copies = scratch.save(digests.join(least, "digest").filter("doc > owner").select("doc", "digest").distinct(), "copies")
    few = F.broadcast(copies) if copies.count() <= 200_000 else copies
    single = rows.filter((F.col("doc").isNotNull()) & (F.octet_length("text") >= SPAN))
    single = single.withColumn("digest", F.unhex(F.sha2("text", 256))).join(few, ["doc", "digest"], "left_anti").drop("digest")

    found = single.mapInPandas(lambda parts: (x for pdf in parts for x in names(pdf)), "name long, doc long")
    shared = found.groupBy("name").agg(F.min("doc").alias("a"), F.max("doc").alias("b"), F.count("*").alias("n")).filter("a < b").select("name", "n")
    shared = scratch.save(shared, "shared")
    total = shared.agg(F.sum("n")).first()[0] or 0
    hot_from = max(HOT, total // HOT_NAMES)  # so there are at most HOT_NAMES of them
    names_ = [r.name for r in shared.filter(F.col("n") > hot_from).select("name").collect()]
    frequent = scratch.broadcast(np.sort(np.array(names_, dtype=np.int64)))
    marks = scratch.broadcast(bitmap(shared))
    buckets = max(64, total // ROWS)

    def deal(parts):
        hot, held = [], 0
        for pdf in parts:
            texts, ids = pdf["text"].tolist(), pdf["doc"].to_numpy()
            for a, b in batches(texts):
                name, doc, start, count, offset, buf, starts = samples(texts[a:b])
                at = spots(name.astype(np.int64))
                ok = np.flatnonzero((marks.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1)
                name, doc, start, count, offset = name[ok].astype(np.int64), doc[ok], start[ok], count[ok], offset[ok].astype(np.int64)
                whole = buf.tobytes()
                out = pd.DataFrame({"name": name, "doc": ids[a:b][doc], "start": start - starts[doc], "offset": offset, "keys": None, "docs": None, "firsts": None})
                out["context"] = [whole[s : s + n + SPAN - 1] for s, n in zip(start.tolist(), count.tolist(), strict=True)]
                out["bucket"] = (mix(name.astype(np.uint64)) % U(buckets)).astype(np.int64)
                if len(frequent.value) and len(name):
                    often = frequent.value[np.minimum(np.searchsorted(frequent.value, name), len(frequent.value) - 1)] == name
                    own, out = out[often], out[~often]
                    if len(own):
                        key, row, place = windows(own["context"].tolist(), own["name"].to_numpy(), own["offset"].to_numpy())
                        hot.append((key.view(np.int64), own["doc"].to_numpy()[row], own["start"].to_numpy()[row] + place))
                        held += len(key)
                yield out[COLUMNS]
                if held > SETTLED:
                    yield settle(hot, buckets)
                    hot, held = [], 0
        if hot:
            yield settle(hot, buckets)

    gone = single.mapInPandas(deal, DEALT).groupBy("bucket").applyInPandas(resolve, "doc long, first long, count long")
    per_doc = gone.groupBy("doc").agg(F.collect_list(F.struct("first", "count")).alias("runs"))

    def cut(parts):
        for pdf in parts:
            out = []
            for doc, text, is_copy, found_ in zip(pdf["doc"], pdf["text"], pdf["copy"], pdf["runs"], strict=True):
                if is_copy and len(text) >= SPAN:
                    where = [(0, len(text))]
                else:
                    where = spans([(r["first"], r["count"]) for r in found_], len(text)) if found_ is not None else []
                ends = [0, *(x for span in where for x in span), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(ends[0::2], ends[1::2], strict=True))
                out.append((doc, kept, len(text), sum(b - a for a, b in where), where, hashlib.sha256(kept).hexdigest()))
            yield pd.DataFrame(out, columns=["doc", "kept", "n_bytes", "n_removed", "spans", "kept_sha256"]).astype({"doc": "Int64"})

    full = rows.withColumn("digest", F.unhex(F.sha2("text", 256))).join(few.withColumn("copy", F.lit(True)), ["doc", "digest"], "left").drop("digest")
    full = full.withColumn("copy", F.coalesce("copy", F.lit(False))).join(per_doc, "doc", "left")
    out = full.mapInPandas(cut, "doc long, kept binary, n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, kept_sha256 string")
    return out.withColumnRenamed("doc", key)


def op5_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    found = repeated_spans(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


QUERIES = {"op5_sampled_suffix_dedup": op5_suffix_dedup}
ORACLE = {
    "op5_sampled_suffix_dedup": """
WITH b AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS MATERIALIZED (SELECT doc_id, i, md5_number(substring(h, 2 * i + 1, 100)) AS s FROM (SELECT doc_id, h, unnest(range(0, CAST(length(h) // 2 AS BIGINT) - 49)) AS i FROM b)),
m AS (SELECT s, min(doc_id) AS m FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
g AS (SELECT w.doc_id, i FROM w JOIN m ON w.s = m.s AND m.m < w.doc_id),
r AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS new FROM g)),
p AS (SELECT doc_id, k, min(i) AS a, max(i) + 50 AS z FROM r GROUP BY doc_id, k),
q AS (SELECT *, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS l FROM p),
d AS (SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans, max(z) AS z, string_agg(substring(h, 2 * l + 1, 2 * (a - l)), '' ORDER BY a) AS kept FROM q JOIN b USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(CASE WHEN kept IS NULL THEN h ELSE kept || substring(h, 2 * z + 1) END)) AS kept_sha256 FROM b LEFT JOIN d USING (doc_id)
"""
}
