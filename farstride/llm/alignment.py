"""Alignment of two tokenizers' tokens over the same bytes, and how well linked tokens go together over the whole corpus.

Tokenizer A (byte-level) and B (pieces of a merge-type model) cut the same bytes differently. Each byte has an owner in A and one in B: the
tokens' numbers repeated by their lengths (np.repeat). Reading both owner arrays side by side, consecutive distinct pairs are
the overlaps of A tokens with B tokens, and offsets where both owners change at once are the cuts, which part the text into groups. The tokens
that end at a cut are a link. All texts of a batch are aligned in one pass, as ends of texts are cuts.

A link's tokens end together, so one of them is a suffix of the other. Hence a corpus of any size has at most
|A| x (longest A token) x (ids per string in B) + |B| x (longest B token) x (ids per string in A) distinct pairs; pair_bound() counts the possible ones of two
vocabularies exactly (here 324,299). Their counts are aggregated by Spark and only then broadcast, after a check against that bound.

Defined cases: texts that are null or empty, or whose tokens' bytes aren't those of space + text under A or B (B reads U+2581 as a space),
have no tokens: zeros, and an empty groups string. Strings of special tokens inside texts are plain text. Repeated rows count each; an empty
table gives an empty result; other columns are kept, those named like the results are replaced. A text is held whole by one task, with some 30 bytes a byte.
"""

from __future__ import annotations

import functools
import itertools
import json
import re
import unicodedata
from array import array
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField

from . import pieces
from .common import Scratch, table
from .pieces import lists, schema_with, slices, with_columns, without

#: The words of byte-level pre-tokenizers, and the bytes that stand for themselves in their vocabularies.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
#: Texts with other characters are left to the library's own word rule.
ODD = regex.compile(r"[^\t-\r\x20-\x7e\xa1-\xac\xae-\xff]")
#: Bytes of text that are aligned at once; words of up to 48 characters that a worker keeps the ids of.
STRETCH, KEPT, LONG = 1 << 18, 1 << 18, 48


def word_pattern():
    """WORD for texts of plain Latin-1 characters, with its classes spelled out for the faster engine."""
    latin = [chr(c) for c in range(256) if not ODD.search(chr(c))]
    of = lambda kind: "".join(re.escape(c) for c in latin if unicodedata.category(c).startswith(kind))
    spaces = re.escape("".join(c for c in latin if c.isspace()))
    pattern = WORD.replace(r"[^\s\p{L}\p{N}]", f"[^{spaces}{of('L')}{of('N')}]").replace(r"\p{L}", f"[{of('L')}]").replace(r"\p{N}", f"[{of('N')}]")
    return re.compile(pattern.replace(r"\s", f"[{spaces}]").replace(r"\S", f"[^{spaces}]"))


class ByteLevel:
    """Ids of texts by a byte-level tokenizer's file, without special tokens; words of plain texts are encoded once each."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = True
        spec = json.loads(Path(path).read_text())
        pre = spec["pre_tokenizer"] or {}
        if pre.get("type") != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"] or spec["model"]["type"] != "BPE":
            raise ValueError("a byte-level tokenizer without a normaliser is needed")
        self.find = word_pattern().findall if pre["use_regex"] else None
        self.words: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as bytes of int32."""
        words = [self.find(t) if self.find and not ODD.search(t) else None for t in texts]
        units = {w for ws in words if ws for w in ws}
        new = [w for w in units if w not in self.words]
        if len(self.words) + len(new) > KEPT:
            self.words, new = {}, list(units)
        self.words.update(zip(new, self.ids(new), strict=True))
        out = [b"".join(map(self.words.__getitem__, ws)) if ws is not None else self.ids([t])[0] for t, ws in zip(texts, words, strict=True)]
        for w in new:
            if len(w) > LONG:
                del self.words[w]
        return out

    def ids(self, texts: list[str]) -> list[bytes]:
        return [array("i", e.ids).tobytes() for lot in itertools.batched(texts, 4096) for e in self.tokenizer.encode_batch_fast(list(lot), add_special_tokens=False)]


def byte_level_bytes(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level tokenizer's file."""
    others = [b for b in range(256) if b not in PRINTABLE]
    back = {chr(b): b for b in PRINTABLE} | {chr(256 + k): b for k, b in enumerate(others)}
    spec = json.loads(Path(path).read_text())
    plain = {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
    named = {i: bytes(back[c] for c in t) for t, i in spec["model"]["vocab"].items()} | plain
    return [named.get(i, b"") for i in range(max(named) + 1)]


def piece_bytes(path: str) -> list[bytes]:
    """The bytes of each id of a merge-type model: U+2581 is a space, <0xHH> a byte; nothing for control and unknown pieces."""
    kinds = {pieces.NORMAL: lambda p: p.replace(pieces.SPACE, " ").encode(), pieces.BYTE: lambda p: bytes([int(p[1:-1], 16)])}
    return [kinds.get(p.type, lambda _: b"")(p.piece) for p in pieces.read_model(path).pieces]


def pair_bound(a: list[bytes], b: list[bytes]) -> int:
    """How many pairs of an id of a and an id of b have one's bytes end with the other's."""

    def ids_of(tokens):
        count: dict[bytes, int] = {}
        for t in tokens:
            if t:
                count[t] = count.get(t, 0) + 1
        return count

    left, right = ids_of(a), ids_of(b)
    within = lambda short, long, shortest: sum(n * short.get(t[k:], 0) for t, n in long.items() for k in range(shortest, len(t)))
    return within(right, left, 0) + within(left, right, 1)


class Tables:
    """What both vocabularies say: token sizes, token bytes, and the texts that a groups string is made of."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = byte_level_bytes(path_a), piece_bytes(path_b)
        self.size_a, self.size_b = (np.array([len(t) for t in x], dtype=np.int64) for x in (self.a, self.b))
        self.signs = [f"{i}{sign}" for n, signs in ((len(self.a), ",|"), (len(self.b), ",;")) for sign in signs for i in range(n)]


@functools.lru_cache(2)
def worker(path_a: str, path_b: str) -> tuple[ByteLevel, pieces.Encoder, Tables]:
    """One for all tasks of a Python worker."""
    return ByteLevel(path_a), pieces.encoder_of(path_b), Tables(path_a, path_b)


def owners(ids_a: np.ndarray, ids_b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray):
    """Of tokens over the same bytes: overlaps (A token, B token), and the A and B token that end at each cut."""
    own_a = np.repeat(np.arange(len(ids_a), dtype=np.int32), size_a[ids_a])
    own_b = np.repeat(np.arange(len(ids_b), dtype=np.int32), size_b[ids_b])
    turn_a, turn_b = own_a[1:] != own_a[:-1], own_b[1:] != own_b[:-1]
    last = np.ones(min(len(own_a), 1), dtype=np.int64) * (len(own_a) - 1)  # the last byte ends both
    changed = np.concatenate([np.flatnonzero(turn_a | turn_b), last])
    cuts = np.concatenate([np.flatnonzero(turn_a & turn_b), last])
    return (own_a[changed], own_b[changed]), (own_a[cuts], own_b[cuts])


def group_texts(ids_a: np.ndarray, ids_b: np.ndarray, end_a: np.ndarray, end_b: np.ndarray, tables: Tables) -> tuple[np.ndarray, list[str]]:
    """Places and texts of all tokens, group by group, A before B: each id with the sign after it; end_a, end_b: last tokens of the groups."""
    n_a, n_b = np.diff(end_a, prepend=-1), np.diff(end_b, prepend=-1)
    closes_a, closes_b = np.zeros(len(ids_a), dtype=np.int64), np.zeros(len(ids_b), dtype=np.int64)
    closes_a[end_a] = closes_b[end_b] = 1
    codes = np.empty(len(ids_a) + len(ids_b), dtype=np.int64)
    before_b = np.repeat(end_b - n_b + 1, n_a)  # B tokens of earlier groups
    codes[np.arange(len(ids_a)) + before_b] = ids_a + closes_a * len(tables.a)
    upto_a = np.repeat(end_a + 1, n_b)  # A tokens up to this group's
    codes[np.arange(len(ids_b)) + upto_a] = ids_b + 2 * len(tables.a) + closes_b * len(tables.b)
    return codes, list(map(tables.signs.__getitem__, codes.tolist()))


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_overlaps", "groups", "links")
FIELDS = [StructField(c, StringType() if c == "groups" else ArrayType(LongType(), False) if c == "links" else LongType()) for c in COLUMNS]


def aligned_batch(texts: list[str | None], path_a: str, path_b: str) -> dict[str, pa.Array]:
    encoder_a, encoder_b, tables = worker(path_a, path_b)
    own = [k for k, t in enumerate(texts) if t]
    ids_a = dict(zip(own, (np.frombuffer(x, dtype=np.int32) for x in encoder_a.encode([" " + texts[k] for k in own])), strict=True))
    ids_b = dict(zip(own, (np.frombuffer(x, dtype=np.int32) for x in encoder_b.encode([texts[k] for k in own])), strict=True))
    # A's tokens are the text's bytes unless some were dropped; B's are those of the text with spaces for U+2581
    raw = {k: 1 + len(texts[k].encode("utf-8", "surrogatepass")) for k in own}
    own = [k for k in own if pieces.SPACE not in texts[k] and tables.size_a[ids_a[k]].sum() == raw[k] == tables.size_b[ids_b[k]].sum()]
    n_a, n_b = (np.zeros(len(texts), dtype=np.int64) for _ in range(2))
    for k in own:
        n_a[k], n_b[k] = len(ids_a[k]), len(ids_b[k])
    flat_a, flat_b = (np.concatenate([np.zeros(0, dtype=np.int32), *(x[k] for k in own)]) for x in (ids_a, ids_b))
    overlap, (end_a, end_b) = owners(flat_a, flat_b, tables.size_a, tables.size_b)
    _, signs = group_texts(flat_a, flat_b, end_a, end_b, tables)
    stop_a, stop_b = np.cumsum(n_a), np.cumsum(n_b)
    stops = np.searchsorted(end_a, stop_a, side="left")  # groups before the end of each text
    groups = np.diff(stops, prepend=0)
    overlaps = np.diff(np.searchsorted(overlap[0], stop_a, side="left"), prepend=0)
    ends = stop_a + stop_b
    joined = ["".join(signs[s:e])[:-1] for s, e in zip((ends - n_a - n_b).tolist(), ends.tolist(), strict=True)]
    links = flat_b[end_b].astype(np.int64) * len(tables.a) + flat_a[end_a]
    array = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], stops]).astype(np.int32)), pa.array(links))
    counts = (n_a, n_b, groups, groups, overlaps)
    return dict(zip(COLUMNS, [*(pa.array(x.astype(np.int64)) for x in counts), pa.array(joined, pa.string()), array], strict=True))


def align(rows: DataFrame, path_a: str, path_b: str, text: str = "text") -> DataFrame:
    """rows with n_a, n_b, n_groups, n_links, n_overlaps, groups (`a1,a2|b1;a3|b2,b3`) and links (B id * |A| + A id, in order)."""
    Scratch(rows.sparkSession)
    rows = without(rows, *COLUMNS)

    def run(parts):
        for batch in parts:
            for part in slices(batch, text, STRETCH):
                yield with_columns(part, **aligned_batch(part.column(text).to_pylist(), path_a, path_b))

    return rows.mapInArrow(run, schema_with(rows, *FIELDS))


def with_counts(aligned: DataFrame, path_a: str, path_b: str, scratch: Scratch | None = None) -> DataFrame:
    """aligned (stored once; with links) with n_best and count_sum: links whose pair is the most frequent one of its B id, and the pairs' frequencies."""
    scratch = scratch or Scratch(aligned.sparkSession)
    saved = scratch.save(without(aligned, "n_best", "count_sum"), "aligned")
    tables = Tables(path_a, path_b)
    pairs = saved.select(F.explode("links").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    counts = scratch.save(pairs, "pairs")
    if counts.count() > pair_bound(tables.a, tables.b):
        raise ValueError("links of tokens that don't end together")
    found = counts.orderBy("pair").toArrow()  # no more than pair_bound, whatever the corpus
    pair, n = found["pair"].to_numpy(), found["n"].to_numpy()
    b = pair // len(tables.a)
    first = np.flatnonzero(np.diff(b, prepend=-1))
    most = np.repeat(np.maximum.reduceat(n, first), np.diff(first, append=len(b))) if len(b) else n
    shared = scratch.broadcast((pair, n, n == most))

    def run(parts):
        pair, n, best = shared.value
        for batch in parts:
            links = batch.column("links")
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(links).to_numpy(zero_copy_only=False))])
            at = np.searchsorted(pair, links.flatten().to_numpy())
            total = lambda x: pa.array(np.diff(np.concatenate([[0], np.cumsum(x[at])])[ends]).astype(np.int64))
            yield with_columns(batch, n_best=total(best.astype(np.int64)), count_sum=total(n))

    return saved.mapInArrow(run, schema_with(saved, StructField("n_best", LongType()), StructField("count_sum", LongType())))


def op13_token_alignment(spark, sf_dir: str) -> DataFrame:
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    found = align(table(spark, sf_dir, "documents").select("doc_id", "text"), *paths)
    sha = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    found = found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", sha, "n_overlaps", "links")
    return with_counts(found, *paths).drop("links")


QUERIES = {"op13_token_alignment": op13_token_alignment}
ORACLE: dict[str, str] = {}
