"""Encoding and decoding by a merge-type (BPE) SentencePiece model, exactly, by backtracking over longest matches.

A text's merges are done by rising rank anywhere in the text, so its ids can't be read off from left to right. But a row of pieces is
what merging gives if and only if each piece is what merging its own characters gives, and each two neighbours, merged again as one
string, give just these two (no merge may cross the boundary between them, and whether one does depends on both sides alone). So the encoder

* finds the longest piece at every character in one Aho-Corasick pass,
* takes it if it is compatible with the piece before, which re-merging the two tells (pairs are remembered), else the next shorter one,
* and where none fits, takes back the piece before and sets the position's bit: what is kept before a position is always the encoding of
  that prefix, which is unique, so a position that failed once fails always. Each position is left once, and the work is linear.

Words are encoded by themselves, many at a time, where the vocabulary proves that no piece reaches over their boundary; a task remembers the ids of
frequent ones. Characters in no piece become the pieces of their UTF-8 bytes.

Defined cases: a null text is encoded as an empty one (the end id alone, if asked for); a null row of ids stays null; repeated rows are encoded
alike; an empty table gives an empty result; other columns are kept, those named like the results are replaced. Texts are encoded
whole, in stretches of about STRETCH characters; one word without any boundary is held with about 10 bytes a character. Models with a normaliser, user-defined or unused pieces are refused.
"""

from __future__ import annotations

import codecs
import functools
import itertools
import re
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .common import Scratch, batches, table

SPACE, STRETCH, WHOLE, LETTER = "▁", 1 << 18, r"(?s).+", r"[^\W\d_]"
#: Units that a task keeps the ids of, and pairs of pieces that it keeps the compatibility of (RECENT: bits of the table before it).
KEPT, PAIRS, RECENT = 1 << 19, 1 << 20, 20
#: Units of up to WORD characters are encoded together, LOT at once.
WORD, LOT = 64, 1 << 14
#: Piece types of the model's file.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


def read_model(path: str):
    """The model's file, if it is of the kind that this module encodes by."""
    from sentencepiece import sentencepiece_model_pb2 as pb2

    model = pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    norm, trainer = model.normalizer_spec, model.trainer_spec
    kinds = {p.type for p in model.pieces}
    if trainer.model_type != trainer.BPE or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or trainer.treat_whitespace_as_suffix:
        raise ValueError("a merge-type model without a normaliser is needed")
    if not kinds <= {NORMAL, UNKNOWN, CONTROL, BYTE} or not trainer.byte_fallback:
        raise ValueError("a model of normal pieces with byte fallback is needed")
    return model


class Encoder:
    """Ids of texts."""

    def __init__(self, path: str):
        import ahocorasick

        model = read_model(path)
        self.prefix, self.eos = model.normalizer_spec.add_dummy_prefix, model.trainer_spec.eos_id
        self.text = [p.piece for p in model.pieces]
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.score = [p.score for p in model.pieces]
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.size = [len(p) for p in self.text]
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            self.automaton.add_word(piece, i)
        self.automaton.make_automaton()
        self.shorter = [-1] * len(self.text)  # the longest other piece that a piece starts with
        for piece, i in self.ids.items():
            self.shorter[i] = next((self.ids[piece[:n]] for n in range(len(piece) - 1, 0, -1) if piece[:n] in self.ids), -1)
        inner = {c for p in self.ids for c in p}
        self.known: dict[tuple[int, int], bool] = {}
        self.words: dict[str, bytes] = {}
        self.find = self.boundaries()
        self.sizes, self.shorter_of = np.array(self.size, dtype=np.int64), np.array(self.shorter, dtype=np.int64)
        self.recent, self.recent_fits = np.full(1 << RECENT, -1, dtype=np.int64), np.zeros(1 << RECENT, dtype=bool)
        self.widest = max(self.size)
        self.single = np.zeros(0x110000, dtype=bool)  # characters that are pieces
        self.single[[ord(p) for p in self.ids if len(p) == 1]] = True
        if not all(self.single[ord(c)] for c in inner):
            raise ValueError("a piece has a character that is no piece")
        self.gap = next(chr(c) for c in range(0xE000, 0xF900) if chr(c) not in inner)  # in no piece

    def boundaries(self):
        """Pattern of the units that no merge leaves, as far as the vocabulary proves; else the whole text is one unit.

        No piece goes on over a space: a run of spaces starts a unit. Characters in no piece but their own are units. If no piece has a
        letter beside anything else but a space before it, letters and others are apart.
        """
        inner = {c for p in self.ids if len(p) > 1 for c in p}
        bare = [p.lstrip(SPACE) for p in self.ids]
        if any(SPACE in p for p in bare):
            return re.compile(WHOLE)
        alone = "".join(re.escape(chr(c)) for c in range(128) if chr(c) not in inner and chr(c) != " ")
        single = f"[{alone}]" if alone else r"(?!)"
        letters = re.compile(LETTER)
        if any(len({bool(letters.match(c)) for c in p}) > 1 for p in bare):
            return re.compile(f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+|{single}")
        others = rf"(?:[^\w{SPACE}{alone}]|(?!{single})[\d_])+"
        return re.compile(f"{SPACE}*{LETTER}+|{single}|{SPACE}*{others}|{SPACE}+")

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, as bytes of int32."""
        texts = [t if not t else (SPACE if self.prefix else "") + t.replace(" ", SPACE) for t in texts]
        units = [self.find.findall(t) if t and len(t) <= STRETCH else [] for t in texts]
        self.learn({u for us in units for u in us})
        out = [b"".join(map(self.words.__getitem__, us)) for us in units]
        for k, t in enumerate(texts):
            if t and len(t) > STRETCH:
                out[k] = b"".join(self.stretches(t))
        return out

    def stretches(self, text: str) -> Iterator[bytes]:
        at = 0
        while at < len(text):
            end = len(text) if self.find.pattern == WHOLE else self.cut(text, at + STRETCH)
            units = self.find.findall(text[at:end])
            self.learn(set(units))
            yield b"".join(map(self.words.__getitem__, units))
            at = end

    def learn(self, units: set[str]) -> None:
        """Puts the ids of all units into words; new short ones are encoded together."""
        new = [u for u in units if u not in self.words]
        if len(self.words) + len(new) > KEPT:
            self.words, new = {}, list(units)
        alone = []
        for lot in itertools.batched([u for u in new if len(u) <= WORD or alone.append(u)], LOT):
            self.words.update(zip(lot, self.side_by_side(lot), strict=True))
        for u in alone:
            self.words[u] = np.array(self.unit(u), dtype=np.int32).tobytes()

    @staticmethod
    def cut(text: str, at: int) -> int:
        """The first place from `at` on where a run of spaces starts."""
        while at < len(text):
            at = text.find(SPACE, at)
            if at < 0:
                break
            if text[at - 1] != SPACE:
                return at
            at += 1
        return len(text)

    def longest_at(self, text: str, at: np.ndarray, longest: np.ndarray) -> np.ndarray:
        """The longest piece at each place, which longest remembers (-1: not looked for yet)."""
        for p in at[longest[at] < 0].tolist():
            longest[p] = next(self.automaton.iter_long(text[p : p + self.widest]))[1]
        return longest[at]

    def side_by_side(self, lot: tuple[str, ...]) -> list[bytes]:
        """Ids of short units: each step of the backtracking is done for all of them at once."""
        text = self.gap.join(lot) + self.gap
        stop = np.cumsum([len(u) + 1 for u in lot]) - 1
        first = stop - np.array([len(u) for u in lot])
        unknown = np.zeros(len(text) + 1, dtype=np.int64)
        np.cumsum(~self.single[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)], out=unknown[1:])
        odd = unknown[stop] > unknown[first]
        found = np.fromiter(itertools.chain.from_iterable(self.automaton.iter_long(text)), dtype=np.int64).reshape(-1, 2)
        longest = np.full(len(text), -1, dtype=np.int64)
        longest[found[:, 0] - self.sizes[found[:, 1]] + 1] = found[:, 1]
        ending, failed = np.full(len(text) + 1, -1, dtype=np.int64), np.zeros(len(text) + 1, dtype=bool)
        unit = np.flatnonzero(~odd)
        at = first[unit]
        i, before = self.longest_at(text, at, longest), np.full(len(unit), -1, dtype=np.int64)
        while len(unit):
            end = at + self.sizes[i]
            fits = ~failed[end]
            fits[fits] = self.fitting(before[fits], i[fits])
            on, off = np.flatnonzero(fits), np.flatnonzero(~fits)
            ending[end[on]] = before[on] = i[on]
            at[on], i[off] = end[on], self.shorter_of[i[off]]
            go = on[at[on] < stop[unit[on]]]
            i[go] = self.longest_at(text, at[go], longest)
            back = off[i[off] < 0]
            failed[at[back]], ending[at[back]] = True, -1
            i[back] = before[back]
            at[back] -= self.sizes[i[back]]
            before[back] = ending[at[back]]
            left = at < stop[unit]
            unit, at, i, before = unit[left], at[left], i[left], before[left]
        places = np.flatnonzero(ending >= 0)
        ids, ends = ending[places].astype(np.int32), np.searchsorted(places, np.stack([first, stop]), side="right")
        return [np.array(self.unit(u), dtype=np.int32).tobytes() if o else ids[a:b].tobytes() for u, o, a, b in zip(lot, odd.tolist(), *ends.tolist(), strict=True)]

    def fitting(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """compatible() of many pairs, through a table of recent ones."""
        pair = (a + 1) * len(self.size) + b
        slot = (pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - RECENT)).astype(np.int64)
        out = self.recent_fits[slot]
        for k in np.flatnonzero(self.recent[slot] != pair).tolist():
            x = int(a[k]), int(b[k])
            fits = self.known.get(x)
            out[k] = self.recent_fits[slot[k]] = self.compatible(*x) if fits is None else fits
            self.recent[slot[k]] = pair[k]
        return out

    def unit(self, s: str) -> list[int]:
        """Ids of a string that stands alone: longest matches, taken back where neighbours don't go together."""
        longest = array("i", [-1]) * len(s)
        size = self.size
        for end, i in self.automaton.iter(s):
            longest[end - size[i] + 1] = i
        out: list[int] = []
        at = 0
        while at < len(s):
            if longest[at] < 0:  # in no piece: nothing merges with it
                out += (self.bytes[b] for b in s[at].encode("utf-8", "surrogatepass"))
                at += 1
                continue
            end = at
            while end < len(s) and longest[end] >= 0:
                end += 1
            out += self.stretch(longest, at, end)
            at = end
        return out

    def stretch(self, longest: array, first: int, stop: int) -> list[int]:
        size, shorter, known = self.size, self.shorter, self.known
        failed = bytearray(((stop - first) >> 3) + 1)  # a bit a position
        taken: list[int] = []
        at, i = first, longest[first]
        while at < stop:
            before = taken[-1] if taken else -1
            while i >= 0:
                end = at + size[i]
                k = end - first
                if end <= stop and not failed[k >> 3] >> (k & 7) & 1:
                    fits = known.get((before, i))
                    if fits is None:
                        fits = self.compatible(before, i)
                    if fits:
                        break
                i = shorter[i]
            if i >= 0:
                taken.append(i)
                at = end
                i = longest[at] if at < stop else -1
            elif taken:
                k = at - first
                failed[k >> 3] |= 1 << (k & 7)
                i = taken.pop()
                at -= size[i]
            else:  # single characters in pieces are pieces, or else longest finds none there
                raise ValueError("the vocabulary has no encoding of a text in its own characters")
        return taken

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging both as one string gives just these two (a: -1 for none)."""
        if len(self.known) >= PAIRS:
            self.known.clear()
        want = [self.text[b]] if a < 0 else [self.text[a], self.text[b]]
        fits = self.known[a, b] = self.merged("".join(want)) == want
        return fits

    def merged(self, s: str) -> list[str]:
        """A short string by the merge rule itself: of all neighbours that join to a piece, those of the best score, the first of equals, until none is left."""
        parts, ids, score = list(s), self.ids, self.score
        while True:
            best, where = None, -1
            for k in range(len(parts) - 1):
                i = ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or score[i] > best):
                    best, where = score[i], k
            if where < 0:
                return parts
            parts[where : where + 2] = [parts[where] + parts[where + 1]]


class Decoder:
    """Texts of ids, as the library's decode() gives them."""

    def __init__(self, path: str):
        model = read_model(path)
        self.prefix = model.normalizer_spec.add_dummy_prefix
        self.kind = [p.type for p in model.pieces]
        self.control = {i for i, k in enumerate(self.kind) if k == CONTROL}
        self.surface = []
        for p in model.pieces:
            special = {CONTROL: b"", UNKNOWN: model.trainer_spec.unk_surface.encode()}
            self.surface.append(bytes([int(p.piece[1:-1], 16)]) if p.type == BYTE else special.get(p.type, p.piece.replace(SPACE, " ").encode()))

    def decode(self, ids: list[int]) -> str:
        while ids and self.kind[ids[-1]] == CONTROL:
            ids = ids[:-1]
        if not self.control.isdisjoint(ids):  # bytes before and after a control piece don't join to a character
            at = next(k for k, i in enumerate(ids) if i in self.control)
            head, tail = self.decode(ids[:at]), ids[at + 1 :]
            return head + (self.raw(tail, 0) if head else self.decode(tail))
        return self.raw(ids, 1 if self.prefix and ids and self.kind[ids[0]] == NORMAL and self.surface[ids[0]][:1] == b" " else 0)

    def raw(self, ids: list[int], skip: int) -> str:
        """skip: 1 to leave out the space that the encoder put first."""
        raw = b"".join(map(self.surface.__getitem__, ids))[skip:]
        try:
            return raw.decode()
        except UnicodeDecodeError:  # bytes that aren't UTF-8: each that starts no character is replaced alone
            return raw.decode("utf-8", "replaced_alone")


codecs.register_error("replaced_alone", lambda e: ("�", e.start + 1))


@functools.lru_cache(2)
def encoder_of(path: str) -> Encoder:
    """One for all tasks of a worker: what it remembers stays."""
    return Encoder(path)


@functools.lru_cache(2)
def decoder_of(path: str) -> Decoder:
    return Decoder(path)


def lists(ids: list[bytes]) -> pa.Array:
    """An Arrow column of int lists."""
    ends = np.zeros(len(ids) + 1, dtype=np.int64)
    np.cumsum([len(x) >> 2 for x in ids], out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(ids), dtype=np.int32)))


def slices(batch: pa.RecordBatch, column: str, size: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about `size` bytes of a column's values; a longer value is alone."""
    values = batch.column(column)
    weight = pc.binary_length(values) if pa.types.is_string(values.type) or pa.types.is_large_string(values.type) else pc.list_value_length(values)
    for start, stop in batches([range(n or 0) for n in weight.to_pylist()], size):
        yield batch.slice(start, stop - start)


def with_columns(batch: pa.RecordBatch, **new: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *new.values()], names=[*batch.schema.names, *new])


def schema_with(df: DataFrame, *fields: StructField) -> StructType:
    return StructType([*df.schema.fields, *fields])


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without columns of these names, in any case."""
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c.lower() not in names))


IDS, DECODED = StructField("ids", ArrayType(IntegerType(), False)), StructField("decoded", StringType())


def encode(rows: DataFrame, path: str, text: str = "text", end: bool = True) -> DataFrame:
    """rows with ids, those of each whole text (and the end id)."""
    Scratch(rows.sparkSession)
    rows = without(rows, "ids")

    def run(parts):
        encoder = encoder_of(path)
        last = np.array([encoder.eos] if end else [], dtype=np.int32).tobytes()
        for batch in parts:
            for part in slices(batch, text, STRETCH):
                yield with_columns(part, ids=lists([x + last for x in encoder.encode(part.column(text).to_pylist())]))

    return rows.mapInArrow(run, schema_with(rows, IDS))


def decode(rows: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """rows with decoded, the text that the ids stand for."""
    Scratch(rows.sparkSession)
    rows = without(rows, "decoded")

    def run(parts):
        decoder = decoder_of(path)
        for batch in parts:
            for part in slices(batch, ids, STRETCH):
                yield with_columns(part, decoded=pa.array([None if x is None else decoder.decode(x) for x in part.column(ids).to_pylist()], pa.string()))

    return rows.mapInArrow(run, schema_with(rows, DECODED))


def op11_piece_codec(spark, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    coded = decode(encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path).drop("text"), path)
    sha = lambda x: F.sha2(x, 256)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), sha(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"), sha("decoded").alias("decoded_sha256"))


QUERIES = {"op11_piece_codec": op11_piece_codec}
ORACLE: dict[str, str] = {}
