"""Token counts of whole texts by a public tokenizer, with overlap resynchronisation for huge documents.

A text of up to CHUNK characters is encoded at once. A longer one becomes overlapping chunks, which Spark may
encode in different tasks. Each chunk reports, for its two overlap zones, the stable boundaries: offsets where a
new word of the pre-tokenizer starts. From a word start on, the words depend only on what follows, so if
two neighbours both start a word at the same offset (far enough from the ends that neither a special string nor
a cut word can reach over it), they agree with the encoding of the whole text on both sides: the left one counts up to
there, the right one from there. Where no common boundary lies in an overlap, the document is encoded again
with chunks and overlaps four times as wide, at last as one chunk.

Where the tokenizer's file says that its words are those that one pattern finds in the lower-cased text, short texts of plain Latin-1
characters take their counts from a table of word counts that the task keeps (each word is encoded once by the library); any other text, and
every text under another kind of tokenizer, is encoded by the library as a whole.

Defined cases: a null text counts as empty: 0 bytes, 0 tokens. Repeated rows are counted alike. An empty table
gives an empty result. Columns named like the results are replaced.
"""

import json
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Scratch, table

CHUNK, OVERLAP, LIMIT = 32_768, 512, 2_048
#: What a tokenizer's file has if its words are those of a pattern (Split, Removed, inverted) over the normalised text.
NORMALISED = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
#: Words that a task keeps the counts of.
KEPT = 1 << 18


def load(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def rule(path: str) -> tuple:
    """Pattern of words (None if the words aren't those of one pattern over lower-cased text) and special strings."""
    spec = json.loads(Path(path).read_text())
    split, *rest = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
    found = split.get("type") == "Split" and split["behavior"] == "Removed" and split["invert"] and "Regex" in split["pattern"]
    known = found and rest == [BYTES] and (spec["normalizer"] or {}).get("normalizers") == NORMALISED
    return regex.compile(split["pattern"]["Regex"]) if known else None, [t["content"] for t in spec["added_tokens"]]


def plain(text: str, special: list[str]) -> bool:
    """Whether a word pattern over text.lower() gives the tokenizer's own words: nothing here composes or folds otherwise."""
    return not any(s in text for s in special) and (text.isascii() or max(text) <= "\xff") and not regex.search(r"[\x00-\x08\x0e-\x1f\x7f-\xa0\xad\xb5]", text)


class Counter:
    """Token counts of short texts."""

    def __init__(self, path: str):
        self.tokenizer, self.known = load(path), {}
        self.word, self.special = rule(path)

    def count(self, texts: list[str]) -> list[int]:
        words = [self.word.findall(t.lower()) if self.word and plain(t, self.special) else None for t in texts]
        new = list({w for ws in words if ws for w in ws} - self.known.keys())
        if len(self.known) + len(new) > KEPT:
            self.known, new = {}, list({w for ws in words if ws for w in ws})
        for w, e in zip(new, self.tokenizer.encode_batch(new, add_special_tokens=False), strict=True):
            self.known[w] = len(e)
        get = self.known.__getitem__
        return [sum(map(get, ws)) if ws is not None else len(self.tokenizer.encode(t, add_special_tokens=False)) for t, ws in zip(texts, words, strict=True)]


def boundaries(tokenizer, text: str, offset: int, head: int, tail: int, reach: int) -> tuple[int, list, list, list, list]:
    """Tokens of a chunk; offsets of word starts within `head` of its start and `tail` of its end, with the tokens before each."""
    e = tokenizer.encode(text, add_special_tokens=False)
    at, before, last = [], [], None
    for i, (w, (start, _)) in enumerate(zip(e.word_ids, e.offsets, strict=True)):
        if w != last or w is None:
            at.append(start)
            before.append(i)
        last = w
    n = len(text)
    first = [i for i, p in enumerate(at) if reach <= p < head]
    end = [i for i, p in enumerate(at) if n - tail <= p < n - reach]
    pick = lambda xs, ids: [xs[i] for i in ids]
    return len(e), [offset + p for p in pick(at, first)], pick(before, first), [offset + p for p in pick(at, end)], pick(before, end)


ENCODED = "n long, head array<long>, head_n array<long>, tail array<long>, tail_n array<long>"


def count_tokens(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP, limit: int = LIMIT) -> DataFrame:
    """key, n_bytes, n_tokens and over_limit of each row."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("row", F.monotonically_increasing_id())
    size = {"n_bytes": F.octet_length("text").cast("long"), "chars": F.char_length("text")}

    @F.pandas_udf("long")
    def short(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = Counter(path)
        for texts in parts:
            yield pd.Series([n for i in range(0, len(texts), 256) for n in counter.count(texts.iloc[i : i + 256].tolist())], dtype="int64")

    @F.pandas_udf(ENCODED)
    def encode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer, reach = load(path), max([32, *(len(s) + 1 for s in rule(path)[1])])  # no special string reaches so far
        for pdf in parts:
            yield pd.DataFrame([boundaries(tokenizer, *x, reach) for x in pdf.itertuples(index=False, name=None)], columns=["n", "head", "head_n", "tail", "tail_n"])

    rows = rows.withColumns(size)
    done = rows.filter(F.col("chars") <= chunk).select("key", "n_bytes", short("text").alias("n_tokens"))
    results = [done]
    # row ids are those of this reading of docs: what the first pass wrote is what later passes read
    long = scratch.save(rows.filter(F.col("chars") > chunk), "long")
    step = 0
    while True:
        stride = chunk - overlap
        # one pass cuts a text: at every stride, what lies ahead up to a chunk
        cut = F.regexp_extract_all("text", F.lit(f"(?s)(?=(.{{1,{chunk}}})).{{1,{stride}}}"), F.lit(1))
        pieces = long.select("row", "key", "n_bytes", "chars", F.posexplode(cut).alias("k", "piece")).withColumn("start", F.col("k").cast("long") * stride)
        pieces = pieces.filter((F.col("k") == 0) | (F.col("start") < F.col("chars") - overlap))
        pieces = pieces.repartition("row", "k")
        encoded = pieces.withColumn("e", encode(F.struct("piece", F.col("start"), F.lit(overlap).alias("h"), F.lit(overlap).alias("t"))))
        encoded = scratch.save(encoded.select("row", "key", "n_bytes", "k", "e.*"), f"encoded{step}")
        order = W.partitionBy("row").orderBy("k")
        common = F.array_max(F.array_intersect("tail", F.lead("head").over(order)))
        joined = encoded.withColumns({"right": common, "last": F.lead("k").over(order).isNull()}).withColumn("left", F.lag("right").over(order))
        place = lambda xs, ns, p: F.element_at(F.col(ns), F.array_position(F.col(xs), F.col(p)).cast("int"))
        own = F.when(F.col("last"), F.col("n")).otherwise(place("tail", "tail_n", "right")) - F.when(F.col("k") == 0, 0).otherwise(place("head", "head_n", "left"))
        ok = F.col("last") | F.col("right").isNotNull()
        ends = scratch.save(
            joined.select("row", "key", "n_bytes", F.when(ok & ((F.col("k") == 0) | F.col("left").isNotNull()), own).alias("own"))
            .groupBy("row", "key", "n_bytes")
            .agg(F.sum("own").alias("n_tokens"), F.bool_and(F.col("own").isNotNull()).alias("whole")),
            f"spliced{step}",
        )
        results.append(ends.filter("whole").select("key", "n_bytes", "n_tokens"))
        if ends.filter(~F.col("whole")).isEmpty():
            break
        long = long.join(ends.filter(~F.col("whole")).select("row"), "row", "left_semi")
        chunk, overlap, step = 4 * chunk, 4 * overlap, step + 1
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out.select(F.col("key").alias(key), "n_bytes", F.col("n_tokens").cast("long").alias("n_tokens"), (F.col("n_tokens") > limit).alias("over_limit"))


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op10_token_counts": op10_token_counts}
ORACLE: dict[str, str] = {}
