"""Alignment of two tokenizers against a plain walk over both tokens' ends."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from farstride.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SIGNS = "abcdefghijklmnopqrstuvwxyz  \n\t▁ÄéßЖ日本語🙂\x00\x7f\x85\xa0\xad\x1f0123456789.,<>'\"ABCDEF²½_-"


@pytest.fixture(scope="module")
def tables():
    return alignment.Tables(A, B)


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def texts(n=300, seed=7):
    rnd = random.Random(seed)
    out = ["".join(rnd.choice(SIGNS if k % 2 else "aeinrst '.sd") for _ in range(rnd.randint(0, 60))) for k in range(n)]
    return [*out, None, "", " ", "a▁b", "<|endoftext|> </s>", "don't we'll  \n\n x", "x" * 900, " " * 400, out[2], out[2]]


def walked(text, tables, libraries):
    """n_a, n_b, groups as lists of ids."""
    a = libraries[0].encode(" " + (text or ""), add_special_tokens=False).ids
    b = libraries[1].encode(text or "")
    raw = (" " + (text or "")).encode()
    if not text or b"".join(tables.a[i] for i in a) != raw or b"".join(tables.b[i] for i in b) != raw:
        return 0, 0, []
    groups, ga, gb, i, j, at_a, at_b = [], [], [], 0, 0, 0, 0
    while i < len(a) or j < len(b):
        if at_a <= at_b:
            at_a, ga, i = at_a + len(tables.a[a[i]]), [*ga, a[i]], i + 1
        else:
            at_b, gb, j = at_b + len(tables.b[b[j]]), [*gb, b[j]], j + 1
        if at_a == at_b:
            groups, ga, gb = [*groups, (ga, gb)], [], []
    return len(a), len(b), groups


def as_text(groups):
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)


def test_query_against_a_walk(spark, tmp_path, tables, libraries):
    rows = [(k % 290, t, "own", [1]) for k, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, GROUPS string, links array<int>")
    docs.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    want = [(d, *walked(t, tables, libraries)) for d, t, *_ in rows]
    seen = Counter((a[-1], b[-1]) for *_, groups in want for a, b in groups)
    most = {}
    for (_, b), n in seen.items():
        most[b] = max(most.get(b, 0), n)
    expected = []
    for d, n_a, n_b, groups in want:
        counts = [(seen[a[-1], b[-1]], most[b[-1]]) for a, b in groups]
        digest = hashlib.sha256(as_text(groups).encode()).hexdigest() if groups else ""
        expected.append((d, n_a, n_b, len(groups), len(groups), sum(n == m for n, m in counts), sum(n for n, _ in counts), digest))
    out = alignment.op13_token_alignment(spark, str(tmp_path))
    got = [tuple(r) for r in out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()]
    assert sorted(got) == sorted(expected)


def test_overlaps_and_cuts_of_owner_arrays(tables):
    sizes = alignment.np.array([1, 2, 3])
    a, b = alignment.np.array([2, 1, 0]), alignment.np.array([0, 1, 2])  # bytes 3 2 1 and 1 2 3
    (over_a, over_b), (end_a, end_b) = alignment.owners(a, b, sizes, sizes)
    assert list(zip(over_a.tolist(), over_b.tolist())) == [(0, 0), (0, 1), (1, 2), (2, 2)]
    assert (end_a.tolist(), end_b.tolist()) == ([0, 2], [1, 2])


def test_clashing_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b", "own", 5)], "doc_id long, text string, Groups string, n_best int")
    out = alignment.with_counts(alignment.align(docs, A, B), A, B)
    assert sorted(c for c in out.columns if c.lower() in ("groups", "n_best")) == ["groups", "n_best"]
    assert out.collect()[0].groups.count("|") == out.collect()[0].n_groups == 2
    assert alignment.with_counts(alignment.align(docs.limit(0), A, B), A, B).count() == 0


def test_pairs_stay_within_the_bound(tables):
    by_bytes = {}
    for i, t in enumerate(tables.b):
        by_bytes.setdefault(t, []).append(i)
    some = tables.a[:300]
    plain = sum(bool(t) and bool(u) and (t.endswith(u) or u.endswith(t)) for t in some for u in tables.b)
    assert alignment.pair_bound(some, tables.b) == plain
