"""Operators that SQL can't express, against plain Python, and their defined cases."""

import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from farstride.llm import decontaminate, jaccard, langid, lattice, mixing, neighbours, quality, sharding, suffixes, tokens
from test_operators import SCHEMA, corpus, labelled, prose, table


def test_ordinal_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(3)
    texts = [f"word{i % 4} and word{i % 3} again !!" for i in range(12)]
    bucket, of = quality.features([t.encode() for t in texts])
    grade, w, thresholds = rng.integers(0, 3, 12), np.zeros(quality.BUCKETS), np.array([-0.4, 0.9])
    used = np.unique(bucket)
    w[used] = rng.normal(size=len(used)) / 10
    by_weight, by_threshold, _ = quality.gradient(w, thresholds, grade, bucket, of)

    def likelihood(w, thresholds):
        total = 0.0
        for i in range(12):
            own = bucket[of == i]
            score = sum(w[b] for b in own) * quality.SCALE / np.sqrt(len(own))
            below = [0.0, *(1 / (1 + np.exp(score - t)) for t in thresholds), 1.0]
            total += np.log(below[grade[i] + 1] - below[grade[i]])
        return total

    for b in used:
        step = np.zeros_like(w)
        step[b] = 1e-6
        assert by_weight[b] == pytest.approx((likelihood(w + step, thresholds) - likelihood(w - step, thresholds)) / 2e-6, rel=1e-4, abs=1e-6)
    for k in range(2):
        step = np.eye(2)[k] * 1e-6
        assert by_threshold[k] == pytest.approx((likelihood(w, thresholds + step) - likelihood(w, thresholds - step)) / 2e-6, rel=1e-4, abs=1e-6)


def test_mixture_inference_in_plain_python():
    rng = np.random.default_rng(5)
    langs, logp = ["aa", "bb", "cc"], np.log(rng.random((langid.BUCKETS, 3)) + 0.02).astype(np.float32)
    rnd = random.Random(5)
    texts = [prose(rnd, n) for n in (1, 3, 8, 20, 45)] + ["", "12 !!"]
    for text, got in zip(texts, langid.infer(texts, langs, logp), strict=True):
        grams, word, _ = langid.features([text])
        n = int(word.max()) + 1 if len(word) else 0
        if not n:
            assert got == ("und", 0.0, [])
            continue
        ll = [[sum(float(logp[g, k]) for g, w in zip(grams, word, strict=True) if w == i) for k in range(3)] for i in range(n)]
        like = [[max(float(np.exp(x - max(row))), 1e-12) for x in row] for row in ll]

        def em(pi, rounds, like=like, n=n):
            for _ in range(rounds):
                shares = [[like[i][k] * pi[k] / sum(like[i][j] * pi[j] for j in range(3)) for k in range(3)] for i in range(n)]
                pi = [sum(s[k] for s in shares) / n for k in range(3)]
            return pi, sum(np.log(sum(like[i][k] * pi[k] for k in range(3))) for i in range(n))

        full, _ = em([1 / 3] * 3, langid.EM_ROUNDS)
        order = sorted(range(3), key=lambda k: -full[k])
        best = None
        for k in (1, 2, 3):
            pi = [max(full[j], 1e-6) if j in order[:k] else 0.0 for j in range(3)]
            pi, fit = em([x / sum(pi) for x in pi], langid.REFIT_ROUNDS if k > 1 else 0)
            value = fit - 0.5 * (k - 1) * np.log(max(n, 2))
            if best is None or value > best[0] + 1e-9:
                best = (value, k, pi)
        top = max(range(3), key=lambda j: best[2][j])
        assert got[0] == langs[top] and got[1] == pytest.approx(min(1.0, best[2][top]), rel=1e-6) and got[2] == [langs[j] for j in order[: best[1]]]


def test_shards_of_a_hot_group_by_sorting(spark):
    rnd = random.Random(2)
    rows = [(i, "the same long text " * 6) for i in range(150)] + [(150 + i, prose(rnd, rnd.randint(1, 60))) for i in range(150)] + [(400, "x" * 3000), (401, None), (401, None)]
    shards, tolerance = 6, 0.01
    got = sharding.shard(table(spark, rows), shards, tolerance)
    keyed = got.withColumns({"k1": F.shiftrightunsigned(F.xxhash64(F.coalesce("text", F.lit(""))), 1), "k2": F.shiftrightunsigned(F.xxhash64("doc_id"), 1)}).collect()
    ordered = sorted(keyed, key=lambda r: (r.k1, r.k2))
    assert [r.shard for r in ordered] == sorted(r.shard for r in ordered)
    total, below = sum(r["size"] for r in ordered), np.cumsum([0] + [r["size"] for r in ordered])
    for j in range(1, shards):
        at = sum(r.shard < j for r in ordered)
        largest = max([r["size"] for r in ordered[max(0, at - 1) : at + 1]] + [0])
        assert abs(below[at] - total * j / shards) <= max(tolerance * total / shards, largest)
    assert len({r.shard for r in keyed if (r.text or "").startswith("the same")}) > 1


def test_scores_sum_all_segmentations_of_all_words(spark):
    rows = corpus(15)[:30] + [(90, "stone"), (90, "stone")]
    docs, held = table(spark, rows), F.col("doc_id") % 5 == 1
    path = public_tokenizers.path("piece_bpe_32k.model")
    learned = docs.select(F.col("text").cast("binary").alias("text"), held.alias("held"))
    training = [t for d, t in rows if d % 5 != 1]
    pieces = lattice.train(lattice.word_table(learned), len(training), path)
    logp = dict(zip(pieces.surfaces, pieces.logp, strict=True))
    words = lambda t: (t or "").encode().translate(lattice.LOWER).split()
    c = Counter(w for t in training for w in words(t))
    n = sum(c.values()) + len(training)

    def forward(b):
        alpha = [0.0] + [-np.inf] * len(b)
        for j in range(1, len(b) + 1):
            for i in range(max(0, j - pieces.longest), j):
                if b[i:j] in logp:
                    alpha[j] = np.logaddexp(alpha[j], alpha[i] + logp[b[i:j]])
        return alpha[-1]

    known = {}
    for r in lattice.lm_scores(docs, held, path).collect():
        text = next(t for d, t in rows if d == r.doc_id)
        want = np.log10(lattice.WHOLE * len(training) / n + (1 - lattice.WHOLE) * np.exp(pieces.end))
        for w in words(text):
            known[w] = known[w] if w in known else np.log10(lattice.WHOLE * c[w] / n + (1 - lattice.WHOLE) * np.exp(forward(lattice.MARK + w)))
            want += known[w]
        assert r.score == pytest.approx(want, rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("rate", [0.02, 0.05, 0.1])
def test_contaminated_pairs_by_edit_distance(spark, rate):
    rnd = random.Random(int(rate * 100))
    items = [(i, prose(rnd, rnd.choice([5, 8, 14, 30]))) for i in range(24)]
    rows = [(i, prose(rnd, 40)) for i in range(20)]
    for i, item in items:
        text = list(item)
        for _ in range(int(rate * len(text) * 0.9)):
            at, how = rnd.randrange(len(text)), rnd.randrange(3)
            text[at : at + (how != 1)] = [] if how == 0 else rnd.choice("qxz")
        rows.append((100 + i, f"{prose(rnd, 9)} {''.join(text)} {prose(rnd, 9)}"))
    got = {(r.doc_id, r.item_id): r.edits for r in decontaminate.contaminated(table(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    for d, t in rows:
        for i, item in items:
            pattern = decontaminate.normalise(item)
            edits = decontaminate.least_edits(pattern, decontaminate.normalise(t))[0]
            if edits <= int(decontaminate.EDITS * len(pattern)):
                want[d, i] = edits
    assert len(want) >= 20 and got.keys() <= want.keys() and len(got) >= 0.9 * len(want) and all(e >= want[k] for k, e in got.items())


def test_repeated_rows_clashing_columns_and_ties(spark):
    """Repeated rows get equal results each, columns named like results are replaced, and a long text is taken whole."""
    rnd = random.Random(1)
    long = prose(rnd, 30_000)
    rows = [(i, prose(rnd, 30)) for i in range(12)] + [(3, None), (20, long), (20, long), (21, "tie"), (21, "tie")]
    names = ["expected_grade", "p_tail", "keep", "tokens", "p", "rate", "copies", "lang_pred", "langs", "n_bytes", "n_tokens", "size", "slot"]
    docs = table(spark, rows).withColumns({c: F.lit("old") for c in names})
    _, labels = labelled(spark, 12)
    graded = quality.grade(docs, quality.fit(quality.rated_documents(docs, labels), rounds=3))
    mixed = mixing.mix_documents(docs, labels)
    told = langid.identify(docs, langid.train(docs))
    dealt = sharding.shard(docs, 3)
    counted = tokens.count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"))
    for out, own in ((graded, "p_tail"), (mixed, "rate"), (told, "lang_pred"), (dealt, "shard"), (counted, "n_tokens")):
        got = out.select("doc_id", own).collect()
        assert len(got) == len(rows) and len(out.columns) == len(set(out.columns)) and all(r[own] != "old" for r in got)
        for d in (20, 21):
            assert len({r[own] for r in got if r.doc_id == d}) == 1
    assert {r.doc_id: r.tokens for r in mixed.collect()}[20] == 30_000
    linked = jaccard.jaccard_components(docs).collect()
    assert len(linked) == len(rows) and {r.component_id for r in linked if r.doc_id in (20, 21)} == {20, 21}
    removed = suffixes.repeated_spans(docs).collect()
    assert len(removed) == len(rows) and all(r.n_removed == 0 for r in removed)  # rows of one doc_id are one document


def test_neighbour_ties_and_repeated_rows(spark):
    df = spark.createDataFrame([(k, [1.0, 0.0]) for k in (0, 0, 3, 1, 2)] + [(9, [0.0, 1.0])], "vec_id long, embedding array<double>").withColumn("score", F.lit("old"))
    got = [(r.query_id, r["rank"], r.vec_id) for r in neighbours.search(df, df.filter("vec_id = 0")).orderBy("rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2), (0, 3, 3), (0, 4, 9)] and SCHEMA


def test_word_pattern_counts_as_the_library(spark):
    assert re.compile(tokens.rule(public_tokenizers.path("byte_bpe_50k.json"))[0] or "x") and tokens.rule(public_tokenizers.path("word_bpe_49k.json"))[0] is not None


@pytest.mark.parametrize("stretch", [3, 40, 1 << 15])
def test_long_words_by_stretches(stretch):
    rnd = random.Random(stretch)
    pieces = lattice.Pieces(*lattice.vocabulary(public_tokenizers.path("piece_bpe_32k.model")))
    for size in (1, 2, 17, 150, 600):
        word = lattice.MARK + "".join(rnd.choice(["the", "ing", "ation", "q", "é", "un", "believ", "able"]) for _ in range(size)).encode()[:size]
        by_length, by_stretch = np.zeros(len(pieces.logp)), np.zeros(len(pieces.logp))
        want = lattice.same_length([word], pieces, np.array([2.5]), by_length)[0]
        assert lattice.long_word(word, pieces, 2.5, None, stretch) == pytest.approx(want, rel=1e-12)
        assert lattice.long_word(word, pieces, 2.5, by_stretch, stretch) == pytest.approx(want, rel=1e-12)
        assert np.allclose(by_length, by_stretch, rtol=1e-9, atol=1e-12)


def test_words_of_small_batches_are_scored_together(monkeypatch):
    """Spark's batches are small; a search for every length of word in each of them cost more than the words did."""
    pieces = lattice.Pieces(*lattice.vocabulary(public_tokenizers.path("piece_bpe_32k.model")))
    rnd = random.Random(5)
    words = ["".join(rnd.choice(["the", "ing", "q", "é", "un", "\x01", "able"]) for _ in range(rnd.randint(0, 14))).encode() for _ in range(3000)]
    parts = [pd.DataFrame({"word": words[a : a + 100], "c": range(a, a + 100)}) for a in range(0, 3000, 100)]
    whole = list(lattice.gathered(iter(parts)))
    assert len(whole) == 1 and whole[0].equals(pd.concat(parts, ignore_index=True)) and not list(lattice.gathered([]))
    monkeypatch.setattr(lattice, "GATHERED", 5000)
    some = list(lattice.gathered(iter(parts)))
    assert len(some) > 2 and pd.concat(some, ignore_index=True).equals(whole[0])
    looked, find = [], pieces.find
    monkeypatch.setattr(pieces, "find", lambda h, kind=None: looked.append(len(h)) or find(h, kind))
    counts, each = np.zeros((2, len(pieces.logp)))
    together = lattice.lattice(words, pieces, np.arange(3000.0), counts)
    assert sum(looked) < 5 * sum(len(w) + 3 for w in words)  # each start with all lengths: about 15 times
    for i, w in enumerate(words):
        word = lattice.MARK + w
        assert lattice.long_word(word, pieces, float(i), each) == pytest.approx(together[i], rel=1e-12)
    assert np.allclose(counts, each)


def test_scores_of_long_texts_long_words_and_clashing_columns(spark):
    rnd = random.Random(5)
    long = prose(rnd, 20_000)
    rows = [(i, prose(rnd, 20)) for i in range(8)] + [(20, long), (21, "ab" * 50_000), (21, "ab" * 50_000), (22, None), (None, "tie tie")]
    plain = table(spark, rows).repartition(3)
    docs = plain.withColumns({c: F.lit("old") for c in ["held_out", "base_score", "score", "word", "c", "tf", "row", "key", "held", "n_known"]})
    held, path = F.col("doc_id") == 3, public_tokenizers.path("piece_bpe_32k.model")
    got = sorted(map(tuple, lattice.lm_scores(docs, held, path).collect()), key=str)
    want = sorted(map(tuple, lattice.lm_scores(plain, held, path).collect()), key=str)
    assert [x[:5] for x in got] == [x[:5] for x in want] and np.allclose([x[5:] for x in got], [x[5:] for x in want])
    by = {x[0]: x for x in got}
    assert by[20][2] == len(long.split()) + 1 and by[21][2] == 2 and by[3][1] is True and by[22][2] == 1 and len(got) == len(rows)
