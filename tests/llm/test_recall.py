"""Recall of benchmark decontamination by item size and edit rate."""

import random

import pytest

from farstride.llm import decontaminate


@pytest.mark.parametrize("size", [20, 24, 32, 47, 48, 60, 80, 100, 170])
@pytest.mark.parametrize("rate", [0.05, 0.1])
def test_recall(size, rate):
    rnd = random.Random(size)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = ["".join(rnd.choices(letters, k=rnd.randint(2, 9))) for _ in range(2000)]
    items, texts = [], []
    for i in range(400):
        item = " ".join(rnd.choices(words, k=size))[: size - 1].rstrip()
        item += "z" * (size - len(item))
        text = list(item)
        for _ in range(int(rate * size)):
            at, how = rnd.randrange(len(text)), rnd.randrange(3)
            text[at : at + (how != 1)] = [] if how == 0 else rnd.choice(letters + " ")
        items.append((i, item.encode()))
        # as it comes out of normalise
        texts.append(decontaminate.normalise(f"some words before {''.join(text)} and some after"))
    found = {(d, i) for d, i, _, _ in decontaminate.Index(items, decontaminate.EDITS).find(texts)}
    # edits at a blank may add one byte's change when texts are normalised, so the truth is the exact distance
    true = {i for i, b in items if decontaminate.least_edits(b, texts[i])[0] <= int(decontaminate.EDITS * size)}
    assert len(true) > 300 and sum((i, i) in found for i in true) >= decontaminate.RECALL * len(true)


def test_signatures_lose_no_match():
    rnd = random.Random(3)
    words = ["".join(rnd.choices("abcde", k=rnd.randint(1, 5))) for _ in range(40)]
    items = [(i, " ".join(rnd.choices(words, k=rnd.choice([8, 20, 60, 250]))).encode()) for i in range(60)]
    items = [x for x in items if len(x[1]) >= decontaminate.MIN_BYTES]
    texts = []
    for _, item in items:
        text = list(item.decode())
        for _ in range(int(0.08 * len(text))):
            at = rnd.randrange(len(text))
            text[at : at + rnd.randrange(2)] = rnd.choice(["", rnd.choice("abcde")])
        texts.append(decontaminate.normalise(" ".join(rnd.choices(words, k=50)) + " " + "".join(text) + " " + " ".join(rnd.choices(words, k=50))))
    index = decontaminate.Index(items, decontaminate.EDITS)
    signed = list(index.matches(texts))
    index.lacking[:] = 1 << 30
    assert signed == list(index.matches(texts)) and len(signed) > 30


def test_long_text_is_searched_in_slices(monkeypatch):
    rnd = random.Random(4)
    words = ["".join(rnd.choices("abcdefghijklmnop", k=rnd.randint(2, 9))) for _ in range(500)]
    items = [(i, " ".join(rnd.choices(words, k=k)).encode()) for i, k in enumerate([5, 8, 30, 90, 200])]
    text = b" ".join(b" ".join([" ".join(rnd.choices(words, k=97)).encode(), item]) for _ in range(20) for _, item in items)
    index = decontaminate.Index(items, decontaminate.EDITS)
    whole = index.proposals([text, text[100:]])
    monkeypatch.setattr(decontaminate, "SLICE", 4096)
    monkeypatch.setattr(decontaminate, "PAIRS", 7)
    assert index.proposals([text, text[100:]]) == whole
    assert {(i, s) for _, i, s, _ in index.matches([text])} == {(i, text.find(t)) for i, t in items}
