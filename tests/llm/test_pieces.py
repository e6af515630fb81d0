"""Exact encoding and decoding against the library, on texts that make the encoder take pieces back."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from farstride.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
SIGNS = "abcdefghijklmnopqrstuvwxyz  \n\t▁ÄéßЖ日本語🙂\x00\x7f\x1f0123456789.,<>'\"ABCDEF²½_-"


def texts(seed=5, n=400):
    rnd = random.Random(seed)
    out = ["".join(rnd.choice(SIGNS if k % 2 else "aeinrst ") for _ in range(rnd.randint(0, 60))) for k in range(n)]
    return [*out, None, "", " ", "  ", "▁", "</s><s><0x41>", "a" * 3000, "ab" * 4000, "erere" * 900, " " * 5000, "x\n" * 3000, "".join(rnd.choice("aeinrst") for _ in range(20000)), "the river " * 60000, out[0], out[0]]


def test_encoder_gives_the_librarys_ids():
    encoder, some = pieces.Encoder(PATH), texts()
    found = [list(memoryview(x).cast("i")) for x in encoder.encode(some)]
    assert found == [LIBRARY.encode(t or "") for t in some]
    alone = pieces.Encoder(PATH)  # the path of long units
    assert [alone.unit("▁" + t.replace(" ", "▁")) if t else [] for t in some[:200]] == found[:200]


def test_neighbours_are_compatible_as_merging_has_it():
    encoder = pieces.Encoder(PATH)
    for word in ("▁international", "▁unhappiness", "▁straße", "aaaaaaaaa"):
        ids = encoder.unit(word)
        assert [encoder.text[i] for i in ids] == encoder.merged(word)
        assert all(encoder.compatible(a, b) for a, b in zip(ids, ids[1:]))


def test_decoder_gives_the_librarys_texts():
    decoder, rnd = pieces.Decoder(PATH), random.Random(2)
    for k in range(3000):
        ids = [rnd.randrange(32000) if k % 3 else rnd.randrange(300) for _ in range(rnd.randint(0, 9))]
        assert decoder.decode(ids) == LIBRARY.decode(ids), ids


def test_whole_tables_with_nulls_repeats_and_clashing_columns(spark):
    some = texts(n=60)
    rows = [(k % 70, t, "own", "own") for k, t in enumerate(some)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, IDS string, decoded string").repartition(3)
    out = pieces.decode(pieces.encode(docs, PATH), PATH)
    assert sorted(out.columns) == ["decoded", "doc_id", "ids", "text"]
    got = sorted(((r.doc_id, r.text or "", r.ids, r.decoded) for r in out.collect()))
    assert got == sorted((d, t or "", x := LIBRARY.encode(t or "", add_eos=True), LIBRARY.decode(x)) for d, t, *_ in rows)
    none = pieces.decode(pieces.encode(docs.limit(0), PATH, end=False), PATH)
    assert none.count() == 0
    assert pieces.decode(spark.createDataFrame([(None,), ([],)], "ids array<int>"), PATH).collect()[0].decoded is None


def test_query_digests(spark, tmp_path):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts(n=20))], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in pieces.op11_piece_codec(spark, str(tmp_path)).join(docs, "doc_id").collect():
        ids = LIBRARY.encode(r.text or "", add_eos=True)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(LIBRARY.decode(ids)))


def test_other_models_are_refused(monkeypatch):
    model = pieces.read_model(PATH)
    model.pieces[300].type = 4
    with pytest.raises(ValueError):
        monkeypatch.setattr("builtins.open", lambda *a: __import__("io").BytesIO(model.SerializeToString()))
        pieces.read_model("any")
