"""Encoding and decoding against the sentencepiece library and a brute-force merger."""

import hashlib
import random

import numpy as np
import pytest

from fieldlens.llm import pieces

TEXTS = [None, "", " ", "  a  b ", "\n\n", "the theory of the thing", "▁a▁", "a\x00b", "<s>[INST]</s>", "日本語 テスト",
         "😀 ok", "é ﬁ  x​y", "x" * 300, "ab" * 5000, " ".join(f"w{i} long, words." for i in range(20_000)),
         "same", "same"]


@pytest.fixture(scope="session")
def model():
    return pieces.Vocabulary(pieces.model_bytes())


@pytest.fixture(scope="session")
def library():
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_proto=pieces.model_bytes())


def packed(ids):
    return np.array(ids, "<u4").tobytes()


def test_encode_and_decode_equal_the_library(spark, library):
    rows = spark.createDataFrame([(i, t, "x", b"y") for i, t in enumerate(TEXTS)],
                                 "doc_id long, text string, ids string, decoded binary")
    out = pieces.encode_texts(rows)
    assert out.columns == [*rows.columns, "pieces"]
    got = {r.doc_id: r.pieces for r in out.collect()}
    for i, t in enumerate(TEXTS):
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        assert (bytes(got[i].ids), got[i].decoded, got[i].agrees) == (packed(ids), library.decode(ids), True)
    again = pieces.decode_ids(out.select("doc_id", "pieces.ids"), out="text")
    assert {r.doc_id: r.text for r in again.collect()} == {i: r.decoded for i, r in got.items()}
    longs = pieces.unpack(out.select("doc_id", "pieces.ids")).where("doc_id = 5").first().ids
    assert longs == library.encode(TEXTS[5], add_bos=True, add_eos=True)
    assert pieces.encode_texts(rows.where("false")).count() == 0
    none = spark.createDataFrame([(None,)], "ids binary")
    assert pieces.decode_ids(none).first().decoded is None


def test_query_digests(spark, library, tmp_path):
    rows = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(TEXTS)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in pieces.op11(spark, str(tmp_path)).collect()}
    for i, t in enumerate(TEXTS):
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        assert got[i] == (len(ids), hashlib.sha256(packed(ids)).hexdigest(),
                          hashlib.sha256(library.decode(ids).encode()).hexdigest(), True)


def test_random_texts_and_ids(model, library):
    rng = random.Random(7)
    names = [library.id_to_piece(i) for i in range(library.vocab_size())]
    for k in range(3000):
        if k % 2:
            text = "".join(rng.choice(names) for _ in range(rng.randrange(12))).replace("▁", " ")
        else:
            text = "".join(chr(rng.choice([rng.randrange(1, 0x250), rng.randrange(0xe000, 0x20000)])) for _ in range(20))
        ids = library.encode(text)
        assert model.encode([text], bos=False, eos=False) == [packed(ids)], text
        assert model.decode([packed(ids), b""]) == [library.decode(ids), ""], text
        ids = [rng.choice([rng.randrange(32000), rng.randrange(300), 1, 2]) for _ in range(rng.randrange(8))]
        assert model.decode([b"", packed(ids), packed(ids)]) == ["", library.decode(ids), library.decode(ids)], ids
    with pytest.raises(ValueError, match="outside the vocabulary"):
        model.decode([packed([32000])])


def brute(model, text):
    """Merge the best adjacent pair of the whole text, again and again."""
    s = list("▁" + text.replace(" ", "▁"))
    while True:
        pairs = [(model.costs[a + b], p) for p, (a, b) in enumerate(zip(s, s[1:])) if a + b in model.costs]
        if not pairs:
            return s
        _, p = min(pairs)
        s[p:p + 2] = [s[p] + s[p + 1]]


def test_agenda_equals_brute_force(model, monkeypatch):
    text = "an agenda of  pairs, merged\nby score; antidisestablishmentarianism über   alles"
    want = brute(model, text)
    parts = model.parts.findall("▁" + text.replace(" ", "▁"))
    assert [s for part in parts for s in model.merge(part)] == want
    some = [p for p in parts if len(p) > 1]
    assert model.merge_many(some) == [b"".join(model.packed[s] for s in model.merge(p)) for p in some]
    ids = b"".join(model.packed[s] if s in model.packed else b"".join(model.bytes[b] for b in s.encode()) for s in want)
    for short, parts_kept in ((0, 3), (5, 0), (40, 100_000)):
        monkeypatch.setattr(pieces, "SHORT", short)
        monkeypatch.setattr(pieces, "CACHE_PARTS", parts_kept)
        assert model.encode([text, "", text], bos=False, eos=False) == [ids, b"", ids]


def test_unused_pieces_are_taken_apart():
    model = pieces.Vocabulary(pieces.model_bytes())
    assert model.merge("▁the") == ["▁the"]
    model.unused = {"▁the"}
    assert model.merge("▁the") == ["▁t", "he"]
    assert model.encode(["the the"], bos=False, eos=False) == [2 * (model.packed["▁t"] + model.packed["he"])]


def test_other_models_are_refused():
    with pytest.raises(ValueError, match="merge-type"):
        pieces.Vocabulary(b"")
