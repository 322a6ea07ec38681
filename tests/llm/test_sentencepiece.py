import random
import struct

import pytest

from graphloom.llm import sentencepiece as sp
from graphloom.llm.queries import MODEL_FILE

TEXTS = ["", " ", "  a", "Hello  world\n\tx", "é́ ​日本", "a\x00b", "x" * 3000, "😀😀 a😀b", "    x  y   ", "the of and " * 200]


def number(n):
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def field(k, value):
    if isinstance(value, int):
        return number(k << 3) + number(value)
    if isinstance(value, float):
        return number(k << 3 | 5) + struct.pack("<f", value)
    return number(k << 3 | 2) + number(len(value)) + value


def unigram(pieces):
    """A unigram model file made by hand from (piece, score)."""
    out = b"".join(field(1, field(1, p.encode()) + field(2, 0.0) + field(3, k)) for p, k in (("<unk>", 2), ("<s>", 3), ("</s>", 3)))
    out += b"".join(field(1, field(1, p.encode()) + field(2, float(s)) + field(3, 1)) for p, s in pieces)
    return out + field(2, field(3, 1)) + field(3, field(1, b"identity") + field(3, 1) + field(4, 0) + field(5, 1))


@pytest.fixture(scope="module")
def model():
    with open(MODEL_FILE, "rb") as f:
        return sp.Model(f.read())


def test_bpe_equals_the_model_s_own_encoder(model):
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=MODEL_FILE)
    rng = random.Random(5)
    made = ["".join(rng.choice("thein or\naéß1  ▁") for _ in range(rng.randrange(60))) for _ in range(300)]
    for text in TEXTS + made:
        assert list(model.encode(text)) == own.encode(text), text
        assert model.decode(model.encode(text)) == own.decode(own.encode(text))


def test_round_trip(model):
    for text in TEXTS:
        assert model.decode(model.encode(text)) == text


def test_decoding_bytes_that_are_no_character(model):
    assert model.decode([model.byte[0xE2], model.byte[0x82]]) == "��"


def test_unigram_equals_the_library_and_the_best_of_all_segmentations():
    import sentencepiece

    rng = random.Random(3)
    pieces = [("▁", -3.1), ("a", -4.0), ("b", -4.3), ("c", -5.2), ("▁a", -2.7), ("ab", -3.3), ("abc", -4.9), ("bc", -4.1), ("▁ab", -4.6), ("cab", -6.03)]
    raw = unigram(pieces)
    own, model = sentencepiece.SentencePieceProcessor(model_proto=raw), sp.Model(raw)
    score = dict(pieces)

    def best(text):
        ways = {0: 0.0}
        for end in range(1, len(text) + 1):
            ways[end] = max(ways[at] + score[text[at:end]] for at in range(end) if text[at:end] in score)
        return ways[len(text)]

    for _ in range(300):
        text = "".join(rng.choice("abc ") for _ in range(rng.randrange(1, 30)))
        ids = list(model.encode(text))
        assert ids == own.encode(text)
        assert sum(model.score[i] for i in ids) == pytest.approx(best("▁" + text.replace(" ", "▁")), abs=1e-3)
    for text in ("axb", "xx", "abxxc", "x"):
        assert list(model.encode(text)) == own.encode(text)


def test_frames(spark):
    rows = [(1, "The thing.", "x"), (2, None, "y"), (3, "", "z"), (None, "a b", "n"), (1, "The thing.", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    out = sp.encode(docs, MODEL_FILE)
    got = out.collect()
    assert out.columns == ["doc_id", "n_tokens", "ids", "decoded"]
    assert len(got) == 5
    assert {(r.doc_id, r.decoded) for r in got} == {(a, b) for a, b, _ in rows}
    assert all(r.n_tokens == len(r.ids) for r in got)
    assert {(r.doc_id, r.text) for r in sp.decode(out, MODEL_FILE).collect()} == {(a, b or "") for a, b, _ in rows}
    assert sp.encode(docs.limit(0), MODEL_FILE).count() == 0
