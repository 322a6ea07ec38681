import random

import pytest

from graphloom.llm import decontaminate as D


def distances(item, text):
    """By dynamic programming: for each end in text, the least distance of the item to a passage that ends there."""
    row = list(range(len(item) + 1))
    out = []
    for w in text:
        new = [0]
        for i, x in enumerate(item):
            new.append(min(row[i] + (x != w), row[i + 1] + 1, new[i] + 1))
        row = new
        out.append(row[-1])
    return out


@pytest.mark.parametrize("n", [1, 5, 63, 64, 65, 150])
def test_myers(n):
    rng = random.Random(n)
    for _ in range(20):
        item = [rng.choice("abcd") for _ in range(n)]
        text = [rng.choice("abcde") for _ in range(rng.randrange(200))]
        assert D.Pattern(item).ends(text) == distances(item, text)


def test_matches_equal_all_pairs():
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 4, 10, 25, 40])))) for i in range(30)] + [(99, "..."), (98, "")]
    m = D.Matcher(items)
    for _ in range(150):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(5, 120))]
        i, text = rng.choice(items[:30])
        passage = text.split()
        for _ in range(rng.randrange(0, 8)):
            at = rng.randrange(len(passage) + 1)
            passage[at : at + rng.randrange(2)] = rng.choice([[], [rng.choice(vocabulary)]])
        w[rng.randrange(len(w)) : 0] = passage
        doc = ", ".join(x.upper() for x in w)
        want = {}
        for k, t in items:
            iw = D.words(t)
            if iw and (d := min(distances(iw, [x.lower() for x in w]))) <= D.budget(len(iw)):
                want[k] = d
        got = {k: d for k, d, _, _ in m.matches(doc)}
        assert got == want
        for k, d, a, b in m.matches(doc):
            iw = D.words(dict(items)[k])
            assert distances(iw, [x.lower() for x in w[a:b]])[-1:] == [d] or d == len(iw)


def test_frames(spark, monkeypatch):
    rows = [(1, "x y the quick brown fox jumps over the lazy dog today z", 1), (2, "nothing here", 1), (3, None, 1), (4, "", 1), (None, "the quick brown fox jumps over the lazy dog today", 1), (1, "x y the quick brown fox jumps over the lazy dog today z", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, item_id int")
    bench = spark.createDataFrame([(7, "The quick, brown fox jumps over a lazy dog today!"), (8, None), (9, "--"), (10, "quite another thing")], "item_id bigint, text string")
    want = sorted([(1, 7, 1, 10, 2, 12)] * 2 + [(None, 7, 1, 10, 0, 10)], key=str)
    assert sorted(map(tuple, D.find_leaks(docs, bench).collect()), key=str) == want
    monkeypatch.setattr(D, "BLOCK_CHARS", 25)
    assert sorted(map(tuple, D.find_leaks(docs, bench).collect()), key=str) == want
    kept = D.clean(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 4]  # the row without an id leaks as well
    assert D.find_leaks(docs, bench.limit(0)).count() == D.find_leaks(docs.limit(0), bench).count() == 0


def test_pieces_far_into_a_long_item(monkeypatch):
    monkeypatch.setattr(D, "find", lambda item, text: (0, 0, len(text)))  # its table grows with the square of an item
    item = [f"w{i}" for i in range(70_000)]
    text = list(item)
    for a, z in D.pieces(item, D.budget(len(item))):
        if z <= 65_600:
            text[a] = "edited"
    assert [i for i, *_ in D.Matcher([(1, " ".join(item))]).matches(" ".join(text))] == [1]
