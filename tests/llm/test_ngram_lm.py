import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from graphloom.llm import ngram_lm as L


def test_filter_reads_counts_back():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 63, 20_000, dtype=np.uint64))
    counts = rng.geometric(0.3, len(keys)).astype(np.int64)
    slot = (keys % np.uint64(4)).astype(int)
    f = L.Filter([L.build(keys[slot == s], counts[slot == s], 1) for s in range(4)], 1)
    got, want = f.levels(keys), L.level(counts)
    assert (got >= want).all()  # never too low
    assert (got == want).mean() > 0.98
    assert (f.levels(rng.integers(0, 1 << 63, 20_000, dtype=np.uint64)) > 0).mean() < 0.02
    assert L.level(np.array([1, 2, 3, 4, 7, 8])).tolist() == [1, 2, 2, 3, 3, 4]


def test_keys_carry_the_word():
    w = L.tokens("a b C")
    assert len(w) == 4 and w[-1] == L.END and w[2] == L.tokens("c")[0]
    assert ((L.bigrams(w) >> np.uint64(56)) == (w >> np.uint64(56))).all()


def rows():
    rng = random.Random(2)
    vocabulary = [f"w{int(rng.paretovariate(1))}" for _ in range(500)]
    out = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(60))), "s") for i in range(300)]
    phrase = "some words that always stand together in this order"
    out += [(i, phrase + " " + " ".join(rng.choice(vocabulary) for _ in range(5)), "s") for i in range(300, 400)]
    return out + [(500, None, "n"), (501, "", "n"), (None, "W1 w2\x1cx", "n"), (5, out[5][1], "again")]


def test_scores(spark):
    data = rows()
    docs = spark.createDataFrame(data, "doc_id bigint, text string, score string")
    got = L.score_documents(docs).collect()
    fold = lambda i: zlib.crc32(str(i).encode()) % 10 if i is not None else 9
    toks = lambda t: [*(t or "").encode().lower().split(), None]
    c = Counter(w for i, t, _ in data if fold(i) for w in toks(t))
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), fold(i) == 0, len(toks(t)), sum(c[w] > 0 for w in toks(t)), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in toks(t)), 6)) for i, t, _ in data)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score <= 0 for r in got)
    planted = [r for r in got if r.doc_id is not None and 300 <= r.doc_id < 400 and r.held_out]
    assert planted and all(r.score > r.base_score + 8 for r in planted)
    plain = [r for r in got if r.doc_id is not None and r.doc_id < 300 and r.held_out]
    assert sum(r.score for r in plain) > sum(r.base_score for r in plain) * 1.1
    parts = {str(r.doc_id): r for r in L.score_documents(docs, part_bytes=3000).collect()}
    assert all(parts[str(r.doc_id)].base_score == pytest.approx(r.base_score, abs=1e-6) and abs(parts[str(r.doc_id)].score - r.score) < 3 for r in got)


class Exact:
    """The model by the definition, from exact counts."""

    def __init__(self, texts):
        self.toks = lambda t: [*(t or "").encode().lower().split(), None]
        self.c1, self.c2, self.c3 = Counter(), Counter(), Counter()
        for t in texts:
            w = [None, None, *self.toks(t)]
            self.c1.update(w[2:])
            self.c2.update(zip(w[1:], w[2:], strict=False))
            self.c3.update(zip(w, w[1:], w[2:], strict=False))
        self.n, self.v, self.texts = sum(self.c1.values()), len(self.c1), len(texts)
        star = lambda c: {k: float(L.VALUE[L.level(np.array([x]))[0]]) for k, x in c.items() if x >= 2}
        self.s2, self.s3 = star(self.c2), star(self.c3)
        self.t2, self.t3, self.f2, self.f3 = Counter(), Counter(), Counter(), Counter()
        for (v, _), x in self.s2.items():
            self.t2[v] += x
            self.f2[v] += 1
        for (u, v, _), x in self.s3.items():
            self.t3[u, v] += x
            self.f3[u, v] += 1

    def p(self, u, v, w, start, second):
        p = (self.c1[w] + 0.1) / (self.n + 0.1 * (self.v + 1))
        if self.t2[v]:
            e = self.f2[v] + max(0.0, (self.texts if start else self.c1[v]) - self.t2[v])
            p = (self.s2.get((v, w), 0.0) + e * p) / (self.t2[v] + e)
        if self.t3[u, v]:
            often = float(L.VALUE[L.level(np.array([self.texts]))[0]]) if start else self.s2.get((u, v), 0.0)
            e = self.f3[u, v] + max(0.0, often - self.t3[u, v])
            p = (self.s3.get((u, v, w), 0.0) + e * p) / (self.t3[u, v] + e)
        return p

    def score(self, text):
        w = [None, None, *self.toks(text)]
        return sum(math.log10(self.p(*w[i - 2 : i + 1], i == 2, i == 3)) for i in range(2, len(w)))


def test_scores_are_those_of_exact_counts(spark):
    data = rows()
    docs = spark.createDataFrame(data, "doc_id bigint, text string, score string")
    fold = lambda i: zlib.crc32(str(i).encode()) % 10 if i is not None else 9
    exact = Exact([t for i, t, _ in data if fold(i)])
    want = sorted((str(i), round(exact.score(t), 3)) for i, t, _ in data)
    for part_bytes in (L.PART_BYTES, 2000):
        got = L.score_documents(docs, part_bytes=part_bytes, bits=80).collect()
        assert sorted((str(r.doc_id), round(r.score, 3)) for r in got) == [(i, pytest.approx(x, abs=0.002)) for i, x in want]


def test_the_shares_of_a_history_add_up_to_one(spark):
    texts = [t for _, t, _ in rows()]
    model = L.fit(spark.createDataFrame([(t,) for t in texts], "text string"), bits=80)
    vocabulary = sorted({w.decode() for t in texts for w in (t or "").encode().lower().split()})
    for before in ("", "w1", "some words", "w1 w1", "w2 w1 w3", "unseen w1", "never seen", "always stand"):
        w, sizes = zip(*((x, len(x)) for x in (L.tokens(f"{before} {y}") for y in [*vocabulary, "notaword"])), strict=True)
        at = np.cumsum(sizes) - 2  # the last word, before the end
        w = np.concatenate(w)
        total = model.probabilities(w, np.array(sizes))[2][at].sum()
        end = L.tokens(before)
        total += model.probabilities(end, np.array([len(end)]))[2][-1]
        assert total == pytest.approx(1, abs=1e-5), before


def test_copies_and_repeats_score_higher(spark):
    """A text that occurs twice in training is told from one that occurs once."""
    rng = random.Random(7)
    one = [" ".join(f"a{rng.randrange(3000)}" for _ in range(60)) for _ in range(200)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(one + one[:100])], "doc_id bigint, text string")
    got = {r.doc_id: (r.score - r.base_score) / r.n_tokens for r in L.score_documents(docs).collect()}
    fold = lambda i: zlib.crc32(str(i).encode()) % 10
    twice = [got[i] for i in range(100) if fold(i) and fold(i + 200)]
    once = [got[i] for i in range(100, 200) if fold(i)]
    assert min(twice) > max(once) + 1


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert L.score_documents(docs).count() == 0
    only = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    (r,) = L.score_documents(spark.createDataFrame([(only, "a b")], "doc_id bigint, text string")).collect()
    assert r.held_out and r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score)
