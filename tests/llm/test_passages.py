import random

import numpy as np
import pytest

from graphloom.llm import _shared
from graphloom.llm import passages as P


def best_chain(y, x):
    """By the definition: the greatest score of a chain of anchors that rise in both."""
    order = sorted(range(len(y)), key=lambda i: (y[i], x[i]))
    f = {}
    for i in order:
        f[i] = P.ANCHOR + max([0.0, *(f[j] - P.GAP * (y[i] - y[j] + x[i] - x[j]) for j in f if y[j] < y[i] and x[j] < x[i])])
    return max(f.values())


def score(y, x, c):
    return sum(P.ANCHOR - (P.GAP * (y[b] - y[a] + x[b] - x[a]) if a is not None else 0) for a, b in zip([None, *c], c, strict=False))


def test_chains():
    rng = random.Random(1)
    for _ in range(100):
        n = rng.randrange(1, 40)
        y, x = np.array([rng.randrange(200) for _ in range(n)]), np.array([rng.randrange(200) for _ in range(n)])
        got = P.chains(y, x)
        assert sorted(i for c in got for i in c) == list(range(n))
        for c in got:
            assert all(y[a] < y[b] and x[a] < x[b] for a, b in zip(c, c[1:], strict=False))
        assert score(y, x, got[0]) == pytest.approx(best_chain(y, x))


def test_seeds_are_shared_by_shared_runs():
    rng = np.random.default_rng(2)
    run = rng.integers(0, 1 << 63, P.K + P.WINDOW - 1, dtype=np.uint64)
    for _ in range(50):
        a, b = (np.concatenate([rng.integers(0, 1 << 63, rng.integers(0, 40), dtype=np.uint64), run, rng.integers(0, 1 << 63, 9, dtype=np.uint64)]) for _ in range(2))
        assert set(P.seeds(a)[0].tolist()) & set(P.seeds(b)[0].tolist())
    assert len(P.seeds(run[: P.K - 1])[0]) == 0 and len(P.seeds(run[: P.K])[0]) == 1


def test_extend():
    a = np.arange(100, dtype=np.uint32)
    b = np.concatenate([a[:40], [999], a[41:70], a[72:]]).astype(np.uint32)
    assert P.extend(a, b, 0, 0) == (100, 98, 97)
    assert P.extend(a, np.concatenate([a[:30], a[:30] + 500]).astype(np.uint32), 0, 0) == (30, 30, 30)


def test_remove_spans():
    assert P.remove_spans("a b  c\nd e", [(1, 3)]) == "a d e"
    assert P.remove_spans("a b  c\nd e", [(0, 2), (1, 5)]) == ""
    assert P.remove_spans(" a\x1cb c ", [(1, 2)]) == " a\x1cb "
    assert P.remove_spans("a b", []) == "a b"


def words(rng, n):
    return [f"w{rng.randrange(4000)}" for _ in range(n)]


def test_planted_passages(spark):
    rng = random.Random(3)
    exact, fuzzy, short = words(rng, 60), words(rng, 120), words(rng, 30)
    rows = []
    for i in range(40):
        w = words(rng, rng.randrange(50, 300))
        at = rng.randrange(len(w))
        if i % 4 == 0:
            w[at:at] = exact
        if i % 4 == 1:
            f = list(fuzzy)
            for _ in range(6):
                f[rng.randrange(len(f))] = "edited"
            w[at:at] = f
        if i % 4 == 2:
            w[at:at] = short
        rows.append((i, " ".join(w), "z"))
    copy = rows[3][1]
    rows += [(50, copy.upper(), "z"), (51, None, "z"), (52, "", "z"), (53, "one two", "z"), (None, copy, "z"), (50, copy.upper(), "z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ref_id string")
    got = P.find_passages(docs).collect()
    texts = {i: (t or "").lower().split() for i, t, _ in rows}
    found = {}
    for r in got:
        assert r.ref_id < r.doc_id and r.to_word - r.from_word >= P.MIN_WORDS and r.equal_words >= P.MIN_IDENTITY * (r.to_word - r.from_word)
        found.setdefault(r.doc_id, set()).update(range(r.from_word, r.to_word))
    for i in range(1, 40):
        w = texts[i]
        if i % 4 == 0:
            at = next(k for k in range(len(w)) if w[k : k + 60] == exact)
            assert set(range(at, at + 60)) <= found[i]
        elif i % 4 == 1 and i > 1:
            assert len(found[i]) >= 110
        else:
            assert i not in found
    assert len(found[50]) == len(texts[50])
    assert 0 not in found and None not in found
    left = P.without_repeats(docs)
    assert left.columns == docs.columns and left.count() == len(rows)
    kept = {r.doc_id: r.text for r in left.collect() if r.doc_id is not None}
    assert kept[50] == "" and kept[51] is None and kept[3] == copy
    assert sum(" ".join(exact[5:55]) in (t or "") for t in kept.values()) == 1
    assert P.find_passages(docs.limit(0)).count() == 0


def test_every_fifth_word_replaced(spark):
    rng = random.Random(5)
    passage = words(rng, 60)
    edited = [w if i % 5 else f"e{i}" for i, w in enumerate(passage)]
    rows = [(1, " ".join(words(rng, 40) + passage + words(rng, 40))), (2, " ".join(words(rng, 30) + edited + words(rng, 30)))]
    got = P.find_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert [(r.doc_id, r.ref_id) for r in got] == [(2, 1)]
    assert got[0].from_word <= 31 and got[0].to_word >= 90 and got[0].equal_words == 48


def test_passage_whose_halves_stand_elsewhere(spark):
    rng = random.Random(6)
    rows, whole = [], []
    for at, (n, cut) in enumerate([(60, 30), (80, 40), (60, 30)]):
        passage, k = words(rng, n), 10 * at
        halves = [passage[:cut], passage[cut:]]
        parts = [*halves, passage, *(halves if at == 2 else []), passage]
        rows += [(k + i, " ".join(words(rng, 30) + p + words(rng, 30))) for i, p in enumerate(parts)]
        whole.append((k + len(parts) - 1, k + 2, n))
    got = P.find_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    for y, x, n in whole:
        assert any((r.doc_id, r.ref_id) == (y, x) and r.from_word <= 30 and r.to_word >= 30 + n for r in got)


def test_links_across_batches(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(4)
    rows = sorted({(int(s), int(y), int(p)) for s, y, p in rng.integers(0, [6, 9, 30], (200, 3))})
    want = set()
    for s, y, p in rows:
        earlier = sorted(r for r in rows if r[0] == s and r[1] < y)
        if earlier:
            before = next(r for r in earlier if r[1] == earlier[-1][1])
            want |= {(y, r[1], p, r[2]) for r in (earlier[0], before)}
    for size in (1, 7, 1000):
        monkeypatch.setattr(P, "_ROWS", size)
        batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[i : i + size], strict=True)], ["seed", "y", "y_pos"]) for i in range(0, len(rows), size)]
        assert {tuple(r.values()) for b in P.link(batches) for r in b.to_pylist()} == want


def test_shuffle_files_go_with_the_write_that_made_them(spark):
    """Seeds that are shuffled and written must not stay on disk beside the occurrences and anchors."""
    disk = lambda: {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles())}
    data = lambda names: {x for x in names if x.startswith("shuffle") and x.endswith(".data")}
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * 7 + k) % 400}" for k in range(120))) for i in range(60)], "y bigint, text string")
    before, setting = disk(), spark.conf.get(_shared._CLEANUP, None)
    seeds = _shared.materialize(P.repeated_seeds(docs, 4), "seeds")
    assert not data(disk() - before)
    assert seeds.count() > 0 and spark.conf.get(_shared._CLEANUP, None) == setting
