import random

import numpy as np
import pytest
import xxhash

from graphloom.llm import simhash
from graphloom.llm._shared import connected_components


def plain_fingerprint(text, n=4):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(n, links):
    label = list(range(n))
    for a, b in links:
        x, y = label[a], label[b]
        label = [min(x, y) if z in (x, y) else z for z in label]
    return label


def test_fingerprints():
    for text in [None, "", " \t", "a", "A b", "a\x1cb c d", "One two THREE four five\nsix", "é É ß x y z", "w " * 5000 + "end of it"]:
        assert simhash.fingerprint(text) == plain_fingerprint(text), text


@pytest.mark.parametrize("budget", [0, 2, 4])
def test_trie_join_finds_every_link(budget, monkeypatch):
    monkeypatch.setattr(simhash, "LEAF", 4)
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    near = base.repeat(8) ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (240, 3), dtype=np.uint64), axis=1)
    keys = np.unique(np.concatenate([base, near]))
    d = np.bitwise_count(keys[:, None] ^ keys[None, :])
    every = np.arange(len(keys))
    want = classes(len(keys), np.argwhere(np.triu(d <= budget, 1)).tolist())
    assert simhash.trie_join(keys, every, None, budget).tolist() == want
    a, b = every[::2], every[1::2]
    cross = [(i, j) for i in a for j in b if d[i, j] <= budget]
    assert simhash.trie_join(keys, a, b, budget).tolist() == classes(len(keys), cross)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1080)] + [(2000, i) for i in range(2001, 2300)] + [(None, 3), (7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    label = classes(2400, [(a, b) for a, b in edges if a is not None])
    assert got == {n: label[n] for n in {x for a, b in edges if a is not None and a != b for x in (a, b)}}


def test_frames(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PART", 20)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(500)]
    base = [rng.choice(words) for _ in range(400)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(30)), "x") for i in range(100, 140)]
    for i in range(60):
        copy = list(base)
        copy[rng.randrange(400)] = "changed"
        rows.append((i, " ".join(copy), "y"))
    rows += [(200, None, "n"), (201, "", "n"), (None, "", "n"), (None, "alone here", "n"), (5, rows[45][1], "again")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fp string")
    got = simhash.simhash_components(docs).collect()
    fps = [plain_fingerprint(t) for _, t, _ in rows]
    label = classes(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    least = {}
    for (i, *_), c in zip(rows, label, strict=True):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    want = [(i, f"{f:016x}", least.get(c)) for (i, *_), f, c in zip(rows, fps, label, strict=True)]
    assert sorted(map(str, got)) == sorted(str(type(got[0])(doc_id=a, fingerprint=b, component_id=c)) for a, b, c in want)
    assert simhash.simhash_components(docs.limit(0)).count() == 0


@pytest.mark.parametrize("leaf", [4, 4096])
def test_wide_trie_join_spans_every_link(leaf, monkeypatch):
    monkeypatch.setattr(simhash, "LEAF", leaf)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, (20, 4), dtype=np.uint64)
    flips = np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (200, 4, 9), dtype=np.uint64), axis=2)
    keys = np.unique(np.concatenate([base, base.repeat(10, 0) ^ flips]), axis=0)
    d = np.bitwise_count(keys[:, None] ^ keys[None]).sum(2)
    every = np.arange(len(keys))
    for budget in (30, 50, 70):
        links = simhash.wide_trie_join(keys, every, None, budget)
        assert all(d[a, b] <= budget for a, b in links)
        assert classes(len(keys), links) == classes(len(keys), np.argwhere(np.triu(d <= budget, 1)).tolist())
        a, b = every[::2], every[1::2]
        links = simhash.wide_trie_join(keys, a, b, budget)
        assert classes(len(keys), links) == classes(len(keys), [(i, j) for i in a for j in b if d[i, j] <= budget])
        run = np.repeat([1, 2, 3], [len(keys) // 3, 5, len(keys) - len(keys) // 3 - 5])
        same = np.triu((d <= budget) & (run[:, None] == run[None]), 1)
        assert classes(len(keys), simhash._small_links(run, keys, budget)) == classes(len(keys), np.argwhere(same).tolist())


def jaccard(a, b, n=5):
    a, b = ({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} for w in (a.lower().split(), b.lower().split()))
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("part", [100_000, 30])
def test_near_copies_by_similarity(spark, monkeypatch, part):
    monkeypatch.setattr(simhash, "PART", part)
    monkeypatch.setattr(simhash, "SMALL", 8)
    rng = random.Random(6)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for k in range(40):
        base = [rng.choice(words) for _ in range(rng.choice([60, 150, 400]))]
        texts.append(" ".join(base))
        for _ in range(2):
            copy = list(base)
            for _ in range(max(1, round(len(base) * rng.choice([0.005, 0.01, 0.015, 0.04, 0.1])))):
                copy[rng.randrange(len(copy))] = "changed"
            texts.append(" ".join(copy))
    base = [rng.choice(words) for _ in range(500)]  # one large group, no two alike
    for i in range(120):
        texts.append(" ".join([*base[:i], f"here{i}", *base[i + 1 :]]))
    texts += ["a b c", "A  b c", "one two", " ".join(["w"] * 900 + words[:40]), " ".join(["w"] * 900 + words[50:90])]
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    left = {r.doc_id for r in simhash.without_near_copies(docs).collect()}
    links = [(i, j) for j in range(len(texts)) for i in range(j) if jaccard(texts[i], texts[j]) >= 0.8]
    label = classes(len(texts), links)
    assert set(label) <= left  # nothing goes without a link to a smaller id
    many = set(range(len(texts))) - set(label)
    assert len(many - left) >= 0.95 * len(many)
    assert len(left - set(label)) <= 0.05 * len(many)


def test_pairs_that_a_failed_forest_stood_for_are_looked_for_again(spark, monkeypatch):
    """Two like texts whose sketches are nearest to a text unlike both, and a crowd of such texts: no forest has their own pair."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(3000)]
    prose = lambda: [rng.choice(words) for _ in range(100)]
    one = prose()
    texts = [one, [*one[:-1], "other"], *(prose() for _ in range(40))]
    base = np.random.default_rng(4).integers(0, 1 << 63, 4, dtype=np.uint64)
    keys = np.stack([base] * len(texts))
    keys[0, 3] ^= np.uint64(0b1111)
    keys[1, 3] ^= np.uint64(0b11110000)
    for k in range(2, len(texts)):
        keys[k, 2] ^= np.uint64(k % 3)
    nodes = spark.createDataFrame([(100 + k, *map(int, row.view(np.int64))) for k, row in enumerate(keys)], "node bigint, s0 bigint, s1 bigint, s2 bigint, s3 bigint")
    held = spark.createDataFrame([(100 + k, " ".join(t)) for k, t in enumerate(texts)], "node bigint, text string")
    pairs = lambda df: sorted((r.u, r.v) for r in df.collect())
    links = simhash.similar_links(nodes)
    assert pairs(simhash._verified(links, held, 5, 0.8)) == []
    assert pairs(simhash.verified_links(nodes, held, 5, 0.8, links)) == [(100, 101)]


@pytest.mark.parametrize("part", [100_000, 20])
def test_unlinked_pairs_are_all_of_them_once(spark, monkeypatch, part):
    monkeypatch.setattr(simhash, "PART", part)
    monkeypatch.setattr(simhash, "LEAF", 16)
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, (6, 4), dtype=np.uint64)
    flips = np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (60, 4, 5), dtype=np.uint64), axis=2)
    keys = np.concatenate([base, base.repeat(10, 0) ^ flips, base, base, base])
    label = rng.integers(0, 8, len(keys))
    rows = [(k, *map(int, key.view(np.int64)), int(label[k])) for k, key in enumerate(keys)]
    got = [tuple(r) for r in simhash.unlinked_pairs(spark.createDataFrame(rows, "node bigint, s0 bigint, s1 bigint, s2 bigint, s3 bigint, label bigint")).collect()]
    bits = np.unpackbits(keys.astype(">u8").view(np.uint8).reshape(len(keys), -1), axis=1)
    shares = lambda i, j: any((bits[i, own] == bits[j, own]).all() for own in simhash._drawn())
    d = np.bitwise_count(keys[:, None] ^ keys[None]).sum(2)
    assert sorted(got) == [(i, j, int(d[i, j])) for i in range(len(keys)) for j in range(i + 1, len(keys)) if d[i, j] <= simhash.WIDE_BUDGET and label[i] != label[j] and shares(i, j)]


@pytest.mark.parametrize("torn", [8192, 40])
def test_pairs_of_a_torn_class_are_never_rows(spark, monkeypatch, torn):
    """A large class of near sketches and unlike texts, with three alike: what is written grows with its nodes, not with their pairs."""
    monkeypatch.setattr(simhash, "TORN", torn)
    rng = random.Random(11)
    words = [f"w{i}" for i in range(3000)]
    texts = [[rng.choice(words) for _ in range(60)] for _ in range(150)]
    texts[70], texts[140] = [*texts[3][:-1], "other"], ["first", *texts[3][1:]]
    base = np.random.default_rng(4).integers(0, 1 << 63, 4, dtype=np.uint64)
    keys = np.stack([base] * len(texts))
    keys[:, 3] ^= np.arange(len(texts), dtype=np.uint64)
    nodes = spark.createDataFrame([(k, *map(int, row.view(np.int64))) for k, row in enumerate(keys)], "node bigint, s0 bigint, s1 bigint, s2 bigint, s3 bigint")
    held = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "node bigint, text string")
    links = simhash.similar_links(nodes).localCheckpoint()
    written = []
    kept = simhash.materialize
    monkeypatch.setattr(simhash, "materialize", lambda df, tag: written.append(kept(df, tag)) or written[-1])
    found = [(r.u, r.v) for r in simhash.verified_links(nodes, held, 5, 0.8, links).collect()]
    alike = classes(len(texts), found)
    assert alike[3] == alike[70] == alike[140] and all(jaccard(" ".join(texts[u]), " ".join(texts[v])) >= 0.8 for u, v in found)
    assert max(df.count() for df in written) <= len(texts)
