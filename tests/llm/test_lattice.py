import itertools
import math

import numpy as np
import pytest

from graphloom.llm import lattice as L


def test_nearest_point():
    """Against all points of the lattice around, by its definition."""
    near = np.array([p for p in itertools.product((-1, 0, 1), repeat=8) if sum(p) % 2 == 0], float)
    half = np.array([p for p in itertools.product((-0.5, 0.5), repeat=8)])
    half = half[half.sum(1) % 2 == 0]
    points = np.concatenate([near, half])
    x = np.random.default_rng(0).uniform(-0.5, 0.5, (300, 8))
    want = ((x[:, None] - points) ** 2).sum(-1).min(1)
    got = L.nearest_e8(x)
    assert np.allclose(((x - got) ** 2).sum(-1), want)
    assert len(L.ROOTS) == 240 and np.allclose((L.ROOTS**2).sum(1), 2) and np.allclose(L.nearest_e8(L.ROOTS), L.ROOTS)


@pytest.mark.parametrize("cosine", [0.951, 0.97, 0.99])
def test_recall(cosine):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(1, keepdims=True) * x
    y = cosine * x + math.sqrt(1 - cosine**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    a, b = L.codes(x), L.codes(y)
    met = ((a[:, :, :1] == b) | (a == b[:, :, :1])).any((1, 2))
    assert met.mean() > 0.97


def plain(vectors, at_least=0.95):
    good = [i for i, (_, v) in enumerate(vectors) if v and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    unit = {i: np.array(vectors[i][1], np.float64) / np.linalg.norm(np.array(vectors[i][1], np.float64)) for i in good}
    links, label = [0] * len(vectors), list(range(len(vectors)))
    for i, j in itertools.combinations(good, 2):
        if len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= at_least:
            links[i] += 1
            links[j] += 1
            a, b = label[i], label[j]
            label = [min(a, b) if z in (a, b) else z for z in label]
    least = {}
    for (i, _), c in zip(vectors, label, strict=True):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    return sorted((str(i), n, least.get(c), i == least.get(c)) for (i, _), n, c in zip(vectors, links, label, strict=True))


@pytest.mark.parametrize("part", [2048, 7])
def test_frames(spark, monkeypatch, part):
    monkeypatch.setattr(L, "PART", part)
    rng = np.random.default_rng(part)
    base = rng.normal(size=(12, 32))
    rows = []
    for i in range(150):
        k = i % 12 if i < 120 else int(rng.integers(12))
        rows.append((int(1000 - i), (base[k] + rng.normal(size=32) * 0.12).astype(np.float32).tolist()))
    rows += [(2000, rows[0][1]), (2001, rows[0][1]), (5, rows[30][1])]
    rows += [(3000, None), (3001, []), (3002, [0.0] * 32), (3003, [float("nan")] + [1.0] * 31), (3004, [None] + [1.0] * 31), (3005, [float("inf")] + [1.0] * 31), (3006, [1.0, 2.0]), (3007, [2.0, 4.0]), (None, rows[1][1]), (None, [1.0] * 31)]
    rows += [rows[7]]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id bigint, embedding array<float>, label string")
    got = sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in L.near_duplicates(df).collect())
    want = plain([(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for i, v in rows])
    assert [(a, b, c) for a, b, c, _ in got] == [(a, b, c) for a, b, c, _ in want]
    assert L.near_duplicates(df.limit(0)).count() == 0
