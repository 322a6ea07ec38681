import random

import numpy as np
import pytest

from graphloom.llm import whitening as H

DDL = "vec_id bigint, embedding array<float>, w string, block string"


def made(n, dims, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims)) @ rng.normal(size=(dims, dims)) * 0.2 + 3
    return [(i, [float(c) for c in r]) for i, r in enumerate(x.astype(np.float32))]


def brute(rows):
    x = np.array([[int(np.floor(1024 * float(c))) + 100000 for c in v] for _, v in rows], dtype=object)
    n, s = len(x), x.sum(0)
    y = n * x - s
    c = (y / n).astype(float)
    e, p = np.linalg.eigh(c.T @ c / n)
    order = np.argsort(-e)[:8]
    return n, (y**2).sum(1), c @ p[:, order] / np.sqrt(e[order]), e[order] / e.sum()


@pytest.mark.parametrize("n, dims, tile, block", [(300, 64, 32, 4096), (200, 10, 4, 16), (50, 5, 2, 7)])
def test_against_numpy(spark, monkeypatch, n, dims, tile, block):
    monkeypatch.setattr(H, "TILE", tile)
    monkeypatch.setattr(H, "BLOCK", block)
    rows = made(n, dims, n)
    out = H.whiten(spark.createDataFrame([(*r, "", "") for r in rows], DDL).repartition(3)).collect()
    k = min(8, dims)
    assert len(out) == n * k
    by = {(r.vec_id, r.component): r for r in out}
    size, deviation, white, share = brute(rows)
    assert {r.n for r in out} == {size} and all(by[i, 1].deviation == deviation[i] for i in range(n))
    for c in range(k):
        got = np.array([by[i, c + 1].whitened for i in range(n)])
        assert min(np.abs(got - white[:, c]).max(), np.abs(got + white[:, c]).max()) < 1e-9
        assert abs(by[0, c + 1].explained - share[c]) < 1e-12
    assert {r.identity_error for r in out} == {out[0].identity_error} and out[0].identity_error < 1e-9


def test_exact_and_repeatable(spark):
    rows = made(120, 12, 7)
    random.Random(1).shuffle(rows)
    one = H.whiten(spark.createDataFrame([(*r, "", "") for r in rows], DDL).repartition(5)).collect()
    two = H.whiten(spark.createDataFrame([(*r, "", "") for r in sorted(rows)], DDL).coalesce(1)).collect()
    key = lambda r: (r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained)
    assert sorted(map(key, one)) == sorted(map(key, two))


def test_odd_rows(spark):
    good = made(30, 4, 2)
    odd = [(None, good[0][1]), (3, good[3][1]), (90, None), (91, []), (92, [1.0, None, 1.0, 1.0]), (93, [float("nan")] * 4), (94, [float("-inf")] * 4)]
    out = H.whiten(spark.createDataFrame([(*r, "", "") for r in good + odd], DDL)).collect()
    assert len(out) == 32 * 4 and {r.n for r in out} == {32}
    assert H.whiten(spark.createDataFrame([], DDL)).collect() == []
    same = H.whiten(spark.createDataFrame([(i, [1.0, 2.0], "", "") for i in range(4)], DDL)).collect()
    assert len(same) == 8 and {(r.whitened, r.explained, r.deviation, r.identity_error) for r in same} == {(0.0, 0.0, 0, 0.0)}
    assert {r.whitened for r in H.whiten(spark.createDataFrame([(1, [1.0, 2.0], "", "")], DDL)).collect()} == {0.0}
    with pytest.raises(ValueError):
        H.whiten(spark.createDataFrame([(1, [1.0], "", ""), (2, [1.0, 2.0], "", "")], DDL))
    with pytest.raises(Exception, match="too large"):
        H.whiten(spark.createDataFrame([(1, [1e30], "", ""), (2, [1.0], "", "")], DDL)).collect()


def test_constant_dimension(spark):
    rows = [(i, [*v, 5.0]) for i, v in made(40, 3, 4)]
    out = H.whiten(spark.createDataFrame([(*r, "", "") for r in rows], DDL)).collect()
    assert {r.whitened for r in out if r.component == 4} == {0.0} and out[0].identity_error < 1e-9
