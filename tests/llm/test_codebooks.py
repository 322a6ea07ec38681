import hashlib
import random

import duckdb
import numpy as np
import pytest

from graphloom.llm import codebooks as C

DDL = "vec_id bigint, embedding array<float>, label int, v string, code string"


def plain(rows):
    """The contract over (vec_id, vector, label) with plain loops."""
    x = {i: [int(np.floor(256 * float(c))) for c in v] for i, v, _ in rows}
    ids = sorted(x)
    wide = len(x[ids[0]]) // 16
    part = lambda i, p: x[i][p * wide : (p + 1) * wide]
    books = [[part(i, p) for i in ids[:64]] for p in range(16)]
    near = lambda y, b: min((sum((a - c) ** 2 for a, c in zip(y, e, strict=True)), k) for k, e in enumerate(b))
    for _ in range(2):
        for p in range(16):
            groups: dict[int, list] = {}
            for i in ids:
                groups.setdefault(near(part(i, p), books[p])[1], []).append(part(i, p))
            books[p] = [[sum(c) // len(groups[k]) for c in zip(*groups[k], strict=True)] if k in groups else e for k, e in enumerate(books[p])]
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    found = {i: [near(part(i, p), books[p]) for p in range(16)] for i in ids}
    errors: dict = {}
    for i, _, label in rows:
        errors[label] = errors.get(label, 0) + sum(d for d, _ in found[i])
    return {i: ("".join(f"{k:02x}" for _, k in found[i]), sum(d for d, _ in found[i]), errors[label], sha) for i, _, label in rows}


def made(n, seed, dims=32):
    rng = random.Random(seed)
    return [(i, [rng.choice([-0.5, 0.25, rng.uniform(-1, 1)]) for _ in range(dims)], rng.choice([None, 1, 2])) for i in range(n)]


@pytest.mark.parametrize("n", [7, 64, 150])
def test_against_plain(spark, n):
    rows = made(n, n)
    df = spark.createDataFrame([(*r, "", "") for r in rows], DDL).repartition(3)
    got = {r.vec_id: (r.code, r.error, r.label_error, r.codebooks_sha256) for r in C.compress(df).collect()}
    assert got == plain(rows)


def test_sql(spark):
    rows = made(300, 5, 64)
    con = duckdb.connect()
    con.execute("create table embeddings (vec_id bigint, embedding float[], label int)")
    con.executemany("insert into embeddings values (?, ?, ?)", [list(r) for r in rows])
    got = C.compress(spark.createDataFrame([(*r, "", "") for r in rows], DDL)).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(C.ORACLE).fetchall())


def test_tree_keeps_the_least_index():
    rng = np.random.default_rng(3)
    for _ in range(20):
        entries = rng.integers(-4, 5, (64, 4))
        x = rng.integers(-6, 7, (500, 4))
        far = ((x[:, None] - entries[None]) ** 2).sum(2)
        at, d = C.Tree(entries).nearest(x)
        assert (at == far.argmin(1)).all() and (d == far.min(1)).all()
    same = C.Tree(np.zeros((64, 4), np.int64))
    assert (same.nearest(np.ones((3, 4), np.int64))[0] == 0).all()


def test_odd_rows(spark):
    good = made(70, 9)
    odd = [(None, good[0][1], 5), (3, good[3][1], 5), (900, None, 1), (901, [], 1), (902, [1.0] * 31 + [None], 1), (903, [1.0] * 31 + [float("nan")], 1), (904, [float("inf")] * 32, 1)]
    out = C.compress(spark.createDataFrame([(*r, "", "") for r in good + odd], DDL)).collect()
    assert len(out) == 72 and sorted(r.vec_id for r in out if r.vec_id is not None) == sorted([*range(70), 3])
    both = [r for r in out if r.label == 5]
    assert {r.label_error for r in both} == {sum(r.error for r in both)}
    assert C.compress(spark.createDataFrame([], DDL)).collect() == []
    with pytest.raises(ValueError):
        C.compress(spark.createDataFrame([(1, [1.0] * 16, 1, "", ""), (2, [1.0] * 32, 1, "", "")], DDL))
    with pytest.raises(Exception, match="too large"):
        C.compress(spark.createDataFrame([(1, [1e30] * 16, 1, "", "")], DDL)).collect()
