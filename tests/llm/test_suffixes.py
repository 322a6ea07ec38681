import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import suffixes as S

DDL = "doc_id bigint, text string, y string, held string"


def brute(texts):
    """(bytes, removed, runs, hash of the rest) of each text, by all windows."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(t[s : s + S.LENGTH] for t in raw for s in range(len(t) - S.LENGTH + 1))
    out = []
    for t in raw:
        gone = np.zeros(len(t) + 1, bool)
        for s in range(len(t) - S.LENGTH + 1):
            if seen[t[s : s + S.LENGTH]] > 1:
                gone[s : s + S.LENGTH] = True
        starts = gone[1:] & ~gone[:-1]
        kept = bytes(np.frombuffer(t, np.uint8)[~gone[:-1]])
        out.append((len(t), int(gone.sum()), int(starts.sum()) + int(gone[0]), hashlib.sha256(kept).hexdigest()))
    return out


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary):x}é" if rng.random() < 0.05 else f"w{rng.randrange(vocabulary):x}" for _ in range(n))


def made_texts(seed):
    rng = random.Random(seed)
    shared = [words(rng, n) for n in (70, 95, 120, 400)]
    out = []
    for _ in range(40):
        t = words(rng, rng.randrange(1, 300))
        for _ in range(rng.randrange(3)):
            p, a = rng.choice(shared), rng.randrange(40)
            at = rng.randrange(len(t))
            t = t[:at] + p[a : len(p) - rng.randrange(40)] + t[at:]
        out.append(t)
    out += [out[0], out[0], out[1] + "x", "ab" * 700, "ab" * 300 + words(rng, 50), "=" * 5000, "", None, "x" * 399, "x" * 400, "x" * 401]
    # the same 400 bytes twice, 399 bytes twice, and the same text at two alignments in one document
    p = words(rng, 200)[:400]
    out += ["Q" + p + "R", "S" + p + "T", "U" + p[:399] + "0" + words(rng, 9), words(rng, 30) + p[:399] + "1", words(rng, 80) + p + words(rng, 77) + p]
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_all_windows(spark, seed):
    texts = made_texts(seed)
    rows = S.find_repeats(spark.createDataFrame([(i, t, "y", "h") for i, t in enumerate(texts)], DDL)).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows] == brute(texts)
    assert all(len(r.spans) == 2 * r.n_spans and sum(r.spans[1::2]) - sum(r.spans[::2]) == r.n_removed for r in rows)


def test_long_texts_and_one_batch(spark, monkeypatch):
    monkeypatch.setattr(S, "_PIECE", 2048)
    rng = random.Random(5)
    p = words(rng, 1500)
    texts = [words(rng, 3000) + p, p[1000:] + words(rng, 2000), words(rng, 100)]
    rows = S.find_repeats(spark.createDataFrame([(i, t, "", "") for i, t in enumerate(texts)], DDL), batches=1).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows] == brute(texts)


def test_repeated_and_null_ids(spark):
    rng = random.Random(6)
    a, b = words(rng, 200), words(rng, 200)
    texts = [a, b, a, None]
    rows = S.find_repeats(spark.createDataFrame([(1, a, "", ""), (1, b, "", ""), (None, a, "", ""), (None, None, "", "")], DDL)).collect()
    assert sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows) == sorted(brute(texts))
    assert sorted(str(r.doc_id) for r in rows) == ["1", "1", "None", "None"]


def test_empty(spark):
    assert S.find_repeats(spark.createDataFrame([], DDL)).collect() == []
    assert S.find_repeats(spark.createDataFrame([(1, None, "", "")], DDL)).first().n_bytes == 0


def test_joins_of_larger_tables(spark, monkeypatch):
    monkeypatch.setattr(S, "SENT_BYTES", -1)
    texts = made_texts(4)
    rows = S.find_repeats(spark.createDataFrame([(i, t, "", "") for i, t in enumerate(texts)], DDL)).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows] == brute(texts)


def test_family_levels(spark):
    """Each level is larger than the next, a batch is scanned against all, and a merge shuffles nothing."""
    rng = random.Random(8)
    family, texts = S.Family(spark), [words(rng, 400) for _ in range(8)]
    try:
        for i, t in enumerate(texts):
            docs = spark.createDataFrame([(i, t)], "y bigint, text string")
            assert family.add(docs).isEmpty()
            sizes = [n for _, _, n in family.levels]
            assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:], strict=False))
        assert len(family.levels) <= 4
        again = family.add(spark.createDataFrame([(9, texts[3])], "y bigint, text string"))
        want = {bytes(r["head"]) for r in S.suffixes(spark.createDataFrame([(3, texts[3])], "y bigint, text string")).collect()}
        assert {bytes(r["head"]) for r in again.collect()} == want
        name = family.levels[0][0]
        entries = [bytes(r["head"]) for r in spark.table(name).collect()]
        assert len(entries) == len(set(entries))
        a, b = spark.table(name).alias("a"), spark.table(name).alias("b")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = a.join(b, F.col("a.head") == F.col("b.head"), "full_outer")._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        family.close()
