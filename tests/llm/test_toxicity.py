import itertools
import math

import numpy as np
import pytest

from graphloom.llm import toxicity as X


def brute(field, words):
    """Marginals by the sum over all taggings."""
    e = [field.emission(w) + field.bias for w in words]
    total, toxic = 0.0, np.zeros(len(words))
    for tags in itertools.product((0, 1), repeat=len(words)):
        s, before = 0.0, 0
        for k, t in enumerate(tags):
            s += {(0, 0): 0.0, (0, 1): field.enter, (1, 0): field.leave if k else 0.0, (1, 1): field.stay}[before, t] + t * e[k]
            before = t
        p = math.exp(s)
        total += p
        toxic += p * np.array(tags)
    return toxic / total


@pytest.mark.parametrize("words", ["bad", "a b c", "a a bad b", "bad bad", "a worse b c bad d e", "worse a b c d e f g", "a b c d e f bad"])
def test_marginals(words):
    f = X.Field({"=bad": 3.0, "wors": 1.5, "=worse": 0.7}, -1.2, 0.8, -0.4, 0.3, (0, 0, 0))
    w = words.split()
    at, p = f.marginals(w)
    want = brute(f, w)
    assert at == [i for i, x in enumerate(w) if f.emission(x)]
    assert p == pytest.approx(want[at], abs=1e-9)


def test_long_texts_stay_finite():
    f = X.Field({"=bad": 3.0}, -3.0, 0.5, -0.5, 0.2, (-4, 6, 1))
    at, p = f.marginals(["x"] * 200_000 + ["bad"] + ["x"] * 200_000)
    assert at == [200_000] and 0 < p[0] < 1
    at, p = f.marginals(["bad"] * 5000)
    assert len(at) == 5000 and np.isfinite(p).all()


def test_held_out_accuracy(spark):
    import duckdb

    from graphloom.llm.queries import op5_toxicity

    sf = "/root/testdata/sf0.01"
    got = op5_toxicity(spark, sf).drop("spans").toPandas()
    assert len(got) == 1000 and got["score"].between(0, 1).all() and ((got["score"] >= 0.5) == (got["predicted"] == 1)).all()
    con = duckdb.connect()
    right, n, missed, toxic = con.execute(f"select count_if(predicted = toxic), count(*), count_if(toxic = 1 and predicted = 0), count_if(toxic = 1) from got join '{sf}/labels.parquet' l using (doc_id)").fetchone()
    assert right / n > 0.95 and missed / toxic < 0.3


def test_held_out_accuracy_on_held_out_rows_alone(spark):
    """On the larger fixture: the smaller one has six toxic documents held out."""
    import duckdb

    from graphloom.llm.queries import op5_toxicity

    sf = "/root/testdata/sf0.1"
    got = op5_toxicity(spark, sf).drop("spans").toPandas()
    right, n, missed, toxic = duckdb.connect().execute(f"select count_if(predicted = toxic), count(*), count_if(toxic = 1 and predicted = 0), count_if(toxic = 1) from got join '{sf}/labels.parquet' l using (doc_id) where held_out").fetchone()
    assert n > 500 and right / n > 0.97 and missed / toxic < 0.15


def test_words_stand_where_the_text_has_them():
    text = "İİİİ such a moron"
    assert X.words_of(text) == [w.lower() for w in X.WORD.findall(text)] and X.words_of("Ab c’d e1f") == ["ab", "c’d", "e", "f"]
    assert X.words_of(None) == X.words_of("") == []


def test_training_reads_all_of_a_document(spark):
    """The toxic word stands behind many benign words that are marked as well; its id is repeated."""
    benign = " ".join(f"filler{k} word and so on and on and then some more of it" for k in range(40))
    rows = [(i, f"{benign} {'you such a vilehead go' if i % 2 else 'we went to see the river'}") for i in range(60)]
    docs = spark.createDataFrame(rows + rows[:20] * 3, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id bigint, toxic int")
    field = X.fit(docs, labels)
    assert field.emission("vilehead") > 0 and field.weight.keys() >= {"=vilehead", "vile"}
    assert all(r.predicted == r.doc_id % 2 for r in X.score(docs, field).collect())
    one = X.score(spark.createDataFrame([(1, "İİİİ such a vilehead")], "doc_id bigint, text string"), field).first()
    assert "vilehead" in [("İİİİ such a vilehead")[s.start : s.end] for s in one.spans]


def test_repeated_windows_weigh_as_often_as_they_occur():
    rng = np.random.default_rng(0)
    rows, tags = rng.integers(-1, 5, (6, 13, 4)), rng.integers(0, 2, (6, 13))
    times = np.array([1, 2, 3, 1, 1, 4])
    a = X._train(rows, tags, times.astype(float), 5)
    b = X._train(np.repeat(rows, times, 0), np.repeat(tags, times, 0), np.ones(times.sum()), 5)
    assert a[0] == pytest.approx(b[0], abs=1e-6) and a[1] == pytest.approx(b[1], abs=1e-6)


def test_frames(spark):
    good = ["the sun is on the hill", "a day in the town", "we went to see the river", "many words of no harm"]
    rows = [(i, good[i % 4] + (f" you {['moronic', 'moron', 'morons'][i % 3]} go" if i % 5 == 0 else f" you {['walk', 'run', 'sit'][i % 3]} go"), "z") for i in range(200)]
    rows += [(500, None, "n"), (501, "", "n"), (None, "such a MORON!", "n"), (502, "un moronico", "n"), (3, rows[3][1], "again")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, toxic string")
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(200)] + [(3, 0, None), (None, 0, 1), (900, 0, 1)], "doc_id bigint, quality int, toxic int")
    got = X.classify(docs, labels).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[i].predicted == int(i % 5 == 0) for i in range(200))
    assert by[500].predicted == by[501].predicted == 0 and 0 <= by[500].score == by[501].score < 0.5
    assert by[None].predicted == 1 and [(s.start, s.end) for s in by[None].spans] == [(7, 12)]
    field = X.fit(docs, labels)
    assert {r.doc_id for r in X.keep_clean(docs, field).collect()} == {r.doc_id for r in got if not r.predicted}
    assert X.classify(docs.limit(0), labels).count() == 0
    assert X.fit(docs, labels.where("toxic = 0")) is None
    assert {r.score for r in X.classify(docs, labels.limit(0)).collect()} == {0.0}
