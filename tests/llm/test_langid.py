import numpy as np

from graphloom.llm import langid as L


def test_counts_are_of_all_ngrams(monkeypatch):
    text = "Abc, dé 12 fgh " * 50
    whole = L.counts(text)
    n = len((" ".join("abc dé fgh".split()) + " ") * 50) + 1
    assert whole.sum() == n + n - 1 + n - 2
    monkeypatch.setattr(L, "_STEP", 64)
    assert (L.counts(text) == whole).all()
    assert L.counts("").sum() >= 0


def test_has_letter():
    assert not L.has_letter(None) and not L.has_letter("") and not L.has_letter("12 ?!") and L.has_letter("1é")


def test_kmeans():
    rng = np.random.default_rng(0)
    x = np.concatenate([np.eye(5)[k] + rng.normal(size=(30, 5)) * 0.05 for k in range(3)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = L._kmeans(x, 3)
    assert sorted(c.argmax(1).tolist()) == [0, 1, 2]


def test_held_out_accuracy(spark):
    import duckdb

    from graphloom.llm.queries import op9_language_id

    sf = "/root/testdata/sf0.01"
    got = op9_language_id(spark, sf).toPandas()
    assert len(got) == 1000 and got["score"].between(0, 1).all()
    right = duckdb.connect().execute(f"select avg((lang = lang_pred)::int) from got join '{sf}/documents.parquet' d using (doc_id) where held_out").fetchone()[0]
    assert right > 0.98


def test_frames(spark):
    en, de = "the cat sat on the mat with that hat", "der hund und die katze sind nicht hier"
    rows = [(i, en if i % 2 else de, "en" if i % 2 else "de", 1) for i in range(60)]
    rows += [(100, None, "en", 1), (101, "", "de", 1), (102, "12 34", None, 1), (None, en, None, 1), (103, "der hund " * 50_000, None, 1), (104, "日本語", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score int")
    got = {r.doc_id: r for r in L.identify(docs).collect()}
    assert all(got[i].lang_pred == ("en" if i % 2 else "de") for i in range(60))
    assert [got[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3 and got[100].score == 0 and got[100].rejected
    assert got[None].lang_pred == "en" and got[103].lang_pred == "de" and got[104].rejected
    assert L.identify(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in L.identify(docs.withColumn("lang", docs.lang.substr(1, 0)).replace("", None, "lang")).collect()} == {"und"}


def test_frequencies_of_all_rows_and_repeated_ids(spark):
    from pyspark.sql import functions as F

    rows = [(i, f"word {'abcdefghij'[i % 10] * 3} and {'klmnop'[i % 6] * 4}", "en") for i in range(40)] + [(100, "der hund", "de")] * 50
    model = L.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(5), F.lit(True), fit_rows=4)
    df = np.sum([L.counts(t) > 0 for _, t, _ in rows], 0)
    assert np.allclose(model.idf, np.log((1 + len(rows)) / (1 + df)) + 1)
    assert model.languages == ["de", "en"]
