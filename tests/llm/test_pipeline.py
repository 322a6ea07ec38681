import corpus_pipeline
from graphloom.llm import decontaminate, passages, sentencepiece, simhash
from graphloom.llm._shared import materialize
from graphloom.llm.queries import MODEL_FILE, table


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
        kept.append(docs)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    clean, unique, cut, safe, tokens = kept
    texts = {r.doc_id: r.text for r in unique.collect()}
    # near copies: of each group by the plain similarity of five-word shingles the smallest id is left
    before = {r.doc_id: set(simhash.shingles(r.text, 5).tolist()) for r in clean.collect()}
    label = {i: i for i in before}
    for i, x in before.items():
        for j, y in before.items():
            if i < j and label[i] != label[j] and len(x & y) >= 0.8 * len(x | y):
                lo, hi = sorted((label[i], label[j]))
                label = {k: lo if v == hi else v for k, v in label.items()}
    assert set(texts) == set(label.values())
    # repeats: no run of words stands in two documents any more
    after = {r.doc_id: r.text for r in cut.collect()}
    assert set(after) == set(texts)
    seen = {}
    for i, t in after.items():
        w = t.lower().split()
        for k in range(len(w) - 54):
            assert seen.setdefault(tuple(w[k : k + 55]), i) == i
    m = decontaminate.Matcher([tuple(r) for r in table(spark, sf_dir, "benchmark").collect()])
    assert {r.doc_id for r in safe.collect()} == {i for i, t in after.items() if not m.matches(t)}
    with open(MODEL_FILE, "rb") as f:
        model = sentencepiece.Model(f.read())
    for r in tokens.collect():
        assert r.decoded == after[r.doc_id] and r.ids == list(model.encode(r.decoded))
    assert all(r.n_chars == len(r.text) for r in cut.collect())
    assert passages.find_passages(cut).count() == 0


def odd_documents(spark, sf_dir):
    """Rows with nulls, empty and repeated texts and ids, and columns whose names the operators use themselves."""
    import random

    rng = random.Random(1)
    words = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    item = table(spark, sf_dir, "benchmark").orderBy("item_id" if "item_id" in table(spark, sf_dir, "benchmark").columns else table(spark, sf_dir, "benchmark").columns[0]).first()
    leak = max((x for x in item if isinstance(x, str)), key=len)
    a, b, c, shared = words(80), words(80), words(70), words(60)
    rows = [
        (1, a, "x"), (1, a, "y"), (1, b, "x"), (2, a, "x"), (None, a, "x"), (None, c, "x"), (None, c, "y"),
        (3, None, "x"), (4, "", "x"), (None, None, "x"), (5, f"{words(30)} {shared} {words(30)}", "x"),
        (6, f"{words(30)} {shared} {words(30)}", "x"), (6, f"{words(30)} {shared}", "x"), (7, f"{words(20)} {leak} {words(20)}", "x"),
        (None, f"{words(20)} {leak} {words(20)}", "x"), (7, words(90), "x"), (8, "word " * 30_000, "x"),
    ]
    docs = spark.createDataFrame([(*r, "k", 1, None) for r in rows], "doc_id bigint, text string, source string, fp string, h int, y string")
    return docs, rows, leak


def test_near_copies_of_odd_documents(spark, sf_dir):
    docs, rows, _ = odd_documents(spark, sf_dir)
    got = corpus_pipeline.drop_near_copies(spark, docs, sf_dir)
    assert got.columns == docs.columns
    left = [(r.doc_id, r.text) for r in got.collect()]
    texts = {t for _, t, _ in rows if t}
    assert sorted(t for _, t in left if t) == sorted(texts)  # no text twice, none lost
    assert [i for i, t in left if not t] == [3]  # null and empty texts are one group
    by = dict((t, i) for i, t in left)
    assert by[rows[0][1]] == 1 and by[rows[2][1]] == 1 and by[rows[5][1]] is None
    assert corpus_pipeline.drop_near_copies(spark, docs.limit(0), sf_dir).count() == 0


def test_repeats_of_odd_documents(spark, sf_dir):
    docs, rows, _ = odd_documents(spark, sf_dir)
    got = corpus_pipeline.cut_repeats(spark, docs, sf_dir)
    assert got.columns == docs.columns
    left = got.collect()
    assert len(left) == len(rows)
    shared = " ".join(rows[10][1].split()[30:90])
    assert [r.doc_id for r in left if r.text and shared in r.text] == [5]  # both texts of document 6 lost it
    assert sorted(r.doc_id for r in left if r.text == rows[0][1] and r.doc_id) == [1, 1]
    assert [r.text for r in left if r.doc_id == 2] == [""] and sum(r.text == rows[5][1] for r in left) == 2
    assert sorted(str(r.text) for r in left if r.doc_id in (3, 4)) == ["", "None"]
    assert corpus_pipeline.cut_repeats(spark, docs.limit(0), sf_dir).count() == 0


def test_leaks_of_odd_documents(spark, sf_dir):
    docs, rows, leak = odd_documents(spark, sf_dir)
    got = corpus_pipeline.drop_leaks(spark, docs, sf_dir)
    assert got.columns == docs.columns
    left = got.collect()
    assert sorted(str((r.doc_id, r.text)) for r in left) == sorted(str((i, t)) for i, t, _ in rows if not t or leak not in t)
    assert corpus_pipeline.drop_leaks(spark, docs.limit(0), sf_dir).count() == 0


def test_toxicity_and_tokens_of_odd_documents(spark, sf_dir):
    docs, rows, _ = odd_documents(spark, sf_dir)
    got = corpus_pipeline.drop_toxic(spark, docs, sf_dir)
    assert got.columns == docs.columns and got.count() == len(rows)  # no label is of these: nothing is learnt, nothing goes
    out = corpus_pipeline.tokenize(spark, docs, sf_dir).collect()
    assert sorted(str((r.doc_id, r.decoded or "")) for r in out) == sorted(str((i, t or "")) for i, t, _ in rows)
    assert corpus_pipeline.tokenize(spark, docs.limit(0), sf_dir).count() == corpus_pipeline.drop_toxic(spark, docs.limit(0), sf_dir).count() == 0
