import pytest

from graphloom.api import Engine, GraphloomError, ResolveParams, dispatch
from graphloom.sources import rdf, rules

BOOKS = """@prefix b: <http://books.example/#> .
@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .
@prefix owl: <http://www.w3.org/2002/07/owl#> .
b:Book a owl:Class ; rdfs:label "Book"@en , "Buch"@de ; rdfs:subClassOf b:Work .
b:Work a owl:Class .
b:author a owl:ObjectProperty ; rdfs:domain [ a owl:Class ; owl:unionOf ( b:Book b:Work ) ] ; rdfs:range b:Person ; rdfs:comment \"\"\"who "wrote"
it\"\"\" .
b:pages a owl:DatatypeProperty ; rdfs:label "number of pages" ; rdfs:domain b:Book ; b:n 3, 4.5, 1e3, true .
"""
XML = """<?xml version="1.0"?><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:b="http://books.example/#" xml:base="http://books.example/">
<b:Book rdf:about="#one" b:short="S"><b:title xml:lang="en">One</b:title><b:by><b:Person rdf:ID="p"/></b:by><b:tags rdf:parseType="Collection"><rdf:Description rdf:about="#x"/></b:tags><b:see rdf:resource="#two"/></b:Book></rdf:RDF>"""


def test_turtle():
    rows, prefixes = rdf.parse(BOOKS)
    assert prefixes["b"] == "http://books.example/#"
    objects = {(s.rsplit("#")[-1], p.rsplit("#")[-1], o, dt and dt.rsplit("#")[-1], lang) for s, _, p, o, _, dt, lang in rows}
    assert ("Book", "label", "Buch", "langString", "de") in objects
    assert ("author", "comment", 'who "wrote"\nit', "string", None) in objects
    assert {(o, dt) for _, p, o, dt, _ in objects if p == "n"} == {("3", "integer"), ("4.5", "decimal"), ("1e3", "double"), ("true", "boolean")}
    assert sum(p.endswith("#first") for _, _, p, *_ in rows) == 2


def test_xml():
    rows, _ = rdf.parse(XML, "xml")
    got = {(s, p.rsplit("#")[-1], o) for s, _, p, o, *_ in rows}
    base = "http://books.example/"
    assert {(base + "#one", "title", "One"), (base + "#one", "by", base + "#p"), (base + "#one", "see", base + "#two"), (base + "#one", "short", "S")} <= got
    assert any(p == "first" and o == base + "#x" for _, p, o in got)


def test_the_other_format_is_tried_once():
    assert rdf.parse(XML, "turtle")[0] == rdf.parse(XML, "xml")[0]
    for bad in ("", "  ", "a:b c:d e:f .", "<a> <b> ."):
        with pytest.raises(rdf.RdfError):
            rdf.parse(bad)


def test_ntriples_round_trip(spark):
    docs = spark.createDataFrame([("d1", BOOKS)], "doc_id string, content string")
    t = rdf.read_documents(docs)
    lines = rdf.to_ntriples(t).withColumnRenamed("line", "value")
    back = rdf.from_ntriples(lines)
    key = lambda d: sorted((r.p, r.o, r.o_dt or "", r.o_lang or "") for r in d.collect() if r.o_kind != "bnode")
    assert key(back) == key(t)
    assert back.count() == t.count()


def test_engine(spark):
    e = Engine(spark)
    terms, prefixes, triples = dispatch(e, "ontology.parse", "books.ttl", BOOKS)
    got = {r.iri: r for r in terms.collect()}
    assert set(got) == {"b:Book", "b:Work", "b:author", "b:pages"}
    assert got["b:Book"].superclasses == ["b:Work"]
    assert got["b:author"].range == "b:Person"
    assert got["b:author"].domain is None  # a union has no name
    md = "- Author: X\n## Rule\n- Number: R1\n- Title: Pages\n### Data constraint\nEvery book must have a number of pages.\n---\n"
    found = e.parse_rules("batch.md", md)
    out = e.resolve(found, terms.fillna("", ["domain", "range"])).first()
    assert out.resolved_by == "label"
    assert "b:pages" in out.targets
    assert out.constraint_paths == ["b:pages"]
    assert out.focus_nodes == ["b:Book"]
    with pytest.raises(GraphloomError):
        dispatch(e, "nothing")
    with pytest.raises(GraphloomError):
        e.merge(terms, "other")
    with pytest.raises(ValueError):
        ResolveParams(semantic_threshold=0.1, semantic_margin=0.2)
    assert prefixes.count() == 3 and triples.count() > 10


def test_html_rules(spark):
    page = '<div class="metadata"><span class="author">A</span></div><section class="rule x"><p class="number">Number: R1</p><h2 class="title">T &amp; U</h2><div class="data-constraint"><p>One.</p><p> </p><p>Two <b>bold</b>.</p></div></section><section class="rule"><div class="business-rule">bare<br>text</div></section>'
    assert rules.html_rules(page) == [("R1", "T & U", "One.\n\nTwo bold ."), ("", "", "bare\ntext")]
    docs = spark.createDataFrame([("a", "", "x.html", page), ("b", "", "y.md", "## Rule\r\n- Number: 7\r\n### Business rule\r\nText\r\n---\r\n")], "doc_id string, fmt string, filename string, content string")
    got = {(r.doc_id, r.ord): r for r in rules.parse_rules(docs).collect()}
    assert got["a", 1].text == "One.\n\nTwo bold ."
    assert got["b", 1].text == "Text" and got["b", 1].number == "7"
    assert rules.parse_rules(docs.limit(0)).count() == 0


def test_profiles_and_payloads(spark):
    d = spark.sql("select 'd' doc_id, array(named_struct('name', '', 'content', 'x'), named_struct('name', 'n', 'content', ' '), named_struct('name', cast(null as string), 'content', 'y')) profiles, map('content', 'c', 'merge_content', '') m")
    assert [(r.nr, r.name) for r in rules.profiles(d).orderBy("nr").collect()] == [(1, "profile-1.ttl"), (3, "profile-3.ttl")]
    from pyspark.sql import functions as F

    assert d.select(rules.baseline_payload(F.col("m"), "merge")).first()[0] == ""
    assert d.select(rules.baseline_payload(F.col("m"))).first()[0] == "c"


def test_escapes_and_blank_nodes_survive(spark):
    texts = ["back\\nslash", "new\nline", "tab\tquote\"", "\\", "\\\\n", "caf\u00e9 \U0001f600", "\\u00e9 as it stands", ""]
    nodes = ["x-1", "x_1", "x1", "z0", "z01", "d:1", "\u00e9"]
    rows = [("d", n, "bnode", "urn:p", t, "literal", rdf.XSD + "string", None) for n, t in zip(nodes + ["x1"], texts, strict=True)]
    lines = rdf.to_ntriples(spark.createDataFrame(rows, rdf.TRIPLE)).withColumnRenamed("line", "value")
    back = rdf.from_ntriples(lines).collect()
    assert sorted(r.o for r in back) == sorted(texts) and len({r.s for r in back}) == len(nodes)
    given = ['<urn:s> <urn:p> "caf\\u00e9 \\U0001F600 \\\\u00e9 \\t." .', "  ", "# no triple", None, "<urn:\\u00e9> <urn:p> <urn:o> . # yes"]
    df = spark.createDataFrame([("d", v) for v in given], "doc_id string, value string")
    assert sorted((r.s, r.o) for r in rdf.from_ntriples(df).collect()) == [("urn:s", "caf\u00e9 \U0001f600 \\u00e9 \t."), ("urn:\u00e9", "urn:o")]
    bad = spark.createDataFrame([("d", "<urn:s> <urn:p> .")], "doc_id string, value string")
    assert rdf.bad_lines(bad).count() == 1 and rdf.bad_lines(df).count() == 0 and rdf.from_ntriples(bad, skip_bad=True).count() == 0
    with pytest.raises(Exception, match="not a triple"):
        rdf.from_ntriples(bad).collect()


def test_long_lists(spark):
    from graphloom.operators import graph as G

    n = 3000
    cells = spark.createDataFrame([(f"c{i}", str(i), f"c{i + 1}" if i + 1 < n else G.RDF + "nil") for i in range(n)] + [("r0", "a", "r1"), ("r1", "b", "r0"), ("o", "x", "gone")], "cell string, first string, rest string")
    heads = spark.createDataFrame([("c0",), ("c2990",), ("r0",), ("o",), (G.RDF + "nil",)], "head string")
    got = {r["head"]: (r.members, r.valid) for r in G.list_members(cells, heads).collect()}
    assert got["c0"] == ([str(i) for i in range(n)], True) and got["c2990"] == ([str(i) for i in range(2990, n)], True)
    assert not got["r0"][1] and not got["o"][1] and got[G.RDF + "nil"] == ([], True)


def test_small_documents_share_batches(spark, monkeypatch):
    """Rows of many small documents are handed on together, and a batch in between doesn't lose or repeat any."""
    made, frame = [], rdf.pd.DataFrame
    docs = [(f"d{k}", f"@prefix x: <http://x/> .\nx:a{k} x:b [ x:c {k} ] .\nx:a{k} x:b x:d .\nx:a{k} x:b x:d .") for k in range(50)]

    class Rows:
        def mapInPandas(self, run, schema):
            self.run = run
            return self

        def select(self, *columns):
            return self

    for read, each in ((rdf.read_documents, 3), (rdf.read_prefixes, 1)):
        for batch in (10_000, 7):
            monkeypatch.setattr(rdf, "BATCH", batch)
            given = frame([(d, c, "turtle") for d, c in docs], columns=["doc_id", "content", "fmt"])
            got = list(read(Rows()).run(iter([given[:20], given[20:20], given[20:]])))
            made.append(len(got))
            rows = [r for g in got for r in g.itertuples(index=False)]
            assert len(rows) == len(set(rows)) == 50 * each
            assert [r.doc_id for r in rows] == [d for d, _ in docs for _ in range(each)]
    assert made[0] == made[2] == 1 and made[1] > 1 and made[3] > 1


def test_html_documents_are_parsed_in_slices(monkeypatch):
    """A batch of many pages is handed on in slices, and a parsed tree goes without the garbage collector."""
    import gc
    import weakref

    class Docs:
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            self.run = run
            return self

    class Any:
        def __getattr__(self, name):
            return lambda *a: Any()

    monkeypatch.setattr(rules, "F", Any())
    page = lambda k: f"<body><article><p>one {k}<br>more</b></p><p>two</article><article class=x></article></article>tail"
    pages = rules.pa.RecordBatch.from_pydict({"doc_id": [str(k) for k in range(200)], "content": [page(k) if k % 3 else None for k in range(200)]})
    got = list(rules.parse_html(Docs(), section="article", classes=()).run(iter([pages, pages.slice(0, 0)])))
    assert max(b.num_rows for b in got) <= 2 * rules.PAGES < 200
    want = [(str(k), i, text) for k in range(200) if k % 3 for i, text in ((1, f"one {k} more\n\ntwo"), (2, ""))]
    assert [(r["doc_id"], r["ord"], r["text"]) for b in got for r in b.to_pylist()] == want
    gc.disable()
    try:
        tree = rules._Tree(page(1))
        root = weakref.ref(tree.root.children[0])
        del tree
        assert root() is None
    finally:
        gc.enable()
