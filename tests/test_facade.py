import pytest
from pyspark.sql import functions as F

from graphloom.api import ENDPOINTS, Engine, GraphloomError, dispatch
from graphloom.functions.responses import Outcome
from graphloom.operators import graph as G
from graphloom.operators import shapes
from graphloom.plans import fixtures as X
from graphloom.sources import rdf
from graphloom.streaming.admission import Client

HEAD = "@prefix sh: <http://www.w3.org/ns/shacl#> . @prefix rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> .\n"
PROFILE = HEAD + """
<PropertyShape> a sh:NodeShape ; sh:targetObjectsOf sh:property ;
  sh:property [ sh:path sh:path ; sh:minCount 1 ; sh:maxCount 1 ; sh:node <Path> ] ;
  sh:property [ sh:path sh:name ; sh:maxCount 1 ; sh:severity sh:Warning ] .
<Path> a sh:NodeShape ; sh:xone ( [ sh:nodeKind sh:IRI ] [ sh:nodeKind sh:BlankNode ; sh:closed true ; sh:property [ sh:path sh:inversePath ; sh:minCount 1 ; sh:maxCount 1 ] ] ) .
<Lists> a sh:NodeShape ; sh:targetObjectsOf sh:in ;
  sh:property [ sh:path [ sh:zeroOrMorePath rdf:rest ] ; sh:hasValue rdf:nil ] .
"""


def test_every_operation_has_a_method():
    assert all(callable(getattr(Engine, m)) for m in ENDPOINTS.values())


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark)


def test_validate_document(engine):
    run = lambda body, profiles=(("p.ttl", PROFILE),): dispatch(engine, "shapes.validate", body, list(profiles), HEAD)
    good = run("<S> a sh:NodeShape ; sh:property [ sh:path [ sh:inversePath <p> ] ; sh:in ( 1 2 ) ; sh:name 'a', 'b' ] .")
    assert (good["valid"], good["error_type"], good["warning_count"], good["profile_names"]) == (True, "none", 1, ["p.ttl"])
    bad = run("<S> a sh:NodeShape ; sh:property [ sh:path [ sh:inversePath <p> ; <more> 1 ] ] , [ sh:minCount 1 ; sh:in [ rdf:first 1 ] ] .")
    assert (bad["valid"], bad["error_type"], bad["violation_count"]) == (False, "profile_error", 3)
    assert {r.component for r in bad["results"].collect()} == {"node", "minCount", "hasValue"}
    assert run("<S> a sh:NodeShape", [])["error_type"] == "parse"
    assert run("<S> a sh:NodeShape .", [("q.ttl", "nothing")])["error_type"] == "profile"
    assert run("<S> a sh:NodeShape .", [("q.ttl", HEAD + "<A> sh:targetClass <S> ; sh:node <A> .")])["error_type"] == "profile"
    assert run("<S> a sh:NodeShape .", [])["valid"]


def test_prepare_export(engine, tmp_path):
    body = HEAD + "<http://x/S> a sh:NodeShape ; sh:property [ sh:path <http://x/p> ; sh:in ( 1 2 ) ], [ sh:in ( 1 2 ) ; sh:path <http://x/p> ] . <http://x/E> a sh:NodeShape ."
    out, counts = dispatch(engine, "shapes.prepare-export", [("a.ttl", body), ("b.ttl", body)], str(tmp_path / "out"), {"http://x/": "x"})
    assert (counts["properties_before"], counts["properties"], counts["documents"]) == (4, 1, 2)
    assert rdf.read_files(engine.spark, str(tmp_path / "out")).count() == out.count() == 8
    for bad in ([], [("a.ttl", " ")], [("a.ttl", "<a> <b>")]):
        with pytest.raises(GraphloomError):
            dispatch(engine, "shapes.prepare-export", bad)


def test_generate_and_search(engine):
    terms = X.terms(engine.spark)
    resolved, outcomes, total = dispatch(engine, "workflows.rule.generate", "R1", "Sizes", "Every part has a part size.", terms, lambda i, t: Outcome("s", True))
    assert resolved.first().resolved_by == "label" and outcomes.first().status == "valid" and total.first().total == 1
    with pytest.raises(GraphloomError):
        dispatch(engine, "workflows.rule.generate", "R1", " ", "", terms, lambda i, t: Outcome())
    rules = engine.spark.createDataFrame([(1, "R1", "Sizes", "Every part has a part size.")], "rule_id bigint, number string, title string, text string")
    ranked = dispatch(engine, "ontology.search", rules, terms, top_k=3).orderBy("rank").collect()
    assert len(ranked) == 3 and {r.method for r in ranked} == {"lexical"}
    assert dispatch(engine, "ontology.terms", terms, "part size").count() == 1
    caps = dispatch(engine, "system.capabilities")
    assert "shapes.validate" in caps["operations"] and caps["limits"]["shape_mb"] == 50 and dispatch(engine, "system.health")["status"] == "ok"
    assert dispatch(engine, "models.check", lambda: 1)["valid"]


def test_described_context(spark):
    turtle = """@prefix x: <http://x/> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . @prefix owl: <http://www.w3.org/2002/07/owl#> .
    x:p rdfs:label "p" ; rdfs:domain x:A, [ owl:unionOf ( x:B x:A ) ] . x:A rdfs:comment "the a" ."""
    t = rdf.read_documents(spark.createDataFrame([("d", turtle)], "doc_id string, content string"))
    term = lambda n, kind: (f"x:{n}", f"http://x/{n}", n, kind, kind, "", "")
    fields = ", ".join(f"{c}: string" for c in ("iri", "full_iri", "label", "type", "kind", "domain", "range"))
    rows = spark.createDataFrame([(1, "focus_nodes", 0, term("A", "class")), (1, "constraint_paths", 0, term("p", "property")), (1, "related_terms", 0, term("Z", "class"))], f"rule_id bigint, role string, pos int, term struct<{fields}>")
    names = F.create_map(F.lit("http://x/"), F.lit("x"), F.lit(G.RDFS), F.lit("rdfs"))
    text = shapes.described_context(rows, t, names).first().context
    head, *parts = text.split("# http://x/")
    assert "x:p | label=p" in head
    assert [p.split("\n")[0] for p in parts] == ["p", "A", "B", "Z"]
    assert 'Domains: http://x/A, http://x/B' in parts[0] and "rdfs:label p" in parts[0] and "rdfs:comment the a" in parts[1]


def test_waits():
    for wait, want in ((1.0, 1), (1.0005, 1), (1.002, 2), (0.2, 1)):
        c = Client({"b": [0.0]})
        assert c.check(10.0 - wait, [("b", 10.0, 1)]) == (False, want, "b")
