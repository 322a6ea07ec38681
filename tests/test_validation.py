import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import graph as G
from graphloom.operators import paths as P
from graphloom.operators import shape_source as R
from graphloom.operators import validation as D
from graphloom.plans import catalog_queries, validation_queries
from graphloom.sources import rdf

TRIPLE = "s string, s_kind string, p string, o string, o_kind string, o_dt string, o_lang string"
PARAM = "shape string, target_class string, target_node string, path string, component string, arg string, args array<string>, severity string"


def facts(spark, rows):
    return spark.createDataFrame([(s, "iri", p, o, "literal" if o.startswith("=") else "iri", "xsd:string" if o.startswith("=") else None, None) for s, p, o in rows], TRIPLE)


def plain_reach(tree, node, rows, back=False):
    """The nodes that a path leads to, from its tree."""
    kind, x = tree
    if kind == "pred":
        return {s for s, p, o in rows if p == x and o == node} if back else {o for s, p, o in rows if p == x and s == node}
    if kind == "inv":
        return plain_reach(x, node, rows, not back)
    if kind == "alt":
        return set().union(*(plain_reach(y, node, rows, back) for y in x))
    if kind == "seq":
        at = {node}
        for y in x[::-1] if back else x:
            at = set().union(*(plain_reach(y, n, rows, back) for n in at)) if at else set()
        return at
    if kind == "opt":
        return {node} | plain_reach(x, node, rows, back)
    seen, last = ({node}, {node}) if kind == "star" else (set(), plain_reach(x, node, rows, back))
    seen |= last
    while last:
        last = set().union(*(plain_reach(x, n, rows, back) for n in last)) - seen
        seen |= last
    return seen


def random_path(rng, depth):
    kind = rng.choice(["pred", "pred", "inv", "seq", "alt", "star", "plus", "opt"]) if depth else "pred"
    if kind == "pred":
        return ("pred", rng.choice("abc"))
    if kind in ("seq", "alt"):
        return (kind, [random_path(rng, depth - 1) for _ in range(rng.randrange(2, 4))])
    return (kind, random_path(rng, depth - 1))


def test_path_text():
    rng = random.Random(1)
    for _ in range(500):
        tree = random_path(rng, 4)
        again = P.parse(P.write(tree))
        assert P.write(again) == P.write(tree)
    assert P.parse("http://x/y") == ("pred", "http://x/y")
    for bad in ("<a>/", "(<a>", "<a> <b>", "<a>)", "<a>//<b>", "x<a>"):
        with pytest.raises(P.PathError):
            P.parse(bad)


def test_paths_against_plain(spark):
    rng = random.Random(2)
    rows = sorted({(f"n{rng.randrange(9)}", rng.choice("abc"), f"n{rng.randrange(9)}") for _ in range(16)})
    trees = {P.write(t): t for t in (random_path(rng, 3) for _ in range(25))}
    starts = [(p, f"n{i}", f"n{i}", "iri", None, None) for p in trees for i in range(9)]
    got = P.reach(spark.createDataFrame(starts, "path string, focus string, value string, kind string, dt string, lang string"), facts(spark, rows))
    found = {(r.path, r.focus, r.value) for r in got.collect()}
    assert found == {(p, f"n{i}", v) for p, t in trees.items() for i in range(9) for v in plain_reach(t, f"n{i}", rows)}
    assert got.count() == len(found)


def test_inverse_from_literals(spark):
    """A literal is told by its datatype and language; walked back from, it leads to its subjects."""
    t = spark.createDataFrame([("a", "iri", "p", "1", "literal", "xsd:integer", None), ("b", "iri", "p", "1", "literal", "xsd:string", None), ("c", "iri", "p", "1", "literal", None, "EN"), ("d", "iri", "p", "1", "iri", None, None)], TRIPLE)
    s = spark.createDataFrame([("^<p>", "x", "1", "literal", "xsd:integer", None), ("^<p>", "y", "1", "literal", None, "en"), ("(^<p>/<p>)", "z", "1", "iri", None, None), ("<p>", "w", "1", "literal", None, None), (None, "v", "a", "iri", None, None)], "path string, focus string, value string, kind string, dt string, lang string")
    assert {(r.focus, r.value, r.kind) for r in P.reach(s, t).collect()} == {("x", "a", "iri"), ("y", "c", "iri"), ("z", "1", "iri")}


def run(spark, rows, params, types=(), **more):
    types = spark.createDataFrame(list(types), "s string, type string")
    out = D.validate(facts(spark, rows), types, spark.createDataFrame(params, PARAM), **more).collect()
    return sorted((r.shape, r.focus, r.path or "", r.value or "", r.component) for r in out)


def test_nested_logic(spark):
    rows = [("a", "p", "=1"), ("a", "q", "=2"), ("b", "p", "=1"), ("c", "q", "=2")]
    params = [(f"S{k}", None, n, None, k, None, ms, "sh:Violation") for n in "abcd" for k, ms in (("and", ["P", "Q"]), ("or", ["P", "Q"]), ("xone", ["P", "Q"]), ("not", ["P"]), ("node", ["Q"]))]
    params += [("P", None, None, "p", "minCount", "1", None, "sh:Violation"), ("Q", None, None, "q", "minCount", "1", None, "sh:Violation")]
    failed = {(s[1:], f) for s, f, *_ in run(spark, rows, params)}
    holds = {"a": (True, True), "b": (True, False), "c": (False, True), "d": (False, False)}
    want = set()
    for n, (p, q) in holds.items():
        want |= {(k, n) for k, ok in (("and", p and q), ("or", p or q), ("xone", p != q), ("not", not p), ("node", q)) if not ok}
    assert failed == want


def test_deep_nesting_and_values(spark):
    """Conformance comes up through four strata; only targets' own results are listed, and those of nested property shapes."""
    rows = [("a", "to", "b"), ("b", "to", "c"), ("c", "to", "d"), ("d", "name", "=x"), ("e", "to", "f")]
    params = [("T", None, n, "to", "node", None, ["U"], "sh:Violation") for n in "ae"]
    params += [("U", None, None, "to", "node", None, ["V"], "sh:Violation"), ("V", None, None, "to", "property", None, ["W"], "sh:Violation"), ("W", None, None, "name", "in", None, ["y"], "sh:Violation")]
    assert run(spark, rows, params) == [("T", "a", "to", "b", "node")]
    params[3] = ("V", None, "c", "to", "property", None, ["W"], "sh:Violation")
    assert run(spark, rows, params) == [("T", "a", "to", "b", "node"), ("W", "d", "name", "=x", "in")]
    soft = [(*p[:7], "sh:Warning") if p[0] == "W" else p for p in params]
    assert run(spark, rows, soft, blocking=["sh:Violation"]) == [("W", "d", "name", "=x", "in")]


def test_several_constraints_of_a_kind(spark):
    """Two or-constraints of a shape are told apart, a member named twice counts once, and an unknown shape holds."""
    rows = [("a", "p", "=1")]
    params = [("S", None, "a", None, "or", None, ["Q", "Q"], "sh:Violation"), ("S", None, "a", None, "or", None, ["P", "Q"], "sh:Info"), ("S", None, "a", None, "xone", None, ["P", "P"], "sh:Info"), ("S", None, "a", None, "node", None, ["Nowhere"], "sh:Info"), ("S", None, "a", None, "not", None, ["Nowhere"], "sh:Info")]
    params += [("P", None, None, "p", "minCount", "1", None, "sh:Violation"), ("Q", None, None, "q", "minCount", "1", None, "sh:Violation")]
    assert run(spark, rows, params) == [("S", "a", "", "a", "not"), ("S", "a", "", "a", "or")]


def test_node_constraints_and_literals(spark):
    rows = [("a", "p", "=1"), ("b", "p", "c")]
    params = [("N", None, "a", None, "nodeKind", "sh:Literal", None, "sh:Violation"), ("N", None, "a", None, "pattern", "^a$", None, "sh:Violation"), ("N", None, "a", "p", "not", None, ["L"], "sh:Violation"), ("N", None, "b", "p", "not", None, ["L"], "sh:Violation"), ("L", None, None, None, "nodeKind", "sh:Literal", None, "sh:Violation")]
    assert run(spark, rows, params) == [("N", "a", "", "a", "nodeKind"), ("N", "a", "p", "=1", "not"), ("N", "b", "", "b", "nodeKind"), ("N", "b", "", "b", "pattern")]


def test_recursion_is_reported(spark):
    params = [("A", None, "a", None, "node", None, ["B"], "sh:Violation"), ("B", None, None, "p", "node", None, ["A"], "sh:Violation"), ("C", None, "a", None, "node", None, ["A"], "sh:Violation")]
    with pytest.raises(D.ShapeRecursionError, match="A, B, C"):
        run(spark, [("a", "p", "a")], params)


def test_no_shapes_and_no_data(spark):
    assert run(spark, [("a", "p", "b")], [("S", None, "a", None, None, None, None, None)]) == []
    empty = spark.createDataFrame([], TRIPLE)
    params = spark.createDataFrame([("S", "T", None, None, "not", None, ["P"], "sh:Violation"), ("P", None, None, "p", "minCount", "1", None, "sh:Violation")], PARAM)
    assert D.validate(empty, spark.createDataFrame([], "s string, type string"), params).count() == 0
    assert D.validate(empty, spark.createDataFrame([(None, None)], "s string, type string"), params).count() == 0


def loaded(spark, turtle):
    head = "@prefix sh: <http://www.w3.org/ns/shacl#> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . @prefix rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> .\n"
    return R.parameters(rdf.read_documents(spark.createDataFrame([("d", head + turtle)], "doc_id string, content string")))


def test_turtle_like_hand_made(spark, sf_dir):
    """Shapes in Turtle give the results of the same shapes as rows."""
    turtle = """
    <Cust> a sh:NodeShape ; sh:targetClass <Customer> ;
      sh:property [ sh:path <balance> ; sh:minInclusive 0 ; sh:maxCount 1 ] ;
      sh:property [ sh:path <balance> ; sh:datatype <xsd:integer> ; sh:severity sh:Warning ] ;
      sh:property [ sh:path <segment> ; sh:in ( "AUTOMOBILE" "BUILDING" "MACHINERY" "HOUSEHOLD" ) ; sh:severity sh:Warning ] ;
      sh:property [ sh:path <name> ; sh:pattern "^customer#[0-9]{8}0$" ; sh:flags "i" ; sh:maxLength 17 ; sh:severity sh:Info ] ;
      sh:property [ sh:path <placed> ; sh:minCount 5 ; sh:class <Order> ] ;
      sh:property [ sh:path <placed> ; sh:nodeKind sh:Literal ; sh:severity sh:Info ] ;
      sh:property [ sh:path <segment> ; sh:hasValue "BUILDING" ; sh:severity sh:Info ] .
    """
    t, types, made = catalog_queries._graph(spark, sf_dir)
    key = lambda df: sorted(map(str, df.select(D.RESULT).collect()))
    got, want = key(D.validate(t, types, loaded(spark, turtle))), key(D.validate(t, types, made))
    assert got == want and len(want) > 1000


def test_parameters(spark):
    turtle = """
    <A> a sh:NodeShape, rdfs:Class ; sh:closed true ; sh:ignoredProperties ( rdf:type <x> ) ;
      sh:property <P>, [ sh:path ( <a> [ sh:zeroOrMorePath [ sh:inversePath ( <b> <c> ) ] ] ) ; sh:maxCount 1 ] ;
      sh:and ( <B> [ sh:path <q> ; sh:minCount 1 ] ) .
    <B> sh:targetObjectsOf <r> ; sh:property <P> ; sh:not [ sh:nodeKind sh:IRI ] .
    <P> sh:path <p> ; sh:minCount 2 ; sh:severity sh:Warning ; sh:property [ sh:path <s> ; sh:languageIn ( "de" "en" ) ] .
    <Off> sh:deactivated true ; sh:targetClass <A> ; sh:nodeKind sh:Literal ; sh:property [ sh:path <o> ; sh:minCount 1 ] .
    """
    rows = {(r.shape, r.path, r.component, r.arg, tuple(r.args or ()), r.severity) for r in loaded(spark, turtle).where("component is not null").collect()}
    blank = {m for r in rows for m in r[4] if m.startswith("d:")}
    assert len(blank) == 2
    names = {s: ("not" if (s, None, "nodeKind", "sh:IRI", (), "sh:Violation") in rows else "and") for s in blank}
    told = {(names.get(s, s), p, c, a, tuple(names.get(m, m) for m in ms), v) for s, p, c, a, ms, v in rows}
    hard, soft = "sh:Violation", "sh:Warning"
    assert told == {
        ("A", None, "closed", "true", (G.RDF + "type", "x"), hard), ("A", "p", "minCount", "2", (), soft), ("B", "p", "minCount", "2", (), soft),
        ("A", "p", "property", None, ("P/property",), soft), ("B", "p", "property", None, ("P/property",), soft), ("P/property", "s", "languageIn", None, ("de", "en"), hard),
        ("A", "(<a>/(^(<b>/<c>))*)", "maxCount", "1", (), hard), ("A", None, "and", None, ("B", "and"), hard), ("and", "q", "minCount", "1", (), hard),
        ("B", None, "not", None, ("not",), hard), ("not", None, "nodeKind", "sh:IRI", (), hard),
    }
    aims = {(r.shape, r.target_class, r.target_objects_of) for r in loaded(spark, turtle).where("component is null").collect()}
    assert aims == {("A", "A", None), ("B", None, "r")}


def test_bad_paths_and_no_shapes(spark):
    with pytest.raises(R.PathCycleError):
        loaded(spark, "<A> sh:property [ sh:path _:x ; sh:minCount 1 ] . _:x sh:inversePath _:y . _:y sh:inversePath _:x .")
    assert loaded(spark, "<a> <b> <c> .").count() == 0


def test_registered_turtle_is_nested(spark):
    rows = validation_queries.turtle_params(spark).collect()
    assert not [r for r in rows if r.shape == "Quiet"] and {r.component for r in rows} >= {"xone", "or", "node", "property", "qualifiedMinCount", None}


def test_walk_of_many_cells_that_branch(spark):
    """10^5 cells in 1,000 lists, of which every tenth has a cell with two rests: jumps stay one a cell."""
    ids = spark.range(100_000).selectExpr("id", "id div 100 as list", "id % 100 as pos")
    cells = ids.select(F.concat(F.lit("c"), F.col("id")).alias("cell"), F.concat(F.lit("m"), F.col("pos")).alias("first"), F.when(F.col("pos") == 99, G.RDF + "nil").otherwise(F.concat(F.lit("c"), F.col("id") + 1)).alias("rest"), "list", "pos")
    split = cells.where("list % 10 = 0 and pos in (20, 21, 22, 50)").withColumn("rest", F.concat(F.lit("c"), (F.col("list") * 100 + 70).cast("string")))
    found = G.list_members(cells.unionByName(split).select("cell", "first", "rest"), cells.where("pos = 0").select(F.col("cell").alias("head")))
    got = found.groupBy("valid").agg(F.count("*").alias("n"), F.min(F.size("members")).alias("least"), F.max(F.size("members")).alias("most")).collect()
    assert {(r.valid, r.n) for r in got} == {(True, 900), (False, 100)}
    assert {(r.least, r.most) for r in got if r.valid} == {(100, 100)}


def test_closure_of_a_branching_graph(spark):
    """A binary tree of 2^12 nodes with links back to its root: each node once, at its depth, all rounds one table."""
    edges = spark.range(1, 2048).selectExpr("cast(id as string) as src", "explode(array(2 * id, 2 * id + 1, 1)) as d").selectExpr("src", "cast(d as string) as dst")
    out = G.closure(edges, spark.createDataFrame([("1",)], "root string"))
    rows = out.selectExpr("count(*) as n", "count(distinct node) as d", "max(depth) as deep").first()
    assert (rows.n, rows.d, rows.deep) == (4095, 4095, 11)
    assert "Union" not in out._jdf.queryExecution().executedPlan().toString()


def test_deterministic_automata():
    """Walks of the deterministic automaton are those of the path; states that walks of several lengths reach are told."""
    rng = random.Random(3)
    for _ in range(200):
        path = P.write(random_path(rng, 3))
        one, two = P.automaton(path), P.deterministic(path)
        assert one[0] == two[0] and len({m[:3] for m in two[1]}) == len(two[1])
        for _ in range(30):
            word = [(rng.choice("abc"), rng.random() < 0.3) for _ in range(rng.randrange(1, 5))]
            ends = []
            for _, moves in (one, two):
                at, end = {0}, False
                for p, back in word:
                    took = [m for m in moves if m[0] in at and m[1:3] == (p, back)]
                    at, end = {m[3] for m in took}, any(m[4] for m in took)
                ends.append(end)
            assert ends[0] == ends[1]
        lengths, at = {}, {0}
        for length in range(1, 40):
            at = {m[3] for m in two[1] if m[0] in at}
            for x in at:
                lengths.setdefault(x, set()).add(length)
        assert P.revisited(two[1]) == {x for x, n in lengths.items() if len(n) > 1}


@pytest.mark.parametrize("small", [0, 10_000])
def test_counts_against_plain(spark, monkeypatch, small):
    """Places that several starts share are walked once; what a start is itself counts once, on a cycle and off it."""
    monkeypatch.setattr(P, "SMALL", small)
    rng = random.Random(4)
    rows = sorted({(f"n{i}", "a", f"n{i // 3}") for i in range(27)} | {(f"n{rng.randrange(27)}", rng.choice("bc"), f"n{rng.randrange(27)}") for _ in range(20)})
    paths = ["<a>*", "<a>+", "(<a>/<b>?)*", "((<a>/<a>)|<a>)", "(<a>/^<a>)*", "(<a>/^<a>)", "^<a>", "(<b>|<c>)+", "<a>?", "<d>*", "(^<a>/<a>)+"]
    starts = [(k, p, f"n{i}", f"n{i}", "iri", None, None) for k, p in enumerate(paths) for i in range(30)]
    df = spark.createDataFrame(starts, "shape int, path string, focus string, value string, kind string, dt string, lang string")
    want = {(k, p, f"n{i}"): plain_reach(P.parse(p), f"n{i}", rows) for k, p in enumerate(paths) for i in range(30)}
    got = P.counted(df, facts(spark, rows)).collect()
    assert len(got) == len(want) and {(r.shape, r.path, r.focus): r.n for r in got} == {k: len(v) for k, v in want.items()}
    nodes = P.Walk(df, facts(spark, rows)).nodes().collect()
    assert sorted((r.shape, r.path, r.focus, r.value) for r in nodes) == sorted((*k, x) for k, v in want.items() for x in v)


def test_shared_places_are_walked_once(spark, monkeypatch):
    """60 starts lead to one place: a row of theirs each is all that is written of them, and one walk."""
    monkeypatch.setattr(P, "SMALL", 0)
    rows = [(f"s{i}", "up", "top") for i in range(60)] + [("top", "up", "root")] + [(f"t{i}", "at", "top") for i in range(50)]
    df = spark.createDataFrame([(p, f"s{i}", f"s{i}", "iri", None, None) for p in ("(<up>/<up>)", "(<up>/^<at>)") for i in range(60)], "path string, focus string, value string, kind string, dt string, lang string")
    walk = P.Walk(df, facts(spark, rows))
    assert walk.walked.select("path", "key").distinct().count() == 2 and walk.walked.count() == 51
    assert {r.n: r.k for r in walk.counts().groupBy("n").agg(F.count("*").alias("k")).collect()} == {1: 60, 50: 60}


def test_triples_are_filtered_before_they_are_shuffled(spark):
    """Only predicates that shapes ask for are joined; a count along a path is no row a value node."""
    rows = [(f"s{i}", "p", "=1") for i in range(4)] + [(f"s{i}", "other", f"s{i}") for i in range(4)]
    few = spark.createDataFrame([("p",)], "p string")
    out = P.only(facts(spark, rows), few)
    assert out.count() == 4 and "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    params = spark.createDataFrame([("S", None, "s1", "<p>+", "minCount", "1", None, "v"), ("S", None, "s1", "(<p>|<q>)", "minCount", "1", None, "v"), ("S", None, "s1", "(<p>|<q>)", "in", None, ["1"], "v")], PARAM)
    assert [(r.shape, r.path) for r in D.counted_paths(params).collect()] == [("S", "<p>+")]


@pytest.mark.parametrize("bits", [62, 1])
def test_what_a_node_fails_of_is_one_number(spark, monkeypatch, bits):
    """Qualified counts along a step backwards: no walk, and each failure is joined once, not once a constraint; many members are counted."""
    monkeypatch.setattr(D, "BITS", bits)
    rows = [(f"l{i}", "of", f"o{i // 3}") for i in range(9)] + [(f"l{i}", "size", f"={i}") for i in range(9)]
    rows += [("l8", "of", "o2"), ("l1", "flag", "=R")]
    params = [("T", None, f"o{k}", "^<of>", c, n, ms, "sh:Violation") for k in range(4) for c, n, ms in (("qualifiedMinCount", "2", ["Flag"]), ("qualifiedMaxCount", "0", ["Flag"]), ("qualifiedMinCount", "2", ["Size", "Flag"]))]
    params += [("Flag", None, None, "flag", "minCount", "1", None, "sh:Violation"), ("Size", None, None, "size", "hasValue", "=4", None, "sh:Violation")]
    walks, walk = [], P.Walk
    monkeypatch.setattr(P, "Walk", lambda *a: walks.append(a) or walk(*a))
    joins, cls = [], type(spark.range(1))
    join = cls.join
    monkeypatch.setattr(cls, "join", lambda self, other, on=None, how=None: joins.append((on, how)) or join(self, other, on, how))
    got = run(spark, rows, params)
    least = [("T", f"o{k}", "^<of>", "", "qualifiedMinCount") for k in range(4) for _ in range(2)]
    assert got == sorted([*least, ("T", "o0", "^<of>", "", "qualifiedMaxCount")])
    assert not walks and ((["member", "term"], "left_anti") in joins) == (bits == 1)


def test_triples_are_read_by_predicate(spark, sf_dir):
    """Predicates and types that nothing asks for aren't scanned."""
    t, types = validation_queries.graph(spark, sf_dir)
    text = P.only(t, spark.createDataFrame([("quantity",)], "p string"))._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan") == 1 and "Generate" not in text
    text = P.only(types, spark.createDataFrame([("Order",)], "want string"), "want", "type")._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan") == 1


def test_rows_meet_places_without_a_sort_of_rows(spark, monkeypatch):
    """A level's rows are joined with what their nodes lead to, never grouped by all their columns; a node of several places is one row that is walked."""
    monkeypatch.setattr(P, "SMALL", 0)
    plans, shared = {}, G.shared
    monkeypatch.setattr(G, "shared", lambda df, tag: plans.setdefault(tag, []).append(df._jdf.queryExecution().executedPlan().toString()) or shared(df, tag))
    rows = [(f"s{i}", "up", f"t{i // 10}") for i in range(40)] + [("s3", "up", "t0"), ("s5", "up", "t2")]
    df = spark.createDataFrame([("<up>+", f"s{i}", f"s{i}", "iri", None, None) for i in range(40)], "path string, focus string, value string, kind string, dt string, lang string")
    walk = P.Walk(df, facts(spark, rows))
    assert walk.levels[0].count() == 40 and [r.focus for r in walk.levels[0].where("not easy").collect()] == ["s5"]
    assert {r.focus: r.n for r in walk.counts().collect()} == {f"s{i}": 2 if i == 5 else 1 for i in range(40)}
    assert not [x for tag in ("level", "places") for x in plans[tag] if "SortAggregate" in x]


def test_crowds_are_dealt_out(spark, monkeypatch):
    """Rows that share a place with many others meet its ends in parts."""
    monkeypatch.setattr(P, "SMALL", 0)
    monkeypatch.setattr(P, "CROWD", 10)
    rows = [(f"s{i}", "in", f"n{i % 2}") for i in range(60)]
    df = spark.createDataFrame([("(<in>/^<in>)", f"s{i}", f"s{i}", "iri", None, None) for i in range(60)], "path string, focus string, value string, kind string, dt string, lang string")
    out = P.Walk(df, facts(spark, rows)).nodes()
    got = sorted((r.focus, r.value) for r in out.collect())
    assert got == sorted((f"s{i}", f"s{k}") for i in range(60) for k in range(60) if i % 2 == k % 2)
    assert "part#" in out._jdf.queryExecution().optimizedPlan().toString()
