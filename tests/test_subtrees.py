import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import graph as G
from graphloom.operators import subtrees as T
from graphloom.sources import rdf

DDL = "s string, s_kind string, p string, o string, o_kind string, o_dt string, o_lang string"
SH, XSD = T.SH, G.ESSENTIAL["xsd"]


def triples(spark, rows):
    """Rows (s, p, o): names that begin with _ are blank nodes, with = literals."""
    kind = lambda x: "bnode" if x.startswith("_") else "literal" if x.startswith("=") else "iri"
    return spark.createDataFrame([(s, kind(s), p, o.removeprefix("="), kind(o), XSD + "string" if o.startswith("=") else None, None) for s, p, o in rows], DDL)


def tree(rng, name, depth, rows):
    for k in range(rng.randrange(1, 4)):
        p = rng.choice("pqr")
        if depth and rng.random() < 0.6:
            child = f"{name}{k}"
            rows.append((name, p, child))
            tree(rng, child, depth - 1, rows)
        else:
            rows.append((name, p, rng.choice(["=1", "=2", "i1", "i2"])))


def renamed(rng, rows):
    names = sorted({x for s, _, o in rows for x in (s, o) if x.startswith("_")})
    to = dict(zip(names, rng.sample([f"_n{i}" for i in range(1000)], len(names)), strict=True))
    out = [(to.get(s, s), p, to.get(o, o)) for s, p, o in rows]
    rng.shuffle(out)
    return out, to


def test_hashes_of_trees(spark):
    """Trees under other names hash alike; a change anywhere, three levels down too, doesn't."""
    rng = random.Random(3)
    every, pairs, changed = [], [], []
    for i in range(12):
        rows = []
        tree(rng, f"_t{i}x", 4, rows)
        again, to = renamed(rng, rows)
        again = [tuple(x if not x.startswith("_") else f"{x}c{i}" for x in r) for r in again]
        deep = max(range(len(rows)), key=lambda k: len(rows[k][0]))
        other = [(s, p, "=changed" if k == deep else o) for k, (s, p, o) in enumerate(rows) if k == deep or not (rows[deep][2].startswith("_") and s.startswith(rows[deep][2]))]
        other = [tuple(x if not x.startswith("_") else f"{x}d" for x in r) for r in other]
        every += rows + again + other
        pairs.append((f"_t{i}x", to[f"_t{i}x"] + f"c{i}"))
        changed.append((f"_t{i}x", f"_t{i}xd"))
    found = {r.node: r.hash for r in T.subtree_hashes(triples(spark, every)).collect()}
    assert all(found[a] == found[b] for a, b in pairs)
    assert all(found[a] != found[b] for a, b in changed)


def test_cycles_and_shared_nodes(spark):
    rows = [
        ("_a", "p", "_b"), ("_b", "p", "_a"), ("_c", "p", "_d"), ("_d", "p", "_c"), ("_e", "p", "_e"),  # two cycles of two, one of one
        ("_f", "p", "_g"), ("_f", "q", "_g"), ("_h", "p", "_i"), ("_h", "q", "_j"), ("_k", "q", "_l"), ("_k", "p", "_l"),  # one node twice, two nodes once
        ("_u", "p", "_a"), ("_v", "p", "_c"), ("_w", "p", "=1"), ("_x", "p", "_y"),
    ]
    t = triples(spark, rows)
    hashes = {r.node: r.hash for r in T.subtree_hashes(t).collect()}
    assert not {"_a", "_b", "_c", "_d", "_e", "_u", "_v"} & set(hashes) and {"_w", "_y", "_f"} <= set(hashes)
    roots = spark.createDataFrame([(x,) for x in ("_a", "_c", "_e", "_f", "_h", "_k", "_u", "_v", "_w", "_x")], "root string")
    s = {r.root: r.signature for r in T.signatures(t, roots).collect()}
    assert len(s) == 10 and s["_a"] == s["_c"] and s["_u"] == s["_v"] and s["_f"] == s["_k"]
    assert len({s[x] for x in ("_a", "_e", "_f", "_h", "_u", "_w", "_x")}) == 7


def test_canonical_names():
    """Graphs in which all nodes look alike are told by their shape: two triangles and a ring of six."""
    ring = lambda names: [(a, "p", b, "bnode", None, None) for a, b in zip(names, names[1:] + names[:1], strict=True)]
    six, twice = ring(list("abcdef")), ring(list("abc")) + ring(list("def"))
    assert T.canonical_hash(six, "a") == T.canonical_hash(ring(list("fedcba")), "c")
    assert T.canonical_hash(six, "a") != T.canonical_hash(twice, "a")
    star = [("a", "p", x, "bnode", None, None) for x in "bcd"]
    assert T.canonical_hash(star, "a") == T.canonical_hash([(s.upper(), p, o.upper(), *r) for s, p, o, *r in star[::-1]], "A")


def shapes(rows):
    return [("S", G.RDF + "type", SH + "NodeShape"), ("S", SH + "targetClass", "C"), *rows]


def test_export(spark):
    def prop(n, count, deep="x"):
        return [("S", SH + "property", n), (n, SH + "path", "p"), (n, SH + "minCount", f"={count}"), (n, SH + "or", n + "l"), (n + "l", G.RDF + "first", n + "m"), (n + "l", G.RDF + "rest", G.RDF + "nil"), (n + "m", SH + "class", deep)]

    rows = shapes(prop("_a", 1) + prop("_b", 1) + prop("_c", 2) + prop("_d", 1, "y"))
    rows += [("E", G.RDF + "type", SH + "NodeShape"), ("R", G.RDF + "type", SH + "NodeShape"), ("S", SH + "node", "R"), ("_free", "says", "=kept")]
    out, counts = T.export(triples(spark, rows))
    subjects = {r.s for r in out.select("s").collect()}
    assert subjects == {"S", "R", "_free", "_a", "_al", "_am", "_c", "_cl", "_cm", "_d", "_dl", "_dm"}
    assert (counts["properties_before"], counts["properties"], counts["node_shapes_before"], counts["node_shapes"]) == (4, 3, 3, 2)
    assert T.export(triples(spark, []))[0].count() == 0


def test_lost_constraint_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(T, "deduplicated", lambda t: t.where(F.col("p") != SH + "minCount"))
    with pytest.raises(T.ExportError):
        T.export(triples(spark, shapes([("S", SH + "property", "_a"), ("_a", SH + "minCount", "=1")])))


def read_back(spark, path):
    return rdf.read_files(spark, str(path)).drop("doc_id")


def test_turtle_round_trip(spark, tmp_path):
    rng = random.Random(9)
    rows = [("http://x/S", "http://x/p", "_r"), ("http://x/S", G.RDF + "type", "http://x/C.")]
    for i in range(5):
        rows.append((f"http://x/s{i}", "http://x/has", f"_t{i}"))
        tree(rng, f"_t{i}", 3, rows)
    rows = [(s, p if ":" in p else f"http://x/{p}", o if not o.startswith("i") else f"http://x/{o}") for s, p, o in rows]
    rows += [("_r", G.RDF + "first", "_m"), ("_r", G.RDF + "rest", "_r2"), ("_r2", G.RDF + "first", "=one"), ("_r2", G.RDF + "rest", G.RDF + "nil"), ("_m", "http://x/q", "_none"), ("http://x/S", "http://x/empty", G.RDF + "nil")]
    rows += [("_bad", G.RDF + "first", "=1"), ("_bad", G.RDF + "first", "=2"), ("_bad", G.RDF + "rest", G.RDF + "nil"), ("http://x/S", "http://x/bad", "_bad")]
    t = triples(spark, rows)
    odd = [('say "a"\n\t\\ é 漢', XSD + "string", None), ("1", XSD + "integer", None), ("hallo", G.RDF + "langString", "de-at"), ("", XSD + "string", None), ("x", "http://x/type", None)]
    t = t.unionByName(spark.createDataFrame([("http://x/S", "iri", "http://x/odd", o, "literal", dt, lang) for o, dt, lang in odd], DDL))
    T.write_turtle(t, str(tmp_path / "a"), {"http://x/": "x", XSD: "xsd", SH: "sh"})
    back = read_back(spark, tmp_path / "a")
    assert T.same(t, back) and back.count() == t.distinct().count()
    text = "".join(p.read_text() for p in (tmp_path / "a").glob("part-*"))
    assert "_:" not in text and "( [" in text and "x:empty ()" in text and text.count("@prefix x:") == 1
    T.write_turtle(t, str(tmp_path / "b"), {"http://x/": "x"}, files=3)
    assert len([p for p in (tmp_path / "b").glob("part-*") if p.stat().st_size]) > 1
    assert T.same(t, read_back(spark, tmp_path / "b"))


def test_turtle_of_shared_nodes_and_cycles(spark, tmp_path, monkeypatch):
    rows = [("http://x/a", "http://x/p", "_s"), ("http://x/b", "http://x/p", "_s"), ("_s", "http://x/v", "=1"), ("_u", "http://x/v", "=root"), ("_u", "http://x/w", "_n"), ("http://x/c", "http://x/p", "_x"), ("_x", "http://x/p", "_y"), ("_y", "http://x/p", "_x"), ("http://x/d", "http://x/v", "=2")]
    rows += [("http://x/many", "http://x/v", f"={i}") for i in range(57)] + [("http://x/many", "http://x/q", "=1")]
    monkeypatch.setattr(T, "CHUNK", 10)
    t = triples(spark, rows)
    T.write_turtle(t, str(tmp_path / "c"), files=3)
    back = read_back(spark, tmp_path / "c")
    assert back.count() == len(rows)
    shared = {r.o for r in back.where(F.col("s").isin("http://x/a", "http://x/b")).collect()}
    assert len(shared) == 1
    for root in ("http://x/c",):
        at = {r.o for r in back.where(F.col("s") == root).collect()}
        edges = {(r.s, r.o) for r in back.where("s_kind = 'bnode' and o_kind = 'bnode'").collect()}
        (x,) = at
        assert any(a == x and (b, a) in edges for a, b in edges)
    text = "".join(p.read_text() for p in (tmp_path / "c").glob("part-*"))
    assert text.count("<http://x/many>") > 5 and "[] <http://x/v>" in text
    T.write_turtle(triples(spark, []), str(tmp_path / "d"))
    assert not "".join(p.read_text() for p in (tmp_path / "d").glob("part-*"))


def test_hashing_writes_references_alone(spark, monkeypatch):
    """Triples are read as they are: what hashing shares is a row a reference and level, never the triples or the open nodes again."""
    rows = [(f"_o{i}", "line", f"_l{i}-{k}") for i in range(20) for k in range(3)] + [(f"_l{i}-{k}", "ships", f"_s{i}-{k}") for i in range(20) for k in range(3)]
    rows += [(f"_s{i}-{k}", "size", f"={k % 2}") for i in range(20) for k in range(3)] + [(f"_o{i}", "state", f"={i % 2}") for i in range(20)]
    written, shared = [], G.shared
    monkeypatch.setattr(G, "shared", lambda df, tag: written.append(shared(df, tag)) or written[-1])
    found = T.subtree_hashes(triples(spark, rows + rows)).collect()
    assert len({r.hash for r in found if r.node.startswith("_o")}) == 2 and {r.depth for r in found if r.node.startswith("_o")} == {2}
    assert len(found) == 140 and sum(df.count() for df in written) <= 120 + 60
