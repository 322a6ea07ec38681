"""What hangs below blank nodes: canonical hashes of subtrees, the export that loses nothing, and Turtle text.

Both the hashes and the text are made from the leaves up, a level a round: a blank node is done when all
blank nodes that it refers to are. A node's hash comes from sums over its triples, which are added up
map-side, so that it needs no order and no collected rows. Blank nodes that lead back to themselves are never
done, which is how cycles show; for them, and for nodes that several refer to, names are found for each
fragment by itself.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators import graph as G
from graphloom.operators import shapes as S

SH = G.ESSENTIAL["sh"]
TRIPLE = ["s", "s_kind", "p", "o", "o_kind", "o_dt", "o_lang"]
#: Objects of one predicate in one statement, and triples of a blank node that is written within another.
CHUNK, NESTED = 1000, 1000


def _line(told: Column) -> Column:
    """What a triple says of its subject, with told in place of its object."""
    return F.concat_ws("\x1f", "p", F.substring("o_kind", 1, 1), told, F.coalesce("o_dt", F.lit("")), F.coalesce(F.lower("o_lang"), F.lit("")))


def _hashes(*line: Column) -> list[Column]:
    """128 bits of a line of columns that are never null."""
    return [F.xxhash64(F.lit(i), *line).alias(f"x{i}") for i in range(2)]


def _sums(hashes: list[Column] | None = None) -> list[Column]:
    """Sums that tell a set of lines by their hashes (x0, x1), whatever their order; aggregates. Of halves, as 64 bits hold two billion of these."""
    part = lambda x, high: F.shiftrightunsigned(x, 32) if high else x.bitwiseAND(F.lit(0xFFFFFFFF))
    return [F.coalesce(F.sum(part(x, high)), F.lit(0)).alias(f"h{2 * i + high}") for i, x in enumerate(hashes or [F.col("x0"), F.col("x1")]) for high in (0, 1)]


_SUMS = ["n", "h0", "h1", "h2", "h3"]


def _told() -> Column:
    return F.sha2(F.concat_ws(" ", *[F.col(c).cast("string") for c in _SUMS]), 256)


def subtree_hashes(triples: DataFrame) -> DataFrame:
    """S70. (node, hash, depth) of blank nodes: equal for subtrees that are equal up to names of blank nodes.

    A blank node without triples is a leaf. Nodes that lead into a cycle have no row. triples are read twice.

    A node is one row: the sums of what it says without blank nodes, and how many references to blank nodes
    wait for their hashes. References are looked up once by what they refer to, a level a round; what they
    then say is added up by subject. Only what still waits goes on.
    """
    spark = triples.sparkSession
    t = triples.select(TRIPLE).where("s_kind = 'bnode'")
    none = lambda c: F.coalesce(c, F.lit(""))
    tail = [none(F.col("o_dt")), none(F.lower("o_lang"))]
    blank = F.coalesce(F.col("o_kind") == "bnode", F.lit(False))
    # o_lang as it stands tells triples apart, in lower case it is what they say
    raw = F.xxhash64(none(F.col("o")), none(F.col("o_lang")))
    parts = G.dealt_parts(t)
    rows = t.select(F.col("s").alias("node"), blank.alias("blank"), raw.alias("raw"), *_hashes(F.col("p"), none(F.substring("o_kind", 1, 1)), none(F.col("o")), *tail))
    rows = rows.repartition(parts, "node").groupBy("node", "blank", "raw", "x0", "x1").agg(F.lit(1).alias("one"))
    x = [F.when(F.col("blank"), 0).otherwise(F.col(c)).cast("bigint") for c in ("x0", "x1")]
    states = G.Rounds(spark, "hashes")
    depth = lambda d: F.lit(d).alias("depth")
    state = states.add(rows.groupBy("node").agg(F.count_if(~F.col("blank")).alias("n"), *_sums(x), F.count_if("blank").alias("waits")).select("node", *_SUMS, "waits", depth(0)))
    refs = t.where("o_kind = 'bnode'").select("o", F.col("s").alias("node"), "p", none(F.col("o_dt")).alias("o_dt"), none(F.col("o_lang")).alias("o_lang"))
    refs = refs.repartition(parts, "o").dropDuplicates()
    said = _hashes(F.col("p"), F.lit("b"), *[F.col(c) for c in _SUMS], F.col("o_dt"), F.lower("o_lang"))
    level = 0
    while True:
        # what is looked up is written with what it says, or as it is if that isn't known yet
        known = F.col("waits") == 0
        if level == 0:
            below = state.select(F.col("node").alias("o"), *_SUMS, "waits")
            met = refs.join(below, "o", "left").withColumn("bare", F.col("waits").isNull()).fillna(0, [*_SUMS, "waits"])
        else:
            met = refs.join(state.where(known).select(F.col("node").alias("o"), *_SUMS, "waits"), "o", "left").withColumn("bare", F.lit(False))
        done = F.coalesce(known, F.lit(False))
        rest = [F.when(~done, F.col(c)).alias(c) for c in ("p", "o_dt", "o_lang")]
        met = G.shared(met.select("node", F.when(~done | F.col("bare"), F.col("o")).alias("o"), *rest, *[F.when(done, h).alias(f"x{i}") for i, h in enumerate(said)], "bare"), "references")
        told = met.where("x0 is not null").groupBy("node").agg(F.count("*").alias("n"), *_sums())
        if level == 0:
            bare = met.where("bare").select(F.col("o").alias("node")).distinct()
            states.add(bare.select("node", *[F.lit(0).cast("bigint").alias(c) for c in [*_SUMS, "waits"]], depth(0)))
        waiting = state.where("waits > 0")
        both = waiting.select("node", *_SUMS, "waits").unionByName(told.withColumn("waits", -F.col("n")))
        level += 1
        state = states.add(both.groupBy("node").agg(*[F.sum(c).alias(c) for c in [*_SUMS, "waits"]]).select("node", *_SUMS, "waits", depth(level)))
        refs = met.where("x0 is null").select("o", "node", "p", "o_dt", "o_lang")
        if state.where("waits = 0").isEmpty():
            return states.all().where("waits = 0").select("node", _told().alias("hash"), "depth")


def canonical_hash(rows: list[tuple], root: str) -> str:
    """The hash of a fragment (s, p, o, kind, dt, lang; kind of the object) that is the same for all names of its blank nodes.

    Blank nodes get colours from what surrounds them until these part no further; where several still look
    alike, each of them is told apart in turn and the least result is taken.
    """
    blank = sorted({root} | {r[0] for r in rows} | {r[2] for r in rows if r[3] == "bnode"})
    text = lambda *x: hashlib.sha256("\x1f".join(map(str, x)).encode()).hexdigest()

    def refined(colour: dict[str, str]) -> dict[str, str]:
        while True:
            around: dict[str, list[str]] = {b: [] for b in blank}
            for s, p, o, kind, dt, lang in rows:
                around[s].append(text(">", p, kind, colour.get(o, "") if kind == "bnode" else o, dt or "", (lang or "").lower()))
                if kind == "bnode":
                    around[o].append(text("<", p, colour[s]))
            new = {b: text(colour[b], *sorted(around[b])) for b in blank}
            if len(set(new.values())) == len(set(colour.values())):
                return new
            colour = new

    def least(colour: dict[str, str]) -> str:
        colour = refined(colour)
        groups: dict[str, list[str]] = {}
        for b in blank:
            groups.setdefault(colour[b], []).append(b)
        alike = [g for _, g in sorted(groups.items()) if len(g) > 1]
        if not alike:
            return text(*sorted(text(colour[s], p, kind, colour[o] if kind == "bnode" else o, dt or "", (lang or "").lower()) for s, p, o, kind, dt, lang in rows), colour[root])
        return min(least(colour | {b: text("one", colour[b])}) for b in alike[0])

    return least({b: "root" if b == root else "" for b in blank})


def signatures(triples: DataFrame, roots: DataFrame) -> DataFrame:
    """S70. (root, signature) of blank nodes (root), the same for subtrees that are equal up to names.

    Subtrees are hashed by level. Fragments with a blank node that several refer to within them, or that
    lead into a cycle, are named by canonical_hash, one fragment a group: what one shape holds.
    """
    t = G.shared(triples.select(TRIPLE).distinct(), "signed")
    roots = G.shared(roots.select("root").distinct(), "roots")
    hashes = G.shared(subtree_hashes(t), "hashes")
    edges = t.where("s_kind = 'bnode' and o_kind = 'bnode'").select(F.col("s").alias("src"), F.col("o").alias("dst"), "p")
    # which fragments need names: a cycle, or a node that is referred to twice within the fragment
    crowded = edges.groupBy("dst").agg(F.count("*").alias("n")).where("n > 1")
    odd = hashes.join(roots.withColumnRenamed("root", "node"), "node", "right").where("hash is null").select(F.col("node").alias("root"))
    if not crowded.isEmpty():
        within = G.closure(edges.select("src", "dst"), roots)
        twice = within.withColumnRenamed("node", "src").join(edges, "src").groupBy("root", F.col("dst").alias("node")).agg(F.count("*").alias("n")).where("n > 1 or node = root")
        odd = odd.unionByName(twice.select("root"))
    odd = G.shared(odd.distinct(), "odd")
    plain = roots.join(odd, "root", "left_anti").join(hashes.select(F.col("node").alias("root"), F.col("hash").alias("signature")), "root")
    if odd.isEmpty():
        return plain

    def named(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        plain_ = rows.astype(object).where(rows.notna(), None)
        found = [tuple(r) for r in plain_[["s", "p", "o", "o_kind", "o_dt", "o_lang"]].itertuples(index=False) if r[0] is not None]
        return pd.DataFrame({"root": [key[0]], "signature": [canonical_hash(found, key[0])]})

    below = G.closure(edges.select("src", "dst"), odd).select("root", F.col("node").alias("s"))
    fragments = below.join(t.where("s_kind = 'bnode'"), "s", "left")
    return plain.unionByName(fragments.groupBy("root").applyInPandas(named, "root string, signature string"))


def inventory(triples: DataFrame) -> DataFrame:
    """S71, S72. The distinct constraints of shapes in triples with full IRIs: (role, parent, predicate, signature).

    attached: property shapes of node shapes, node: other values of node shapes, standalone: property
    shapes that nothing has. What isn't blank is its own signature.
    """
    t = G.shared(triples.select(TRIPLE).distinct(), "inventory")
    of = lambda k: t.where((F.col("p") == G.RDF + "type") & (F.col("o") == SH + k)).select("s").distinct()
    said = t.join(of("NodeShape"), "s", "left_semi").where(~F.col("p").isin(G.RDF + "type", SH + "targetClass"))
    has = t.where(F.col("p") == SH + "property").select(F.col("o").alias("s")).distinct()
    alone = of("PropertyShape").join(has, "s", "left_anti").join(t.select("s", "s_kind").distinct(), "s")
    blank = said.where("o_kind = 'bnode'").select(F.col("o").alias("root")).unionByName(alone.where("s_kind = 'bnode'").select(F.col("s").alias("root"))).distinct()
    signed = G.shared(signatures(t, blank), "signed")
    # the signature of a property shape with a name is what it says, of a value what it is
    lines = t.join(has.unionByName(alone.select("s")).distinct(), "s", "left_semi").where("s_kind = 'iri'").join(subtree_hashes(t).select(F.col("node").alias("o"), "hash"), "o", "left")
    names = lines.select("s", *_hashes(_line(F.coalesce("hash", "o")))).groupBy("s").agg(F.count("*").alias("n"), *_sums()).select(F.col("s").alias("root"), F.concat(F.col("s"), F.lit(" "), _told()).alias("signature"))
    every = signed.unionByName(names)
    attached = F.col("p") == SH + "property"
    value = F.when(F.col("o_kind") == "bnode", F.col("signature")).when(attached, F.coalesce("signature", "o")).otherwise(F.sha2(_line(F.col("o")), 256))
    rows = said.join(every.withColumnRenamed("root", "o"), "o", "left").select(F.when(attached, "attached").otherwise("node").alias("role"), F.col("s").alias("parent"), F.when(~attached, F.col("p")).alias("predicate"), value.alias("signature"))
    own = alone.join(every.withColumnRenamed("root", "s"), "s").select(F.lit("standalone").alias("role"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("string").alias("predicate"), "signature")
    return rows.unionByName(own).distinct()


def deduplicated(triples: DataFrame) -> DataFrame:
    """S73, S74. Triples with one of each node shape's blank property shapes that are alike, the least name; orphans go."""
    t = G.shared(triples.select(TRIPLE).distinct(), "repeated")
    shapes = t.where((F.col("p") == G.RDF + "type") & (F.col("o") == SH + "NodeShape")).select("s").distinct()
    has = t.where((F.col("p") == SH + "property") & (F.col("o_kind") == "bnode")).join(shapes, "s", "left_semi").select("s", F.col("o").alias("root"))
    signed = has.join(signatures(t, has.select("root")), "root")
    stay = signed.groupBy("s", "signature").agg(F.min("root").alias("o")).select("s", F.lit(SH + "property").alias("p"), "o")
    gone = has.select("s", F.lit(SH + "property").alias("p"), F.col("root").alias("o")).join(stay, ["s", "p", "o"], "left_anti")
    kept = t.join(gone, ["s", "p", "o"], "left_anti").select(TRIPLE)
    # blank nodes that only what went referred to
    lost = gone.select(F.col("o").alias("s")).join(kept.where("o_kind = 'bnode'").select(F.col("o").alias("s")), "s", "left_anti").distinct()
    first = kept.join(lost, "s", "left_anti").select(TRIPLE)
    before = t.where("s_kind = 'bnode'").select("s").distinct().join(t.where("o_kind = 'bnode'").select(F.col("o").alias("s")), "s", "left_anti")
    roots = G.shared(before, "unreferred")  # what nothing referred to before stays
    return S.without_orphans(first, keep=roots)


def without_empty(triples: DataFrame) -> DataFrame:
    """S75. Triples without node shapes that hold only a type and target classes and that nothing refers to."""
    node = (F.col("p") == G.RDF + "type") & (F.col("o") == SH + "NodeShape")
    only = triples.groupBy("s").agg(F.bool_and(F.col("p").isin(G.RDF + "type", SH + "targetClass")).alias("bare"), F.bool_or(node).alias("node")).where("bare and node").select("s")
    empty = only.join(triples.where("o_kind <> 'literal'").select(F.col("o").alias("s")), "s", "left_anti")
    return triples.join(empty, "s", "left_anti").select(TRIPLE)


class ExportError(ValueError):
    """An export that would lose or make up constraints."""


def export(triples: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """S76. (triples to write, counts): repeated blank property shapes and empty shapes gone, and no constraint with them."""
    t = G.shared(triples.select(TRIPLE).distinct(), "export")
    once = G.shared(deduplicated(t), "deduplicated")
    out = G.shared(without_empty(once), "exported")
    a, b = G.shared(inventory(t), "before"), G.shared(inventory(out), "after")
    lost, made = a.exceptAll(b).count(), b.exceptAll(a).count()
    if lost or made:
        raise ExportError(f"{lost} constraints lost, {made} made up")
    n = lambda df, k: df.where((F.col("p") == G.RDF + "type") & (F.col("o") == SH + k)).select("s").distinct().count()
    properties = lambda df: df.where(F.col("p") == SH + "property").count()
    return out, {"triples_before": t.count(), "triples": out.count(), "node_shapes_before": n(t, "NodeShape"), "node_shapes": n(out, "NodeShape"), "properties_before": properties(t), "properties": properties(out), "constraints": a.count()}


def _literal() -> Column:
    esc = F.replace(F.col("o"), F.lit("\\"), F.lit("\\\\"))
    for a, b in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ('"', '\\"')):
        esc = F.replace(esc, F.lit(a), F.lit(b))
    return F.concat(F.lit('"'), esc, F.lit('"'))


def turtle_blocks(triples: DataFrame, prefixes: dict[str, str] | None = None) -> DataFrame:
    """S77. (subject, part, scope, block): statements of Turtle; prefixes: namespace to prefix.

    Blank nodes stand where they are referred to, in brackets, lists in parentheses. Those that several
    refer to, that lead back to themselves, or that hold more than NESTED triples have a label. A subject's objects come in
    statements of about CHUNK a predicate, so that none is without bound. Blocks whose scope is 0 need no label and may
    be in any file, the others must be in one.
    """
    spark = triples.sparkSession
    t = G.shared(triples.select(TRIPLE).distinct(), "turtle")
    names = F.create_map(*[F.lit(x) for kv in (prefixes or {}).items() for x in kv]) if prefixes else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    short = lambda c: G.qname(F.col(c), F.lit("iri"), names)
    iri = lambda c: F.when(short(c).endswith("."), F.concat(F.lit("<"), F.col(c), F.lit(">"))).otherwise(short(c))
    label = lambda c: F.concat(F.lit("_:b"), F.lower(F.hex(F.encode(c, "UTF-8"))))
    mark = F.when(F.coalesce("o_lang", F.lit("")) != "", F.concat(F.lit("@"), "o_lang")).when(~F.coalesce("o_dt", F.lit("")).isin("", G.ESSENTIAL["xsd"] + "string"), F.concat(F.lit("^^"), iri("o_dt"))).otherwise("")
    nil = G.RDF + "nil"
    # cells of lists: nothing but one first and one rest, and one reference, by the cell before if there is one
    uses = t.where("o_kind = 'bnode'").groupBy(F.col("o").alias("node")).agg(F.count("*").alias("uses"))
    holds = t.where("s_kind = 'bnode'").groupBy(F.col("s").alias("node")).agg(
        F.count("*").alias("n"), F.count_if(F.col("p") == G.RDF + "first").alias("firsts"), F.count_if(F.col("p") == G.RDF + "rest").alias("rests"),
        F.max(F.when(F.col("p") == G.RDF + "rest", F.col("o"))).alias("rest"),
    )
    nodes = G.shared(uses.join(holds, "node", "full_outer").fillna(0, ["uses", "n", "firsts", "rests"]), "nodes")
    cell = (F.col("n") == 2) & (F.col("firsts") == 1) & (F.col("rests") == 1) & (F.col("uses") == 1)
    cells = G.shared(nodes.where(cell).select(F.col("node").alias("cell"), F.col("node").alias("first"), "rest"), "cells")
    heads = cells.select(F.col("cell").alias("head")).join(cells.select(F.col("rest").alias("head")), "head", "left_anti")
    lists = G.shared(G.list_members(cells, heads).where("valid").select("head", F.posexplode("members").alias("pos", "cell")), "lists")
    first = t.where(F.col("p") == G.RDF + "first")
    # parts: what each nested node is made of, in the order in which it is written
    members = lists.join(first.withColumnRenamed("s", "cell"), "cell").select(F.col("head").alias("node"), F.lit(True).alias("is_list"), "pos", "p", "o", "o_kind", "o_dt", "o_lang")
    nested = nodes.where((F.col("uses") == 1) & (F.col("n") <= NESTED)).join(lists.select(F.col("cell").alias("node")), "node", "left_anti").select("node")
    inner = t.join(nested.withColumnRenamed("node", "s"), "s", "left_semi").select(F.col("s").alias("node"), F.lit(False).alias("is_list"), F.lit(0).alias("pos"), "p", "o", "o_kind", "o_dt", "o_lang")
    parts = G.shared(members.unionByName(inner), "parts")
    known = G.Rounds(spark, "texts")
    # a nested blank node without triples is an empty bracket
    bare = nested.join(parts.select("node"), "node", "left_anti")
    known.add(bare.select("node", F.lit("[]").alias("text"), F.lit(False).alias("labelled")))
    open_ = G.shared(parts.select("node").distinct(), "open")
    inside = open_.unionByName(bare)
    edges = G.shared(parts.where("o_kind = 'bnode'").join(inside.select(F.col("node").alias("o")), "o", "left_semi").select("node", F.col("o").alias("below")).distinct(), "below")
    told = F.when(F.col("o_kind") == "literal", F.concat(_literal(), mark)).when(F.col("o_kind") == "iri", F.when(F.col("o") == nil, "()").otherwise(iri("o"))).otherwise(F.coalesce("text", label("o")))
    verb = F.when(F.col("p") == G.RDF + "type", "a").otherwise(iri("p"))

    def with_text(rows: DataFrame) -> DataFrame:
        got = known.all().select(F.col("node").alias("o"), F.lit("bnode").alias("o_kind"), "text", "labelled")
        return rows.join(got, ["o", "o_kind"], "left").withColumns({"labelled": (F.col("o_kind") == "bnode") & F.coalesce("labelled", F.lit(True)), "told": told})

    while True:
        waits = edges.join(open_.select(F.col("node").alias("below")), "below", "left_semi").select("node").distinct()
        ready = G.shared(open_.join(waits, "node", "left_anti"), "ready")
        if ready.isEmpty():
            break
        lines = with_text(parts.join(ready, "node", "left_semi"))
        each = F.array_sort(F.collect_list(F.struct("pos", F.concat(verb, F.lit(" "), "told").alias("line"), "told")))
        whole = lines.groupBy("node", "is_list").agg(each.alias("x"), F.bool_or("labelled").alias("labelled"))
        text = F.when(F.col("is_list"), F.concat(F.lit("( "), F.array_join(F.transform("x", lambda m: m["told"]), " "), F.lit(" )"))).otherwise(F.concat(F.lit("[ "), F.array_join(F.transform("x", lambda m: m["line"]), " ; "), F.lit(" ]")))
        known.add(whole.select("node", text.alias("text"), "labelled"))
        open_ = G.shared(open_.join(ready, "node", "left_anti"), "open")
    # what is left stands by itself: named subjects, and blank ones that are not nested
    gone = known.all().select(F.col("node").alias("s")).unionByName(lists.join(known.all().select(F.col("node").alias("head")), "head", "left_semi").select(F.col("cell").alias("s"))).distinct()
    rows = with_text(t.join(gone, "s", "left_anti"))
    free = nodes.where("uses = 0").select(F.col("node").alias("s"), F.lit(True).alias("free"))
    rows = rows.join(free, "s", "left")
    crowd = rows.groupBy("s", "p").agg(F.count("*").alias("of")).where(F.col("of") > CHUNK)
    rows = rows.join(crowd, ["s", "p"], "left").withColumn("part", F.when(F.col("of").isNotNull(), F.pmod(F.xxhash64("o", "o_kind", "o_dt", "o_lang"), F.ceil(F.col("of") / CHUNK)) + 1).otherwise(0))
    several = rows.where("part > 0").select("s").distinct().withColumn("several", F.lit(True))
    objects = rows.groupBy("s", "s_kind", "free", "part", verb.alias("verb"), (F.col("p") != G.RDF + "type").alias("rank")).agg(F.array_join(F.array_sort(F.collect_list("told")), ", ").alias("objects"), F.bool_or("labelled").alias("labelled"))
    alone = F.struct("part", F.when(F.col("part") > 0, F.col("verb")).otherwise("").alias("of"))
    said = objects.withColumn("key", alone).groupBy("s", "s_kind", "free", "key").agg(F.array_sort(F.collect_list(F.struct("rank", F.concat("verb", F.lit(" "), "objects").alias("line")))).alias("x"), F.bool_or("labelled").alias("labelled"))
    said = said.join(several, "s", "left")
    # a blank subject that nothing refers to needs no label if one statement says all
    unnamed = (F.col("s_kind") == "bnode") & F.coalesce("free", F.lit(False)) & F.col("several").isNull()
    subject = F.when(unnamed, "[]").when(F.col("s_kind") == "bnode", label("s")).otherwise(iri("s"))
    block = F.concat(subject, F.lit(" "), F.array_join(F.transform("x", lambda m: m["line"]), " ;\n    "), F.lit(" ."))
    scoped = F.col("labelled") | ((F.col("s_kind") == "bnode") & ~unnamed)
    return said.select(F.col("s").alias("subject"), F.concat_ws(" ", F.col("key.part").cast("string"), "key.of").alias("part"), scoped.cast("int").alias("scope"), block.alias("block"))


def write_turtle(triples: DataFrame, path: str, prefixes: dict[str, str] | None = None, files: int = 1) -> None:
    """S77, S08, S26. Turtle files below path, by ranges of subjects; each is a document with its own prefixes.

    Blocks that share labels go to the first file. A file is sorted by subject.
    """
    blocks = turtle_blocks(triples, prefixes).select(F.when(F.col("scope") == 1, "").otherwise(F.col("subject")).alias("range"), "subject", "part", "block")
    head = "\n".join(f"@prefix {p}: <{ns}> ." for ns, p in sorted((prefixes or {}).items(), key=lambda x: x[1]))
    dealt = (blocks.repartitionByRange(files, "range") if files > 1 else blocks.repartition(1)).sortWithinPartitions("range", "subject", "part")

    def with_head(batches):
        first = True
        for b in batches:
            if first and len(b):
                yield pd.DataFrame({"value": [head]})
                first = False
            yield b

    dealt.select(F.col("block").alias("value")).mapInPandas(with_head, "value string").write.text(path)


def same(a: DataFrame, b: DataFrame) -> bool:
    """Whether two sets of triples are equal up to names of blank nodes, where these are trees below named subjects."""
    told = lambda t: t.select(TRIPLE).distinct().where("s_kind = 'iri'").join(subtree_hashes(t).select(F.col("node").alias("o"), F.lit("bnode").alias("o_kind"), "hash"), ["o", "o_kind"], "left").select("s", _line(F.coalesce("hash", "o")).alias("line"))
    return reduce(lambda x, y: x and y, (x.exceptAll(y).isEmpty() for x, y in ((told(a), told(b)), (told(b), told(a)))))
