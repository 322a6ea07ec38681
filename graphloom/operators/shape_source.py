"""Shapes given as triples, as the table of parameters that validation takes.

Lists are walked once for all that use them, property paths are put together level by level from their
predicates up, and property shapes are laid out below the shapes that have them. All are joins over the
shapes' triples; a round is a level of nesting of paths, whatever their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators import graph as G
from graphloom.operators import paths as P

SH = G.ESSENTIAL["sh"]
PARAMS = "shape string, target_class string, target_node string, target_subjects_of string, target_objects_of string, path string, component string, arg string, args array<string>, severity string"
# fixed values: predicates of shapes, by what their objects are
SCALARS = ["minCount", "maxCount", "datatype", "nodeKind", "class", "hasValue", "minInclusive", "maxInclusive", "minExclusive", "maxExclusive", "minLength", "maxLength", "pattern", "equals", "disjoint", "lessThan", "lessThanOrEquals", "uniqueLang", "closed"]
LISTS = ["in", "languageIn", "and", "or", "xone"]
SHAPES = ["node", "not"]
COUNTS = ["qualifiedMinCount", "qualifiedMaxCount"]
TARGETS = {"targetClass": "target_class", "targetNode": "target_node", "targetSubjectsOf": "target_subjects_of", "targetObjectsOf": "target_objects_of"}
UNARY = {"inversePath": "^", "zeroOrMorePath": "*", "oneOrMorePath": "+", "zeroOrOnePath": "?"}
_STRINGS = "array<string>"


class PathCycleError(ValueError):
    """Property paths that don't end in predicates."""


def all_lists(triples: DataFrame) -> DataFrame:
    """(head, members): every valid list; a member is its kind's first letter and its text."""
    part = lambda p, out: triples.where(F.col("p") == G.RDF + p).select(F.col("s").alias("cell"), out)
    first = part("first", F.concat(F.substring("o_kind", 1, 1), "o").alias("first"))
    cells = G.shared(first.join(part("rest", F.col("o").alias("rest")), "cell", "full_outer"), "cells")
    heads = cells.select(F.col("cell").alias("head")).join(cells.select(F.col("rest").alias("head")), "head", "left_anti").distinct()
    found = G.list_members(cells, heads).where("valid").select("head", "members")
    nil = F.lit(G.RDF + "nil")
    return found.unionByName(triples.where(F.col("o") == nil).select(nil.alias("head"), F.array().cast(_STRINGS).alias("members")).distinct())


def path_texts(triples: DataFrame, lists: DataFrame) -> DataFrame:
    """(node, text) of property paths that blank nodes stand for, in the text form of paths; a cycle is an error.

    A round puts together the paths whose parts are known.
    """
    sh = lambda p: F.col("p") == SH + p
    op = F.lit(None).cast("string")
    for p, mark in UNARY.items():
        op = F.when(sh(p), mark).otherwise(op)
    one = triples.select(F.col("s").alias("node"), op.alias("op"), F.array(F.concat(F.substring("o_kind", 1, 1), "o")).alias("parts")).where("op is not null")
    many = triples.where(sh("alternativePath")).select(F.col("s").alias("node"), F.col("o").alias("head")).join(lists, "head").select("node", F.lit("|").alias("op"), F.col("members").alias("parts"))
    made = one.unionByName(many)
    # a list is a sequence where a path is asked for
    steps = lists.select(F.col("head").alias("node"), F.lit("/").alias("op"), F.col("members").alias("parts"))
    used = triples.where(sh("path") & (F.col("o_kind") == "bnode")).select(F.col("o").alias("node"))
    parts = made.unionByName(steps).select("node", F.explode("parts").alias("part")).where("part like 'b%'").select(F.col("node").alias("src"), F.expr("substr(part, 2)").alias("dst"))
    below = G.closure(parts, used.select(F.col("node").alias("root")).distinct()).select("node").distinct()
    open_ = G.shared(made.unionByName(steps.join(made.select("node"), "node", "left_anti")).join(below, "node", "left_semi"), "paths")
    known = G.Rounds(triples.sparkSession, "texts")
    known.add(triples.sparkSession.createDataFrame([], "node string, text string"))
    while not open_.isEmpty():
        each = open_.select("node", "op", F.size("parts").alias("n"), F.posexplode("parts").alias("nr", "part"))
        name = F.expr("substr(part, 2)")
        text = F.when(F.col("part").startswith("b"), F.col("text")).otherwise(F.concat(F.lit("<"), name, F.lit(">")))
        told = each.join(known.all().select(F.concat(F.lit("b"), "node").alias("part"), "text"), "part", "left").withColumn("text", text)
        whole = told.groupBy("node", "op", "n").agg(F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("nr", "text")))).alias("t")).where(F.size("t") == F.col("n"))
        texts = F.transform("t", lambda x: x["text"])
        joined = F.concat(F.lit("("), F.array_join(texts, "\x00"), F.lit(")"))
        inner = F.get(texts, F.lit(0))
        out = (
            F.when(F.col("op").isin("/", "|"), F.when(F.col("n") == 1, inner).otherwise(F.replace(joined, F.lit("\x00"), F.col("op"))))
            .when(F.col("op") == "^", F.concat(F.lit("^"), inner))
            .otherwise(F.concat(F.when(inner.startswith("^"), F.concat(F.lit("("), inner, F.lit(")"))).otherwise(inner), F.col("op")))
        )
        now = known.add(whole.select("node", out.alias("text")))
        if now.isEmpty():
            names = [r.node for r in open_.orderBy("node").limit(5).collect()]
            raise PathCycleError(f"paths without an end: {', '.join(names)}")
        open_ = G.shared(open_.join(now.select("node"), "node", "left_anti"), "paths")
    return known.all()


def _short(c: Column | str) -> Column:
    """A name of the shapes' own vocabulary with its prefix."""
    x = F.col(c) if isinstance(c, str) else c
    return F.when(x.startswith(SH), F.concat(F.lit("sh:"), F.expr(f"substr({c}, {len(SH) + 1})"))).otherwise(x)


def parameters(triples: DataFrame) -> DataFrame:
    """S09, S15-S17, V10-V25. PARAMS of the shapes in triples with full IRIs, written.

    Rows of a property shape stand under each shape that has it, with its path and severity; one with targets
    of its own, or that is a member of others or of none, stands for itself too. Property shapes within a
    property shape stand under the name of the outer one and "/property", which its value nodes are asked
    for. Deactivated shapes have no rows, so that all nodes conform to them. What else a shape says is no
    parameter; lists that aren't valid give none.
    """
    own = G.shared(P.sided(triples).where(F.col("p").startswith(SH) | F.col("p").isin(G.RDF + "first", G.RDF + "rest", G.RDF + "type")).select("s", "s_kind", F.col("p"), "o", "o_kind", "o_dt", "o_lang").distinct(), "shapes")
    lists = G.shared(all_lists(own), "lists")
    said = own.where(F.col("p").startswith(SH)).withColumn("k", F.expr(f"substr(p, {len(SH) + 1})"))
    bare = lambda a: F.transform(a, lambda m: F.substr(m, F.lit(2)))
    texts = path_texts(own, lists)
    at = said.where("k = 'path'").join(texts.withColumnRenamed("node", "o"), "o", "left").groupBy("s").agg(F.min(F.when(F.col("o_kind") == "iri", F.col("o")).otherwise(F.col("text"))).alias("path"))
    severity = said.where("k = 'severity'").groupBy("s").agg(F.min(_short("o")).alias("severity"))
    off = said.where("k = 'deactivated' and o in ('true', '1')").select("s").distinct()
    only = lambda k, name: said.where(F.col("k") == k).groupBy("s").agg(F.min("o").alias(name))
    none = F.lit(None).cast(_STRINGS)
    # constraints of each shape by itself
    scalar = said.where(F.col("k").isin(SCALARS)).join(only("flags", "flags"), "s", "left")
    ignored = said.where("k = 'ignoredProperties'").join(lists.withColumnRenamed("head", "o"), "o").select("s", bare("members").alias("ignored"))
    scalar = scalar.join(ignored, "s", "left")
    args = F.when(F.col("k") == "closed", F.coalesce("ignored", F.array().cast(_STRINGS))).when((F.col("k") == "pattern") & F.col("flags").isNotNull(), F.array("flags"))
    boolean = F.when(F.col("k").isin("closed", "uniqueLang") & (F.col("o") == "1"), "true").otherwise(_short("o"))
    rows = scalar.select("s", F.col("k").alias("component"), boolean.alias("arg"), args.cast(_STRINGS).alias("args"))
    listed = said.where(F.col("k").isin(LISTS)).join(lists.withColumnRenamed("head", "o"), "o").select("s", F.col("k").alias("component"), F.lit(None).cast("string").alias("arg"), bare("members").alias("args"))
    named = said.where(F.col("k").isin(SHAPES)).select("s", F.col("k").alias("component"), F.lit(None).cast("string").alias("arg"), F.array("o").alias("args"))
    has = said.where("k = 'property'").select(F.col("s").alias("outer"), F.col("o").alias("s"))
    counted = said.where(F.col("k").isin(COUNTS)).select("s", F.col("k").alias("component"), F.col("o").alias("arg")).join(only("qualifiedValueShape", "member"), "s")
    apart = said.where("k = 'qualifiedValueShapesDisjoint' and o in ('true', '1')").select("s").distinct()
    shapes_of = only("qualifiedValueShape", "other")
    beside = apart.join(has, "s").join(has.withColumnRenamed("s", "t"), "outer").join(shapes_of.withColumnRenamed("s", "t"), "t").groupBy("s").agg(F.array_sort(F.collect_set("other")).alias("others"))
    counted = counted.join(beside, "s", "left").select("s", "component", "arg", F.concat(F.array("member"), F.coalesce(F.array_except("others", F.array("member")), F.array().cast(_STRINGS))).alias("args"))
    inside = has.select(F.col("outer").alias("s")).distinct().join(at.select("s"), "s", "left_semi").select("s", F.lit("property").alias("component"), F.lit(None).cast("string").alias("arg"), F.array(F.concat("s", F.lit("/property"))).alias("args"))
    every = rows.unionByName(listed).unionByName(named).unionByName(counted).unionByName(inside).join(off, "s", "left_anti")
    every = every.join(severity, "s", "left").withColumn("severity", F.coalesce("severity", F.lit("sh:Violation"))).join(at, "s", "left")
    # where they stand: node shapes for themselves, property shapes under those that have them
    is_path = at.select("s", F.lit(True).alias("is_path"))
    above = has.join(off.withColumnRenamed("s", "outer"), "outer", "left_anti").join(is_path.withColumnRenamed("s", "outer"), "outer", "left").select("s", F.when(F.col("is_path"), F.concat("outer", F.lit("/property"))).otherwise(F.col("outer")).alias("shape")).distinct()
    members = listed.where(F.col("component").isin("and", "or", "xone")).unionByName(named).unionByName(counted).select(F.explode("args").alias("s"))
    targeted = said.where(F.col("k").isin(list(TARGETS))).select("s")
    alone = at.select("s").join(has.select("s"), "s", "left_anti").unionByName(members).unionByName(targeted).distinct()
    stands = above.unionByName(every.where("path is null").select("s", F.col("s").alias("shape"))).unionByName(alone.select("s", F.col("s").alias("shape"))).distinct()
    placed = every.join(stands, "s").select("shape", "path", "component", "arg", "args", "severity")
    # targets, also of shapes that are classes themselves
    kinds = own.where(F.col("p") == G.RDF + "type").groupBy("s").agg(F.bool_or(F.col("o").isin(SH + "NodeShape", SH + "PropertyShape")).alias("shape"), F.bool_or(F.col("o").isin(G.CLASS_TYPES)).alias("class"))
    aims = said.where(F.col("k").isin(list(TARGETS))).select("s", "k", "o").unionByName(kinds.where("shape and class").select("s", F.lit("targetClass").alias("k"), F.col("s").alias("o"))).join(off, "s", "left_anti")
    aimed = aims.select(F.col("s").alias("shape"), *[F.when(F.col("k") == k, F.col("o")).alias(c) for k, c in TARGETS.items()])
    out = placed.unionByName(aimed, allowMissingColumns=True)
    return G.shared(out.select(*[F.col(c.split()[0]) for c in PARAMS.split(", ")]).distinct(), "params")
