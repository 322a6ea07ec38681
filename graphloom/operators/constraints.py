"""Constraint algebra over one long table: consolidate, merge and normalise values of a key and predicate.

constraints (doc_id, source, shape, target_class, path, predicate, value, kind, dt, members, ord): a value
is an IRI, blank node or literal, or a list given by its members. Predicates are local names, as in
minCount. All values of a key are aggregated at once, map-side first; a policy then picks among the
aggregates, so that one shuffle serves every predicate. What comes first is said by ord.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.functions import values as V
from graphloom.operators import graph as G
from graphloom.operators.grounding import looked_up

# fixed values: what each predicate's conflicting values become
HIGHER = ["minCount", "minInclusive", "minExclusive", "minLength"]
LOWER = ["maxCount", "maxInclusive", "maxExclusive", "maxLength"]
FIRST = ["datatype", "class", "nodeKind", "severity", "node"]
TRUE_WINS = ["closed", "uniqueLang"]
INTERSECTED = ["in", "languageIn"]
CHECKED = ["datatype", "class"]
PRIORITY = ["or", "xone", "not"]
METADATA = ["name", "description", "message", "order", "severity"]
SPECIFICITY = {"sh:BlankNodeOrIRI": 1, "sh:BlankNodeOrLiteral": 1, "sh:IRIOrLiteral": 1, "sh:BlankNode": 2, "sh:IRI": 2, "sh:Literal": 2}
NODE_KINDS = {"sh:BlankNode": 1, "sh:IRI": 2, "sh:Literal": 4, "sh:BlankNodeOrIRI": 3, "sh:BlankNodeOrLiteral": 5, "sh:IRIOrLiteral": 6}
SEVERITIES = {"sh:Info": 1, "sh:Warning": 2, "sh:Violation": 3}
COUNTS = ["minCount", "maxCount", "minLength", "maxLength", "qualifiedMinCount", "qualifiedMaxCount"]
BOOLEANS = ["closed", "deactivated", "uniqueLang", "qualifiedValueShapesDisjoint"]
STRICT_BOOLEANS = ["closed", "uniqueLang", "qualifiedValueShapesDisjoint"]
MINIMA = ["minCount", "minLength", "qualifiedMinCount", "minInclusive", "minExclusive"]
MAXIMA = ["maxCount", "maxLength", "qualifiedMaxCount", "maxInclusive", "maxExclusive"]
STRUCTURAL = ["and", "or", "xone", "not", "node", "property", "qualifiedValueShape", "sparql"]
NOT_CONSTRAINTS = ["type", "path", "targetClass"]
BOUNDS = [("minCount", "maxCount"), ("minLength", "maxLength"), ("minInclusive", "maxInclusive"), ("minExclusive", "maxExclusive")]


def P() -> Column:  # noqa: N802
    return F.col("predicate")


def of_map(x: Column, table: dict[str, int]) -> Column:
    out = F.when(F.lit(False), F.lit(0))
    for k, v in table.items():
        out = out.when(x == k, F.lit(v))
    return out


def identity(prefix: str = "") -> Column:
    """H23. What makes two values one: kind, text and datatype; a typed 1 and "1" differ."""
    return F.concat_ws("\x1f", *[T.text(prefix + c) for c in ("kind", "value", "dt")])


def shape_iri(class_iri: Column | str, namespace: str) -> Column:
    """S14. The shape of a class: the namespace, the class's local name and Shape."""
    return F.concat(F.lit(namespace), V.class_local_name(class_iri), F.lit("Shape"))


def collect(triples: DataFrame, shapes: DataFrame) -> DataFrame:
    """S09, S11. Constraint rows of shapes (shape, target_class, path) from triples (s, p, o, o_kind, o_dt, ord).

    Types, paths and targets are no constraints; blank values that hold no shape vocabulary are
    dropped unless the predicate is structural. Shapes without a class or with a path that is no IRI
    are left out: audit them with dropped().
    """
    shacl = F.col("p").startswith("sh:")
    held = triples.where(shacl).select(F.col("s").alias("o"), F.lit(True).alias("holds")).distinct()
    rows = shapes.where("target_class is not null and (path is null or path_kind = 'iri')").join(triples.where(shacl), F.col("shape") == F.col("s"))
    rows = rows.withColumn("predicate", F.substring("p", 4, 1 << 20)).where(~P().isin(NOT_CONSTRAINTS))
    rows = rows.join(held, "o", "left").where((F.col("o_kind") != "bnode") | F.col("holds") | P().isin(STRUCTURAL))
    return rows.select("shape", "target_class", "path", "predicate", F.col("o").alias("value"), F.col("o_kind").alias("kind"), F.col("o_dt").alias("dt"), "ord")


def dropped(shapes: DataFrame) -> DataFrame:
    """Shapes that consolidation leaves out, and why."""
    why = F.when(F.col("target_class").isNull(), "no target class").when(F.col("path_kind") != "iri", "path is no IRI")
    return shapes.select("shape", why.alias("reason")).where("reason is not null")


def distinct_values(constraints: DataFrame, keys: list[str], *more: str) -> DataFrame:
    """A row for each distinct value of a key and predicate, with its least ord, written.

    This is a hash aggregation that begins map-side, so that aggregates over texts, which sort their rows, see distinct values alone.
    """
    return G.shared(constraints.groupBy(*keys, "predicate", "value", "kind", "dt", *more).agg(F.min("ord").alias("ord")), "values")


def consolidate(constraints: DataFrame, keys: list[str]) -> DataFrame:
    """S10, S12. (keys, predicate, values, conflict): minima keep the greatest, maxima the least, some the first, others all.

    values are in the order they come first. Bounds collapse only if all of a key's values are
    numbers. conflict marks keys of which a first value stood against others.
    """
    number = V.number_value("value")
    order = F.struct("ord", "value")
    constraints = distinct_values(constraints, keys)
    g = constraints.withColumn("num", number).groupBy(*keys, "predicate").agg(
        F.count_if(F.col("num").isNull()).alias("bad"),
        F.max_by("value", F.struct("num", -F.col("ord"))).alias("high"),
        F.min_by("value", F.struct("num", "ord")).alias("low"),
        F.min_by("value", order).alias("first"),
        F.count_distinct(identity()).alias("n"),
    )
    bound = P().isin(HIGHER + LOWER) & (F.col("bad") == 0)
    one = F.when(P().isin(HIGHER), F.col("high")).when(P().isin(LOWER), F.col("low")).otherwise(F.col("first"))
    single = g.where(bound | P().isin(FIRST)).select(*keys, "predicate", F.array(F.when(P().isin(FIRST), F.col("first")).otherwise(one)).alias("values"), (P().isin(FIRST) & (F.col("n") > 1)).alias("conflict"))
    rest = g.where(~(bound | P().isin(FIRST))).select(*keys, "predicate")
    listed = constraints.groupBy(*keys, "predicate", identity().alias("id")).agg(F.min("ord").alias("ord"), F.min("value").alias("value"))
    listed = listed.join(rest, [*keys, "predicate"], "left_semi").groupBy(*keys, "predicate").agg(F.transform(F.array_sort(F.collect_list(order)), lambda s: s["value"]).alias("values"))
    return single.unionByName(listed.withColumn("conflict", F.lit(False)))


def merge(constraints: DataFrame, keys: list[str]) -> DataFrame:
    """S20, S22, S23. (keys, predicate, values, members, warning) of two sources, generated and baseline.

    Generated values stand first. The predicate's policy is one case over aggregates of a single
    grouping; lists are compared by their distinct member sets.
    """
    generated = F.col("source") == "generated"
    order = F.struct(F.when(generated, 0).otherwise(1).alias("r"), "ord", "value")
    c = distinct_values(constraints, keys, "source", "members")
    c = c.withColumn("num", V.number_value("value")).withColumn("spec", F.coalesce(of_map(F.col("value"), SPECIFICITY), F.lit(-1))).withColumn("order", order)
    has = lambda x: F.when(x, F.col("order"))
    g = c.groupBy(*keys, "predicate").agg(
        F.max_by("value", F.when(F.col("num").isNotNull(), F.struct("num", -F.col("order.r"), -F.col("ord")))).alias("high"),
        F.min_by("value", F.when(F.col("num").isNotNull(), F.struct("num", "order"))).alias("low"),
        F.min_by("value", "order").alias("first"),
        F.min_by("members", has(F.col("members").isNotNull())).alias("first_list"),
        F.min_by("value", F.when(F.col("kind") == "iri", F.struct(-F.col("spec"), "order"))).alias("kind"),
        F.coalesce(F.bool_or(V.typed_boolean("value", "dt")), F.lit(False)).alias("truth"),
        F.count_distinct(identity()).alias("n"),
        F.count_distinct("value").alias("nodes"),
        F.collect_set("members").alias("lists"),
        F.bool_or(generated).alias("any_generated"),
    )
    common = F.array_sort(F.reduce(F.slice("lists", 2, 1 << 20), F.array_distinct(F.element_at("lists", 1)), lambda a, b: F.array_intersect(a, b)))
    g = g.withColumn("common", F.when(F.size("lists") > 0, common))
    one = F.when(P().isin(HIGHER), F.coalesce("high", "first")).when(P().isin(LOWER), F.coalesce("low", "first")).when(P().isin(TRUE_WINS), F.col("truth").cast("string"))
    one = one.when(P().isin(PRIORITY + CHECKED), F.col("first")).when(P() == "nodeKind", F.coalesce("kind", "first"))
    members = F.when(P().isin(INTERSECTED), F.when(F.size("common") > 0, F.col("common")).otherwise(F.col("first_list"))).when(P() == "and", F.array_distinct(F.flatten(F.array_sort("lists"))))
    warning = (
        F.when(P().isin(INTERSECTED) & (F.size("lists") > 0) & (F.size("common") == 0), "empty intersection; kept the generated list")
        .when(P().isin(PRIORITY) & (F.col("n") > 1), "logical constraints could not be combined safely; kept the generated constraint")
        .when(P().isin(CHECKED) & (F.col("nodes") > 1), "conflicting values; kept the generated value")
    )
    picked = P().isin(HIGHER + LOWER + TRUE_WINS + PRIORITY + CHECKED + ["nodeKind"])
    lists = P().isin([*INTERSECTED, "and"])
    single = g.where(picked | lists).select(*keys, "predicate", F.when(picked, F.array(one)).alias("values"), F.when(lists, members).alias("members"), warning.alias("warning"))
    # the rest keeps all values, of metadata the generated ones where there are any
    kept = c.join(g.where(~(picked | lists)).select(*keys, "predicate", "any_generated"), [*keys, "predicate"])
    kept = kept.where(~P().isin(METADATA) | generated | ~F.col("any_generated"))
    kept = kept.groupBy(*keys, "predicate", identity().alias("id")).agg(F.min("order").alias("o")).groupBy(*keys, "predicate").agg(F.array_sort(F.collect_list("o")).alias("o"))
    firsts = F.when(P().isin(METADATA) & (F.element_at("o", 1)["r"] == 1), F.slice("o", 1, 1)).otherwise(F.col("o"))
    kept = kept.select(*keys, "predicate", F.transform(firsts, lambda s: s["value"]).alias("values"), F.lit(None).cast("array<string>").alias("members"), F.lit(None).cast("string").alias("warning"))
    return single.unionByName(kept)


def incompatible_bounds(merged: DataFrame, keys: list[str]) -> DataFrame:
    """S24. (keys, low, high, low_value, high_value) of keys whose merged minimum is over its maximum."""
    value = V.number_value(F.element_at("values", 1))
    out = merged.where(P().isin([p for pair in BOUNDS for p in pair])).groupBy(*keys).agg(*[F.max(F.when(P() == p, value)).alias(p) for pair in BOUNDS for p in pair])
    rows = F.filter(F.array(*[F.struct(F.lit(a).alias("low"), F.lit(b).alias("high"), F.col(a).alias("low_value"), F.col(b).alias("high_value")) for a, b in BOUNDS]), lambda s: s["low_value"] > s["high_value"])
    return out.select(*keys, F.explode(rows).alias("b")).select(*keys, "b.*")


def merge_priority(constraints: DataFrame) -> DataFrame:
    """S17, S18. All generated constraints, and baseline ones of paths and classes that no generated shape covers."""
    generated = constraints.where("source = 'generated'")
    paths = generated.where("path is not null").select("path").distinct()
    classes = generated.where("path is null").select("target_class").distinct()
    base = constraints.where("source <> 'generated'")
    return generated.unionByName(base.where("path is not null").join(paths, "path", "left_anti").select(constraints.columns)).unionByName(
        base.where("path is null").join(classes, "target_class", "left_anti").select(constraints.columns)
    )


def merge_sides(constraints: DataFrame, keys: list[str]) -> DataFrame:
    """S15, S16, S19. (keys, side, n_generated, n_baseline): each key in both sources, or in one of them."""
    n = lambda s: F.count_if(F.col("source") == s)
    g = constraints.groupBy(*keys).agg(n("generated").alias("n_generated"), n("baseline").alias("n_baseline"))
    side = F.when((F.col("n_generated") > 0) & (F.col("n_baseline") > 0), "both").when(F.col("n_generated") > 0, "generated").otherwise("baseline")
    return g.select(*keys, side.alias("side"), "n_generated", "n_baseline")


def focused(constraints: DataFrame, roles: DataFrame) -> DataFrame:
    """S28, S29, H26. Baseline constraints that bear on a rule's roles (rule_id, role, iri).

    A chosen path counts with the shapes of chosen classes, or with shapes of no class; a chosen
    class counts with its node constraints. Other paths of a chosen class stay out.
    """
    paths = roles.where("role = 'path'").select("rule_id", F.col("iri").alias("path"))
    classes = roles.where("role <> 'path'").select("rule_id", F.col("iri").alias("target_class"))
    # a rule's paths and classes are paired first: a path alone meets far more rules than it has to
    on_path = constraints.where("path is not null")
    owned = on_path.where("target_class is not null").join(looked_up(paths.join(classes.distinct(), "rule_id"), "pairs"), ["path", "target_class"])
    free = on_path.where("target_class is null").join(looked_up(paths, "paths"), "path")
    shells = constraints.where("path is null").join(looked_up(classes, "classes"), "target_class")
    columns = ["rule_id", *constraints.columns]
    return owned.select(columns).unionByName(free.select(columns)).unionByName(shells.select(columns))


def normalise_literals(constraints: DataFrame) -> DataFrame:
    """S42, S21. Counts become integers, flags booleans, texts strings; changed marks rows whose value or datatype did."""
    whole, truth = V.integer_value("value"), V.boolean_value("value")
    as_int = P().isin(COUNTS) & whole.isNotNull() & (F.col("kind") == "literal") & ~T.text("dt").isin("xsd:integer")
    as_bool = P().isin(BOOLEANS) & truth.isNotNull() & (F.col("kind") == "literal") & ~T.text("dt").isin("xsd:boolean")
    as_text = P().isin("pattern", "flags", "message") & (F.col("kind") == "literal") & ~T.text("dt").isin("xsd:string") & ~((P() == "message") & (T.text("dt") == "rdf:langString"))
    value = F.when(as_int, whole.cast("string")).when(as_bool, truth.cast("string")).otherwise(F.col("value"))
    dt = F.when(as_int, "xsd:integer").when(as_bool, "xsd:boolean").when(as_text, "xsd:string").otherwise(F.col("dt"))
    return constraints.withColumns({"value": value, "dt": dt, "changed": F.when(as_int, "integer_literals_normalized").when(as_bool, "boolean_literals_normalized").when(as_text, "string_literals_normalized")})


def normalise(constraints: DataFrame, keys: list[str]) -> DataFrame:
    """S43-S51, S53. (keys, predicate, values, members, outcome, removed) of a subject's repeated parameters.

    outcome names the counter that a repair adds to, removed the number it adds; both are null where nothing
    was repaired. Values that can't be compared stay as they are. conjoined: each value becomes a
    member of a conjunction.
    """
    d = V.decimal_value("value")
    c = distinct_values(constraints, keys, "members")
    c = c.withColumn("num", d).withColumn("truth", V.boolean_value("value")).withColumn("sev", of_map(F.col("value"), SEVERITIES)).withColumn("mask", of_map(F.col("value"), NODE_KINDS))
    g = c.groupBy(*keys, "predicate").agg(
        F.count_distinct(identity()).alias("n"),
        F.count_if(F.col("num").isNull()).alias("bad_num"),
        F.max_by("value", F.struct("num", -F.col("ord"))).alias("high"),
        F.min_by("value", F.struct("num", "ord")).alias("low"),
        F.count_if(F.col("truth").isNull()).alias("bad_truth"),
        F.bool_or("truth").alias("any"),
        F.bool_and("truth").alias("all"),
        F.count_if(F.col("sev").isNull()).alias("bad_sev"),
        F.max_by("value", F.struct("sev", -F.col("ord"))).alias("worst"),
        F.count_if(F.col("mask").isNull()).alias("bad_mask"),
        F.bit_or("mask").alias("mask"),
        F.collect_set("members").alias("lists"),
        F.count_if(F.col("members").isNull()).alias("bad_list"),
        F.count_if(F.col("kind") != "literal").alias("bad_lit"),
        F.array_sort(F.collect_set("value")).alias("values"),
    )
    many, lists = F.col("n") > 1, F.size("lists")
    common = F.array_sort(F.reduce(F.slice("lists", 2, 1 << 20), F.array_distinct(F.element_at("lists", 1)), lambda a, b: F.array_intersect(a, b)))
    kind = F.when(F.col("mask") == 7, F.lit(None))
    for k, m in NODE_KINDS.items():
        kind = kind.when(F.col("mask") == m, F.lit(k))
    numeric = P().isin(MINIMA + MAXIMA) & many & (F.col("bad_num") == 0)
    boolean = P().isin(BOOLEANS) & many & (F.col("bad_truth") == 0)
    severity = (P() == "severity") & many & (F.col("bad_sev") == 0)
    kinds = (P() == "nodeKind") & many
    flags = (P() == "flags") & many & (F.col("bad_lit") == 0)
    merged = P().isin("in", "languageIn", "ignoredProperties") & (lists > 1) & (F.col("bad_list") == 0)
    conjoined = P().isin("pattern", "datatype", "qualifiedValueShape") & many
    one = (
        F.when(numeric, F.array(F.when(P().isin(MINIMA), F.col("high")).otherwise(F.col("low"))))
        .when(boolean, F.array(F.when(P().isin(STRICT_BOOLEANS), F.col("any")).otherwise(F.col("all")).cast("string")))
        .when(severity, F.array("worst"))
        .when(kinds & (F.col("bad_mask") == 0), F.when(F.col("mask") == 7, F.array().cast("array<string>")).otherwise(F.array(kind)))
        .when(flags, F.array(F.array_join(F.array_sort(F.array_distinct(F.filter(F.split(F.array_join("values", ""), ""), lambda x: x != ""))), "")))
        .otherwise(F.col("values"))
    )
    outcome = (
        F.when(numeric, "numeric_parameters_collapsed").when(boolean, "boolean_parameters_collapsed").when(severity, "severity_parameters_collapsed")
        .when(kinds, F.when(F.col("bad_mask") > 0, "skipped_shapes").when(F.col("mask") == 7, "unrestricted_shapes").otherwise("collapsed_shapes"))
        .when(merged, "list_parameters_merged")
        .when(conjoined, F.when(P() == "pattern", "pattern_parameters_conjoined").when(P() == "datatype", "datatype_parameters_conjoined").otherwise("qualified_shapes_conjoined"))
    )
    members = F.when(lists > 0, F.when(P() == "ignoredProperties", F.array_sort(F.array_distinct(F.flatten("lists")))).otherwise(common))
    removed = F.when(kinds & (F.col("bad_mask") == 0), F.col("n")).when(kinds, F.lit(0)).when(merged, lists - 1).when(outcome.isNotNull(), F.col("n") - 1)
    return g.select(*keys, "predicate", F.when(lists == 0, one).alias("values"), members.alias("members"), conjoined.alias("conjoined"), outcome.alias("outcome"), removed.cast("bigint").alias("removed"))


def counters(normalised: DataFrame) -> DataFrame:
    """H11, S54, S60. How much each repair did: (counter, shapes, removed)."""
    return normalised.where("outcome is not null").groupBy(F.col("outcome").alias("counter")).agg(F.count("*").alias("shapes"), F.sum("removed").alias("removed"))


def repair_types(shapes: DataFrame) -> DataFrame:
    """S52. (shape, is_node, is_property, n_paths, n_parents) with the types a shape should have, and whether they changed.

    A shape of both types with one path is a property; one that no shape refers to, a node. Then a
    node with a path or a parent is a property.
    """
    both = F.col("is_node") & F.col("is_property")
    node = F.when(both & (F.col("n_paths") == 1), False).otherwise(F.col("is_node"))
    prop = F.when(both & (F.col("n_paths") != 1) & (F.col("n_parents") == 0), False).otherwise(F.col("is_property"))
    out = shapes.withColumns({"node": node, "prop": prop})
    turned = F.col("node") & ((F.col("n_paths") > 0) | (F.col("n_parents") > 0))
    out = out.withColumns({"node_now": F.col("node") & ~turned, "prop_now": F.col("prop") | turned})
    changed = (F.col("node_now") != F.col("is_node")) | (F.col("prop_now") != F.col("is_property"))
    return out.select("shape", F.col("node_now").alias("is_node"), F.col("prop_now").alias("is_property"), changed.alias("repaired"))


def repair_lists(cells: DataFrame) -> DataFrame:
    """S41. Cells (list, pos, firsts) with several first values become as many cells, sorted within the cell."""
    out = cells.select("list", "pos", F.posexplode(F.array_sort(F.array_distinct("firsts"))).alias("k", "member"))
    return out.select("list", (F.row_number().over(W.partitionBy("list").orderBy("pos", "k")) - 1).alias("pos"), "member")


def signature(constraints: DataFrame, keys: list[str]) -> DataFrame:
    """S70, S71. (keys, signature): SHA-256 over a subtree's sorted lines; the order of rows doesn't matter."""
    line = F.concat_ws("\x1f", "predicate", identity())
    return constraints.groupBy(*keys).agg(F.sha2(F.array_join(F.array_sort(F.collect_set(line)), "\n"), 256).alias("signature"))


def inventory(constraints: DataFrame) -> DataFrame:
    """S72. The distinct constraints: of a class and path, of a class, or standing alone."""
    role = F.when(F.col("target_class").isNull(), "standalone").when(F.col("path").isNull(), "node").otherwise("attached")
    return constraints.select(role.alias("role"), "target_class", "path", "predicate", identity().alias("id")).distinct()


def dedupe_shapes(constraints: DataFrame) -> DataFrame:
    """S73. Of anonymous shapes alike under one class and path, the first stays: (shape) of those that do."""
    signed = signature(constraints, ["target_class", "path", "shape"])
    first = W.partitionBy("target_class", "path", "signature").orderBy("shape")
    return signed.withColumn("nr", F.row_number().over(first)).where("nr = 1").drop("nr")


def lossless(before: DataFrame, after: DataFrame) -> DataFrame:
    """S76. Inventory entries that an export lost or made up; none if it is lossless."""
    a, b = inventory(before), inventory(after)
    return a.exceptAll(b).withColumn("change", F.lit("lost")).unionByName(b.exceptAll(a).withColumn("change", F.lit("added")))


def empty_shapes(triples: DataFrame) -> DataFrame:
    """S75. Node shapes that hold only a type and target and that nothing refers to."""
    only = triples.groupBy("s").agg(F.bool_and(F.col("p").isin("rdf:type", "sh:targetClass")).alias("bare"), F.bool_or((F.col("p") == "rdf:type") & (F.col("o") == "sh:NodeShape")).alias("node"))
    return only.where("bare and node").select("s").join(triples.where("p <> 'rdf:type'").select(F.col("o").alias("s")), "s", "left_anti")
