"""Shape validation over triples: parameters are a table, and each kind of check one plan over all shapes.

triples (s, s_kind, p, o, o_kind, o_dt, o_lang). params (shape, target_class, path, component, arg, args,
severity): a row a constraint, path null for the focus itself, else a predicate or a property path (see
paths). Results (focus, path, value, component, shape, severity). Targets and value nodes are joined by class
and predicate, counts are aggregated map-side.

Constraints that ask for other shapes (node, property, not, and, or, xone, qualified counts) name them in
args. Shapes are taken by strata of what they ask for: from the top down, each stratum's value nodes become
focus nodes of the shapes below; from the bottom up, each stratum is judged with the failures of those below.
A stratum is one plan, however many shapes it has, and each is written.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import graph as G
from graphloom.operators import paths as P

RESULT = ["focus", "path", "value", "component", "shape", "severity"]
XSD = "http://www.w3.org/2001/XMLSchema#"
# fixed values: what a node kind admits
KINDS = {"sh:IRI": ["iri"], "sh:BlankNode": ["bnode"], "sh:Literal": ["literal"], "sh:BlankNodeOrIRI": ["bnode", "iri"], "sh:BlankNodeOrLiteral": ["bnode", "literal"], "sh:IRIOrLiteral": ["iri", "literal"]}
# fixed values: the lexical forms of datatypes that are checked
LEXICAL = {
    "integer": r"^[+-]?\d+$",
    "decimal": r"^[+-]?(\d+(\.\d*)?|\.\d+)$",
    "double": r"^([+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|[+-]?INF|NaN)$",
    "boolean": r"^(true|false|0|1)$",
    "date": r"^-?\d{4,}-\d\d-\d\d(Z|[+-]\d\d:\d\d)?$",
    "dateTime": r"^-?\d{4,}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)?$",
}


def targets(types: DataFrame, params: DataFrame, triples: DataFrame | None = None) -> DataFrame:
    """V10. (shape, focus): instances of target classes; with triples, subjects and objects of target predicates."""
    own = params.select("shape", "target_class").where("target_class is not null").distinct()
    out = own.join(types.select(F.col("s").alias("focus"), F.col("type").alias("target_class")), "target_class").select("shape", "focus")
    if triples is not None and "target_subjects_of" in params.columns:
        for c, side in (("target_subjects_of", "s"), ("target_objects_of", "o")):
            want = params.select("shape", F.col(c).alias("p")).where("p is not null").distinct()
            out = out.unionByName(want.join(triples, "p").select("shape", F.col(side).alias("focus")))
    return out.distinct()


def values(focus: DataFrame, params: DataFrame, triples: DataFrame) -> DataFrame:
    """(shape, path, focus, value, kind, dt, lang): the distinct value nodes of each focus and path."""
    paths = params.where("path is not null").select("shape", "path").distinct()
    return focus.join(paths, "shape").join(triples.select(F.col("s").alias("focus"), F.col("p").alias("path"), F.col("o").alias("value"), F.col("o_kind").alias("kind"), F.col("o_dt").alias("dt"), F.col("o_lang").alias("lang")), ["focus", "path"]).distinct()


def check_counts(focus: DataFrame, found: DataFrame, params: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """V12, V16. minCount, maxCount and hasValue: one row for a focus; a focus without values counts zero.

    counts (shape, path, focus, n), if given, holds every focus of shapes and paths that are not in found.
    """
    want = params.where(F.col("component").isin("minCount", "maxCount", "hasValue"))
    far = None
    if counts is not None:
        apart = counted_paths(params)
        far = counts.join(want.join(apart, ["shape", "path"], "left_semi"), ["shape", "path"])
        want = want.join(apart, ["shape", "path"], "left_anti")
    n = found.groupBy("shape", "path", "focus").agg(F.count("*").alias("n"))
    rows = focus.join(want.where("component <> 'hasValue'"), "shape").join(n, ["shape", "path", "focus"], "left")
    count, limit = F.coalesce("n", F.lit(0)), F.col("arg").cast("bigint")
    bad = F.when(F.col("component") == "minCount", count < limit).otherwise(count > limit)
    none = F.lit(None).cast("string").alias("value")
    out = rows.where(bad).select("focus", "path", none, "component", "shape", "severity")
    if far is not None:
        out = out.unionByName(far.where(bad).select("focus", "path", none, "component", "shape", "severity"))
    value = want.where("component = 'hasValue'")
    held = focus.join(value, "shape")
    # only values that are asked for are shuffled
    has = found.select("shape", "path", "focus", F.col("value").alias("arg")).join(value.select("shape", "path", "arg"), ["shape", "path", "arg"], "left_semi")
    missing = held.join(has, ["shape", "path", "focus", "arg"], "left_anti")
    return out.unionByName(missing.select("focus", "path", none, "component", "shape", "severity"))


def value_fails(c: Column, arg: Column, args: Column, value: Column, kind: Column, dt: Column, lang: Column) -> Column:
    """Whether a value breaks a component; what can't be compared breaks it."""
    admitted = F.when(F.lit(False), F.lit(True))
    for k, ks in KINDS.items():
        admitted = admitted.when(arg == k, kind.isin(ks))
    form = F.lit(True)
    for name, pattern in LEXICAL.items():
        form = F.when(arg.isin("xsd:" + name, XSD + name), value.rlike(pattern)).otherwise(form)
    x, y = value.try_cast("double"), arg.try_cast("double")
    later = F.when(x.isNotNull() & y.isNotNull(), F.when(x < y, -1).when(x > y, 1).otherwise(0)).otherwise(F.when(value.try_cast("timestamp") < arg.try_cast("timestamp"), -1).when(value.try_cast("timestamp") > arg.try_cast("timestamp"), 1).when(value.try_cast("timestamp") == arg.try_cast("timestamp"), 0))
    ok = (
        F.when(c == "nodeKind", admitted)
        .when(c == "datatype", (kind == "literal") & (dt == arg) & form)
        .when(c == "in", F.array_contains(args, value))
        .when(c == "minInclusive", later >= 0).when(c == "maxInclusive", later <= 0).when(c == "minExclusive", later > 0).when(c == "maxExclusive", later < 0)
        .when(c == "minLength", (kind != "bnode") & (F.length(value) >= arg.cast("int")))
        .when(c == "maxLength", (kind != "bnode") & (F.length(value) <= arg.cast("int")))
        .when(c == "pattern", (kind != "bnode") & F.regexp_like(value, F.concat(F.when(T.text(F.try_element_at(args, F.lit(1))) != "", F.concat(F.lit("(?"), F.try_element_at(args, F.lit(1)), F.lit(")"))).otherwise(""), arg)))
        .when(c == "languageIn", F.exists(args, lambda a: (F.lower(lang) == F.lower(a)) | F.lower(lang).startswith(F.concat(F.lower(a), F.lit("-")))))
    )
    return ~F.coalesce(ok, F.lit(False))


VALUE_COMPONENTS = ["nodeKind", "datatype", "in", "minInclusive", "maxInclusive", "minExclusive", "maxExclusive", "minLength", "maxLength", "pattern", "languageIn"]


def check_values(found: DataFrame, params: DataFrame) -> DataFrame:
    """A row a value that breaks a component; all of them in one pass over the values."""
    want = params.where(F.col("component").isin(VALUE_COMPONENTS)).select("shape", "path", "component", "arg", "args", "severity")
    rows = found.join(want, ["shape", "path"])
    return rows.where(value_fails(*[F.col(c) for c in ("component", "arg", "args", "value", "kind", "dt", "lang")])).select(RESULT)


def check_class(found: DataFrame, params: DataFrame, types: DataFrame) -> DataFrame:
    """V14. Values that aren't instances of the class; types come closed over subclasses."""
    node = "term" if "term" in found.columns else "value"
    rows = found.join(params.where("component = 'class'").select("shape", "path", "component", "arg", "severity"), ["shape", "path"])
    return rows.join(types.select(F.col("s").alias(node), F.col("type").alias("arg")), [node, "arg"], "left_anti").select(RESULT)


def check_pairs(focus: DataFrame, found: DataFrame, params: DataFrame, triples: DataFrame) -> DataFrame:
    """V25. equals, disjoint, lessThan and lessThanOrEquals against another property of the focus."""
    want = params.where(F.col("component").isin("equals", "disjoint", "lessThan", "lessThanOrEquals")).select("shape", "path", "component", "arg", "severity")
    other = P.only(triples, want, "arg").select(F.col("s").alias("focus"), F.col("p").alias("arg"), F.col("o").alias("other"))
    own = found.join(want, ["shape", "path"])
    same = other.withColumnRenamed("other", "value")
    less = own.where("component like 'lessThan%'").join(other, ["focus", "arg"])
    x, y = F.col("value").try_cast("double"), F.col("other").try_cast("double")
    order = F.when(x.isNotNull() & y.isNotNull(), F.when(F.col("component") == "lessThan", x < y).otherwise(x <= y)).otherwise(F.when(F.col("component") == "lessThan", F.col("value").try_cast("timestamp") < F.col("other").try_cast("timestamp")).otherwise(F.col("value").try_cast("timestamp") <= F.col("other").try_cast("timestamp")))
    out = own.where("component = 'equals'").join(same, ["focus", "arg", "value"], "left_anti").select(RESULT)
    back = focus.join(want.where("component = 'equals'"), "shape").join(same, ["focus", "arg"]).join(found.select("shape", "path", "focus", "value"), ["shape", "path", "focus", "value"], "left_anti").select(RESULT)
    return out.unionByName(back).unionByName(own.where("component = 'disjoint'").join(same, ["focus", "arg", "value"], "left_semi").select(RESULT)).unionByName(less.where(~F.coalesce(order, F.lit(False))).select(RESULT))


def check_unique_lang(found: DataFrame, params: DataFrame) -> DataFrame:
    """V25. Languages that several values of a focus have."""
    rows = found.where("lang is not null").join(params.where("component = 'uniqueLang' and arg = 'true'"), ["shape", "path"])
    g = rows.groupBy("shape", "path", "focus", "component", "severity", F.lower("lang").alias("lang")).agg(F.count("*").alias("n")).where("n > 1")
    return g.withColumn("value", F.lit(None).cast("string")).select(RESULT)


def check_closed(focus: DataFrame, params: DataFrame, triples: DataFrame) -> DataFrame:
    """V22. Triples of a focus whose predicate is neither a path of the closed shape nor ignored."""
    closed = params.where("component = 'closed' and arg = 'true'").select("shape", "component", "severity", "args")
    allowed = params.where("path is not null").select("shape", F.col("path").alias("p")).unionByName(closed.select("shape", F.explode("args").alias("p"))).distinct()
    rows = focus.join(closed.drop("args"), "shape").join(triples.select(F.col("s").alias("focus"), "p", F.col("o").alias("value")), "focus")
    return rows.join(allowed, ["shape", "p"], "left_anti").withColumnRenamed("p", "path").select(RESULT)


def combine(focus: DataFrame, failing: DataFrame, logic: DataFrame) -> DataFrame:
    """V17-V21. node, and, or, xone and not of shapes (shape, component, member, severity) over failing (shape, focus).

    Members come evaluated, so shapes are taken in the order of their dependencies. One aggregation
    counts the members that each focus conforms to.
    """
    member = logic.groupBy("shape", "component", "severity").agg(F.count("*").alias("members"))
    bad = failing.select(F.col("shape").alias("member"), "focus").distinct()
    fails = focus.join(logic, "shape").join(bad, ["member", "focus"], "left_semi").groupBy("shape", "component", "focus").agg(F.count("*").alias("fails"))
    rows = focus.join(member, "shape").join(fails, ["shape", "component", "focus"], "left").withColumn("ok", F.col("members") - F.coalesce("fails", F.lit(0)))
    c = F.col("component")
    good = F.when(c.isin("and", "node"), F.col("ok") == F.col("members")).when(c == "or", F.col("ok") > 0).when(c == "xone", F.col("ok") == 1).when(c == "not", F.col("ok") == 0)
    none = F.lit(None).cast("string")
    return rows.where(~good).withColumns({"path": none, "value": none}).select(RESULT)


#: Components that ask whether nodes conform to other shapes, which args names; a qualified count may add its siblings to leave out.
LOGIC = ["node", "and", "or", "xone", "not"]
QUALIFIED = ["qualifiedMinCount", "qualifiedMaxCount"]
NESTED = [*LOGIC, *QUALIFIED, "property"]
_FOCUS = ["shape", "focus", *P.NODE]
#: Members whose failures are bits of one number.
BITS = 62
_BACK = r"^\^<([^<>]*)>$"


class ShapeRecursionError(ValueError):
    """Shapes that ask for themselves."""


def references(params: DataFrame) -> DataFrame:
    """(shape, member): what shapes ask for, each once."""
    return params.where(F.col("component").isin(NESTED)).select("shape", F.explode("args").alias("member")).distinct()


def strata(params: DataFrame) -> tuple[DataFrame, int]:
    """((shape, level), strata): a shape's level is one above the highest of those that it asks for.

    A round levels the shapes whose members all have levels. Shapes that ask for themselves, or for such
    as do, are an error that names the least few.
    """
    refs = references(params)
    every = params.select("shape").unionByName(refs.select(F.col("member").alias("shape"))).distinct()
    if refs.isEmpty():
        return every.withColumn("level", F.lit(0)), 1
    refs, rounds = G.shared(refs, "references"), G.Rounds(params.sparkSession, "strata")
    open_ = G.shared(every, "shapes")
    level = 0
    while not open_.isEmpty():
        waits = refs.join(open_.select(F.col("shape").alias("member")), "member", "left_semi").select("shape").distinct()
        now = rounds.add(open_.join(waits, "shape", "left_anti").withColumn("level", F.lit(level)))
        if now.isEmpty():
            names = [r.shape for r in open_.orderBy("shape").limit(5).collect()]
            raise ShapeRecursionError(f"shapes ask for themselves: {', '.join(names)}")
        open_ = G.shared(open_.join(now.select("shape"), "shape", "left_anti"), "shapes")
        level += 1
    return rounds.all(), level


def focus_nodes(types: DataFrame, params: DataFrame, triples: DataFrame) -> DataFrame:
    """V10. (shape, focus, value, kind, dt, lang) of targets: classes' instances, named nodes, subjects and objects of predicates.

    focus is the name that tells nodes apart (see paths.term). An instance's kind is a blank node's by its name.
    """
    none = F.lit(None).cast("string")
    named = lambda df, c: df.select("shape", F.col(c).alias("value"), F.when(F.col(c).startswith("_:"), "bnode").otherwise("iri").alias("kind"), none.alias("dt"), none.alias("lang"))
    want = lambda c: params.select("shape", F.col(c).alias("want")).where("want is not null").distinct()
    aimed = want("target_class")
    out = named(aimed.join(P.only(types, aimed, "want", "type").select("s", F.col("type").alias("want")), "want"), "s")
    if "target_node" in params.columns:
        out = out.unionByName(named(want("target_node"), "want"))
    if "target_subjects_of" in params.columns:
        own = want("target_subjects_of").join(triples.withColumnRenamed("p", "want"), "want")
        out = out.unionByName(own.select("shape", F.col("s").alias("value"), F.col("s_kind").alias("kind"), none.alias("dt"), none.alias("lang")))
    if "target_objects_of" in params.columns:
        own = want("target_objects_of").join(triples.withColumnRenamed("p", "want"), "want")
        out = out.unionByName(own.select("shape", F.col("o").alias("value"), F.col("o_kind").alias("kind"), F.col("o_dt").alias("dt"), F.col("o_lang").alias("lang")))
    return out.withColumn("focus", P.term("value", "kind", "dt", "lang")).transform(lambda df: P.once(df, ["shape", "focus"])).select(_FOCUS)


def counted_paths(params: DataFrame) -> DataFrame:
    """(shape, path) of property paths whose value nodes are only counted; one step backwards is no walk."""
    counts = F.coalesce(F.col("component").isin("minCount", "maxCount"), F.lit(False))
    return params.where(P.is_complex("path") & ~F.col("path").rlike(_BACK)).groupBy("shape", "path").agg(F.bool_and(counts).alias("only")).where("only").select("shape", "path")


def value_nodes(focus: DataFrame, params: DataFrame, triples: DataFrame) -> DataFrame:
    """(shape, path, focus, value, kind, dt, lang, term): the distinct value nodes of focus nodes along the paths of their shapes.

    The empty path is the focus itself. Plain predicates are one join; other paths are walked together.
    """
    asked = params.select("shape", F.coalesce("path", F.lit("")).alias("path")).distinct()
    own = focus.join(asked.where("path = ''"), "shape").select("shape", "path", "focus", *P.NODE).withColumn("term", F.col("focus"))
    near = asked.where((F.col("path") != "") & ~P.is_complex("path"))
    # a focus that is no literal is told by its value: distinct within what the join has dealt out
    plain = focus.where("kind <> 'literal'").select("shape", "focus").join(near, "shape")
    told = P.only(triples, near, "path").select(F.col("s").alias("focus"), F.col("p").alias("path"), F.col("o").alias("value"), F.col("o_kind").alias("kind"), F.col("o_dt").alias("dt"), F.col("o_lang").alias("lang"))
    found = P.once(plain.join(told, ["focus", "path"]), ["shape", "path", "focus"])
    back = asked.where(F.col("path").rlike(_BACK))
    if not back.isEmpty():
        # one step backwards is one join too; distinct before it, as many subjects may have one object
        name = F.regexp_extract("path", _BACK, 1)
        behind = P.only(triples, back.select(name.alias("p"))).select(P.term("o", "o_kind", "o_dt", "o_lang").alias("focus"), F.concat(F.lit("^<"), "p", F.lit(">")).alias("path"), F.col("s").alias("value"), F.col("s_kind").alias("kind")).distinct()
        none = F.lit(None).cast("string")
        met = focus.select("shape", "focus").join(back, "shape").join(behind, ["focus", "path"])
        found = found.unionByName(met.withColumns({"dt": none, "lang": none}).select(found.columns))
    out = own.unionByName(found.withColumn("term", P.term("value", "kind", "dt", "lang")).select(own.columns))
    far = asked.where(P.is_complex("path") & ~F.col("path").rlike(_BACK))
    if not far.isEmpty():
        begun = focus.join(far, "shape").select("shape", "path", "focus", *P.NODE)
        out = out.unionByName(P.Walk(begun, triples).nodes().select(out.columns))
    return out


def _values(focus: DataFrame, params: DataFrame, triples: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(value nodes, and counts along paths whose value nodes are only counted), written."""
    apart = G.shared(counted_paths(params), "counted")
    if apart.isEmpty():
        return G.shared(value_nodes(focus, params, triples), "values"), None
    begun = focus.join(apart, "shape").select("shape", "path", "focus", *P.NODE)
    counts = G.shared(P.Walk(begun, triples).counts().select("shape", "path", "focus", "n"), "counts")
    keyed = params.withColumn("at", F.coalesce("path", F.lit("")))
    near = keyed.join(apart.withColumnRenamed("path", "at"), ["shape", "at"], "left_anti").drop("at")
    return G.shared(value_nodes(focus, near, triples), "values"), counts


def constraint_ids(params: DataFrame) -> DataFrame:
    """params with cid: what tells constraints apart where a shape has several of a component on one path."""
    return params.withColumn("cid", F.xxhash64("shape", "path", "component", "arg", "args", "severity"))


def check_nested(focus: DataFrame, found: DataFrame, params: DataFrame, failing: DataFrame) -> DataFrame:
    """V17-V21, V25. node, and, or, xone and not of value nodes, and qualified counts, over failing (shape, term) of the shapes below.

    What a value node fails of at most BITS members is one number; all constraints are read from it in one pass.
    Of more members one aggregation counts, for each value node and constraint, those that it doesn't conform to.
    """
    every = constraint_ids(params.where(F.col("component").isin([*LOGIC, *QUALIFIED])))
    of = ["shape", "path", "cid"]
    qualified = F.col("component").isin(QUALIFIED)
    on = [*of, "focus", "term"]
    c = F.col("component")
    good = F.when(c.isin("and", "node"), F.col("ok") == F.col("members")).when(c == "or", F.col("ok") > 0).when(c == "xone", F.col("ok") == 1).when(c == "not", F.col("ok") == 0)
    size = F.size(F.array_distinct("args"))
    names = sorted(r.member for r in every.select(F.explode("args").alias("member")).distinct().limit(BITS + 1).collect() if r.member is not None)
    if 0 < len(names) <= BITS:
        bits = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(1 << i).cast("bigint"))])
        mask = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda x, m: x.bitwiseOR(F.coalesce(F.element_at(bits, m), F.lit(0))))
        bad = failing.where(F.col("shape").isin(names)).groupBy("term").agg(F.bit_or(F.element_at(bits, F.col("shape"))).alias("bad"))
        # of a qualified count the first member is to conform, and its siblings are not
        asked = G.held(every.select(*of, "component", "severity", size.alias("members"), mask(F.when(qualified, F.slice("args", 1, 1)).otherwise(F.col("args"))).alias("own"), mask(F.slice("args", 2, 1 << 30)).alias("siblings")), "constraints")
        seen = found.select("shape", "path", "focus", "value", "term").join(bad, "term", "left").withColumn("bad", F.coalesce("bad", F.lit(0))).join(asked, ["shape", "path"])
        seen = seen.withColumn("ok", F.col("members") - F.bit_count(F.col("bad").bitwiseAND(F.col("own"))))
        out = seen.where(~qualified & ~good).select(RESULT)
        holds = (F.col("bad").bitwiseAND(F.col("own")) == 0) & (F.col("bad").bitwiseAND(F.col("siblings")) == F.col("siblings"))
        counted = seen.where(qualified & holds).groupBy(*of, "focus").agg(F.count("*").alias("n"))
    else:
        members = every.select(*of, F.explode(F.when(qualified, F.slice("args", 1, 1)).otherwise(F.array_distinct("args"))).alias("member"))
        bad = failing.select(F.col("shape").alias("member"), "term")
        fails = found.join(members, ["shape", "path"]).join(bad, ["member", "term"], "left_semi").groupBy(on).agg(F.count("*").alias("fails"))
        seen = found.join(every.select(*of, "component", "severity", size.alias("members")), ["shape", "path"]).join(fails, on, "left").withColumn("ok", F.col("members") - F.coalesce("fails", F.lit(0)))
        out = seen.where(~qualified & ~good).select(RESULT)
        # qualified counts: values that conform, of which no sibling holds
        sibling = every.where(qualified).select(*of, F.explode(F.slice("args", 2, 1 << 30)).alias("member"))
        holds = found.join(sibling, ["shape", "path"]).join(bad, ["member", "term"], "left_anti").select(on).distinct()
        counted = seen.where(qualified & F.col("fails").isNull()).join(holds, on, "left_anti").groupBy(*of, "focus").agg(F.count("*").alias("n"))
    if every.where(qualified).isEmpty():
        return out
    return out.unionByName(_qualified(focus, every.where(qualified), counted))


def _qualified(focus: DataFrame, every: DataFrame, counted: DataFrame) -> DataFrame:
    """Focus nodes (shape, focus) whose counts (shape, path, cid, focus, n) are out of the limits; none counted is zero."""
    rows = focus.select("shape", "focus").join(every, "shape").join(counted, ["shape", "path", "cid", "focus"], "left")
    count, limit = F.coalesce("n", F.lit(0)), F.col("arg").cast("bigint")
    bad = F.when(F.col("component") == "qualifiedMinCount", count < limit).otherwise(count > limit)
    return rows.where(bad).withColumn("value", F.lit(None).cast("string")).select(RESULT)


def validate(triples: DataFrame, types: DataFrame, params: DataFrame, blocking: list[str] | None = None) -> DataFrame:
    """V01, V10-V25. The results of all shapes for their targets, written.

    A node conforms to a shape that another asks for if it has no result there, or none of the severities
    in blocking. A nested property shape adds its own results, and a value node that fails it makes its focus
    fail. Shapes that ask for themselves are an error; a shape that is asked for and has no constraints holds.
    """
    spark = triples.sparkSession
    triples = P.canonical(triples)
    aimed, params = params, G.shared(params.where("component is not null").select("shape", "path", "component", "arg", "args", "severity").distinct(), "params")
    if params.where(F.col("component").isin(NESTED)).isEmpty():
        focus = G.shared(focus_nodes(types, aimed, triples), "focus")
        return _judged(focus, params, _components(params), triples, types, None, *_values(focus, params, triples))
    levels, n = strata(params)
    levels = G.shared(levels, "levels")
    leveled = G.shared(params.join(levels, "shape"), "params")
    asked = G.shared(references(params).join(levels.select(F.col("shape").alias("member"), F.col("level").alias("to")), "member"), "references")
    nested = G.shared(params.where(F.col("component").isin(NESTED)).select("shape", F.coalesce("path", F.lit("")).alias("path"), (F.col("component") == "property").alias("direct"), F.explode("args").alias("member")).distinct().join(asked, ["shape", "member"]), "nested")
    # which strata hold targets, and which one asks about which: what only one asks is written once
    links = {(r.level, r.to): r.direct for r in nested.join(levels, "shape").groupBy("level", "to").agg(F.max("direct").alias("direct")).collect()}
    # from the top down: what each stratum asks about
    demands = G.Rounds(spark, "demands")
    aims = demands.add(focus_nodes(types, aimed, triples).join(levels, "shape").select(*_FOCUS, "level", F.lit(True).alias("top")))
    begun = {r.level for r in aims.select("level").distinct().collect()}
    tops, held = set(begun), {}
    for level in reversed(range(n)):
        sources = (level in begun) + sum(to == level for _, to in links)
        focus = demands.all().where(F.col("level") == level).drop("level")
        if sources > 1:
            focus = G.shared(P.once(focus, ["shape", "focus"], F.max("top").alias("top")), "focus")
        own = leveled.where(F.col("level") == level).drop("level")
        found, counts = _values(focus.select(_FOCUS), own, triples)
        held[level] = focus, own, found, counts, sources == (level in begun)
        if level:
            down = found.join(nested, ["shape", "path"])
            direct = level in tops and any(d for (at, _), d in links.items() if at == level)
            down = down.join(focus.select("shape", "focus", "top"), ["shape", "focus"]) if direct else down.withColumn("top", F.lit(False))
            down = down.select(F.col("member").alias("shape"), F.col("term").alias("focus"), F.col("to").alias("level"), *P.NODE, (F.col("top") & F.col("direct")).alias("top"))
            demands.add(P.once(down, ["shape", "focus", "level"], F.max("top").alias("top")).select(*_FOCUS, "level", "top"))
            tops |= {to for (at, to), d in links.items() if direct and at == level and d}
    # from the bottom up: who fails
    failing, results = G.Rounds(spark, "failing"), G.Rounds(spark, "results")
    failing.add(spark.createDataFrame([], "shape string, term string"))
    results.add(spark.createDataFrame([], ", ".join(f"{c} string" for c in RESULT)))
    for level in range(n):
        focus, own, found, counts, all_top = held[level]
        judged = _judged(focus.select(_FOCUS), own, _components(own), triples, types, failing.all(), found, counts)
        if level + 1 == n and all_top:
            results.add(judged)
            break
        judged = G.shared(judged, "judged")
        if level in tops:
            results.add(judged if all_top else judged.join(focus.where("top").select("shape", "focus"), ["shape", "focus"], "left_semi").select(RESULT))
        if level + 1 == n:
            break
        bad = judged.where(F.col("severity").isin(blocking)) if blocking else judged
        fails = bad.select("shape", F.col("focus").alias("term"))
        if any(d for (at, _), d in links.items() if at == level):
            direct = found.join(nested.where("direct").select("shape", "path", "member"), ["shape", "path"])
            fails = fails.unionByName(direct.join(failing.all().withColumnRenamed("shape", "member"), ["member", "term"], "left_semi").select("shape", F.col("focus").alias("term")))
        failing.add(fails.distinct())
    return results.all()


def _components(params: DataFrame) -> set[str]:
    """The names of components in use; of the vocabulary there are some thirty."""
    return {r.component for r in params.select("component").distinct().collect()}


def _judged(focus: DataFrame, params: DataFrame, used: set[str], triples: DataFrame, types: DataFrame, failing: DataFrame | None, found: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """The results of one stratum: of focus nodes and their value nodes found, or counted, all written; only checks in use are planned."""
    keyed = params.withColumn("path", F.coalesce("path", F.lit("")))
    own = focus.select("shape", "focus")
    checks = [
        (["minCount", "maxCount", "hasValue"], lambda: check_counts(own, found, keyed, counts)),
        (VALUE_COMPONENTS, lambda: check_values(found, keyed)),
        (["class"], lambda: check_class(found, keyed, types)),
        (["equals", "disjoint", "lessThan", "lessThanOrEquals"], lambda: check_pairs(own, found, keyed, triples)),
        (["uniqueLang"], lambda: check_unique_lang(found, keyed)),
        (["closed"], lambda: check_closed(focus.where("kind <> 'literal'").select("shape", "focus"), params, triples)),
        ([*LOGIC, *QUALIFIED], lambda: check_nested(focus, found, keyed, failing)),
    ]
    parts = [check() for names, check in checks if used & set(names)]
    if not parts:
        return own.where("false").select("focus", *[F.lit(None).cast("string").alias(c) for c in ("path", "value", "component")], "shape", F.lit(None).cast("string").alias("severity"))
    return reduce(DataFrame.unionByName, parts).withColumn("path", F.nullif("path", F.lit("")))


def severity_counts(results: DataFrame) -> DataFrame:
    """V02. One row: results, and how many of each severity."""
    n = lambda s: F.count_if(F.col("severity") == s)
    return results.agg(F.count("*").alias("result_count"), n("sh:Violation").alias("violation_count"), n("sh:Warning").alias("warning_count"), n("sh:Info").alias("info_count"))


def conforms(results: DataFrame) -> DataFrame:
    """V01. One row: whether nothing worse than a warning was found."""
    return results.agg((F.count_if(F.col("severity") == "sh:Violation") == 0).alias("conforms"))


def grounding_catalog(terms: DataFrame, targets_: DataFrame) -> DataFrame:
    """V04. (iri, role): classes, also those that domains and ranges name, properties, and those in scope of the targets (iri)."""
    cls = terms.where("type = 'class'").select("full_iri")
    sides = terms.where("type = 'property'").select(F.explode(F.array("domain", "range")).alias("full_iri")).where("full_iri <> '' and not full_iri like 'xsd:%'")
    classes = cls.unionByName(sides).distinct().select(F.col("full_iri").alias("iri"), F.lit("class").alias("role"))
    props = terms.where("type = 'property'")
    own = props.join(targets_.select(F.col("iri").alias("full_iri")), "full_iri", "left_semi")
    same = own.select("domain").unionByName(targets_.select(F.col("iri").alias("domain"))).distinct()
    scoped = props.join(same, "domain", "left_semi").select(F.col("full_iri").alias("iri"), F.lit("scoped").alias("role"))
    scoped = scoped.unionByName(own.select(F.col("full_iri").alias("iri"), F.lit("scoped").alias("role"))).distinct()
    return classes.unionByName(props.select(F.col("full_iri").alias("iri"), F.lit("property").alias("role")).distinct()).unionByName(scoped)


def grounding_errors(references: DataFrame, catalog: DataFrame, standard: list[str]) -> DataFrame:
    """V05. References (doc_id, predicate, iri) of shapes to terms that the ontology doesn't hold; standard names are skipped."""
    known = F.exists(F.array(*[F.lit(s) for s in standard]), lambda s: F.col("iri").startswith(s)) if standard else F.lit(False)
    rows = references.where(~known)
    of = lambda *roles: catalog.where(F.col("role").isin(*roles)).select("iri").distinct()
    paths = rows.where("predicate = 'path'").join(of("property"), "iri", "left_anti")
    classes = rows.where("predicate in ('targetClass', 'class')").join(of("class"), "iri", "left_anti")
    nodes = rows.where("predicate = 'node'").join(of("class", "property"), "iri", "left_anti")
    return paths.unionByName(classes).unionByName(nodes)


def has_value_errors(shapes: DataFrame, terms: DataFrame) -> DataFrame:
    """V06. Shapes (doc_id, shape, path, has_value) whose value is the very class that the path's range is."""
    ranges = terms.where("type = 'property'").select(F.col("full_iri").alias("path"), F.col("range").alias("has_value"))
    classes = terms.where("type = 'class'").select(F.col("full_iri").alias("has_value"))
    return shapes.join(ranges, ["path", "has_value"], "left_semi").join(classes, "has_value", "left_semi")


def display_list(iris: Column | str, limit: int = 40) -> Column:
    """V07. Sorted distinct names, the first of many with how many more there are; an aggregate."""
    every = F.array_sort(F.collect_set(T.col(iris)))
    return F.concat(F.array_join(F.slice(every, 1, limit), ", "), F.when(F.size(every) > limit, F.concat(F.lit(" ... ("), (F.size(every) - limit).cast("string"), F.lit(" more)"))).otherwise(""))
