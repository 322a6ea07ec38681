"""Shape graphs around the constraint algebra: roots, copies, repair at the edges, context and the generic profile."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.functions import values as V
from graphloom.operators import constraints as C
from graphloom.operators import graph as G
from graphloom.operators.grounding import looked_up

ROLES = ["focus_nodes", "constraint_paths", "related_terms"]
# fixed values: what a predicate of a shape must look like, as a table of constraints for validation
GENERIC_PROFILE = [
    ("minCount", "datatype", "xsd:integer"), ("minCount", "maxCount", "1"), ("minCount", "minInclusive", "0"),
    ("maxCount", "datatype", "xsd:integer"), ("maxCount", "maxCount", "1"), ("maxCount", "minInclusive", "0"),
    ("minLength", "datatype", "xsd:integer"), ("minLength", "maxCount", "1"), ("maxLength", "datatype", "xsd:integer"), ("maxLength", "maxCount", "1"),
    ("datatype", "nodeKind", "sh:IRI"), ("datatype", "maxCount", "1"), ("class", "nodeKind", "sh:IRI"), ("targetClass", "nodeKind", "sh:IRI"),
    ("nodeKind", "maxCount", "1"), ("pattern", "datatype", "xsd:string"), ("flags", "datatype", "xsd:string"), ("flags", "maxCount", "1"),
    ("closed", "datatype", "xsd:boolean"), ("closed", "maxCount", "1"), ("uniqueLang", "datatype", "xsd:boolean"), ("uniqueLang", "maxCount", "1"), ("deactivated", "datatype", "xsd:boolean"), ("deactivated", "maxCount", "1"),
    ("in", "maxCount", "1"), ("languageIn", "maxCount", "1"), ("severity", "maxCount", "1"), ("severity", "nodeKind", "sh:IRI"), ("order", "maxCount", "1"),
    ("minInclusive", "maxCount", "1"), ("minInclusive", "nodeKind", "sh:Literal"), ("maxInclusive", "maxCount", "1"), ("maxInclusive", "nodeKind", "sh:Literal"), ("minExclusive", "maxCount", "1"), ("maxExclusive", "maxCount", "1"),
]


def generic_profile(like: DataFrame) -> DataFrame:
    """G18. The generic profile as parameters for validation: of property and node shapes."""
    rows = [(c[3:], c, "sh:" + p, k, a, None, "sh:Violation") for c in ("sh:NodeShape", "sh:PropertyShape") for p, k, a in GENERIC_PROFILE]
    rows += [("Property", "sh:PropertyShape", "sh:path", k, "1", None, "sh:Violation") for k in ("minCount", "maxCount")]
    return like.sparkSession.createDataFrame(rows, "shape string, target_class string, path string, component string, arg string, args array<string>, severity string")


def shape_roots(rows: DataFrame) -> DataFrame:
    """S55, H12. (s) of shape roots: typed or targeted shapes, and what properties refer to."""
    typed = rows.where((F.col("p") == "rdf:type") & F.col("o").isin("sh:NodeShape", "sh:PropertyShape")).select("s")
    targeted = rows.where(F.col("p").isin("sh:targetClass", "sh:targetNode", "sh:targetSubjectsOf", "sh:targetObjectsOf")).select("s")
    return typed.unionByName(targeted).unionByName(rows.where("p = 'sh:property'").select(F.col("o").alias("s"))).distinct()


def roots_by_key(constraints: DataFrame, key: str) -> DataFrame:
    """S15, S16, H13. (key, shapes): the shapes of each path or class."""
    return constraints.where(F.col(key).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set("shape")).alias("shapes"))


def renamed(triples: DataFrame, source: Column | str) -> DataFrame:
    """S03, S07, H16, H18. Triples with blank nodes under their source's name, so that sources may be united; repeats go."""
    name = lambda c, k: F.when(F.col(k) == "bnode", F.concat(source if isinstance(source, Column) else F.lit(source), F.lit(":"), c)).otherwise(F.col(c))
    return triples.withColumns({"s": name("s", "s_kind"), "o": name("o", "o_kind")}).distinct()


def copied(triples: DataFrame, roots: DataFrame, predicates: list[str] | None = None) -> DataFrame:
    """S03, S04, H19. Triples of roots (root), of the predicates alone if given, with all that their blank nodes hold."""
    own = triples.join(roots.select(F.col("root").alias("s")), "s", "left_semi")
    own = own if predicates is None else own.where(F.col("p").isin(predicates))
    edges = triples.where("o_kind = 'bnode'").select(F.col("s").alias("src"), F.col("o").alias("dst"))
    heads = own.where("o_kind = 'bnode'").select(F.col("o").alias("root")).distinct()
    below = G.closure(edges, heads).select(F.col("node").alias("s")).distinct()
    return own.select(triples.columns).unionByName(triples.join(below, "s", "left_semi").select(triples.columns)).distinct()


def bound(first: DataFrame, later: DataFrame) -> DataFrame:
    """S05. (prefix, ns): the first source's bindings, and the later one's where the prefix is free."""
    return first.select("prefix", "ns").unionByName(later.select("prefix", "ns").join(first.select("prefix"), "prefix", "left_anti"))


def without_orphans(triples: DataFrame, max_rounds: int = 100, keep: DataFrame | None = None) -> DataFrame:
    """S74. Triples without blank subjects that nothing refers to; what they alone referred to goes as well, keep (s) stays."""
    now = triples
    for _ in range(max_rounds):
        used = now.where("o_kind = 'bnode'").select(F.col("o").alias("s")).distinct()
        orphans = now.where("s_kind = 'bnode'").select("s").distinct().join(used, "s", "left_anti")
        orphans = orphans if keep is None else orphans.join(keep, "s", "left_anti")
        if orphans.isEmpty():
            return now
        now = G.shared(now.join(orphans, "s", "left_anti").select(triples.columns), "orphans")
    raise RuntimeError(f"orphans are left after {max_rounds} rounds")


def without_lists(triples: DataFrame, heads: DataFrame) -> DataFrame:
    """H07, H08. Triples without the cells of the lists at heads (root)."""
    rest = triples.where(F.col("p") == G.RDF + "rest").select(F.col("s").alias("src"), F.col("o").alias("dst"))
    cells = G.closure(rest, heads).select(F.col("node").alias("s")).distinct()
    return triples.join(cells, "s", "left_anti").select(triples.columns)


def replaced(triples: DataFrame, changes: DataFrame) -> DataFrame:
    """H10. Triples with new objects where changes (s, p, o, new) has them."""
    out = triples.join(changes.select("s", "p", "o", "new").distinct(), ["s", "p", "o"], "left")
    return out.withColumn("o", F.coalesce("new", "o")).select(triples.columns)


def holds_vocabulary(triples: DataFrame) -> DataFrame:
    """S13. (s) of blank nodes with a predicate of the shape vocabulary."""
    return triples.where(F.col("p").startswith("sh:") & (F.col("s_kind") == "bnode")).select("s").distinct()


def group_predicates(constraints: DataFrame, keys: list[str]) -> DataFrame:
    """H14, H15, H17. (keys, predicates): what each group of shapes says; only simple paths are in groups."""
    return constraints.where("path is null or not path like '[%'").groupBy(*keys).agg(F.array_sort(F.collect_set("predicate")).alias("predicates"))


def merge_nodes(constraints: DataFrame) -> DataFrame:
    """S20b, S20c. Classes of both sources: their own constraints merged by class, nested ones by class and path.

    typed: whether either side calls the nested shape a property shape; complex paths stay as they are.
    """
    simple = constraints.where("path is null or not path like '[%'")
    node = C.merge(simple.where("path is null"), ["target_class"]).withColumn("path", F.lit(None).cast("string"))
    nested = C.merge(simple.where("path is not null"), ["target_class", "path"])
    kept = constraints.where("path like '[%'").groupBy("target_class", "path", "predicate").agg(F.array_sort(F.collect_set("value")).alias("values"))
    kept = kept.select("target_class", "path", "predicate", "values", F.lit(None).cast("array<string>").alias("members"), F.lit(None).cast("string").alias("warning"))
    order = ["target_class", "path", "predicate", "values", "members", "warning"]
    return node.select(order).unionByName(nested.select(order)).unionByName(kept)


def merge_documents(constraints: DataFrame, strategy: str, validate=None) -> tuple[DataFrame, DataFrame | None]:
    """S26, S27, S31. Two documents' constraints merged by a strategy, then validated by what is injected."""
    merged = C.merge_priority(constraints) if strategy != "restrictive" else C.merge(constraints, ["target_class", "path"])
    return merged, None if validate is None else validate(merged)


def build_baseline(triples: DataFrame, normalise, validate, candidates_of, edges_of, generate=None) -> tuple[DataFrame, bool]:
    """S61, H24. A baseline's triples, from an injected service or as given, normalised and cut to what conforms.

    A baseline that conforms at once isn't validated again. Returns the triples and whether any were set aside.
    """
    triples = G.shared(normalise(triples if generate is None else generate(triples)), "baseline")
    if validate(triples).isEmpty():
        return triples, False
    return G.conforming_subset(triples, validate, candidates_of, edges_of), True


def hints(triples: DataFrame, limit: int = 12) -> DataFrame:
    """R58. (doc_id, nr, reason, hint): distinct shape predicates with their values, the first in order."""
    local = F.regexp_replace("p", "^.*[#:]", "")
    rows = triples.where(F.col("p").rlike("^(sh:|http://www.w3.org/ns/shacl#)") & ~local.isin("path", "targetClass", "property"))
    rows = rows.select("doc_id", F.concat(F.lit("constraint sh:"), local).alias("reason"), F.concat(F.lit("sh:"), local, F.lit(" "), "o").alias("hint")).distinct()
    return rows.withColumn("nr", F.row_number().over(W.partitionBy("doc_id").orderBy("hint"))).where(F.col("nr") <= limit)


def role_terms(roles: DataFrame, terms: DataFrame) -> DataFrame:
    """R55. (rule_id, role, pos, term) of references (rule_id, role, pos, ref): catalog rows, each term once a rule, in role order.

    A reference that the catalog doesn't know stands for itself. References are dealt out by rule while they are
    narrow; the catalog then comes to them, and what follows by rule needs no other shuffle.
    """
    terms = G.shared(terms, "terms")
    names = terms.select("ord", F.explode(V.term_refs("id", "iri", "full_iri", "label")).alias("ref")).groupBy("ref").agg(F.max("ord").alias("ord"))
    fields = ["iri", "full_iri", "label", "type", "kind", "domain", "range"]
    known = terms.select("ord", F.struct(*fields).alias("term"))
    ref = F.trim(T.text("ref"))
    own = F.struct(ref.alias("iri"), ref.alias("full_iri"), *[F.lit(None).cast("string").alias(f) for f in fields[2:]])
    rank = F.array_position(F.array(*[F.lit(r) for r in ROLES]), F.col("role"))
    own_refs = roles.where(ref != "").repartition("rule_id")
    rows = own_refs.join(looked_up(names, "names"), "ref", "left").join(looked_up(known, "known"), "ord", "left").withColumn("term", F.coalesce("term", own))
    key = V.term_key("term.full_iri", "term.iri", F.lit(""))
    first = rows.groupBy("rule_id", key.alias("key")).agg(F.min_by(F.struct("role", "pos", "term"), F.struct(rank.alias("r"), "pos")).alias("x"))
    return first.select("rule_id", "x.role", "x.pos", "x.term")


def role_context(terms_of: DataFrame) -> DataFrame:
    """R56. (rule_id, context): a rule's terms by role as text for a prompt, with what may be said of their values."""
    t = lambda f: T.filled(f"term.{f}")
    part = lambda name, c: F.when(c.isNotNull(), F.concat(F.lit(name + "="), c))
    proof = F.when((F.col("role") == "constraint_paths") & t("range").isNotNull(), F.when(F.lower(t("kind")).contains("objectproperty"), F.concat(F.lit("values are instances of "), t("range"))).when(F.lower(t("kind")).contains("datatypeproperty"), F.concat(F.lit("values have datatype "), t("range"))))
    line = F.concat_ws(" | ", F.concat(F.lit("- "), F.coalesce(t("iri"), t("full_iri"), F.lit("(no IRI)"))), part("label", t("label")), part("type", t("type")), part("kind", t("kind")), part("domain", t("domain")), part("range", t("range")), proof)
    g = terms_of.withColumn("line", line).groupBy("rule_id").agg(F.array_sort(F.collect_list(F.struct("role", "pos", "line"))).alias("all"))
    title = {"focus_nodes": "Focus classes:", "constraint_paths": "Paths that may be constrained:", "related_terms": "Related terms, for context:"}
    block = lambda r: F.concat_ws("\n", F.lit(title[r]), F.coalesce(T.filled(F.array_join(F.transform(F.filter("all", lambda s: s["role"] == r), lambda s: s["line"]), "\n")), F.lit("- (none)")))
    return g.select("rule_id", F.concat_ws("\n\n", *[block(r) for r in ROLES]).alias("context"))


def ontology_context(terms_of: DataFrame, notes: DataFrame) -> DataFrame:
    """R57. (rule_id, context): the role context, then each term's note (iri, note), each once, in order."""
    rows = terms_of.select("rule_id", "role", "pos", F.col("term.iri").alias("iri")).join(notes, "iri", "left")
    g = rows.groupBy("rule_id").agg(F.array_sort(F.collect_list(F.struct("role", "pos", F.concat(F.lit("# "), "iri", F.lit("\n"), T.text("note")).alias("body")))).alias("all"))
    body = F.array_join(F.array_distinct(F.transform("all", lambda s: s["body"])), "\n\n")
    return role_context(terms_of).join(g, "rule_id").select("rule_id", F.concat_ws("\n\n", "context", body).alias("context"))


def described_context(terms_of: DataFrame, triples: DataFrame, prefixes: Column) -> DataFrame:
    """R57, G57, G58. (rule_id, context): the role context, then what an ontology's triples say of each term, each once, in order.

    A property is followed by its domains, and these by what is said of them. A section is a name and a line
    for each of its triples, as prefixed names; a term of which nothing is said has its name alone.
    """
    line = F.concat_ws(" ", G.qname(F.col("p"), F.lit("iri"), prefixes), F.coalesce(G.qname(F.col("o"), F.col("o_kind"), prefixes), F.lit("[]")))
    said = triples.groupBy(F.col("s").alias("full")).agg(F.array_join(F.array_sort(F.collect_set(line)), "\n").alias("said"))
    cells = triples.where(F.col("p") == G.RDF + "first").select(F.col("s").alias("cell"), F.col("o").alias("first")).join(triples.where(F.col("p") == G.RDF + "rest").select(F.col("s").alias("cell"), F.col("o").alias("rest")), "cell")
    domains = G.property_domains(triples, cells).groupBy(F.col("property").alias("full")).agg(F.array_sort(F.collect_set("domain")).alias("domains"))
    own = terms_of.select("rule_id", "role", "pos", F.coalesce("term.full_iri", "term.iri").alias("full")).where("full is not null").join(domains, "full", "left")
    order = F.struct("role", "pos")
    sections = own.select("rule_id", order.alias("at"), F.lit(0).alias("nr"), "full", "domains").unionByName(own.select("rule_id", order.alias("at"), F.posexplode("domains").alias("k", "full")).select("rule_id", "at", (F.col("k") + 1).alias("nr"), "full", F.lit(None).cast("array<string>").alias("domains")))
    body = F.concat_ws("\n", F.concat(F.lit("# "), "full"), "said", F.when(F.col("domains").isNotNull(), F.concat(F.lit("Domains: "), F.array_join("domains", ", "))))
    rows = sections.join(said, "full", "left").groupBy("rule_id", "full").agg(F.min(F.struct("at", "nr")).alias("first"), F.min_by(body, F.struct("at", "nr")).alias("body"))
    g = rows.groupBy("rule_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "body"))), lambda x: x["body"]), "\n\n").alias("bodies"))
    return role_context(terms_of).join(g, "rule_id", "left").select("rule_id", F.concat_ws("\n\n", "context", "bodies").alias("context"))


def shape_prefix(bindings: list[tuple[str, str]], shape_ns: str, requested: str = "") -> tuple[str, str | None]:
    """G56. The prefix of shapes and the declaration to add, if any; a bad name or another binding is an error."""
    of = dict(bindings)
    own = sorted((p for p, n in of.items() if p and n == shape_ns), key=lambda p: (p != "shape", not p.endswith("-sh"), "shape" not in p, len(p), p))
    name = requested.strip() or (own[0] if own and shape_ns else "shape")
    if not re.fullmatch(r"[A-Za-z][A-Za-z0-9._-]*", name):
        raise ValueError("a prefix begins with a letter, and holds letters, digits, dots, underscores and hyphens")
    if of.get(name) and shape_ns and of[name] != shape_ns:
        raise ValueError(f"prefix {name} is already bound to {of[name]}, not {shape_ns}")
    return name, f"@prefix {name}: <{shape_ns}> ." if shape_ns and name not in of else None


def guessed_namespace(prefixes: DataFrame) -> DataFrame:
    """H22. (ns) of shapes: bound to shape, else to the best prefix that ends in -sh or holds shape."""
    p = prefixes.where((F.col("prefix") == "shape") | F.col("prefix").endswith("-sh") | F.col("prefix").contains("shape"))
    return p.agg(F.min_by("ns", F.struct(F.col("prefix") != "shape", ~F.col("prefix").endswith("-sh"), F.length("prefix"), "prefix")).alias("ns")).where("ns is not null")


def profile_metadata(profiles: DataFrame, generic: str | None = "generic") -> DataFrame:
    """V03. (doc_id, profile_count, profile_names, domain_profile_count, validation_level) of domain profiles (doc_id, nr, name)."""
    g = profiles.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("nr", "name"))), lambda s: s["name"]).alias("names"))
    own = F.array(F.lit(generic)) if generic else F.array().cast("array<string>")
    return g.select("doc_id", (F.size("names") + int(bool(generic))).alias("profile_count"), F.concat(own, "names").alias("profile_names"), F.size("names").alias("domain_profile_count"), F.when(F.size("names") > 0, "syntax+generic+profile").otherwise("syntax+generic").alias("validation_level"))


def allowed_terms(catalog: DataFrame) -> DataFrame:
    """V08. One row of text: the classes, and the properties in scope or else all of them."""
    names = lambda role: F.array_sort(F.collect_set(F.when(F.col("role") == role, F.col("iri"))))
    g = catalog.agg(names("class").alias("c"), names("scoped").alias("s"), names("property").alias("p"))
    shown = lambda x: F.concat(F.array_join(F.slice(x, 1, 40), ", "), F.when(F.size(x) > 40, F.concat(F.lit(" ... ("), (F.size(x) - 40).cast("string"), F.lit(" more)"))).otherwise(""))
    return g.select(F.concat_ws("\n", F.lit("Allowed ontology classes:"), shown(F.col("c")), F.lit("Allowed ontology properties for this target/domain:"), shown(F.when(F.size("s") > 0, F.col("s")).otherwise(F.col("p")))).alias("allowed"))
