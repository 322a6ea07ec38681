"""Graph operators over edges and triples: closures, lists, catalog, namespaces and prefixes."""

from __future__ import annotations

import uuid
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import text as T

RDF, RDFS, OWL = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2000/01/rdf-schema#", "http://www.w3.org/2002/07/owl#"
#: Rows of a look-up that is broadcast.
FEW = 100_000
#: Rows of a part where many rows are dealt out by a key.
PART = 1_000_000
# fixed values: vocabularies, their usual prefixes, and the predicates that name things, the first first
ESSENTIAL = {"sh": "http://www.w3.org/ns/shacl#", "rdf": RDF, "rdfs": RDFS, "owl": OWL, "xsd": "http://www.w3.org/2001/XMLSchema#"}
KNOWN = {
    "dc": "http://purl.org/dc/elements/1.1/",
    "dcat": "http://www.w3.org/ns/dcat#",
    "dct": "http://purl.org/dc/terms/",
    "foaf": "http://xmlns.com/foaf/0.1/",
    "geosparql": "http://www.opengis.net/ont/geosparql#",
    "prov": "http://www.w3.org/ns/prov#",
    "sf": "http://www.opengis.net/ont/sf#",
    "skos": "http://www.w3.org/2004/02/skos/core#",
    "time": "http://www.w3.org/2006/time#",
    "wgs": "http://www.w3.org/2003/01/geo/wgs84_pos#",
}
STANDARD = [*ESSENTIAL.values(), KNOWN["skos"], KNOWN["dc"], KNOWN["dct"]]
LABELS = [RDFS + "label", KNOWN["skos"] + "prefLabel", KNOWN["dc"] + "title", KNOWN["dct"] + "title"]
DOMAINS, RANGES = [RDFS + "domain", "http://schema.org/domainIncludes"], [RDFS + "range", "http://schema.org/rangeIncludes"]
CLASS_TYPES = [OWL + "Class", RDFS + "Class"]
PROPERTY_TYPES = {OWL + "ObjectProperty": "ObjectProperty", OWL + "DatatypeProperty": "DatatypeProperty", OWL + "AnnotationProperty": "DatatypeProperty", RDF + "Property": "DatatypeProperty"}


def _shared_path(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that driver and executors share.

    Where spark.checkpoint.dir is unset, a folder of our own is made in local mode; elsewhere this is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not found:
        import tempfile

        found = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        spark.sparkContext.setCheckpointDir(found)
    return f"{found.rstrip('/')}/graphloom/{tag}-{uuid.uuid4().hex}"


def shared(df: DataFrame, tag: str) -> DataFrame:
    """A written copy in the folder that driver and executors share; the lineage ends here."""
    path = _shared_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held(df: DataFrame, tag: str) -> DataFrame:
    """df, written, to be looked up by few names that stand in many rows: broadcast if it is small, whatever the planner takes it for."""
    out = shared(df, tag)
    return F.broadcast(out) if out.count() <= FEW else out


def dealt_parts(df: DataFrame) -> int:
    """Over how many partitions rows of df are dealt: as many as a shuffle has, and more where these would hold over PART rows."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // PART))


class Rounds:
    """One table that grows round by round: a folder for each round, all of them one scan."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.path, self.count, self.schema = spark, _shared_path(spark, tag), 0, None

    def add(self, df: DataFrame) -> DataFrame:
        """df as the next round, written; what is returned reads that round alone."""
        self.schema = self.schema or df.schema
        path = f"{self.path}/round={self.count}"
        df.write.parquet(path)
        self.count += 1
        return self.spark.read.schema(self.schema).parquet(path)

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path).drop("round")


def total_order(df: DataFrame, by: list[Column], out: str) -> DataFrame:
    """df, written, with out: each row's place (from 0, bigint) in the order by, over as many partitions as a shuffle has.

    Rows are dealt by ranges and sorted within them; a row's place is its place in its range plus the rows of
    the ranges before, of which only the counts meet on the driver. Rows that are equal in by follow each
    other in any order.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    mid = F.monotonically_increasing_id()  # the partition above 33 bits, the place in it below
    placed = shared(df.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("__at", mid), "ordered")
    sizes = sorted((r.part, r.n) for r in placed.groupBy(F.shiftright("__at", 33).alias("part")).agg(F.count("*").alias("n")).collect())
    before = [(p, sum(m for _, m in sizes[:i])) for i, (p, _) in enumerate(sizes)]
    begins = F.broadcast(spark.createDataFrame(before, "__part bigint, __before bigint"))  # a row a partition
    at = placed.withColumn("__part", F.shiftright("__at", 33)).join(begins, "__part", "left")
    return at.withColumn(out, F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).select(*df.columns, out)


def match(triples: DataFrame, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
    """G30. Triples that agree with what is given."""
    for c, v in (("s", s), ("p", p), ("o", o)):
        triples = triples if v is None else triples.where(F.col(c) == v)
    return triples


def closure(edges: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """S01, S56, V23. (root, node, depth) reachable from roots (root) over edges (src, dst), each at its least depth.

    A round joins the last round's nodes with the edges and keeps what is new; each round is written to
    the shared folder, where all rounds are one table. Cycles end by themselves, as nothing is new in them; max_depth, if given, ends it earlier.
    """
    rounds = Rounds(roots.sparkSession, "closure")
    last = rounds.add(roots.select(F.col("root"), F.col("root").alias("node"), F.lit(0).alias("depth")).distinct())
    for depth in count(1) if max_depth is None else range(1, max_depth + 1):
        step = last.join(edges, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node")).distinct()
        last = rounds.add(step.join(rounds.all(), ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if last.isEmpty():
            break
    return rounds.all()


def walk(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """closure() of edges that hardly branch, as those of lists: each round doubles the depth that is reached.

    A round joins what is reached with the jumps of the last length, and the jumps with themselves, so that
    a list of n cells takes the logarithm of n rounds.
    """
    seen = shared(roots.select("root", F.col("root").alias("node"), F.lit(0).cast("bigint").alias("depth")).distinct(), "walk")
    jump, length, size = shared(edges.select("src", "dst").where("src is not null and dst is not null").distinct(), "jump"), 1, seen.count()
    while True:
        far = seen.join(jump, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node"), (F.col("depth") + length).alias("depth"))
        seen = shared(seen.unionByName(far).groupBy("root", "node").agg(F.min("depth").alias("depth")), "walk")
        now = seen.count()
        if now == size:
            return seen
        size, length = now, 2 * length
        ahead = jump.select(F.col("src").alias("dst"), F.col("dst").alias("end"))
        jump = shared(jump.join(ahead, "dst").select("src", F.col("end").alias("dst")).distinct(), "jump")


def list_members(cells: DataFrame, heads: DataFrame) -> DataFrame:
    """S02, S40, H09. (head, members, valid) of lists of cells (cell, first, rest) from heads (head).

    A list is valid if each of its cells has one first and one rest and it ends in nil. A cell that has
    several ends its list: what is behind it doesn't matter any more, and jumps never branch.
    """
    held = shared(cells.groupBy("cell").agg(F.min("first").alias("first"), F.min("rest").alias("rest"), F.count("*").alias("n")), "cells")
    edges = held.where("n = 1").select(F.col("cell").alias("src"), F.col("rest").alias("dst"))
    walked = walk(edges, heads.select(F.col("head").alias("root")))
    rows = walked.join(held, F.col("node") == F.col("cell"), "left").groupBy("root").agg(
        F.array_sort(F.collect_list(F.when(F.col("first").isNotNull(), F.struct("depth", "first")))).alias("m"),
        F.bool_or(F.col("node") == RDF + "nil").alias("ends"),
        F.bool_and((F.col("node") == RDF + "nil") | (F.coalesce("n", F.lit(0)) == 1)).alias("single"),
    )
    return rows.select(F.col("root").alias("head"), F.transform("m", lambda x: x["first"]).alias("members"), (F.col("ends") & F.col("single")).alias("valid"))


def nearest_roots(edges: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """S57. (node, candidate): a node itself if it is a root, else the nearest root above it, the least of equally near ones."""
    up = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    walked = closure(up, nodes.select(F.col("node").alias("root")))
    found = walked.join(roots.select(F.col("root").alias("node")), "node", "left_semi")
    return found.groupBy(F.col("root").alias("node")).agg(F.min_by("node", F.struct("depth", "node")).alias("candidate"))


def quarantine(triples: DataFrame, edges: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S58. Triples kept and triples set aside: all below the candidates (root), with references to them."""
    below = closure(edges, candidates).select("node").distinct()
    aside = triples.join(below.select(F.col("node").alias("s")), "s", "left_semi")
    kept = triples.join(below.select(F.col("node").alias("s")), "s", "left_anti").join(candidates.select(F.col("root").alias("o")), "o", "left_anti")
    return kept.select(triples.columns), aside.select(triples.columns)


def conforming_subset(triples: DataFrame, validate, candidates_of, edges_of, max_rounds: int = 50) -> DataFrame:
    """S59. The fixpoint of setting aside what fails: validate(triples) gives failing nodes (node), candidates_of their roots.

    Ends when nothing fails, or when a round sets nothing aside. The driver sees one number a round.
    """
    triples = shared(triples, "subset")
    size = triples.count()
    for _ in range(max_rounds):
        failing = validate(triples)
        if failing.isEmpty():
            return triples
        kept = shared(quarantine(triples, edges_of(triples), candidates_of(triples, failing))[0], "subset")
        now = kept.count()
        triples = kept
        if now == size:
            return triples
        size = now
    raise RuntimeError(f"no fixpoint after {max_rounds} rounds")


def split_namespace(iri: Column | str) -> Column:
    """G44. What precedes the longest name at the end; else up to the last #, slash, or in a URN colon."""
    x = T.text(iri)
    name = F.regexp_extract(x, r"(?s)^(.*?)([A-Za-z_À-￿][A-Za-z0-9_.\-À-￿·]*)$", 1)
    ends = x.rlike(r"[A-Za-z_À-￿][A-Za-z0-9_.\-À-￿·]*$")
    part = lambda mark: F.regexp_extract(x, f"(?s)^(.*{mark})[^{mark}]*$", 1)
    return F.when(ends & (name != ""), name).when(x.contains("#"), part("#")).when(x.contains("/"), part("/")).when(x.rlike("^urn:.*:"), part(":")).otherwise("")


def first_objects(triples: DataFrame, predicates: list[str], out: str) -> DataFrame:
    """G33, G34, G35. (s, out): the object of the first predicate that a subject has; the least of several."""
    rank = F.array_position(F.array(*[F.lit(p) for p in predicates]), F.col("p"))
    return triples.where(F.col("p").isin(predicates)).groupBy("s").agg(F.min_by(F.struct("o", "o_kind"), F.struct(rank.alias("r"), "o")).alias(out))


def qname(value: Column, kind: Column, prefixes: Column) -> Column:
    """G37, H20, H53. A prefixed name by the longest namespace of the map prefixes (namespace to prefix), else in brackets.

    Blank nodes have no name: null. Literals are their text.
    """
    fits = F.filter(F.map_keys(prefixes), lambda ns: (ns != "") & value.startswith(ns) & F.substring(value, F.length(ns) + 1, F.lit(1 << 20)).rlike(r"^[A-Za-z_][A-Za-z0-9_.\-]*$"))
    longest = F.reduce(fits, F.lit(""), lambda a, b: F.when(F.length(b) > F.length(a), b).otherwise(a))
    named = F.concat(F.element_at(prefixes, longest), F.lit(":"), F.substring(value, F.length(longest) + 1, F.lit(1 << 20)))
    return F.when(value.isNull(), "").when(kind == "bnode", F.lit(None)).when(kind == "literal", value).when(F.size(fits) > 0, named).otherwise(F.concat(F.lit("<"), value, F.lit(">")))


def note(kind: Column | str, iri: Column | str, domain: Column | str, range_: Column | str, comment: Column | str) -> Column:
    """G36. The comment, else a sentence made of kind, domain and range."""
    domain_part = F.when(T.text(domain) != "", F.concat(F.lit("with domain "), domain))
    range_part = F.when(T.text(range_) != "", F.concat(F.lit("and range "), range_))
    made = F.when(T.col(kind) == "Class", F.concat(iri, F.lit(" is an ontology class."))).otherwise(F.concat(F.concat_ws(" ", F.concat(iri, F.lit(" is a "), kind), domain_part, range_part), F.lit(".")))
    return F.when(T.text(comment) != "", T.col(comment)).otherwise(made)


def term_types(triples: DataFrame) -> DataFrame:
    """G31, G32. (s, type, kind): named classes, and properties by the first of their types."""
    typed = triples.where((F.col("p") == RDF + "type") & (F.col("s_kind") == "iri"))
    classes = typed.where(F.col("o").isin(CLASS_TYPES)).select("s", F.lit("class").alias("type"), F.lit("Class").alias("kind")).distinct()
    rank = F.array_position(F.array(*[F.lit(p) for p in PROPERTY_TYPES]), F.col("o"))
    kind = F.element_at(F.array(*[F.lit(k) for k in PROPERTY_TYPES.values()]), F.min(rank).cast("int"))
    props = typed.where(F.col("o").isin(list(PROPERTY_TYPES))).groupBy("s").agg(F.lit("property").alias("type"), kind.alias("kind"))
    return classes.unionByName(props)


def catalog(triples: DataFrame, prefixes: Column) -> DataFrame:
    """G38-G40. terms of an ontology's triples: (ord, id, type, label, iri, full_iri, kind, domain, range, superclasses, comment, note)."""
    types = term_types(triples)
    tail = F.regexp_replace(F.regexp_replace("s", "[/#]+$", ""), "(?s)^.*[/#]", "")
    named = types
    for preds, out in ((LABELS, "l"), ([RDFS + "comment"], "c"), (DOMAINS, "d"), (RANGES, "r")):
        named = named.join(first_objects(triples, preds, out), "s", "left")
    supers = triples.where((F.col("p") == RDFS + "subClassOf") & (F.col("o_kind") == "iri")).groupBy("s").agg(F.array_sort(F.collect_set(qname(F.col("o"), F.col("o_kind"), prefixes))).alias("superclasses"))
    named = named.join(supers, "s", "left")
    iri = qname(F.col("s"), F.lit("iri"), prefixes)
    side = lambda c: qname(F.col(f"{c}.o"), F.col(f"{c}.o_kind"), prefixes)
    is_class = F.col("type") == "class"
    rows = named.select(
        "s",
        "type",
        "kind",
        F.coalesce("l.o", F.coalesce(T.filled(tail), F.col("s"))).alias("label"),
        iri.alias("iri"),
        F.when(is_class, iri).otherwise(side("d")).alias("domain"),
        F.when(is_class, "").otherwise(side("r")).alias("range"),
        F.when(is_class, F.coalesce("superclasses", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")).alias("superclasses"),
        F.coalesce("c.o", F.lit("")).alias("comment"),
    )
    rank = F.when(F.col("kind") == "ObjectProperty", 0).otherwise(1)
    rows = total_order(rows.withColumn("kind_rank", rank), [F.col(c) for c in ("type", "kind_rank", "s")], "pre").withColumn("pre", F.col("pre").cast("int"))
    rows = total_order(rows, [F.col("type"), F.lower("label"), F.col("pre")], "ord")
    return rows.select(
        F.col("ord").cast("int").alias("ord"), F.concat_ws("-", "type", F.col("pre").cast("string")).alias("id"), "type", "label", "iri", F.col("s").alias("full_iri"), "kind", "domain", "range", "superclasses", "comment",
        note("kind", "iri", "domain", "range", "comment").alias("note"),
    )


def used_namespaces(triples: DataFrame) -> DataFrame:
    """G43. (ns) of every IRI that stands in a triple."""
    every = F.array(F.when(F.col("s_kind") == "iri", F.col("s")), F.col("p"), F.when(F.col("o_kind") == "iri", F.col("o")))
    return triples.select(F.explode(every).alias("iri")).where("iri is not null").select(split_namespace("iri").alias("ns")).where("ns <> ''").distinct()


def vocabulary(triples: DataFrame) -> DataFrame:
    """G41. (iri) of named classes and properties."""
    return triples.where((F.col("p") == RDF + "type") & F.col("o").isin(CLASS_TYPES + list(PROPERTY_TYPES)) & (F.col("s_kind") == "iri")).select(F.col("s").alias("iri")).distinct()


def ontology_iris(triples: DataFrame) -> DataFrame:
    """G42."""
    return triples.where((F.col("p") == RDF + "type") & (F.col("o") == OWL + "Ontology") & (F.col("s_kind") == "iri")).select(F.col("s").alias("iri")).distinct()


def coverage(terms: DataFrame, prefixes: DataFrame, hints: DataFrame) -> DataFrame:
    """G46, G47. (ns, term_count, coverage, prefixes, ontology_hint, rank) of candidate namespaces.

    terms (iri), prefixes (prefix, ns), hints (iri of ontologies). Ranked by terms, hint, an empty
    prefix, and name; standard vocabularies are none.
    """
    counted = terms.select(split_namespace("iri").alias("ns")).where((F.col("ns") != "") & ~F.col("ns").isin(STANDARD)).groupBy("ns").agg(F.count("*").alias("term_count"))
    bound = prefixes.where(~F.col("ns").isin(STANDARD)).groupBy("ns").agg(F.array_sort(F.collect_set("prefix")).alias("prefixes"))
    hinted = hints.select(split_namespace("iri").alias("ns")).where((F.col("ns") != "") & ~F.col("ns").isin(STANDARD)).distinct()
    c = counted.join(bound, "ns", "full_outer").join(hinted, "ns", "full_outer")
    stem = lambda x: F.regexp_replace(x, "[/#:]+$", "")
    iris = hints.agg(F.collect_set("iri").alias("iris"))
    total = terms.agg(F.count("*").alias("total"))
    c = c.crossJoin(iris).crossJoin(total)  # one row each
    hint = F.exists("iris", lambda i: i.startswith(F.col("ns")) | (stem(i) == stem(F.col("ns"))))
    n = F.coalesce("term_count", F.lit(0)).cast("bigint")
    out = c.select("ns", n.alias("term_count"), F.when(F.col("total") > 0, F.bround(n / F.col("total"), 4)).otherwise(0.0).alias("coverage"), F.coalesce("prefixes", F.array().cast("array<string>")).alias("prefixes"), hint.alias("ontology_hint"))
    by = [F.desc("term_count"), F.desc("ontology_hint"), F.desc(F.array_contains("prefixes", "")), F.col("ns")]
    return total_order(out, by, "rank").withColumn("rank", (F.col("rank") + 1).cast("int"))


def base_namespace(covered: DataFrame) -> DataFrame:
    """G48, G49. (ns, detected_by, confidence), one row: the best covered, else the longest hinted, else the first declared."""
    pick = covered.agg(
        F.max("term_count").alias("most"),
        F.min_by("ns", "rank").alias("first"),
        F.min_by("coverage", "rank").alias("share"),
        F.min_by("ns", F.when(F.col("ontology_hint"), F.struct(-F.length("ns"), "ns"))).alias("hinted"),
        F.sum("term_count").alias("total"),
    )
    by = F.when(F.col("most") > 0, "term_coverage").when(F.col("hinted").isNotNull(), "ontology_iri").when(F.col("first").isNotNull(), "declared_prefix").otherwise("none")
    ns = F.when(F.col("most") > 0, F.col("first")).otherwise(F.coalesce("hinted", "first", F.lit("")))
    sure = F.when(F.col("most") > 0, F.col("share")).when(ns != "", 0.5).otherwise(0.0)
    return pick.select(ns.alias("ns"), by.alias("detected_by"), sure.alias("confidence"))


def shapes_namespace(base: Column | str) -> Column:
    """G50. The namespace of shapes beside a vocabulary's."""
    b = T.text(base)
    return F.when(b == "", "").when(b.endswith("#"), F.concat(F.regexp_replace(b, "#$", ""), F.lit("/shapes/"))).when(b.endswith("/"), F.concat(b, F.lit("shapes/"))).when(b.endswith(":"), F.concat(b, F.lit("shapes:"))).otherwise(F.concat(b, F.lit("/shapes/")))


def pick_shapes_namespace(prefixes: DataFrame, base: str) -> DataFrame:
    """G51. (ns, source): what shape or onto-sh is bound to, else the derived one, bound or not."""
    derived = shapes_namespace(F.lit(base))
    p = prefixes.agg(F.max(F.when(F.col("prefix") == "shape", F.col("ns"))).alias("a"), F.max(F.when(F.col("prefix") == "onto-sh", F.col("ns"))).alias("b"), F.coalesce(F.bool_or(F.col("ns") == derived), F.lit(False)).alias("bound"))
    named = F.coalesce(T.filled("a"), T.filled("b"))
    return p.select(F.coalesce(named, derived).alias("ns"), F.when(named.isNotNull() | F.col("bound"), "declared_prefix").when(F.lit(base) != "", "derived").otherwise("none").alias("source"))


def pick_shape_prefix(prefixes: DataFrame, shape_ns: str) -> DataFrame:
    """G52. (prefix, source): the best of those bound to the namespace, else the first free of shape, shape2 and so on."""
    own = prefixes.where((F.col("prefix") != "") & (F.col("ns") == shape_ns))
    best = own.agg(F.min_by("prefix", F.struct(F.col("prefix") != "shape", ~F.col("prefix").endswith("-sh"), ~F.col("prefix").contains("shape"), F.length("prefix"), "prefix")).alias("best"))
    taken = prefixes.agg(F.collect_set("prefix").alias("taken"))
    free = F.filter(F.transform(F.sequence(F.lit(1), F.size("taken") + 1), lambda i: F.when(i == 1, "shape").otherwise(F.concat(F.lit("shape"), i.cast("string")))), lambda p: ~F.array_contains("taken", p))
    return best.crossJoin(taken).select(F.coalesce("best", F.element_at(free, 1)).alias("prefix"), F.when(F.col("best").isNotNull(), "declared_prefix").otherwise("default").alias("source"))


def inferred_prefixes(used: DataFrame, prefixes: DataFrame) -> DataFrame:
    """G45. (prefix, ns): usual names of namespaces that are used, aren't bound, and whose name is free."""
    spark = used.sparkSession
    known = spark.createDataFrame(list(KNOWN.items()), "prefix string, ns string")
    return known.join(used, "ns", "left_semi").join(prefixes.where("prefix <> ''").select("ns"), "ns", "left_anti").join(prefixes.select("prefix"), "prefix", "left_anti").where(~F.col("ns").isin(list(ESSENTIAL.values()))).select("prefix", "ns")


def prefix_block(prefixes: DataFrame, inferred: DataFrame, base: str, shape_ns: str, shape_prefix: str, base_prefix: str = "onto") -> DataFrame:
    """G53. (prefix, ns, ord, line) of a block: essential, declared, inferred, base and shape prefixes, each once.

    A shape prefix that is bound to something else fails the query.
    """
    spark = prefixes.sparkSession
    rows = lambda d, rank: d.select("prefix", "ns", F.lit(rank).alias("rank"))
    fixed = spark.createDataFrame(list(ESSENTIAL.items()), "prefix string, ns string")
    named = prefixes.where("prefix <> ''")
    has_base = named.agg(F.coalesce(F.bool_or(F.col("ns") == base), F.lit(False)).alias("has"))
    own = has_base.where("not has").select(F.lit(base_prefix).alias("prefix"), F.lit(base).alias("ns")).where("ns <> ''")
    shape = has_base.select(F.lit(shape_prefix).alias("prefix"), F.lit(shape_ns).alias("ns")).where("prefix <> '' and ns <> ''")
    every = rows(named, 0).unionByName(rows(fixed, 1)).unionByName(rows(inferred, 2)).unionByName(rows(own, 3)).unionByName(rows(shape, 4))
    g = every.groupBy("prefix").agg(F.min_by("ns", "rank").alias("ns"))
    clash = (F.col("prefix") == shape_prefix) & (F.col("ns") != shape_ns) & (F.lit(shape_ns) != "")
    g = g.withColumn("ns", F.when(clash, F.raise_error(F.concat(F.lit(f"shape prefix {shape_prefix} is already bound to "), "ns"))).otherwise(F.col("ns")))
    g = total_order(g, [F.col("prefix") != base_prefix, F.col("prefix")], "ord")
    return g.select("prefix", "ns", (F.col("ord") + 1).cast("int").alias("ord"), F.format_string("@prefix %s: <%s> .", "prefix", "ns").alias("line"))


def parse_prefix_block(block: Column | str) -> Column:
    """G54. Pairs (prefix, ns) of a block, in order."""
    pattern = F.lit(r"@prefix\s+([^:]+):\s*<([^>]+)>\s*\.")
    pairs = F.arrays_zip(F.regexp_extract_all(T.text(block), pattern, F.lit(1)).alias("prefix"), F.regexp_extract_all(T.text(block), pattern, F.lit(2)).alias("ns"))
    return F.transform(pairs, lambda p: F.struct(F.trim(p["prefix"]).alias("prefix"), F.trim(p["ns"]).alias("ns")))


def prefix_bindings(block: Column | str) -> Column:
    """G55. Pairs (prefix, ns) of either declaration form, the empty prefix too; of a repeated prefix the last."""
    pattern = F.lit(r"(?im)^\s*@?prefix\s+([^\s:]*)\s*:\s*<([^>]+)>")
    names, spaces = F.regexp_extract_all(T.text(block), pattern, F.lit(1)), F.regexp_extract_all(T.text(block), pattern, F.lit(2))
    last = F.filter(F.transform(F.arrays_zip(names.alias("prefix"), spaces.alias("ns")), lambda p, i: F.struct(p["prefix"].alias("prefix"), p["ns"].alias("ns"), i.alias("i"))), lambda p: ~F.array_contains(F.slice(names, p["i"] + 2, 1 << 20), p["prefix"]))
    return F.transform(last, lambda p: F.struct(p["prefix"].alias("prefix"), p["ns"].alias("ns")))


def describe(triples: DataFrame, iri: str, prefixes: Column) -> DataFrame:
    """G58. (p, o) of one subject, by its exact name, as prefixed names."""
    return match(triples, s=iri).select(qname(F.col("p"), F.lit("iri"), prefixes).alias("p"), qname(F.col("o"), F.col("o_kind"), prefixes).alias("o"))


def property_domains(triples: DataFrame, cells: DataFrame) -> DataFrame:
    """G57. (property, domain): named domains, and the members of unions of classes."""
    d = triples.where(F.col("p") == RDFS + "domain")
    named = d.where("o_kind = 'iri'").select(F.col("s").alias("property"), F.col("o").alias("domain"))
    unions = triples.where(F.col("p") == OWL + "unionOf").select(F.col("s").alias("o"), F.col("o").alias("head"))
    heads = d.join(unions, "o").select(F.col("s").alias("property"), "head")
    members = list_members(cells, heads.select("head").distinct()).select("head", F.explode("members").alias("domain"))
    return named.unionByName(heads.join(members, "head").select("property", "domain"))


def search_terms(terms: DataFrame, query: str, types: list[str] | None = None, cap: int = 400) -> DataFrame:
    """G59. Terms whose label, names, domain or range hold the query, in catalog order, a screenful."""
    hay = F.lower(F.concat_ws(" ", *[T.text(c) for c in ("label", "iri", "full_iri", "domain", "range")]))
    found = terms.where(hay.contains(query.lower()))
    return (found.where(F.col("type").isin(types)) if types else found).orderBy("ord").limit(cap)


def rdfs_closure(triples: DataFrame) -> DataFrame:
    """V26. (s, type) entailed by subclasses, and by domains and ranges of predicates and of those above them.

    What the schema says is looked up: by predicate or class the triples would be a few tasks.
    """
    sub = lambda p: triples.where(F.col("p") == RDFS + p).select(F.col("s").alias("src"), F.col("o").alias("dst"))
    above = lambda e: closure(e, e.select(F.col("src").alias("root")).unionByName(e.select(F.col("dst").alias("root"))).distinct()).select("root", "node")
    props = held(above(sub("subPropertyOf")), "properties")
    use = triples.select("s", "p", "o", "o_kind").join(props.withColumnRenamed("root", "p"), "p", "left").select("s", F.coalesce("node", "p").alias("p"), "o", "o_kind")
    declared = lambda p: triples.where(F.col("p") == RDFS + p).select(F.col("s").alias("p"), F.col("o").alias("type"))
    typed = triples.where(F.col("p") == RDF + "type").select("s", F.col("o").alias("type"))
    typed = typed.unionByName(use.join(held(declared("domain"), "domains"), "p").select("s", "type")).unionByName(use.where("o_kind <> 'literal'").join(held(declared("range"), "ranges"), "p").select(F.col("o").alias("s"), "type"))
    classes = held(above(sub("subClassOf")), "classes")
    return typed.join(classes.withColumnRenamed("root", "type"), "type", "left").select("s", F.coalesce("node", "type").alias("type")).distinct()
