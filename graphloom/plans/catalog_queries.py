"""Queries of the sources, the graph and the catalog, and of validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.functions import values as V
from graphloom.operators import graph as G
from graphloom.operators import validation as D
from graphloom.plans import fixtures as X
from graphloom.plans import ontology as O
from graphloom.plans import sql as S
from graphloom.plans.registry import query, table
from graphloom.sources import rdf, rules

RDF, RDFS, OWL = G.RDF, G.RDFS, G.OWL


prefix_map, prefixes, triples = O.prefix_map, O.prefixes, O.triples
PREFIXES_SQL, TRIPLES_SQL = O.PREFIXES_SQL, O.TRIPLES_SQL


_PQ = "'" + "', '".join(G.PROPERTY_TYPES) + "'"


@query("catalog_terms", f"WITH {O.TERMS_SQL} SELECT CAST(ord AS INT) AS ord, type, label, iri, full_iri, kind, \"domain\", \"range\", array_to_string(superclasses, ' ') AS superclasses, comment, note FROM terms")
def catalog_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schema's triples give its terms back"""
    t = G.catalog(triples(spark, sf_dir), prefix_map())
    return t.select("ord", "type", "label", "iri", "full_iri", "kind", "domain", "range", F.array_join("superclasses", " ").alias("superclasses"), "comment", "note")


@query("catalog_from_turtle", f"WITH {TRIPLES_SQL} SELECT s, p, o, o_kind FROM triples")
def from_turtle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Turtle document of each subject gives its triples"""
    o = F.when(F.col("o_kind") == "iri", F.concat(F.lit("<"), "o", F.lit(">"))).otherwise(F.concat(F.lit('"'), "o", F.lit('"')))
    line = F.concat(F.lit("<"), "s", F.lit("> <"), "p", F.lit("> "), o, F.lit(" ."))
    docs = triples(spark, sf_dir).groupBy(F.col("s").alias("doc_id")).agg(F.array_join(F.collect_list(line), "\n").alias("content"))
    return rdf.read_documents(docs).select("s", "p", "o", "o_kind")


@query("catalog_prefixes", f"WITH {PREFIXES_SQL} SELECT prefix, ns FROM prefixes")
def from_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of documents that declare a prefix each"""
    line = F.format_string("@prefix %s: <%s> .\n<a> <b> <c> .", "prefix", "ns")
    return rdf.read_prefixes(prefixes(spark, sf_dir).select(F.col("ns").alias("doc_id"), line.alias("content"))).select("prefix", "ns")


@query("catalog_match", f"WITH {TRIPLES_SQL} SELECT s, o FROM triples WHERE p = '{RDFS}subClassOf'")
def pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G30"""
    return G.match(triples(spark, sf_dir), p=RDFS + "subClassOf").select("s", "o")


@query("catalog_types", f"WITH {TRIPLES_SQL} SELECT DISTINCT s, CASE WHEN o IN ({_PQ}) THEN 'property' ELSE 'class' END AS type, CASE WHEN o = '{OWL}ObjectProperty' THEN 'ObjectProperty' WHEN o IN ({_PQ}) THEN 'DatatypeProperty' ELSE 'Class' END AS kind FROM triples WHERE p = '{RDF}type' AND o <> '{OWL}Ontology'")
def types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G31, G32, G41"""
    return G.term_types(triples(spark, sf_dir))


@query("catalog_labels", f"WITH {TRIPLES_SQL} SELECT s, min(o) AS label FROM triples WHERE p = '{RDFS}label' GROUP BY s")
def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G33-G35"""
    return G.first_objects(triples(spark, sf_dir), G.LABELS, "l").select("s", F.col("l.o").alias("label"))


_NS = "CASE WHEN regexp_matches(url, '[A-Za-z_][A-Za-z0-9_.\\-]*$') THEN regexp_extract(url, '^(.*?)([A-Za-z_][A-Za-z0-9_.\\-]*)$', 1, 's') WHEN contains(url, '#') THEN regexp_extract(url, '^(.*#)[^#]*$', 1, 's') WHEN contains(url, '/') THEN regexp_extract(url, '^(.*/)[^/]*$', 1, 's') ELSE '' END"


@query("catalog_namespaces", f"SELECT page_id, {_NS} AS ns FROM pages")
def namespaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G44"""
    return table(spark, sf_dir, "pages").select("page_id", G.split_namespace("url").alias("ns"))


_COVER = f"""WITH n AS (SELECT {_NS} AS ns FROM pages), c AS (SELECT ns, count(*) AS term_count FROM n WHERE ns <> '' GROUP BY ns), {PREFIXES_SQL},
b AS (SELECT ns, array_to_string(list_sort(list(DISTINCT prefix)), ',') AS prefixes, bool_or(prefix = '') AS empty_prefix FROM prefixes WHERE ns NOT IN ('{"', '".join(G.STANDARD)}') GROUP BY ns),
h AS (SELECT 'http://page.example/' AS ns UNION SELECT 'http://fixture.example/'),
j AS (SELECT ns, coalesce(term_count, 0) AS term_count, round_even(coalesce(term_count, 0) / (SELECT count(*) FROM pages), 4) AS coverage, coalesce(prefixes, '') AS prefixes, coalesce(empty_prefix, FALSE) AS e,
  starts_with('http://page.example/onto', ns) OR starts_with('http://fixture.example/schema', ns) OR rtrim(ns, '/#:') IN ('http://page.example/onto', 'http://fixture.example/schema') AS ontology_hint
  FROM c FULL JOIN b USING (ns) FULL JOIN h USING (ns))"""


def _coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    hints = spark.createDataFrame([("http://page.example/onto",), ("http://fixture.example/schema",)], "iri string")
    return G.coverage(table(spark, sf_dir, "pages").select(F.col("url").alias("iri")), prefixes(spark, sf_dir), hints)


@query("catalog_coverage", f"{_COVER} SELECT ns, term_count, coverage, prefixes, ontology_hint, CAST(row_number() OVER (ORDER BY term_count DESC, ontology_hint DESC, e DESC, ns) AS INT) AS rank FROM j")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G46, G47"""
    return _coverage(spark, sf_dir).withColumn("prefixes", F.array_join("prefixes", ","))


@query("catalog_base_namespace", f"{_COVER} SELECT ns, 'term_coverage' AS detected_by, coverage AS confidence FROM j ORDER BY term_count DESC, ontology_hint DESC, e DESC, ns LIMIT 1")
def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G48, G49"""
    return G.base_namespace(_coverage(spark, sf_dir))


@query("catalog_used_namespaces", f"WITH {TRIPLES_SQL}, i AS (SELECT s AS url FROM triples UNION SELECT p FROM triples UNION SELECT o FROM triples WHERE o_kind = 'iri') SELECT DISTINCT {_NS} AS ns FROM i WHERE {_NS} <> ''")
def used(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G43"""
    return G.used_namespaces(triples(spark, sf_dir))


_KNOWN = list(G.KNOWN.items())


@query("catalog_inferred_prefixes", f"WITH {S.values('known', ['k', 'prefix', 'ns'], [(k, *x) for k, x in enumerate(_KNOWN)])} SELECT DISTINCT prefix, ns FROM known JOIN supplier ON s_suppkey % {len(_KNOWN)} = k WHERE s_suppkey % 3 <> 0 AND prefix <> 'foaf'")
def inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Namespaces that suppliers use; one name is taken"""
    used_ = F.element_at(F.array(*[F.lit(ns) for _, ns in _KNOWN]), (F.col("s_suppkey") % len(_KNOWN) + 1).cast("int"))
    u = table(spark, sf_dir, "supplier").where("s_suppkey % 3 <> 0").select(used_.alias("ns")).unionByName(spark.createDataFrame([(OWL,), ("http://other.example/",)], "ns string"))
    p = prefixes(spark, sf_dir).unionByName(spark.createDataFrame([("foaf", "http://taken.example/")], "prefix string, ns string"))
    return G.inferred_prefixes(u, p)


@query("catalog_shapes_namespace", "SELECT page_id, CASE WHEN ns = '' THEN '' WHEN suffix(ns, '#') THEN left(ns, length(ns) - 1) || '/shapes/' WHEN suffix(ns, '/') THEN ns || 'shapes/' WHEN suffix(ns, ':') THEN ns || 'shapes:' ELSE ns || '/shapes/' END AS shapes FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url || '#' WHEN 1 THEN url || '/' WHEN 2 THEN 'urn:x:' || page_id || ':' ELSE url END AS ns FROM pages)")
def shapes_ns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G50"""
    k = F.col("page_id") % 4
    ns = F.when(k == 0, F.concat("url", F.lit("#"))).when(k == 1, F.concat("url", F.lit("/"))).when(k == 2, F.concat(F.lit("urn:x:"), F.col("page_id").cast("string"), F.lit(":"))).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", G.shapes_namespace(ns).alias("shapes"))


@query("catalog_shape_prefix", "SELECT 'shape' AS prefix, 'declared_prefix' AS source, 'http://fixture.example/shapes/' AS ns, 'declared_prefix' AS ns_source")
def shape_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G51, G52"""
    ns = G.pick_shapes_namespace(prefixes(spark, sf_dir), X.BASE).select("ns", F.col("source").alias("ns_source"))
    return G.pick_shape_prefix(prefixes(spark, sf_dir), "http://fixture.example/shapes/").crossJoin(ns)


@query("catalog_prefix_block", f"WITH {PREFIXES_SQL}, e AS ({' UNION ALL '.join(f'SELECT {S.literal(p)} AS prefix, {S.literal(n)} AS ns' for p, n in G.ESSENTIAL.items())}), u AS (SELECT * FROM prefixes WHERE prefix <> '' UNION SELECT * FROM e) SELECT prefix, ns, CAST(row_number() OVER (ORDER BY prefix) AS INT) AS ord, '@prefix ' || prefix || ': <' || ns || '> .' AS line FROM u")
def block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G53"""
    none = spark.createDataFrame([], "prefix string, ns string")
    return G.prefix_block(prefixes(spark, sf_dir), none, X.BASE, "http://fixture.example/shapes/", "shape")


@query("catalog_parsed_prefix_block", "SELECT 's' || s_suppkey AS prefix, 'http://a/' || s_suppkey || '/' AS ns FROM supplier UNION ALL SELECT 'b-c', 'http://b#' FROM supplier")
def parsed_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block of each supplier"""
    key = F.col("s_suppkey").cast("string")
    d = table(spark, sf_dir, "supplier").select(F.concat(F.lit("@prefix s"), key, F.lit(": <http://a/"), key, F.lit("/> .\n@prefix b-c:  <http://b#> .\nx")).alias("b"))
    return d.select(F.explode(G.parse_prefix_block("b")).alias("p")).select("p.*")


@query("catalog_search", f"WITH {O.TERMS_SQL} SELECT iri, label FROM terms WHERE type = 'property' AND contains(lower(label || ' ' || iri || ' ' || full_iri || ' ' || \"domain\" || ' ' || \"range\"), 'order')")
def search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G59"""
    return G.search_terms(O.terms(spark, sf_dir), "Order", ["property"]).select("iri", "label")


@query("catalog_client_coverage", f"WITH {O.TERMS_SQL} SELECT count_if(starts_with(full_iri, '{X.BASE}')) / count(*) AS coverage FROM terms")
def client_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G60"""
    return O.terms(spark, sf_dir).agg((F.count_if(F.col("full_iri").startswith(X.BASE)) / F.count("*")).alias("coverage"))


@query("catalog_describe", f"SELECT * FROM (VALUES ('<{RDF}type>', 'owl:Class'), ('rdfs:label', 'Part'), ('rdfs:subClassOf', 'fx:Thing')) v(p, o)")
def describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G37, G58"""
    return G.describe(triples(spark, sf_dir), X.BASE + "Part", prefix_map())


_EDGES = "edges AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders)"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = lambda t, a, s, b, d: table(spark, sf_dir, t).select(F.concat(F.lit(a), F.col(s).cast("string")).alias("src"), F.concat(F.lit(b), F.col(d).cast("string")).alias("dst"))
    return e("nation", "r", "n_regionkey", "n", "n_nationkey").unionByName(e("customer", "n", "c_nationkey", "c", "c_custkey")).unionByName(e("orders", "c", "o_custkey", "o", "o_orderkey"))


@query("closure_regions", f"WITH RECURSIVE {_EDGES}, w AS (SELECT DISTINCT 'r' || r_regionkey AS root, 'r' || r_regionkey AS node, 0 AS depth FROM region UNION ALL SELECT w.root, e.dst, depth + 1 FROM w JOIN edges e ON e.src = w.node) SELECT root, depth, count(DISTINCT node) AS n FROM w GROUP BY ALL")
def closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S01, S56, V23"""
    roots = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("root"))
    return G.closure(_edges(spark, sf_dir), roots).groupBy("root", "depth").agg(F.count("*").alias("n"))


@query("closure_nearest_root", f"WITH {_EDGES} SELECT 'n' || n_nationkey AS node, 'r' || n_regionkey AS candidate FROM nation")
def nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S57"""
    nodes = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("node"))
    roots = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("root"))
    return G.nearest_roots(_edges(spark, sf_dir), nodes, roots)


@query("closure_quarantine", "SELECT count(*) FILTER (o_custkey % 10 <> 0) AS n_kept, count(*) FILTER (o_custkey % 10 = 0) AS n_aside FROM orders")
def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth customer goes with all below"""
    e = _edges(spark, sf_dir).where("src like 'c%'")
    t = e.select(F.col("src").alias("s"), F.col("dst").alias("o"))
    roots = t.select(F.col("s").alias("root")).where("cast(substring(root, 2) as bigint) % 10 = 0").distinct()
    kept, aside = G.quarantine(t, e, roots)
    return kept.agg(F.count("*").alias("n_kept")).crossJoin(aside.agg(F.count("*").alias("n_aside")))


@query("closure_lists", "WITH l AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS first FROM lineitem GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS k FROM l) SELECT l_orderkey || '/1' AS head, array_to_string(list(CAST(first AS VARCHAR) ORDER BY k), ' ') AS members, TRUE AS valid FROM n GROUP BY l_orderkey")
def lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line items of each order are a list"""
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("first"))
    w = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber"))
    n = l.withColumn("k", w).withColumn("n", F.max("k").over(W.partitionBy("l_orderkey")))
    name = lambda k: F.concat_ws("/", F.col("l_orderkey").cast("string"), k.cast("string"))
    cells = n.select(name(F.col("k")).alias("cell"), F.col("first").cast("string").alias("first"), F.when(F.col("k") == F.col("n"), RDF + "nil").otherwise(name(F.col("k") + 1)).alias("rest"))
    heads = n.where("k = 1").select(name(F.col("k")).alias("head"))
    return G.list_members(cells, heads).select("head", F.array_join("members", " ").alias("members"), "valid")


@query("closure_rdfs", f"WITH {O.LITERAL_SQL}, i AS (SELECT 'p' || p_partkey AS s, 'Part' AS t FROM part UNION ALL SELECT 'c' || c_custkey, 'Customer' FROM customer), a AS (SELECT s, t FROM i UNION ALL SELECT s, CASE t WHEN 'Part' THEN 'Thing' ELSE 'Agent' END FROM i UNION ALL SELECT 'c' || o_custkey, x FROM orders, (VALUES ('Customer'), ('Agent')) v(x) UNION ALL SELECT 'o' || o_orderkey, x FROM orders, (VALUES ('Order'), ('Thing')) v(x)) SELECT t AS type, count(DISTINCT s) AS n FROM a GROUP BY t")
def rdfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes, and what placing an order says of both ends"""
    inst = lambda t, a, k, c: table(spark, sf_dir, t).select(F.concat(F.lit(a), F.col(k).cast("string")).alias("s"), F.lit(RDF + "type").alias("p"), F.lit(X.BASE + c).alias("o"), F.lit("iri").alias("o_kind"))
    placed = table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("s"), F.lit(X.BASE + "placesOrder").alias("p"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("o"), F.lit("iri").alias("o_kind"))
    every = O.schema_triples(spark).drop("s_kind").where(F.col("p") != RDF + "type").unionByName(inst("part", "p", "p_partkey", "Part")).unionByName(inst("customer", "c", "c_custkey", "Customer")).unionByName(placed)
    out = G.rdfs_closure(every).where("s rlike '^[pco][0-9]'")
    return out.groupBy(F.regexp_replace("type", "^.*#", "").alias("type")).agg(F.count("*").alias("n"))


@query("parse_rdf_ntriples", "SELECT 'http://fixture.example/nation/' || n_nationkey AS s, 'http://fixture.example/schema#name' AS p, n_name || '\"' || chr(10) AS o, 'literal' AS o_kind FROM nation UNION ALL SELECT 'http://fixture.example/nation/' || n_nationkey, 'http://fixture.example/schema#isInRegion', 'http://fixture.example/region/' || n_regionkey, 'iri' FROM nation")
def ntriples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written as N-Triples and read back"""
    n = table(spark, sf_dir, "nation")
    s = F.concat(F.lit("http://fixture.example/nation/"), F.col("n_nationkey").cast("string")).alias("s")
    row = lambda p, o, k: n.select(F.lit("d").alias("doc_id"), s, F.lit("iri").alias("s_kind"), F.lit(X.BASE + p).alias("p"), o.alias("o"), F.lit(k).alias("o_kind"), F.lit(None).cast("string").alias("o_dt"), F.lit(None).cast("string").alias("o_lang"))
    t = row("name", F.concat("n_name", F.lit('"\n')), "literal").unionByName(row("isInRegion", F.concat(F.lit("http://fixture.example/region/"), F.col("n_regionkey").cast("string")), "iri"))
    return rdf.from_ntriples(rdf.to_ntriples(t).withColumnRenamed("line", "value")).select("s", "p", "o", "o_kind")


_MD = "'- Ontology: o' || conv_id || '.ttl' || chr(10) || '- Author:  A B ' || chr(10)"


def _markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as a document, a rule a turn; every seventh turn has no text."""
    c = table(spark, sf_dir, "conversations")
    body = F.when(F.col("turn") % 7 == 6, "").otherwise(F.regexp_replace("text", r"\s+", " "))
    rule = F.concat(F.lit("\n## Rule\n\n- Number: R"), F.col("turn").cast("string"), F.lit("\r\n- Title: "), "role", F.lit("\n\n### Data constraint\n\n"), body, F.lit("\n---\nrest"))
    turns = c.groupBy(F.col("conv_id").cast("string").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("turn", rule.alias("r")))).alias("rs"))
    head = F.concat(F.lit("- Ontology: o"), "doc_id", F.lit(".ttl\n- Author:  A B \n"))
    return turns.select("doc_id", F.concat(head, F.array_join(F.transform("rs", lambda x: x["r"]), "\n")).alias("content"))


@query("parse_md_rules", "SELECT CAST(conv_id AS VARCHAR) AS doc_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INT) AS ord, 'R' || turn AS number, role AS title, CASE WHEN turn % 7 = 6 THEN '' ELSE trim(regexp_replace(text, '\\s+', ' ', 'g')) END AS text FROM conversations")
def md(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G07"""
    return rules.parse_markdown(_markdown(spark, sf_dir)).drop("source_format")


@query("parse_md_metadata", "SELECT CAST(conv_id AS VARCHAR) AS doc_id, 'o' || conv_id || '.ttl' AS ontology, 'A B' AS author, '' AS date, '' AS description FROM conversations GROUP BY conv_id")
def md_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G08"""
    return rules.markdown_metadata(_markdown(spark, sf_dir))


@query("parse_md_invalid", "SELECT count(*) AS n, 'text' AS lacks FROM conversations WHERE turn % 7 = 6")
def md_invalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G15"""
    bad = rules.invalid_rules(rules.parse_markdown(_markdown(spark, sf_dir)))
    return bad.agg(F.count("*").alias("n"), F.coalesce(F.max(F.array_join("lacks", ",")), F.lit("text")).alias("lacks"))


@query("parse_html_articles")
def html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G09-G11 over pages: each article is a section"""
    return rules.parse_html(table(spark, sf_dir, "pages"), "page_id", "html", "article", ()).select("doc_id", "ord", "text")


@query("parse_formats", "SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'html' WHEN 1 THEN 'md' WHEN 2 THEN 'html' WHEN 3 THEN 'md' END AS fmt FROM pages")
def formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G06"""
    k = F.col("page_id") % 5
    said, name = F.when(k == 0, ".HTM").otherwise(""), F.when(k == 1, "x/rules.Markdown").when(k == 2, "").otherwise("x.txt")
    body = F.when(k == 2, F.col("html")).when(k == 3, "a\n ## rule \nb").otherwise("nothing")
    return table(spark, sf_dir, "pages").select("page_id", rules.document_format(said, name, body).alias("fmt"))


@query("parse_rdf_formats", "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'turtle' WHEN 1 THEN 'xml' WHEN 2 THEN 'nt' WHEN 3 THEN 'nquads' ELSE 'turtle' END AS fmt FROM part")
def rdf_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G01, G04, H52"""
    name = F.element_at(F.array(*[F.lit(x) for x in ("a.TTL", "b.owl", "c.d.nt", "e.nq", "f")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", V.rdf_format(name).alias("fmt"))


# --- validation -----------------------------------------------------------------------------------
_PARAMS = [
    ("Cust", "Customer", "balance", "minInclusive", "0", None, "sh:Violation"),
    ("Cust", "Customer", "balance", "maxCount", "1", None, "sh:Violation"),
    ("Cust", "Customer", "segment", "in", None, ["AUTOMOBILE", "BUILDING", "MACHINERY", "HOUSEHOLD"], "sh:Warning"),
    ("Cust", "Customer", "name", "pattern", "^customer#[0-9]{8}0$", ["i"], "sh:Info"),
    ("Cust", "Customer", "placed", "minCount", "5", None, "sh:Violation"),
    ("Cust", "Customer", "placed", "class", "Order", None, "sh:Violation"),
    ("Cust", "Customer", "balance", "datatype", "xsd:integer", None, "sh:Warning"),
    ("Cust", "Customer", "name", "maxLength", "17", None, "sh:Info"),
    ("Cust", "Customer", "placed", "nodeKind", "sh:Literal", None, "sh:Info"),
    ("Cust", "Customer", "segment", "hasValue", "BUILDING", None, "sh:Info"),
]
_PARAM_DDL = "shape string, target_class string, path string, component string, arg string, args array<string>, severity string"


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    s = F.concat(F.lit("c"), F.col("c_custkey").cast("string"))
    row = lambda p, v, k, dt: F.struct(F.lit(p).alias("p"), v.cast("string").alias("o"), F.lit(k).alias("o_kind"), F.lit(dt).cast("string").alias("o_dt"))
    facts = c.select(s.alias("s"), F.explode(F.array(row("balance", F.floor(F.col("c_acctbal")), "literal", "xsd:decimal"), row("segment", F.col("c_mktsegment"), "literal", "xsd:string"), row("name", F.col("c_name"), "literal", "xsd:string"))).alias("r")).select("s", "r.*")
    placed = o.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("s"), F.lit("placed").alias("p"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("o"), F.lit("iri").alias("o_kind"), F.lit(None).cast("string").alias("o_dt"))
    t = facts.unionByName(placed).withColumn("o_lang", F.lit(None).cast("string"))
    types_ = c.select(s.alias("s"), F.lit("Customer").alias("type")).unionByName(o.where("o_orderkey % 100 <> 7").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("s"), F.lit("Order").alias("type")))
    return t, types_, spark.createDataFrame(_PARAMS, _PARAM_DDL)


_RESULTS = """res AS (
SELECT 'minInclusive' AS component, 'sh:Violation' AS severity FROM customer WHERE floor(c_acctbal) < 0
UNION ALL SELECT 'in', 'sh:Warning' FROM customer WHERE c_mktsegment NOT IN ('AUTOMOBILE', 'BUILDING', 'MACHINERY', 'HOUSEHOLD')
UNION ALL SELECT 'pattern', 'sh:Info' FROM customer WHERE NOT regexp_matches(c_name, '^customer#[0-9]{8}0$', 'i')
UNION ALL SELECT 'minCount', 'sh:Violation' FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey HAVING count(o_orderkey) < 5
UNION ALL SELECT 'class', 'sh:Violation' FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 100 = 7
UNION ALL SELECT 'datatype', 'sh:Warning' FROM customer
UNION ALL SELECT 'maxLength', 'sh:Info' FROM customer WHERE length(c_name) > 17
UNION ALL SELECT 'nodeKind', 'sh:Info' FROM orders JOIN customer ON o_custkey = c_custkey
UNION ALL SELECT 'hasValue', 'sh:Info' FROM customer WHERE c_mktsegment <> 'BUILDING')"""


@query("validate_components", f"WITH {_RESULTS} SELECT component, severity, count(*) AS n FROM res GROUP BY ALL")
def validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V01, V10-V16, V24"""
    return D.validate(*_graph(spark, sf_dir)).groupBy("component", "severity").agg(F.count("*").alias("n"))


@query("validate_severities", f"WITH {_RESULTS} SELECT count(*) AS result_count, count_if(severity = 'sh:Violation') AS violation_count, count_if(severity = 'sh:Warning') AS warning_count, count_if(severity = 'sh:Info') AS info_count FROM res")
def severities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V02"""
    return D.severity_counts(D.validate(*_graph(spark, sf_dir)))


@query("validate_logic", "WITH f AS (SELECT c_custkey, c_acctbal < 0 AS a, c_mktsegment <> 'BUILDING' AS b FROM customer) SELECT * FROM (SELECT 'and' AS component, count(*) AS n FROM f WHERE a OR b UNION ALL SELECT 'or', count(*) FROM f WHERE a AND b UNION ALL SELECT 'xone', count(*) FROM f WHERE a = b UNION ALL SELECT 'not', count(*) FROM f WHERE NOT a UNION ALL SELECT 'node', count(*) FROM f WHERE b) WHERE n > 0")
def logic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V17-V21"""
    c = table(spark, sf_dir, "customer")
    ids = c.select(F.col("c_custkey").cast("string").alias("focus"))
    bad = c.where("c_acctbal < 0").select(F.lit("A").alias("shape"), F.col("c_custkey").cast("string").alias("focus")).unionByName(c.where("c_mktsegment <> 'BUILDING'").select(F.lit("B").alias("shape"), F.col("c_custkey").cast("string").alias("focus")))
    rows = [(f"S{k}", k, m, "sh:Violation") for k, ms in (("and", "AB"), ("or", "AB"), ("xone", "AB"), ("not", "A"), ("node", "B")) for m in ms]
    lg = spark.createDataFrame(rows, "shape string, component string, member string, severity string")
    focus = ids.crossJoin(lg.select("shape").distinct()).select("shape", "focus")
    return D.combine(focus, bad, lg).groupBy("component").agg(F.count("*").alias("n"))


@query("validate_closed", "SELECT 'placed' AS path, count(*) AS n FROM (SELECT DISTINCT o_custkey, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey)")
def closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V22"""
    t, types_, _ = _graph(spark, sf_dir)
    p = spark.createDataFrame([("C", "Customer", None, "closed", "true", ["segment"], "sh:Violation"), ("C", "Customer", "balance", "maxCount", "9", None, "sh:Violation"), ("C", "Customer", "name", "maxCount", "9", None, "sh:Violation")], _PARAM_DDL)
    return D.check_closed(D.targets(types_, p), p, t.distinct()).groupBy("path").agg(F.count("*").alias("n"))


@query("validate_pairs", "SELECT 'lessThan' AS component, count(*) AS n FROM lineitem WHERE NOT l_discount < l_tax UNION ALL SELECT 'disjoint', count(*) FROM lineitem WHERE l_discount = l_tax UNION ALL SELECT 'equals', 2 * count(*) FROM lineitem WHERE l_discount <> l_tax")
def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discount against tax, in hundredths, of each line item"""
    l = table(spark, sf_dir, "lineitem").withColumn("id", F.monotonically_increasing_id().cast("string"))
    side = lambda p, c: l.select(F.col("id").alias("s"), F.lit(p).alias("p"), F.round(F.col(c) * 100).cast("int").cast("string").alias("o"), F.lit("literal").alias("o_kind"), F.lit("xsd:integer").alias("o_dt"), F.lit(None).cast("string").alias("o_lang"))
    t = G.shared(side("discount", "l_discount").unionByName(side("tax", "l_tax")), "pairs")
    p = spark.createDataFrame([("L", "Line", "discount", c, "tax", None, "sh:Violation") for c in ("lessThan", "disjoint", "equals")], _PARAM_DDL)
    focus = t.select(F.lit("L").alias("shape"), F.col("s").alias("focus")).distinct()
    return D.check_pairs(focus, D.values(focus, p, t), p, t).groupBy("component").agg(F.count("*").alias("n"))


@query("validate_unique_keys", "SELECT count(*) AS n_groups FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) > 1)")
def unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V12 over a pair of columns"""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("n_groups"))


def _terms(spark: SparkSession) -> DataFrame:
    return X.terms(spark).withColumn("full_iri", F.col("iri"))


@query("grounding_catalog", f"WITH {O.TERMS_SQL} SELECT iri, 'class' AS role FROM terms WHERE type = 'class' UNION SELECT iri, 'property' FROM terms WHERE type = 'property' UNION SELECT iri, 'scoped' FROM terms WHERE type = 'property' AND \"domain\" IN ('fx:Customer', 'fx:partSize', 'fx:Part')")
def ground(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V04"""
    t = spark.createDataFrame([("fx:Customer",), ("fx:partSize",)], "iri string")
    return D.grounding_catalog(O.terms(spark, sf_dir).withColumn("full_iri", F.col("iri")), t)


@query("grounding_errors", f"WITH {X.TERMS_SQL}, r AS (SELECT p_partkey AS doc_id, predicate, iri FROM part, (VALUES ('path', 'fx:partSize'), ('path', 'fx:Part'), ('class', 'fx:Order'), ('targetClass', 'fx:Nothing'), ('node', 'fx:shipDate'), ('class', 'xsd:string')) v(predicate, iri)) SELECT doc_id, predicate, iri FROM r WHERE (predicate = 'path' AND iri = 'fx:Part') OR iri = 'fx:Nothing'")
def ground_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V05"""
    refs = [("path", "fx:partSize"), ("path", "fx:Part"), ("class", "fx:Order"), ("targetClass", "fx:Nothing"), ("node", "fx:shipDate"), ("class", "xsd:string")]
    r = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.explode(F.array(*[F.struct(F.lit(a).alias("predicate"), F.lit(b).alias("iri")) for a, b in refs])).alias("r")).select("doc_id", "r.*")
    cat = D.grounding_catalog(_terms(spark), spark.createDataFrame([], "iri string"))
    return D.grounding_errors(r, cat, ["xsd:"]).select("doc_id", "predicate", "iri")


@query("grounding_has_value", "SELECT p_partkey AS doc_id FROM part WHERE p_partkey % 3 = 1")
def ground_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V06"""
    v = F.element_at(F.array(*[F.lit(x) for x in ("fx:Part", "fx:Order", "x")]), (F.col("p_partkey") % 3 + 1).cast("int"))
    s = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.lit("s").alias("shape"), F.lit("fx:placesOrder").alias("path"), v.alias("has_value"))
    return D.has_value_errors(s, _terms(spark)).select("doc_id")


@query("grounding_display", "SELECT p_brand, array_to_string(list_sort(list(DISTINCT p_name))[1:3], ', ') || CASE WHEN count(DISTINCT p_name) > 3 THEN ' ... (' || (count(DISTINCT p_name) - 3) || ' more)' ELSE '' END AS names FROM part GROUP BY p_brand")
def display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V07"""
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(D.display_list("p_name", 3).alias("names"))


@query("catalog_content_hash", "SELECT page_id, sha256(coalesce(html, '')) AS hash FROM pages")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G61"""
    return table(spark, sf_dir, "pages").select("page_id", T.content_hash("html").alias("hash"))
