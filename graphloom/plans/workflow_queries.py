"""Queries of shape graphs and of the workflow's projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import constraints as C
from graphloom.operators import graph as G
from graphloom.operators import grounding, shapes, validation
from graphloom.operators import workflow as O
from graphloom.plans import catalog_queries, constraint_queries
from graphloom.plans import fixtures as X
from graphloom.plans import grounding_queries as GQ
from graphloom.plans.registry import dealt, query, table


def shape_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part is a node shape with a blank property shape; every ninth has a property that nothing refers to."""
    p = dealt(spark, sf_dir, "part")
    s, b = F.concat(F.lit("s"), F.col("p_partkey").cast("string")), F.concat(F.lit("b"), F.col("p_partkey").cast("string"))
    row = lambda a, ak, q, o, k: F.struct(a.alias("s"), F.lit(ak).alias("s_kind"), F.lit(q).alias("p"), o.alias("o"), F.lit(k).alias("o_kind"))
    ref = F.when(F.col("p_partkey") % 9 != 0, row(s, "iri", "sh:property", b, "bnode"))
    rows = [row(s, "iri", "rdf:type", F.lit("sh:NodeShape"), "iri"), row(s, "iri", "sh:targetClass", F.col("p_brand"), "iri"), ref, row(b, "bnode", "sh:path", F.col("p_type"), "iri"), row(b, "bnode", "sh:minCount", (F.col("p_size") % 3).cast("string"), "literal")]
    return p.select(F.explode(F.filter(F.array(*rows), lambda r: r.isNotNull())).alias("r")).select("r.*").withColumn("doc_id", F.lit("d"))


_T = "t AS (SELECT 's' || p_partkey AS s, 'b' || p_partkey AS b, p_partkey AS k, p_brand, p_type, p_size FROM part)"


@query("shapes_roots", f"WITH {_T} SELECT count(*) + (SELECT count(*) FROM t WHERE k % 9 <> 0) AS n FROM t")
def roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S55"""
    return shapes.shape_roots(shape_triples(spark, sf_dir)).agg(F.count("*").alias("n"))


@query("shapes_without_orphans", f"WITH {_T} SELECT 3 * count(*) FILTER (k % 9 <> 0) + 2 * count(*) AS n FROM t")
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S74"""
    return shapes.without_orphans(shape_triples(spark, sf_dir)).agg(F.count("*").alias("n"))


@query("shapes_copied", f"WITH {_T} SELECT count(*) FILTER (k % 9 <> 0) * 3 AS n FROM t WHERE k % 2 = 0")
def copied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties of even shapes"""
    t = shape_triples(spark, sf_dir)
    even = t.where("s like 's%' and cast(substring(s, 2) as bigint) % 2 = 0").select(F.col("s").alias("root")).distinct()
    return shapes.copied(t, even, ["sh:property"]).agg(F.count("*").alias("n"))


@query("shapes_renamed", f"WITH {_T} SELECT 2 * (count(*) FILTER (k % 9 <> 0) * 3 + count(*) FILTER (k % 9 = 0) * 2) + 2 * count(*) AS n FROM t")
def renamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two copies of a graph only what hangs on blank nodes is doubled"""
    t = shape_triples(spark, sf_dir).drop("doc_id")
    return shapes.renamed(t, "x").unionByName(shapes.renamed(t, "y")).distinct().agg(F.count("*").alias("n"))


@query("shapes_empty", f"WITH {_T} SELECT s FROM t WHERE k % 9 = 0")
def empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S75"""
    return C.empty_shapes(shape_triples(spark, sf_dir))


@query("shapes_hints", f"WITH {_T} SELECT DISTINCT 'd' AS doc_id, 'constraint sh:minCount' AS reason, 'sh:minCount ' || (p_size % 3) AS hint FROM t")
def hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R58"""
    return shapes.hints(shape_triples(spark, sf_dir)).drop("nr")


@query("shapes_generic_profile", f"WITH {_T} SELECT 'datatype' AS component, count(*) AS n FROM t")
def generic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts written as plain strings break the profile"""
    t = shape_triples(spark, sf_dir).withColumns({"o_dt": F.when(F.col("o_kind") == "literal", "xsd:string"), "o_lang": F.lit(None).cast("string")})
    types = t.where("p = 'sh:path'").select("s", F.lit("sh:PropertyShape").alias("type"))
    return validation.validate(t, types, shapes.generic_profile(t)).groupBy("component").agg(F.count("*").alias("n"))


@query("shapes_merged_nodes", f"WITH {constraint_queries.CONS}, {constraint_queries._MERGED} SELECT target_class, path, predicate, vals FROM merged")
def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S20b, S20c"""
    out = shapes.merge_nodes(constraint_queries.constraints(spark, sf_dir))
    return out.select("target_class", "path", "predicate", F.array_join(F.coalesce("values", "members"), "|").alias("vals"))


@query("shapes_group_predicates", f"WITH {constraint_queries.CONS} SELECT target_class, path, array_to_string(list_sort(list(DISTINCT predicate)), ' ') AS predicates FROM cons GROUP BY ALL")
def predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H14, H15"""
    out = shapes.group_predicates(constraint_queries.constraints(spark, sf_dir), ["target_class", "path"])
    return out.withColumn("predicates", F.array_join("predicates", " "))


@query("shapes_namespace_guess", "SELECT 'http://fixture.example/shapes/' AS ns")
def guessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H22"""
    return shapes.guessed_namespace(catalog_queries.prefixes(spark, sf_dir))


@query("shapes_bound_prefixes", f"WITH {catalog_queries.PREFIXES_SQL} SELECT 'fx' AS prefix, 'http://first/' AS ns UNION ALL SELECT prefix, ns FROM prefixes WHERE prefix <> 'fx'")
def bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S05"""
    return shapes.bound(spark.createDataFrame([("fx", "http://first/")], "prefix string, ns string"), catalog_queries.prefixes(spark, sf_dir))


_REFS = [("focus_nodes", 0, "Part"), ("constraint_paths", 0, "fx:partSize"), ("constraint_paths", 1, "part size"), ("related_terms", 0, "fx:Part"), ("related_terms", 1, "http://other/x")]


def _roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("rule_id"))
    refs = F.explode(F.array(*[F.struct(F.lit(r).alias("role"), F.lit(k).alias("pos"), F.lit(x).alias("ref")) for r, k, x in _REFS]))
    return shapes.role_terms(p.select("rule_id", refs.alias("x")).select("rule_id", "x.*"), X.terms(spark))


@query("roles_terms", "SELECT p_partkey AS rule_id, role, iri FROM part, (VALUES ('focus_nodes', 'fx:Part'), ('constraint_paths', 'fx:partSize'), ('related_terms', 'http://other/x')) v(role, iri)")
def role_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R55, H48"""
    return _roles(spark, sf_dir).select("rule_id", "role", F.col("term.iri").alias("iri"))


@query("roles_context", "SELECT p_partkey AS rule_id, 'Focus classes:' || chr(10) || '- fx:Part | label=Part | type=class | kind=Class | domain=fx:Part' || chr(10) || chr(10) || 'Paths that may be constrained:' || chr(10) || '- fx:partSize | label=part size | type=property | kind=DatatypeProperty | domain=fx:Part | range=xsd:integer | values have datatype xsd:integer' || chr(10) || chr(10) || 'Related terms, for context:' || chr(10) || '- http://other/x' AS context FROM part")
def role_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R56"""
    return shapes.role_context(_roles(spark, sf_dir))


@query("roles_ontology_context")
def ontology_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R57"""
    return shapes.ontology_context(_roles(spark, sf_dir), X.terms(spark).select("iri", "note"))


_SHOWN = lambda c: f"array_to_string({c}[1:40], ', ') || CASE WHEN len({c}) > 40 THEN ' ... (' || (len({c}) - 40) || ' more)' ELSE '' END"


@query(
    "grounding_allowed_terms",
    f"WITH {catalog_queries.O.TERMS_SQL}, a AS (SELECT list_sort(list(iri) FILTER (type = 'class')) AS c, list_sort(list(iri) FILTER (type = 'property' AND \"domain\" = 'fx:Customer')) AS p FROM terms) SELECT 'Allowed ontology classes:' || chr(10) || {_SHOWN('c')} || chr(10) || 'Allowed ontology properties for this target/domain:' || chr(10) || {_SHOWN('p')} AS allowed FROM a",
)
def allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V08"""
    t = catalog_queries.O.terms(spark, sf_dir).withColumn("full_iri", F.col("iri"))
    return shapes.allowed_terms(validation.grounding_catalog(t, spark.createDataFrame([("fx:Customer",)], "iri string")))


@query("validate_profile_metadata", "SELECT p_brand AS doc_id, CAST(count(*) + 1 AS INT) AS profile_count, 'generic|' || array_to_string(list('p' || p_partkey ORDER BY p_partkey), '|') AS names, 'syntax+generic+profile' AS validation_level FROM part GROUP BY p_brand")
def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V03"""
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("doc_id"), F.col("p_partkey").alias("nr"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("name"))
    return shapes.profile_metadata(p).select("doc_id", "profile_count", F.array_join("profile_names", "|").alias("names"), "validation_level")


@query("public_terms", f"WITH {catalog_queries.O.TERMS_SQL} SELECT id, iri, full_iri, label, \"domain\" AS d, \"range\" AS r, note AS ontology_note FROM terms")
def public_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms made public and taken back"""
    t = O.internal_terms(O.public_terms(catalog_queries.O.terms(spark, sf_dir)))
    return t.select("id", "iri", "full_iri", "label", F.col("domain").alias("d"), F.col("range").alias("r"), F.col("note").alias("ontology_note"))


@query("public_candidates", f"{GQ._WITH} SELECT rule_id, CAST(rank AS INT) AS rank, l.target, t.label, t.type, l.score FROM label l JOIN terms t ON t.ord = l.term_ord")
def public_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H33, H58"""
    t = X.terms(spark)
    return O.public_candidates(grounding.label_candidates(X.rules(spark, sf_dir), t), t).select("rule_id", "rank", "target", "label", "type", "score")


@query("public_routes", "SELECT user_id, CASE user_id % 3 WHEN 0 THEN 'jobs.list' WHEN 1 THEN 'jobs.get' END AS operation FROM (SELECT DISTINCT user_id FROM events)")
def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A02"""
    r = spark.createDataFrame([("jobs.list", "GET", "/api/v1/jobs"), ("jobs.get", "GET", "/api/v1/jobs/{job_id}"), ("jobs.put", "PUT", "/api/v1/jobs/{job_id}")], "operation string, method string, template string")
    u = table(spark, sf_dir, "events").select("user_id").distinct()
    path = F.when(F.col("user_id") % 3 == 0, "/api/v1/jobs").when(F.col("user_id") % 3 == 1, F.concat(F.lit("/api/v1/jobs/"), F.col("user_id").cast("string"))).otherwise("/api/v1/jobs/a/b")
    asked = u.select("user_id", F.lit("GET").alias("method"), path.alias("path"))
    known = O.match_route(r, asked.select("method", "path").distinct())
    return asked.join(known, ["method", "path"], "left").select("user_id", "operation")


@query("public_outcomes")
def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W10, H60"""
    done = G.shared(GQ.resolved(spark, sf_dir), "outcomes")
    return O.public_outcomes(done, grounding.classify_roles(done, X.terms(spark)))
