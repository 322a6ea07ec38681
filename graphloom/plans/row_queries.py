"""Row by row what other queries only count, and operators that none of them reaches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import constraints as C
from graphloom.operators import graph as G
from graphloom.operators import shapes
from graphloom.operators import validation as D
from graphloom.plans import catalog_queries as Q
from graphloom.plans import constraint_queries as CQ
from graphloom.plans import ontology as O
from graphloom.plans import sql as S
from graphloom.plans.registry import query, table


@query("validate_closed_rows", "SELECT DISTINCT 'c' || o_custkey AS focus, 'placed' AS path, 'o' || o_orderkey AS value FROM orders JOIN customer ON o_custkey = c_custkey")
def closed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V22"""
    t, types, _ = Q._graph(spark, sf_dir)
    p = spark.createDataFrame([("C", "Customer", None, "closed", "true", ["segment"], "sh:Violation"), ("C", "Customer", "balance", "maxCount", "9", None, "sh:Violation"), ("C", "Customer", "name", "maxCount", "9", None, "sh:Violation")], Q._PARAM_DDL)
    return D.validate(t.distinct(), types, p).select("focus", "path", "value")


_ITEM = "SELECT 'l' || l_orderkey || '-' || l_linenumber AS id, CAST(round(min(l_discount) * 100) AS INT) AS d, CAST(round(min(l_tax) * 100) AS INT) AS t FROM lineitem GROUP BY l_orderkey, l_linenumber"


@query(
    "validate_pair_rows",
    f"WITH i AS ({_ITEM}) SELECT id AS focus, 'lessThan' AS component, CAST(d AS VARCHAR) AS value FROM i WHERE NOT d < t UNION ALL SELECT id, 'disjoint', CAST(d AS VARCHAR) FROM i WHERE d = t UNION ALL SELECT id, 'equals', CAST(v AS VARCHAR) FROM i, LATERAL (VALUES (d), (t)) x(v) WHERE d <> t UNION ALL SELECT id, 'lessThanOrEquals', CAST(d AS VARCHAR) FROM i WHERE d > t",
)
def pair_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discount against tax of each line item, as values of properties"""
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.round(F.min("l_discount") * 100).cast("int").alias("d"), F.round(F.min("l_tax") * 100).cast("int").alias("t"))
    s = F.concat(F.lit("l"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"))
    side = lambda p, c: F.struct(F.lit(p).alias("p"), F.col(c).cast("string").alias("o"))
    none = F.lit(None).cast("string")
    t = l.select(s.alias("s"), F.explode(F.array(side("discount", "d"), side("tax", "t"))).alias("r")).select("s", "r.*", F.lit("literal").alias("o_kind"), F.lit("xsd:integer").alias("o_dt"), none.alias("o_lang"))
    types = l.select(s.alias("s"), F.lit("Line").alias("type"))
    p = spark.createDataFrame([("L", "Line", "discount", c, "tax", None, "sh:Violation") for c in ("lessThan", "lessThanOrEquals", "disjoint", "equals")], Q._PARAM_DDL)
    return D.validate(t, types, p).select("focus", "component", "value")


@query(
    "merge_priority_rows",
    f"WITH {CQ.CONS}, {CQ._ODD} SELECT source, shape, path, predicate, value, kind, dt FROM c2 WHERE source = 'generated' OR path NOT IN (SELECT path FROM c2 WHERE source = 'generated')",
)
def priority_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S17, S18"""
    c = CQ.constraints(spark, sf_dir).withColumn("path", F.when(F.col("ord") % 3 == 0, F.concat("target_class", F.lit("/"), "path")).otherwise(F.col("path")))
    return C.merge_priority(c).select("source", "shape", "path", "predicate", "value", "kind", "dt")


@query("closure_quarantine_rows", "SELECT 'c' || o_custkey AS s, 'o' || o_orderkey AS o, CASE WHEN o_custkey % 10 = 0 THEN 'aside' ELSE 'kept' END AS side FROM orders")
def quarantine_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth customer goes with all below"""
    e = Q._edges(spark, sf_dir).where("src like 'c%'")
    t = e.select(F.col("src").alias("s"), F.col("dst").alias("o"))
    roots = t.select(F.col("s").alias("root")).where("cast(substring(root, 2) as bigint) % 10 = 0").distinct()
    kept, aside = G.quarantine(t, e, roots)
    return kept.withColumn("side", F.lit("kept")).unionByName(aside.withColumn("side", F.lit("aside")))


@query(
    "conforming_subset",
    "SELECT 's' || p_partkey AS s, 'sh:property' AS p, 'b' || p_partkey AS o FROM part WHERE p_partkey % 7 <> 0 UNION ALL SELECT 'b' || p_partkey, 'sh:minCount', CAST(p_size AS VARCHAR) FROM part WHERE p_partkey % 7 <> 0",
)
def subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes of parts, a blank node each; those with a bad count go with their blank node"""
    p = table(spark, sf_dir, "part")
    key = F.col("p_partkey").cast("string")
    s, b = F.concat(F.lit("s"), key), F.concat(F.lit("b"), key)
    count = F.when(F.col("p_partkey") % 7 == 0, "many").otherwise(F.col("p_size").cast("string"))
    row = lambda s, sk, p, o, ok: F.struct(s.alias("s"), F.lit(sk).alias("s_kind"), F.lit(p).alias("p"), o.alias("o"), F.lit(ok).alias("o_kind"))
    t = p.select(F.explode(F.array(row(s, "iri", "sh:property", b, "bnode"), row(b, "bnode", "sh:minCount", count, "literal"))).alias("r")).select("r.*")
    bad = lambda t: t.where("p = 'sh:minCount' and not o rlike '^[0-9]+$'").select(F.col("s").alias("node"))
    edges = lambda t: t.where("o_kind = 'bnode'").select(F.col("s").alias("src"), F.col("o").alias("dst"))
    roots = lambda t, failing: G.nearest_roots(edges(t), failing, t.where("s_kind = 'iri'").select(F.col("s").alias("root"))).select(F.col("candidate").alias("root"))
    return shapes.build_baseline(t, lambda x: x, bad, roots, edges)[0].select("s", "p", "o")


@query(
    "catalog_property_domains",
    f"SELECT '{O._SUPPLIED.split(chr(39))[1]}' || s_suppkey AS property, d AS \"domain\" FROM supplier, LATERAL (VALUES ('{Q.X.BASE}Part' || s_suppkey), (CASE WHEN s_suppkey % 2 = 0 THEN '{Q.X.BASE}Part' || (s_suppkey + 1) END), (CASE WHEN s_suppkey % 2 = 0 THEN '{Q.X.BASE}Thing' END)) v(d) WHERE d IS NOT NULL",
)
def property_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named domains of suppliers' properties, and for every second one a union of two classes"""
    base = Q.X.BASE
    u = table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0")
    key = F.col("s_suppkey").cast("string")
    name = lambda x: F.concat(F.lit(x), key)
    row = lambda s, p, o, k: F.struct(s.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(k).alias("o_kind"))
    union = u.select(F.explode(F.array(row(name(f"{base}suppliedBy"), G.RDFS + "domain", name("_:u"), "bnode"), row(name("_:u"), G.OWL + "unionOf", name("_:x"), "bnode"))).alias("r")).select("r.*")
    nil = F.lit(G.RDF + "nil")
    other = F.concat(F.lit(base + "Part"), (F.col("s_suppkey") + 1).cast("string"))
    cells = u.select(F.explode(F.array(F.struct(name("_:x").alias("cell"), other.alias("first"), name("_:y").alias("rest")), F.struct(name("_:y").alias("cell"), F.lit(base + "Thing").alias("first"), nil.alias("rest")))).alias("r")).select("r.*")
    t = O.triples(spark, sf_dir).select("s", "p", "o", "o_kind").where(F.col("s").startswith(base + "suppliedBy") & (F.col("s") != base + "suppliedBy")).unionByName(union)
    return G.property_domains(t, cells)


@query("catalog_ontologies", f"SELECT DISTINCT 'http://fixture.example/nation/' || n_nationkey AS iri FROM nation UNION SELECT '{Q.X.BASE[:-1]}'")
def ontologies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G42"""
    n = table(spark, sf_dir, "nation").selectExpr("'http://fixture.example/nation/' || n_nationkey as s", f"'{G.RDF}type' as p", f"'{G.OWL}Ontology' as o", "'iri' as o_kind", "'iri' as s_kind")
    return G.ontology_iris(O.triples(spark, sf_dir).unionByName(n))


@query("text_phrase_rows", f"SELECT DISTINCT p_partkey, {S.norm('b.p_name')} AS alias FROM part a, (SELECT DISTINCT p_name FROM part) b WHERE {S.phrase(S.norm('a.p_type || chr(32) || a.p_name'), S.norm('b.p_name'))}")
def phrase_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names are joined by their first word before the phrase is looked for"""
    p = table(spark, sf_dir, "part")
    a = p.select("p_partkey", T.normalise(F.concat_ws(" ", "p_type", "p_name")).alias("t"))
    b = p.select(T.normalise("p_name").alias("alias")).distinct().withColumn("w", F.element_at(F.split("alias", " "), 1))
    words = a.select("p_partkey", "t", F.explode(F.array_distinct(F.split("t", " "))).alias("w"))
    return words.join(b, "w").where(T.contains_phrase("t", "alias")).select("p_partkey", "alias").distinct()
