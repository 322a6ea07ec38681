"""An ontology over the tables: a class of each part and brand, a property of each supplier and customer, beside the schema's own.

Triples, prefixes and terms are given twice, as DataFrames and as SQL: the SQL builds terms from the tables
directly, the DataFrames by the library's catalog from the triples.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import graph as G
from graphloom.plans import fixtures as X
from graphloom.plans import sql as S
from graphloom.plans.registry import table

RDF, RDFS, OWL, XSD = G.RDF, G.RDFS, G.OWL, G.ESSENTIAL["xsd"]


def _literal_triples() -> list[tuple]:
    """The fixture schema as triples (s, p, o, o_kind)."""
    rows = [(X.BASE[:-1], RDF + "type", OWL + "Ontology", "iri")]
    for _, _, type_, label, _, full, kind, domain, range_, supers, comment, _ in X.TERMS:
        rows.append((full, RDF + "type", OWL + kind, "iri"))
        rows.append((full, RDFS + "label", label, "literal"))
        if comment:
            rows.append((full, RDFS + "comment", comment, "literal"))
        rows += [(full, RDFS + "subClassOf", X.BASE + s[3:], "iri") for s in supers]
        if type_ == "property":
            rows.append((full, RDFS + "domain", X.BASE + domain[3:], "iri"))
            rows.append((full, RDFS + "range", (X.BASE + range_[3:]) if range_.startswith("fx:") else XSD + range_[4:], "iri"))
    return rows


LITERAL = _literal_triples()
LITERAL_SQL = S.values("triples", ["s", "p", "o", "o_kind"], LITERAL)

_PART, _BRAND = f"'{X.BASE}Part' || p_partkey", f"'{X.BASE}Brand' || substr(p_brand, 7)"
_SUPPLIED, _BALANCE = f"'{X.BASE}suppliedBy' || s_suppkey", f"'{X.BASE}balanceOf' || c_custkey"
#: (table, subject, predicate, object, kind, condition) in expressions that both dialects read.
_DERIVED = [
    ("part", _PART, RDF + "type", f"'{OWL}Class'", "iri", "true"),
    ("part", _PART, RDFS + "label", "p_name", "literal", "true"),
    ("part", _PART, RDFS + "subClassOf", _BRAND, "iri", "true"),
    ("part", _PART, RDFS + "comment", "'size ' || p_size", "literal", "p_partkey % 3 = 0"),
    ("part", _BRAND, RDF + "type", f"'{OWL}Class'", "iri", "true"),
    ("part", _BRAND, RDFS + "label", "p_brand", "literal", "true"),
    ("supplier", _SUPPLIED, RDF + "type", f"'{OWL}ObjectProperty'", "iri", "true"),
    ("supplier", _SUPPLIED, RDFS + "label", "s_name", "literal", "true"),
    ("supplier", _SUPPLIED, RDFS + "domain", f"'{X.BASE}Part' || s_suppkey", "iri", "true"),
    ("supplier", _SUPPLIED, RDFS + "range", f"'{X.BASE}Supplier'", "iri", "true"),
    ("customer", _BALANCE, RDF + "type", f"'{OWL}DatatypeProperty'", "iri", "true"),
    ("customer", _BALANCE, RDFS + "label", "c_name", "literal", "true"),
    ("customer", _BALANCE, RDFS + "domain", f"'{X.BASE}Part' || (c_custkey % 50)", "iri", "true"),
    ("customer", _BALANCE, RDFS + "range", f"'{XSD}decimal'", "iri", "true"),
    ("customer", _BALANCE, RDFS + "comment", "c_mktsegment", "literal", "c_custkey % 2 = 0"),
]
TRIPLES_SQL = (
    S.values("schema_triples", ["s", "p", "o", "o_kind"], LITERAL)
    + ", triples AS (SELECT s, p, o, o_kind FROM schema_triples UNION "
    + " UNION ".join(f"SELECT {s}, '{p}', {o}, '{k}' FROM {t} WHERE {w}" for t, s, p, o, k, w in _DERIVED)
    + ")"
)
PREFIXES = [("fx", X.BASE), ("xsd", XSD), ("rdfs", RDFS), ("owl", OWL), ("shape", "http://fixture.example/shapes/"), ("unused", "http://unused.example/ns#"), ("", "http://page.example/")]
PREFIXES_SQL = S.values("schema_prefixes", ["prefix", "ns"], PREFIXES) + ", prefixes AS (SELECT prefix, ns FROM schema_prefixes UNION ALL SELECT 's' || s_suppkey, 'http://fixture.example/supplier/' || s_suppkey || '/' FROM supplier)"

_SCHEMA_TERMS = S.values("schema_terms", ["type", "label", "iri", "full_iri", "kind", "domain", "range", "superclasses", "comment"], [(t[2], t[3], t[4], t[5], t[6], t[7], t[8], t[9], t[10]) for t in X.TERMS])
TERMS_SQL = f"""{_SCHEMA_TERMS}, said AS (
SELECT type, label, iri, full_iri, kind, "domain", "range", superclasses, comment FROM schema_terms
UNION ALL SELECT 'class', p_name, 'fx:Part' || p_partkey, {_PART}, 'Class', 'fx:Part' || p_partkey, '', ['fx:Brand' || substr(p_brand, 7)], CASE WHEN p_partkey % 3 = 0 THEN 'size ' || p_size ELSE '' END FROM part
UNION ALL SELECT DISTINCT 'class', p_brand, 'fx:Brand' || substr(p_brand, 7), {_BRAND}, 'Class', 'fx:Brand' || substr(p_brand, 7), '', CAST([] AS VARCHAR[]), '' FROM part
UNION ALL SELECT 'property', s_name, 'fx:suppliedBy' || s_suppkey, {_SUPPLIED}, 'ObjectProperty', 'fx:Part' || s_suppkey, 'fx:Supplier', CAST([] AS VARCHAR[]), '' FROM supplier
UNION ALL SELECT 'property', c_name, 'fx:balanceOf' || c_custkey, {_BALANCE}, 'DatatypeProperty', 'fx:Part' || (c_custkey % 50), 'xsd:decimal', CAST([] AS VARCHAR[]), CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE '' END FROM customer),
placed AS (SELECT *, row_number() OVER (ORDER BY type, CASE WHEN kind = 'ObjectProperty' THEN 0 ELSE 1 END, full_iri) - 1 AS pre FROM said),
terms AS (SELECT CAST(row_number() OVER (ORDER BY type, lower(label), pre) - 1 AS INT) AS ord, type || '-' || pre AS id, type, label, iri, full_iri, kind, "domain", "range", superclasses, comment,
  CASE WHEN comment <> '' THEN comment WHEN type = 'class' THEN iri || ' is an ontology class.' ELSE iri || ' is a ' || kind || ' with domain ' || "domain" || ' and range ' || "range" || '.' END AS note FROM placed)"""


def schema_triples(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LITERAL, "s string, p string, o string, o_kind string").withColumn("s_kind", F.lit("iri"))


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = [table(spark, sf_dir, t).where(w).selectExpr(f"{s} as s", f"'{p}' as p", f"{o} as o", f"'{k}' as o_kind") for t, s, p, o, k, w in _DERIVED]
    return schema_triples(spark).unionByName(reduce(DataFrame.unionByName, made).withColumn("s_kind", F.lit("iri"))).distinct()


def prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "supplier").selectExpr("'s' || s_suppkey as prefix", "'http://fixture.example/supplier/' || s_suppkey || '/' as ns")
    return spark.createDataFrame(PREFIXES, "prefix string, ns string").unionByName(own)


def prefix_map() -> Column:
    return F.create_map(*[F.lit(x) for p, n in PREFIXES if p for x in (n, p)])


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog of these triples."""
    return G.catalog(triples(spark, sf_dir), prefix_map())
