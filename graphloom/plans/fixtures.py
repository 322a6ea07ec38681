"""The fixture schema as an ontology: tables are classes, columns properties, keys object properties.

Rules are sentences made from part rows. The same literals feed the queries and their oracle SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.plans import sql as S
from graphloom.plans.registry import table

BASE = "http://fixture.example/schema#"
# table: (label, superclass), and of each table (column name, label, range, note)
CLASSES = {"Part": ("Part", "Thing"), "Supplier": ("Supplier", "Agent"), "Customer": ("Customer", "Agent"), "Order": ("Order", "Thing"), "LineItem": ("Line Item", "Thing"), "Nation": ("Nation", "Place"), "Region": ("Region", "Place"), "Agent": ("Agent", ""), "Thing": ("Thing", ""), "Place": ("Place", "")}
PROPERTIES = [
    ("hasRetailPrice", "retail price", "Part", "xsd:double", "price that a part has in retail"),
    ("partSize", "part size", "Part", "xsd:integer", ""),
    ("partBrand", "brand", "Part", "xsd:string", "brand label of a part"),
    ("suppliedBy", "supplied by", "Part", "Supplier", "the supplier that supplies a part"),
    ("accountBalance", "account balance", "Customer", "xsd:double", "balance of a customer account"),
    ("marketSegment", "market segment", "Customer", "xsd:string", ""),
    ("placesOrder", "places order", "Customer", "Order", "an order that a customer places"),
    ("orderDate", "order date", "Order", "xsd:dateTime", ""),
    ("orderPriority", "order priority", "Order", "xsd:string", "priority of the order"),
    ("hasLineItem", "has line item", "Order", "LineItem", "a line item of an order"),
    ("itemQuantity", "quantity", "LineItem", "xsd:double", ""),
    ("shipDate", "ship date", "LineItem", "xsd:dateTime", "date on which an item is shipped"),
    ("requiresPart", "requires part", "LineItem", "Part", "the part that a line item requires"),
    ("locatedInNation", "located in nation", "Agent", "Nation", "nation that an agent is located in"),
    ("isInRegion", "is in region", "Nation", "Region", "region of a nation"),
]
TERM_COLUMNS = ["ord", "id", "type", "label", "iri", "full_iri", "kind", "domain", "range", "superclasses", "comment", "note"]


def _terms() -> list[tuple]:
    rows = []
    for name, (label, parent) in CLASSES.items():
        iri = f"fx:{name}"
        rows.append(["class", label, iri, BASE + name, "Class", iri, "", [f"fx:{parent}"] if parent else [], "", f"{iri} is an ontology class."])
    for name, label, domain, range_, note in PROPERTIES:
        iri, to = f"fx:{name}", range_ if ":" in range_ else f"fx:{range_}"
        kind = "DatatypeProperty" if ":" in range_ else "ObjectProperty"
        rows.append(["property", label, iri, BASE + name, kind, f"fx:{domain}", to, [], note, note or f"{iri} is a {kind} with domain fx:{domain} and range {to}."])
    rows.sort(key=lambda r: (r[0], r[1].lower()))
    return [(i, f"{r[0]}-{i}", *r) for i, r in enumerate(rows)]


TERMS = _terms()
TERM_DDL = "ord int, id string, type string, label string, iri string, full_iri string, kind string, domain string, range string, superclasses array<string>, comment string, note string"
TERMS_SQL = S.values("terms", TERM_COLUMNS, TERMS)

_RULES = [
    "Every {n} must have exactly one retail price and a brand.",
    "The {n} part is supplied by one supplier located in a nation.",
    "Each order of {n} requires an order priority, and its line item has a quantity.",
    "A customer places an order for {n} with an account balance greater than zero.",
    "The size of {n} must be given.",
    "Nothing is said of {n} here.",
    "Line items that require a part such as {n} have a ship date.",
]


def terms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TERMS, TERM_DDL)


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rule_id, number, title, text), one of every part."""
    p = table(spark, sf_dir, "part")
    text = F.lit(_RULES[-1])
    for k, sentence in enumerate(_RULES[:-1]):
        text = F.when(F.col("p_partkey") % len(_RULES) == k, F.lit(sentence)).otherwise(text)
    return p.select(
        F.col("p_partkey").alias("rule_id"),
        F.concat(F.lit("R"), F.col("p_partkey").cast("string")).alias("number"),
        F.concat(F.lit("Rule on "), F.when(F.col("p_partkey") % 3 == 0, "Line Items of ").otherwise(""), "p_name").alias("title"),
        F.replace(text, F.lit("{n}"), F.col("p_name")).alias("text"),
    )


RULES_SQL = (
    "rules AS (SELECT p_partkey AS rule_id, 'R' || p_partkey AS number, 'Rule on ' || CASE WHEN p_partkey % 3 = 0 THEN 'Line Items of ' ELSE '' END || p_name AS title, replace(CASE p_partkey % "
    + str(len(_RULES))
    + " "
    + " ".join(f"WHEN {k} THEN {S.literal(s)}" for k, s in enumerate(_RULES))
    + " END, '{n}', p_name) AS text FROM part)"
)
