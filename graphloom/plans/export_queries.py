"""Queries of subtree hashes, the export of shapes and Turtle text; trees are made from orders and parts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import graph as G
from graphloom.operators import subtrees as T
from graphloom.plans.registry import query, table
from graphloom.sources import rdf

NS = "http://fixture.example/shapes#"
SH, XSD = G.ESSENTIAL["sh"], G.ESSENTIAL["xsd"]


def _rows(df: DataFrame, cells: list[tuple]) -> DataFrame:
    """Triples of rows: (subject, kind, predicate, object, kind, datatype) each; what is null isn't said."""
    text = lambda x: F.lit(x) if isinstance(x, str) else x.cast("string")
    each = F.array(*[F.struct(text(s).alias("s"), F.lit(sk).alias("s_kind"), F.lit(p).alias("p"), text(o).alias("o"), F.lit(ok).alias("o_kind"), F.lit(dt).cast("string").alias("o_dt")) for s, sk, p, o, ok, dt in cells])
    return df.select(F.explode(each).alias("r")).select("r.*", F.lit(None).cast("string").alias("o_lang")).where("s is not null and o is not null")


def order_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as a blank node over its line items, and each of these over its shipping.

    Line items are numbered in a written copy, as names are made up; a predicate is one scan.
    """
    o = table(spark, sf_dir, "orders")
    l = G.shared(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", F.floor(F.col("l_quantity") / 25).cast("int").alias("size"), F.monotonically_increasing_id().alias("nr")), "lines")
    name = lambda x, c: F.concat(F.lit(x), F.col(c).cast("string"))
    none = F.lit(None).cast("string")

    def said(df: DataFrame, s, p: str, of, kind: str, dt: str | None) -> DataFrame:
        row = df.select(s.alias("s"), F.lit("bnode").alias("s_kind"), F.lit(NS + p).alias("p"), of.cast("string").alias("o"), F.lit(kind).alias("o_kind"), F.lit(dt).cast("string").alias("o_dt"), none.alias("o_lang"))
        return row.where("s is not null and o is not null")

    top = [said(o, name("o", "o_orderkey"), p, F.col(c), "literal", XSD + "string") for p, c in (("status", "o_orderstatus"), ("priority", "o_orderpriority"))]
    below = [
        said(l, name("o", "l_orderkey"), "line", name("l", "nr"), "bnode", None), said(l, name("l", "nr"), "flag", F.col("l_returnflag"), "literal", XSD + "string"),
        said(l, name("l", "nr"), "ships", name("s", "nr"), "bnode", None), said(l, name("s", "nr"), "size", F.col("size"), "literal", XSD + "integer"),
    ]
    return reduce(DataFrame.unionByName, top + below)


@query(
    "export_subtrees",
    """WITH l AS (SELECT l_orderkey, string_agg(l_returnflag || CAST(floor(l_quantity / 25) AS INT), ',' ORDER BY l_returnflag, floor(l_quantity / 25)) AS lines FROM lineitem GROUP BY l_orderkey),
t AS (SELECT 'o' || coalesce(o_orderkey, l_orderkey) AS root, coalesce(o_orderstatus, '') || '|' || coalesce(o_orderpriority, '') || '|' || coalesce(lines, '') AS form FROM orders FULL JOIN l ON l_orderkey = o_orderkey)
SELECT min(root) AS least, count(*) AS n FROM t GROUP BY form""",
)
def subtrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose trees are alike, whatever their blank nodes are called"""
    t = order_trees(spark, sf_dir)
    found = T.subtree_hashes(t).where("node like 'o%'")
    return found.groupBy("hash").agg(F.min("node").alias("least"), F.count("*").alias("n")).drop("hash")


def part_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A node shape of each brand, with a blank property shape of each part: its path, a count, and a list of allowed values."""
    p = table(spark, sf_dir, "part")
    shape, prop = F.concat(F.lit(NS), F.regexp_replace("p_brand", "[^A-Za-z0-9]", "")), F.concat(F.lit("p"), F.col("p_partkey").cast("string"))
    cell = lambda x: F.concat(F.lit(x), F.col("p_partkey").cast("string"))
    rdf_ = lambda x: G.RDF + x
    path = F.concat(F.lit(NS), F.regexp_replace(F.lower("p_type"), "[^a-z]", ""))
    return _rows(p, [
        (shape, "iri", rdf_("type"), SH + "NodeShape", "iri", None), (shape, "iri", SH + "targetClass", F.concat(shape, F.lit("Class")), "iri", None), (shape, "iri", SH + "property", prop, "bnode", None),
        (prop, "bnode", SH + "path", path, "iri", None), (prop, "bnode", SH + "minCount", F.col("p_size") % 2, "literal", XSD + "integer"), (prop, "bnode", SH + "in", cell("a"), "bnode", None),
        (cell("a"), "bnode", rdf_("first"), F.col("p_size") % 3, "literal", XSD + "integer"), (cell("a"), "bnode", rdf_("rest"), cell("b"), "bnode", None),
        (cell("b"), "bnode", rdf_("first"), F.concat(F.lit('say "'), (F.col("p_size") % 2).cast("string"), F.lit('"\n')), "literal", XSD + "string"), (cell("b"), "bnode", rdf_("rest"), rdf_("nil"), "iri", None),
        (F.concat(shape, F.lit("Empty")), "iri", rdf_("type"), SH + "NodeShape", "iri", None),
    ]).distinct()


_FORMS = f"f AS (SELECT DISTINCT '{NS}' || regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g') AS shape, '{NS}' || regexp_replace(lower(p_type), '[^a-z]', '', 'g') AS path, p_size % 2 AS a, p_size % 3 AS b FROM part)"


@query("export_shapes", f"WITH {_FORMS} SELECT shape, count(*) AS n_properties, count(DISTINCT path) AS n_paths FROM f GROUP BY shape")
def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Property shapes alike by their nested lists are one, empty shapes go, no constraint is lost"""
    out, _ = T.export(part_shapes(spark, sf_dir))
    has = out.where(F.col("p") == SH + "property").select(F.col("s").alias("shape"), F.col("o").alias("s"))
    path = out.where(F.col("p") == SH + "path").select("s", F.col("o").alias("path"))
    left = out.where((F.col("p") == G.RDF + "type") & F.col("s").endswith("Empty")).select(F.col("s").alias("shape"))
    return has.join(path, "s").join(left, "shape", "left_anti").groupBy("shape").agg(F.count("*").alias("n_properties"), F.count_distinct("path").alias("n_paths"))


@query(
    "export_turtle",
    f"WITH {_FORMS} SELECT shape, path, CAST(a AS VARCHAR) AS min_count, CAST(b AS VARCHAR) || '|say \"' || a || '\"' || chr(10) AS members FROM f",
)
def turtle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes written as Turtle files and read back, with their nested nodes and lists"""
    out, _ = T.export(part_shapes(spark, sf_dir))
    path = G._shared_path(spark, "turtle")
    T.write_turtle(out, path, {SH: "sh", NS: "", XSD: "xsd"}, files=4)
    t = G.shared(rdf.read_files(spark, path), "read")
    of = lambda p, c: t.where(F.col("p") == SH + p).select("s", F.col("o").alias(c))
    part = lambda p: t.where(F.col("p") == G.RDF + p).select(F.col("s").alias("cell"), F.col("o").alias(p))
    lists = G.list_members(part("first").join(part("rest"), "cell"), of("in", "head").select("head"))
    has = t.where(F.col("p") == SH + "property").select(F.col("s").alias("shape"), F.col("o").alias("s"))
    return has.join(of("path", "path"), "s").join(of("minCount", "min_count"), "s").join(of("in", "head"), "s").join(lists, "head").select("shape", "path", "min_count", F.array_join("members", "|").alias("members"))
