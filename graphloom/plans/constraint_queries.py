"""Queries of the constraint algebra; the part table stands for two sources of constraints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import constraints as C
from graphloom.plans.registry import query, table

# predicate: (Spark expression, DuckDB expression, kind, datatype); the two read the same
_SHAPES = {
    "minCount": ("cast(p_size % 7 as string)", "literal", "xsd:integer"),
    "maxCount": ("cast(p_size % 7 + 2 as string)", "literal", "xsd:integer"),
    "minInclusive": ("case when p_size % 29 = 0 then 'many' else cast(p_size as string) end", "literal", "xsd:string"),
    "datatype": ("case p_size % 3 when 0 then 'xsd:string' when 1 then 'xsd:integer' else 'xsd:decimal' end", "iri", None),
    "nodeKind": ("case p_size % 4 when 0 then 'sh:IRI' when 1 then 'sh:Literal' when 2 then 'sh:IRIOrLiteral' else 'sh:BlankNodeOrIRI' end", "iri", None),
    "severity": ("case p_size % 3 when 0 then 'sh:Info' when 1 then 'sh:Warning' else 'sh:Violation' end", "iri", None),
    "closed": ("case when p_size % 5 = 0 then 'true' else 'false' end", "literal", "xsd:boolean"),
    "pattern": ("concat('^', substr(p_name, 1, 2))", "literal", "xsd:string"),
    "flags": ("case when p_size % 2 = 0 then 'im' else 'sx' end", "literal", "xsd:string"),
    "name": ("p_name", "literal", "xsd:string"),
    "or": ("concat('b', cast(p_size % 6 as string))", "bnode", None),
}
_NULL = "cast(null as varchar)"


def _q(x: str | None) -> str:
    return _NULL if x is None else f"'{x}'"


_ROWS = " UNION ALL ".join(
    f"SELECT 'd' || (p_partkey % 5) AS doc_id, CASE WHEN p_partkey % 2 = 0 THEN 'generated' ELSE 'baseline' END AS source, 's' || p_partkey AS shape, p_brand AS target_class, p_type AS path, '{k}' AS predicate, {e} AS value, '{kind}' AS kind, {_q(dt)} AS dt, CAST(NULL AS VARCHAR[]) AS members, p_partkey AS ord FROM part"
    for k, (e, kind, dt) in _SHAPES.items()
)
_LIST = "SELECT 'd' || (p_partkey % 5) AS doc_id, CASE WHEN p_partkey % 2 = 0 THEN 'generated' ELSE 'baseline' END AS source, 's' || p_partkey AS shape, p_brand AS target_class, p_type AS path, 'in' AS predicate, p_name AS value, 'list' AS kind, cast(null as varchar) AS dt, list_sort(string_split(p_name, ' ')) AS members, p_partkey AS ord FROM part"
CONS = f"cons AS ({_ROWS.replace('as string', 'as varchar')} UNION ALL {_LIST})"
ID = "concat_ws(chr(31), coalesce(kind, ''), coalesce(value, ''), coalesce(dt, ''))"
KEYS = "target_class, path, predicate"


def constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part gives a value of each predicate to its brand and type; even parts are generated ones."""
    # a file of few megabytes holds a million parts, and would be two tasks
    p = table(spark, sf_dir, "part").repartition("p_partkey")
    row = lambda k, e, kind, dt, members: F.struct(F.lit(k).alias("predicate"), e.alias("value"), F.lit(kind).alias("kind"), F.lit(dt).cast("string").alias("dt"), members.alias("members"))
    none = F.lit(None).cast("array<string>")
    rows = [row(k, F.expr(e), kind, dt, none) for k, (e, kind, dt) in _SHAPES.items()] + [row("in", F.col("p_name"), "list", None, F.array_sort(F.split("p_name", " ")))]
    out = p.select(
        F.concat(F.lit("d"), (F.col("p_partkey") % 5).cast("string")).alias("doc_id"),
        F.when(F.col("p_partkey") % 2 == 0, "generated").otherwise("baseline").alias("source"),
        F.concat(F.lit("s"), F.col("p_partkey").cast("string")).alias("shape"),
        F.col("p_brand").alias("target_class"),
        F.col("p_type").alias("path"),
        F.explode(F.array(*rows)).alias("r"),
        F.col("p_partkey").alias("ord"),
    )
    return out.select("doc_id", "source", "shape", "target_class", "path", "r.*", "ord")


_HIGHER, _LOWER, _FIRST = ("'" + "', '".join(x) + "'" for x in (C.HIGHER, C.LOWER, C.FIRST))
_LISTED = f"listed AS (SELECT {KEYS}, list(value ORDER BY ord, value) AS vs FROM (SELECT {KEYS}, {ID} AS id, min(ord) AS ord, min(value) AS value FROM cons GROUP BY {KEYS}, id) GROUP BY {KEYS})"
_CONSOLIDATE = f"""WITH {CONS}, {_LISTED}, g AS (SELECT {KEYS}, count(*) FILTER (try_cast(value AS DOUBLE) IS NULL) AS bad, arg_max(value, try_cast(value AS DOUBLE)) AS high, arg_min(value, try_cast(value AS DOUBLE)) AS low, arg_min(value, ord) AS first, count(DISTINCT {ID}) AS n FROM cons GROUP BY {KEYS})
SELECT {KEYS}, CASE WHEN predicate IN ({_FIRST}) THEN first WHEN predicate IN ({_HIGHER}) AND bad = 0 THEN high WHEN predicate IN ({_LOWER}) AND bad = 0 THEN low ELSE array_to_string(vs, '|') END AS vals, predicate IN ({_FIRST}) AND n > 1 AS conflict FROM g JOIN listed USING ({KEYS})"""


@query("consolidate_values", _CONSOLIDATE)
def consolidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S09, S10, S12"""
    out = C.consolidate(constraints(spark, sf_dir), ["target_class", "path"])
    return out.select("target_class", "path", "predicate", F.array_join("values", "|").alias("vals"), "conflict")


@query("consolidate_shape_map", f"WITH {CONS} SELECT target_class, 'http://fixture.example/shapes/' || regexp_replace(target_class, '^.*[#/]', '') || 'Shape' AS shape_iri, count(DISTINCT path) AS n_paths, count(DISTINCT shape) AS n_sources FROM cons GROUP BY target_class")
def shape_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S14, H21"""
    out = constraints(spark, sf_dir).groupBy("target_class").agg(F.count_distinct("path").alias("n_paths"), F.count_distinct("shape").alias("n_sources"))
    return out.select("target_class", C.shape_iri("target_class", "http://fixture.example/shapes/").alias("shape_iri"), "n_paths", "n_sources")


_R = "CASE WHEN source = 'generated' THEN 0 ELSE 1 END"
_SPEC = "CASE value " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in C.SPECIFICITY.items()) + " ELSE -1 END"
_MERGED = f"""ranked AS (SELECT *, {_R} AS r, row_number() OVER (PARTITION BY {KEYS} ORDER BY {_R}, ord) AS nr FROM cons),
lists AS (SELECT {KEYS}, count(*) AS n FROM (SELECT DISTINCT {KEYS}, members FROM cons WHERE members IS NOT NULL) GROUP BY {KEYS}),
common AS (SELECT {KEYS}, list(m ORDER BY m) AS ms FROM (SELECT {KEYS}, m, count(*) AS k FROM (SELECT {KEYS}, unnest(list_distinct(members)) AS m FROM (SELECT DISTINCT {KEYS}, members FROM cons WHERE members IS NOT NULL)) GROUP BY {KEYS}, m) JOIN lists USING ({KEYS}) WHERE k = n GROUP BY {KEYS}),
g AS (SELECT {KEYS}, arg_max(value, try_cast(value AS DOUBLE) * 1000000000 - nr) FILTER (try_cast(value AS DOUBLE) IS NOT NULL) AS high, arg_min(value, try_cast(value AS DOUBLE) * 1000000000 + nr) FILTER (try_cast(value AS DOUBLE) IS NOT NULL) AS low,
  arg_min(value, nr) AS first, arg_min(members, nr) AS first_list, arg_max(value, ({_SPEC}) * 1000000000 - nr) AS kind, bool_or(value = 'true') AS truth, count(DISTINCT {ID}) AS n, count(DISTINCT value) AS nodes, bool_or(source = 'generated') AS gen FROM ranked GROUP BY {KEYS}),
kept AS (SELECT {KEYS}, list(value ORDER BY r, o, value) AS vs FROM (SELECT {KEYS}, {ID} AS id, min(value) AS value, min(r) AS r, arg_min(ord, r * 1000000000 + ord) AS o FROM ranked JOIN (SELECT {KEYS}, gen FROM g) USING ({KEYS}) WHERE predicate <> 'name' AND predicate <> 'severity' OR r = 0 OR NOT gen GROUP BY {KEYS}, id) GROUP BY {KEYS}),
merged AS (SELECT {KEYS},
  CASE WHEN predicate IN ({_HIGHER}) THEN coalesce(high, first) WHEN predicate IN ({_LOWER}) THEN coalesce(low, first) WHEN predicate IN ('closed', 'uniqueLang') THEN CAST(truth AS VARCHAR) WHEN predicate IN ('or', 'xone', 'not', 'datatype', 'class') THEN first WHEN predicate = 'nodeKind' THEN kind
    WHEN predicate = 'in' THEN array_to_string(coalesce(ms, first_list), '|') WHEN predicate IN ('name', 'severity') AND NOT gen THEN vs[1] ELSE array_to_string(vs, '|') END AS vals,
  CASE WHEN predicate = 'in' AND ms IS NULL THEN 'empty intersection; kept the generated list' WHEN predicate IN ('or', 'xone', 'not') AND n > 1 THEN 'logical constraints could not be combined safely; kept the generated constraint' WHEN predicate IN ('datatype', 'class') AND nodes > 1 THEN 'conflicting values; kept the generated value' END AS warning
  FROM g LEFT JOIN kept USING ({KEYS}) LEFT JOIN common USING ({KEYS}))"""


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.merge(constraints(spark, sf_dir), ["target_class", "path"])


@query("merge_restrictive", f"WITH {CONS}, {_MERGED} SELECT * FROM merged")
def merge_restrictive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S19-S23"""
    return merged(spark, sf_dir).select("target_class", "path", "predicate", F.array_join(F.coalesce("values", "members"), "|").alias("vals"), "warning")


@query("merge_incompatible_bounds", f"WITH {CONS}, {_MERGED} SELECT a.target_class, a.path, 'minCount' AS low, 'maxCount' AS high, CAST(a.vals AS DOUBLE) AS low_value, CAST(b.vals AS DOUBLE) AS high_value FROM merged a JOIN merged b USING (target_class, path) WHERE a.predicate = 'minCount' AND b.predicate = 'maxCount' AND CAST(a.vals AS DOUBLE) > CAST(b.vals AS DOUBLE)")
def bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S24"""
    return C.incompatible_bounds(merged(spark, sf_dir), ["target_class", "path"])


@query("merge_sides", f"WITH {CONS} SELECT target_class, path, CASE WHEN a > 0 AND b > 0 THEN 'both' WHEN a > 0 THEN 'generated' ELSE 'baseline' END AS side, a AS n_generated, b AS n_baseline FROM (SELECT target_class, path, count(*) FILTER (source = 'generated') AS a, count(*) FILTER (source = 'baseline') AS b FROM cons GROUP BY ALL)")
def sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S15, S16, S19"""
    return C.merge_sides(constraints(spark, sf_dir), ["target_class", "path"])


_ODD = "c2 AS (SELECT * REPLACE (CASE WHEN ord % 3 = 0 THEN target_class || '/' || path ELSE path END AS path) FROM cons)"


@query("merge_priority", f"WITH {CONS}, {_ODD} SELECT source, predicate, count(*) AS n FROM c2 WHERE source = 'generated' OR path NOT IN (SELECT path FROM c2 WHERE source = 'generated') GROUP BY ALL")
def priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S17, S18"""
    c = constraints(spark, sf_dir).withColumn("path", F.when(F.col("ord") % 3 == 0, F.concat("target_class", F.lit("/"), "path")).otherwise(F.col("path")))
    return C.merge_priority(c).groupBy("source", "predicate").agg(F.count("*").alias("n"))


@query("merge_focused_evidence", f"WITH {CONS} SELECT CAST(r AS INT) AS rule_id, predicate, count(*) AS n FROM cons, (SELECT DISTINCT p_size AS r, p_brand AS b, p_type AS t FROM part) x WHERE target_class = b AND path = t GROUP BY ALL")
def focused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each size is a rule whose parts name a class and a path"""
    p = table(spark, sf_dir, "part").select("p_size", "p_brand", "p_type").distinct()
    one = F.explode(F.array(F.struct(F.lit("path").alias("role"), F.col("p_type").alias("iri")), F.struct(F.lit("focus").alias("role"), F.col("p_brand").alias("iri"))))
    pair = p.select(F.concat_ws("/", F.col("p_size").cast("string"), "p_brand", "p_type").alias("rule_id"), one.alias("r")).select("rule_id", "r.*")
    out = C.focused(constraints(spark, sf_dir), pair)
    return out.groupBy(F.split("rule_id", "/")[0].cast("int").alias("rule_id"), "predicate").agg(F.count("*").alias("n"))


@query("normalize_literals", """WITH l AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'minCount' WHEN 1 THEN 'closed' WHEN 2 THEN 'pattern' ELSE 'maxCount' END AS predicate,
  CASE o_orderkey % 6 WHEN 0 THEN '3.0' WHEN 1 THEN ' TRUE ' WHEN 2 THEN '3.5' WHEN 3 THEN '-1' WHEN 4 THEN '7' ELSE '0' END AS value, CASE WHEN o_orderkey % 5 = 0 THEN 'xsd:integer' ELSE 'xsd:decimal' END AS dt FROM orders),
w AS (SELECT *, CASE WHEN trim(value) IN ('3.0', '7', '0') THEN CAST(CAST(trim(value) AS DOUBLE) AS BIGINT) END AS whole, CASE lower(trim(value)) WHEN 'true' THEN TRUE WHEN '0' THEN FALSE END AS truth FROM l)
SELECT predicate, CASE WHEN predicate IN ('minCount', 'maxCount') AND whole IS NOT NULL AND dt <> 'xsd:integer' THEN CAST(whole AS VARCHAR) WHEN predicate = 'closed' AND truth IS NOT NULL THEN CAST(truth AS VARCHAR) ELSE value END AS value,
  CASE WHEN predicate IN ('minCount', 'maxCount') AND whole IS NOT NULL AND dt <> 'xsd:integer' THEN 'integer_literals_normalized' WHEN predicate = 'closed' AND truth IS NOT NULL THEN 'boolean_literals_normalized' WHEN predicate = 'pattern' THEN 'string_literals_normalized' END AS changed, count(*) AS n FROM w GROUP BY ALL""")
def literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S21, S42, H01-H03"""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    case = lambda m, *v: F.element_at(F.array(*[F.lit(x) for x in v]), (k % m + 1).cast("int"))
    rows = o.select(case(4, "minCount", "closed", "pattern", "maxCount").alias("predicate"), case(6, "3.0", " TRUE ", "3.5", "-1", "7", "0").alias("value"), F.lit("literal").alias("kind"), F.when(k % 5 == 0, "xsd:integer").otherwise("xsd:decimal").alias("dt"))
    return C.normalise_literals(rows).groupBy("predicate", "value", "changed").agg(F.count("*").alias("n"))


_NORMAL = f"""masks AS (SELECT *, CASE value {" ".join(f"WHEN '{k}' THEN {v}" for k, v in C.NODE_KINDS.items())} END AS mask, CASE value WHEN 'sh:Info' THEN 1 WHEN 'sh:Warning' THEN 2 WHEN 'sh:Violation' THEN 3 END AS sev FROM cons),
n0 AS (SELECT {KEYS}, count(DISTINCT {ID}) AS n, count(*) FILTER (try_cast(value AS DOUBLE) IS NULL) AS bad, arg_max(value, try_cast(value AS DOUBLE)) AS high, arg_min(value, try_cast(value AS DOUBLE)) AS low, bool_or(value = 'true') AS truth, arg_max(value, sev) AS worst, bit_or(mask) AS mask, list_sort(list(DISTINCT value)) AS vs, count(DISTINCT members) AS nl,
  count(*) FILTER (members IS NULL) AS no_list FROM masks GROUP BY {KEYS}),
lists AS (SELECT {KEYS}, count(*) AS n FROM (SELECT DISTINCT {KEYS}, members FROM cons WHERE members IS NOT NULL) GROUP BY {KEYS}),
common AS (SELECT {KEYS}, list(m ORDER BY m) AS ms FROM (SELECT {KEYS}, m, count(*) AS k FROM (SELECT {KEYS}, unnest(list_distinct(members)) AS m FROM (SELECT DISTINCT {KEYS}, members FROM cons WHERE members IS NOT NULL)) GROUP BY {KEYS}, m) JOIN lists USING ({KEYS}) WHERE k = n GROUP BY {KEYS}),
normal AS (SELECT {KEYS}, CASE WHEN predicate = 'in' THEN array_to_string(coalesce(ms, []), '|') WHEN n <= 1 THEN array_to_string(vs, '|') WHEN predicate IN ('minCount', 'minInclusive') AND bad = 0 THEN high WHEN predicate = 'maxCount' AND bad = 0 THEN low WHEN predicate = 'closed' THEN CAST(truth AS VARCHAR) WHEN predicate = 'severity' THEN worst
   WHEN predicate = 'nodeKind' THEN CASE mask WHEN 7 THEN '' {" ".join(f"WHEN {v} THEN '{k}'" for k, v in C.NODE_KINDS.items())} END WHEN predicate = 'flags' THEN 'imsx' ELSE array_to_string(vs, '|') END AS vals,
  CASE WHEN predicate = 'in' THEN CASE WHEN nl > 1 THEN 'list_parameters_merged' END WHEN n <= 1 THEN NULL WHEN predicate IN ('minCount', 'maxCount', 'minInclusive') THEN CASE WHEN bad = 0 THEN 'numeric_parameters_collapsed' END WHEN predicate = 'closed' THEN 'boolean_parameters_collapsed' WHEN predicate = 'severity' THEN 'severity_parameters_collapsed'
   WHEN predicate = 'nodeKind' THEN CASE WHEN mask = 7 THEN 'unrestricted_shapes' ELSE 'collapsed_shapes' END WHEN predicate = 'pattern' THEN 'pattern_parameters_conjoined' WHEN predicate = 'datatype' THEN 'datatype_parameters_conjoined' END AS outcome,
  CASE WHEN predicate = 'in' THEN nl - 1 WHEN predicate = 'nodeKind' THEN n ELSE n - 1 END AS removed FROM n0 LEFT JOIN common USING ({KEYS}))"""


@query("normalize_parameters", f"WITH {CONS}, {_NORMAL} SELECT {KEYS}, CASE WHEN predicate = 'flags' AND vals = 'imsx' THEN 'imsx' ELSE vals END AS vals, outcome, CASE WHEN outcome IS NULL THEN NULL ELSE removed END AS removed FROM normal")
def parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S43-S51, S53"""
    out = C.normalise(constraints(spark, sf_dir), ["target_class", "path"])
    return out.select("target_class", "path", "predicate", F.array_join(F.coalesce("values", "members"), "|").alias("vals"), "outcome", "removed")


@query("normalize_counters", f"WITH {CONS}, {_NORMAL} SELECT outcome AS counter, count(*) AS shapes, CAST(sum(removed) AS BIGINT) AS removed FROM normal WHERE outcome IS NOT NULL GROUP BY outcome")
def normal_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S53, S54, S60, H11"""
    return C.counters(C.normalise(constraints(spark, sf_dir), ["target_class", "path"]))


_TYPES = "t AS (SELECT 's' || p_partkey AS shape, p_size % 2 = 0 AS is_node, p_size % 3 <> 0 AS is_property, p_size % 4 AS n_paths, p_partkey % 3 AS n_parents FROM part)"


@query("normalize_shape_types", f"WITH {_TYPES}, a AS (SELECT *, CASE WHEN is_node AND is_property AND n_paths = 1 THEN FALSE ELSE is_node END AS node, CASE WHEN is_node AND is_property AND n_paths <> 1 AND n_parents = 0 THEN FALSE ELSE is_property END AS prop FROM t), b AS (SELECT *, node AND (n_paths > 0 OR n_parents > 0) AS turned FROM a) SELECT shape, node AND NOT turned AS is_node, prop OR turned AS is_property, (node AND NOT turned) <> is_node OR (prop OR turned) <> is_property AS repaired FROM b")
def shape_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S52"""
    p = table(spark, sf_dir, "part")
    t = p.selectExpr("concat('s', cast(p_partkey as string)) as shape", "p_size % 2 = 0 as is_node", "p_size % 3 <> 0 as is_property", "p_size % 4 as n_paths", "p_partkey % 3 as n_parents")
    return C.repair_types(t)


@query("normalize_list_cells", "WITH c AS (SELECT l_orderkey AS list, l_linenumber AS pos, list_sort(list(DISTINCT CAST(l_partkey AS VARCHAR))) AS firsts FROM lineitem GROUP BY ALL), e AS (SELECT list, pos, unnest(firsts) AS member, unnest(range(len(firsts))) AS k FROM c) SELECT list, CAST(row_number() OVER (PARTITION BY list ORDER BY pos, k) - 1 AS INT) AS pos, member FROM e")
def list_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cell of an order and line number with several parts"""
    cells = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("list"), F.col("l_linenumber").alias("pos")).agg(F.collect_set(F.col("l_partkey").cast("string")).alias("firsts"))
    return C.repair_lists(cells)


_SIG = f"sig AS (SELECT target_class, path, shape, sha256(array_to_string(list_sort(list(DISTINCT predicate || chr(31) || {ID})), chr(10))) AS signature FROM cons WHERE predicate IN ('minCount', 'datatype', 'closed') GROUP BY ALL)"


def _few(spark: SparkSession, sf_dir: str) -> DataFrame:
    return constraints(spark, sf_dir).where("predicate in ('minCount', 'datatype', 'closed')")


@query("export_signatures", f"WITH {CONS}, {_SIG} SELECT * FROM sig")
def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S70, S71"""
    return C.signature(_few(spark, sf_dir), ["target_class", "path", "shape"])


@query("export_deduplicated", f"WITH {CONS}, {_SIG} SELECT target_class, path, min(shape) AS shape, signature FROM sig GROUP BY target_class, path, signature")
def deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S73"""
    return C.dedupe_shapes(_few(spark, sf_dir))


@query("export_inventory", f"WITH {CONS} SELECT role, predicate, count(*) AS n FROM (SELECT DISTINCT 'attached' AS role, target_class, path, predicate, {ID} AS id FROM cons) GROUP BY ALL")
def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S72"""
    return C.inventory(constraints(spark, sf_dir)).groupBy("role", "predicate").agg(F.count("*").alias("n"))


@query("export_lossless", "SELECT 0 AS n_changed")
def lossless(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dropping repeated shapes changes no constraint"""
    before = _few(spark, sf_dir)
    after = before.join(C.dedupe_shapes(before).select("shape"), "shape", "left_semi").select(before.columns)
    return C.lossless(before, after).agg(F.count("*").cast("int").alias("n_changed"))
