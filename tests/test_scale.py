"""Orders, look-ups and rankings over many rows, against plain versions and by their plans."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import graph as G
from graphloom.operators import grounding as R
from graphloom.plans import registered


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_total_order_of_a_million(spark):
    df = spark.range(1_000_000).select(F.pmod(F.xxhash64("id"), F.lit(50_000)).alias("a"), F.col("id").alias("b"))
    out = G.total_order(df, [F.desc("a"), F.col("b")], "place")
    assert "SinglePartition" not in plan(out) and "Window" not in plan(out)
    wrong = out.alias("x").join(out.alias("y"), F.col("x.place") + 1 == F.col("y.place")).where("not (x.a > y.a or (x.a = y.a and x.b < y.b))")
    assert wrong.count() == 0
    assert out.agg(F.min("place"), F.max("place"), F.count_distinct("place")).first()[:] == (0, 999_999, 1_000_000)


def test_total_order_of_few_and_none(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,)], "x string")
    assert [r.x for r in G.total_order(df, [F.col("x")], "nr").orderBy("nr").collect()] == [None, "a", "b"]
    assert G.total_order(df.where("false"), [F.col("x")], "nr").count() == 0


def test_catalog_without_one_partition(spark):
    """20,000 classes: their order is that of plain Python, and no exchange goes to one partition."""
    label = F.concat(F.lit("L"), F.pmod(F.xxhash64("id"), F.lit(9000)).cast("string"))
    s = F.concat(F.lit("http://x/c"), F.col("id").cast("string"))
    none = F.lit(None).cast("string")
    row = lambda p, o, k: F.struct(F.lit(p).alias("p"), o.alias("o"), F.lit(k).alias("o_kind"))
    t = spark.range(20_000).select(s.alias("s"), F.lit("iri").alias("s_kind"), F.explode(F.array(row(G.RDF + "type", F.lit(G.OWL + "Class"), "iri"), row(G.RDFS + "label", label, "literal"))).alias("r")).select("s", "s_kind", "r.*", none.alias("o_dt"), none.alias("o_lang"))
    out = G.catalog(G.shared(t, "t"), F.create_map(F.lit("http://x/"), F.lit("x")))
    assert "SinglePartition" not in plan(out)
    rows = [(r.ord, r.label, r.full_iri) for r in out.select("ord", "label", "full_iri").collect()]
    iris = sorted(r[2] for r in rows)
    pre = {x: i for i, x in enumerate(iris)}
    assert [r[2] for r in sorted(rows)] == [r[2] for r in sorted(rows, key=lambda r: (r[1].lower(), pre[r[2]]))]


def test_token_index(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randrange(2, 6)))
    texts = [(i, f"e{i}", "class", " ".join(word() for _ in range(6)), word()) for i in range(2000)]
    texts += [(2000, "e", "class", "", ""), (2001, "f", "class", "ab", "ab")]
    tokens = sorted({word() for _ in range(150)} | {"zzz"})
    out = R.token_hits(spark.createDataFrame([(t,) for t in tokens], "tok string"), spark.createDataFrame(texts, "term_ord int, entity_id string, type string, hay string, low string"))
    assert "NestedLoop" not in plan(out) and "Cartesian" not in plan(out)
    got = sorted((r.tok, r.term_ord, r.named) for r in out.collect())
    assert got == sorted((t, i, t in low) for t in tokens if len(t) > 2 for i, _, _, hay, low in texts if t in hay)


def test_blocked_cosine(spark, monkeypatch):
    monkeypatch.setattr(R, "QUERY_BLOCK", 3)
    monkeypatch.setattr(R, "VECTOR_BLOCK", 7)
    rng = np.random.default_rng(5)
    v = [[float(c) for c in r] for r in rng.normal(size=(40, 5)).round(1)]
    v[7] = v[3]
    v[20] = [0.0] * 5
    v[21] = [2 * c for c in v[3]]
    q = [v[3], [0.0] * 5, *[[float(c) for c in r] for r in rng.normal(size=(9, 5))]]
    queries = spark.createDataFrame([*enumerate(q), (99, None)], "rule_id bigint, vec array<double>")
    vectors = spark.createDataFrame([(i, f"e{i}", "class" if i % 4 else "property", x) for i, x in enumerate(v)] + [(50, "n", "class", None)], "term_ord int, entity_id string, type string, vec array<double>")

    def plain(allowed):
        out = []
        for i, a in enumerate(q):
            near = []
            for j, b in enumerate(v):
                n = sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5
                if allowed is None or ("class" if j % 4 else "property") in allowed:
                    near.append((-(sum(x * y for x, y in zip(a, b, strict=True)) / n if n else 0.0), j))
            out += [(i, j, r + 1) for r, (_, j) in enumerate(sorted(near)[:6])]
        return sorted(out)

    for allowed in (None, ["class"]):
        out = R.rank_semantic(queries, vectors, allowed, 6)
        assert "NestedLoop" not in plan(out) and "Cartesian" not in plan(out)
        assert sorted((r.rule_id, r.term_ord, r["rank"]) for r in out.collect()) == plain(allowed)
    assert R.rank_semantic(queries.where("false"), vectors).count() == 0 and R.rank_semantic(queries, vectors.where("false")).count() == 0


def broadcast_lines(df):
    """The lines of a plan below its broadcasts."""
    out, at = [], None
    for line in plan(df).splitlines():
        depth = len(line) - len(line.lstrip(" :+-"))
        at = None if at is not None and depth <= at else at
        if at is not None:
            out.append(line)
        elif "BroadcastExchange" in line:
            at = depth
    return out


@pytest.mark.parametrize("name", ["resolve_choice", "resolve_summary", "resolve_target_details", "roles_of_targets", "rank_lexical_properties", "rank_lexical_terms", "public_outcomes", "resolve_cascade", "resolve_choice_pool", "roles_primary_term"])
def test_rules_are_never_broadcast(spark, sf_dir, name):
    """Files of a few megabytes hold a million rules: what the planner takes for small would fill the driver."""
    assert not [x for x in broadcast_lines(registered.QUERIES[name](spark, sf_dir)) if "rule_id#" in x or "p_partkey#" in x]


@pytest.mark.parametrize("name", ["consolidate_values", "merge_restrictive", "normalize_parameters"])
def test_texts_are_aggregated_over_distinct_values(spark, sf_dir, name):
    """Aggregates that sort their rows read the written distinct values, not every row of the source."""
    assert "part.parquet" not in plan(registered.QUERIES[name](spark, sf_dir))


def test_focused_constraints_meet_paths_and_classes_at_once(spark, sf_dir):
    joins = [x for x in plan(registered.QUERIES["merge_focused_evidence"](spark, sf_dir)).splitlines() if "Join" in x]
    assert [x for x in joins if "path#" in x and "target_class#" in x] and not [x for x in joins if "rule_id#" in x]


@pytest.mark.parametrize("name", ["roles_terms", "roles_context", "roles_ontology_context"])
def test_references_are_not_shuffled_by_name(spark, sf_dir, name):
    """A few names stand in all rules: by name they would be a few tasks."""
    assert "hashpartitioning(ref#" not in plan(registered.QUERIES[name](spark, sf_dir))


def test_schema_is_looked_up(spark, sf_dir):
    """One predicate stands in most triples: by predicate or type they would be one task."""
    text = plan(registered.QUERIES["closure_rdfs"](spark, sf_dir))
    assert "SortMergeJoin" not in text and "hashpartitioning(p#" not in text
