import json

import pytest

from graphloom.operators import shapes
from graphloom.operators import workflow as O


def test_settings():
    assert O.integer_setting("", 5) == 5 and O.integer_setting("7", 5) == 7
    with pytest.raises(ValueError):
        O.integer_setting("0", 5)
    assert O.seconds_setting([None, "", "2.5"], 9.0) == 2.5 and O.seconds_setting([], 9.0) == 9.0
    with pytest.raises(ValueError):
        O.seconds_setting(["0"], 1.0)
    assert O.list_setting(" a, ,b ") == ("a", "b") and O.list_setting(None, ("x",)) == ("x",)
    assert O.choice("Evidence-and-Merge", O.BASELINE_MODES, "mode", "none") == "both"
    with pytest.raises(ValueError):
        O.choice("other", O.BASELINE_MODES, "mode", "none")


def test_retries_and_throttle():
    waits, calls = [], []

    def call(n):
        calls.append(n)
        if len(calls) < 3:
            raise O.Throttled
        return n

    assert O.with_retries(call, 6, 5.0, waits.append, lambda: 0.0)(4) == 4
    assert waits == [5.0, 10.0]
    with pytest.raises(O.Throttled):
        O.with_retries(lambda: (_ for _ in ()).throw(O.Throttled()), 2, 0.0, waits.append)()
    clock, slept = iter([0.0, 0.0, 0.3, 0.3]), []
    slow = O.throttle(lambda: 1, 1.0, lambda: next(clock), slept.append)
    slow(), slow()
    assert slept == [pytest.approx(0.7)]


def test_small_helpers():
    assert O.prompt(json.dumps({"k": [{"role": "user", "content": "Hi {name}"}]}), "k", name="B") == [("user", "Hi B")]
    assert O.last_token_pool([[[1.0], [2.0], [3.0]]], [[1, 1, 0]]) == [[2.0]]
    try:
        try:
            raise TimeoutError
        except TimeoutError as e:
            raise RuntimeError from e
    except RuntimeError as e:
        assert O.is_timeout(e)
    assert not O.is_timeout(ValueError())
    assert O.check_model(lambda: 1)["valid"] and O.check_model(lambda: 1 / 0)["status"] == 502
    assert O.flat({"a": 1, "b": None, "baseline": {"mode": "m", "x": 2}}) == {"a": 1, "baseline_mode": "m", "x": 2}
    pick = O.selection_adapter(lambda p: '["b"]' if "- b | B" in p else "[]")
    assert pick({"rule_number": "1", "title": "t", "text": "x", "allowed_candidates": [{"target": "b", "label": "B"}]}) == ["b"]
    assert O.wait_for(iter([False, True]).__next__, 9.0, sleep=lambda s: None)
    with pytest.raises(TimeoutError):
        O.wait_for(lambda: False, 0.0, strict=True)
    with pytest.raises(ValueError):
        O.provider_enabled("x", ["y"])


def test_shape_prefix():
    assert shapes.shape_prefix([("a-sh", "n"), ("xshape", "n")], "n") == ("a-sh", None)
    assert shapes.shape_prefix([], "n") == ("shape", "@prefix shape: <n> .")
    assert shapes.shape_prefix([("s", "n")], "n", "s") == ("s", None)
    for bindings, wanted in (([("s", "m")], "s"), ([], "1x")):
        with pytest.raises(ValueError):
            shapes.shape_prefix(bindings, "n", wanted)


def test_conforming_subset(spark):
    from pyspark.sql import functions as F

    from graphloom.operators import graph as G

    rows = [("a", "iri", "sh:property", "b", "bnode"), ("b", "bnode", "sh:minCount", "x", "literal"), ("c", "iri", "sh:property", "d", "bnode"), ("d", "bnode", "sh:minCount", "1", "literal")]
    t = spark.createDataFrame(rows, "s string, s_kind string, p string, o string, o_kind string")
    bad = lambda t: t.where("p = 'sh:minCount' and o not rlike '^[0-9]+$'").select(F.col("s").alias("node"))
    edges = lambda t: t.where("o_kind = 'bnode'").select(F.col("s").alias("src"), F.col("o").alias("dst"))
    roots = lambda t, failing: G.nearest_roots(edges(t), failing, t.where("s_kind = 'iri'").select(F.col("s").alias("root"))).select(F.col("candidate").alias("root"))
    kept, cut = shapes.build_baseline(t, lambda x: x, bad, roots, edges)
    assert cut and {r.s for r in kept.collect()} == {"c", "d"}


def test_batch(spark):
    from graphloom.functions.responses import Outcome
    from graphloom.plans import fixtures as X

    rules = spark.createDataFrame([(1, "R1", "Sizes", "Every part has a part size."), (2, "R2", "", "qqq")], "rule_id bigint, number string, title string, text string")
    resolved, outcomes, total = O.run_batch(rules, X.terms(spark), lambda i, t: Outcome("s", True))
    assert {r.rule_id: r.resolved_by for r in resolved.collect()} == {1: "label", 2: "none"}
    assert [r.status for r in outcomes.collect()] == ["valid"] and total.first().total == 1


def test_rows_that_become_many_are_dealt_out(spark, sf_dir):
    """The part table is one small file; its triples aren't made in one task."""
    from graphloom.plans import workflow_queries

    assert spark.read.parquet(f"{sf_dir}/part.parquet").rdd.getNumPartitions() == 1
    assert workflow_queries.shape_triples(spark, sf_dir).rdd.getNumPartitions() == 4
