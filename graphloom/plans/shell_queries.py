"""Queries of the shell around models: cleaning, reviews and the build machine, with injected stand-ins."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import responses as R
from graphloom.plans import fixtures as X
from graphloom.plans.registry import query, table


def _build(rule_id: int, text: str) -> R.Outcome:
    """A stand-in for a model: fails now and then, by the rule's number."""
    calls = {"generate": 0, "review": 0}

    def generate(error: str) -> str:
        calls["generate"] += 1
        if rule_id % 11 == 0:
            return R.NOT_FOUND
        return f"Here it is:\n```turtle\nfx:S{rule_id} a sh:NodeShape ; fx:try {calls['generate']} .\n```\nDone."

    def check(shape: str) -> tuple[str, str] | None:
        return ("parse", "not yet") if f"fx:try {1 + rule_id % 3} " not in shape and "fixed" not in shape else None

    def review(shape: str) -> str:
        calls["review"] += 1
        bad = rule_id % 5 == 0 and "fixed" not in shape
        return json.dumps({"status": "fail" if bad else "ok", "issues": [{"message": "wrong path"}] if bad else []})

    return R.build_shape(generate, check, review, lambda shape, report: shape.replace(" .", " ; fx:note fixed:x ."))


_OUT = "o AS (SELECT p_partkey AS rule_id, CASE WHEN p_partkey % 11 = 0 THEN 'skipped' ELSE 'valid' END AS status, CASE WHEN p_partkey % 11 = 0 THEN 'not_found' END AS error_type, CASE WHEN p_partkey % 11 = 0 THEN 1 ELSE 1 + p_partkey % 3 END AS attempts, CASE WHEN p_partkey % 11 = 0 THEN 0 WHEN p_partkey % 5 = 0 THEN 2 ELSE 1 END AS critic_calls, CASE WHEN p_partkey % 11 <> 0 AND p_partkey % 5 = 0 THEN 1 ELSE 0 END AS corrections FROM part)"


@query("shell_build_shapes", f"WITH {_OUT} SELECT rule_id, status, error_type, CAST(attempts AS INT) AS attempts, critic_calls, corrections FROM o")
def build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W01, W02, W07, R16, R17"""
    return R.build_shapes(X.rules(spark, sf_dir), _build).drop("shape")


@query("shell_batch_summary", f"WITH {_OUT} SELECT count(*) AS total, count_if(status = 'valid') AS valid, count_if(status = 'skipped') AS skipped, count_if(status = 'invalid') AS invalid, CAST(sum(attempts) AS BIGINT) AS attempts, CAST(sum(corrections) AS BIGINT) AS corrections FROM o")
def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W01"""
    return R.batch_summary(R.build_shapes(X.rules(spark, sf_dir), _build))


@query("shell_clean_responses", "SELECT p_partkey, 'fx:S' || p_partkey || ' a sh:NodeShape ;' || chr(10) || '  sh:path fx:p .' AS shape FROM part")
def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prose before and behind, a fence or none"""

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"p_partkey": b["p_partkey"], "shape": [R.clean_response(t) for t in b["t"]]})

    body = F.concat(F.lit("fx:S"), F.col("p_partkey").cast("string"), F.lit(" a sh:NodeShape ;\n  sh:path fx:p ."))
    t = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("Sure:\n```ttl\n"), body, F.lit("\n```\nbye"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("It is\n"), body, F.lit("\nI hope this helps"))).otherwise(body)
    return table(spark, sf_dir, "part").select("p_partkey", t.alias("t")).mapInPandas(run, "p_partkey bigint, shape string")


@query("shell_selections", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'a|b' WHEN 1 THEN 'a' WHEN 2 THEN 'x|y' ELSE 'z' END AS targets FROM part")
def selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R18"""
    raw = ['["a", "b"]', '"a"', 'I choose ["x", "y"].', '{"selected_targets": ["z"]}']

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"p_partkey": b["p_partkey"], "targets": ["|".join(R.parse_selection(t)) for t in b["t"]]})

    t = F.element_at(F.array(*[F.lit(x) for x in raw]), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", t.alias("t")).mapInPandas(run, "p_partkey bigint, targets string")
