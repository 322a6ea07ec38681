"""Requests and results around the operators: settings, public projections, connectors with retries, and batches."""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import responses as R
from graphloom.functions import text as T
from graphloom.functions import values as V
from graphloom.operators import grounding

# fixed values: retries and pauses of remote calls, and how modes of a baseline are said
CHAT_RETRIES, CHAT_PAUSE, EMBED_RETRIES, EMBED_PAUSE, EMBED_BATCH = 6, 5.0, 10, 1.0, 8
BASELINE_MODES = {"none": "none", "evidence": "baseline", "baseline": "baseline", "merge": "merge", "evidence-and-merge": "both", "both": "both"}


class Throttled(RuntimeError):
    """A remote call that may be tried again."""


def choice(value: object, choices: dict[str, str], name: str, default: str) -> str:
    """H54. A choice by its names, in any case; an unknown one is an error."""
    said = str(value or default).strip().lower()
    if said not in choices:
        raise ValueError(f"{name} must be one of: {', '.join(sorted(choices))}")
    return choices[said]


def integer_setting(raw: str | None, default: int, minimum: int = 1) -> int:
    """H67. A whole number of at least minimum, from a setting's text."""
    value = default if raw in (None, "") else int(raw)
    if value < minimum:
        raise ValueError(f"a setting of {value} is below {minimum}")
    return value


def seconds_setting(raws: Iterable[str | None], default: float) -> float:
    """H67. Seconds over zero, from the first filled of a setting and its aliases."""
    raw = next((r for r in raws if r not in (None, "")), None)
    value = default if raw is None else float(raw)
    if value <= 0:
        raise ValueError("a number of seconds must be over zero")
    return value


def list_setting(raw: str | None, default: tuple[str, ...] = ()) -> tuple[str, ...]:
    """H67. Filled items between commas."""
    return default if raw is None else tuple(x.strip() for x in raw.split(",") if x.strip())


def with_retries(call: Callable, retries: int = CHAT_RETRIES, pause: float = CHAT_PAUSE, sleep: Callable[[float], None] = time.sleep, rng: Callable[[], float] = random.random) -> Callable:
    """G19, G20, G22. A call that waits and tries again where it was throttled, longer each time; other errors pass."""

    def run(*args, **options):
        for n in range(retries + 1):
            try:
                return call(*args, **options)
            except Throttled:
                if n == retries:
                    raise
                sleep(pause * 2**n + rng())

    return run


def throttle(call: Callable, gap: float = EMBED_PAUSE, now: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> Callable:
    """H68. A call that leaves gap seconds between its beginnings."""
    last = [float("-inf")]

    def run(*args, **options):
        wait = last[0] + gap - now()
        if wait > 0:
            sleep(wait)
        last[0] = now()
        return call(*args, **options)

    return run


def prompt(template: str, key: str, **fields: object) -> list[tuple[str, str]]:
    """G23. (role, content) messages of a JSON document of templates, with their fields filled in."""
    return [(m["role"], m["content"].format(**fields)) for m in json.loads(template)[key]]


def last_token_pool(states: list[list[list[float]]], masks: list[list[int]]) -> list[list[float]]:
    """H70. Of each row the state of its last token that isn't padding."""
    return [s[max(i for i, m in enumerate(mask) if m)] for s, mask in zip(states, masks, strict=True)]


def is_timeout(error: BaseException | None) -> bool:
    """H47. Whether an error or one behind it is a timeout, by its class's name."""
    seen: set[int] = set()
    while error is not None and id(error) not in seen:
        seen.add(id(error))
        if "timeout" in type(error).__name__.lower():
            return True
        error = error.__cause__ or error.__context__
    return False


def review_summary(status: str, critic_calls: int, corrections: int, issues: list) -> dict:
    """H50."""
    return {"status": status, "critic_calls": critic_calls, "correction_count": corrections, "issue_count": len(issues)}


def selection_adapter(model: Callable[[str], str]) -> Callable[[dict], list[str]]:
    """H46. A model of prompts as a chooser among candidates."""

    def choose(request: dict) -> list[str]:
        lines = [f"- {c['target']} | {c.get('label') or ''} | {c.get('type') or ''} | {c.get('score') or 0}" for c in request["allowed_candidates"]]
        return R.parse_selection(model("\n".join([f"Rule {request['rule_number']}: {request['title']}", request["text"], "Choose targets of this list, as a JSON array:", *lines])))

    return choose


def reference(x: Column) -> Column:
    """H56, H63. A public reference: a struct of its trimmed name; null for an empty one or a dash."""
    return F.when(V.target_ref(x).isNotNull(), F.struct(V.target_ref(x).alias("iri")))


def public_terms(terms: DataFrame) -> DataFrame:
    """H57. Catalog rows as public terms, domain, range and superclasses as lists of references."""
    refs = lambda c: F.filter(F.array(reference(F.col(c))), lambda r: r.isNotNull())
    supers = F.filter(F.transform("superclasses", reference), lambda r: r.isNotNull())
    return terms.select(T.text("id").alias("id"), F.coalesce(T.filled("iri"), T.text("full_iri")).alias("iri"), F.coalesce(T.filled("full_iri"), T.text("iri")).alias("full_iri"), T.text("label").alias("label"), "type", T.text("kind").alias("kind"), refs("domain").alias("domain"), refs("range").alias("range"), supers.alias("superclasses"), T.text("comment").alias("comment"), T.text("note").alias("ontology_note"))


def internal_terms(public: DataFrame) -> DataFrame:
    """H61. Public terms as catalog rows: the first domain and range."""
    one = lambda c: F.coalesce(F.try_element_at(F.col(c), F.lit(1))["iri"], F.lit(""))
    return public.select("id", "type", "label", "iri", "full_iri", "kind", one("domain").alias("domain"), one("range").alias("range"), F.transform("superclasses", lambda s: s["iri"]).alias("superclasses"), "comment", F.col("ontology_note").alias("note"))


def public_candidates(candidates: DataFrame, terms: DataFrame) -> DataFrame:
    """H33, H35, H58. Ranked candidates with their terms' fields; a type that is missing is a property's."""
    detail = terms.select(F.col("ord").alias("term_ord"), F.col("id").alias("entity_id"), "iri", "full_iri", "label", "type", "kind", "domain", "range", "superclasses")
    out = candidates.join(detail, "term_ord", "left")
    return out.select("rule_id", "rank", "entity_id", "target", F.coalesce(T.filled("iri"), "target").alias("iri"), "full_iri", F.coalesce(T.filled("label"), "target").alias("label"), F.coalesce("type", F.lit("property")).alias("type"), F.coalesce(T.filled("kind"), F.lit("Property")).alias("kind"), "domain", "range", "superclasses", F.bround("score", 3).alias("score"), "reasons")


def matches(ref: Column, target: Column, full_iri: Column, label: Column) -> Column:
    """H36. Whether a reference is one of a candidate's names."""
    return F.coalesce(V.target_ref(ref).isin(V.target_ref(target), V.target_ref(full_iri), V.target_ref(label)), F.lit(False))


def public_validation(counts: DataFrame, metadata: DataFrame) -> DataFrame:
    """H59. Severity counts (doc_id) and profile metadata as one record, with whether a document is valid."""
    v = metadata.join(counts, "doc_id", "left").fillna(0, ["result_count", "violation_count", "warning_count", "info_count"])
    return v.withColumn("valid", F.col("violation_count") == 0).withColumn("message", F.when(F.col("valid"), "The shapes conform.").otherwise(F.format_string("%d violations were found.", "violation_count")))


def public_outcomes(resolved: DataFrame, roles: DataFrame) -> DataFrame:
    """W10, H60. Resolutions with their roles and score kind; rules without a target are unresolved."""
    out = resolved.join(roles, "rule_id", "left")
    none = F.array().cast("array<string>")
    return out.select("rule_id", "resolved_by", V.score_kind("resolved_by").alias("score_kind"), "confidence", "targets", *[F.coalesce(c, none).alias(c) for c in ("focus_nodes", "constraint_paths", "related_terms")], (F.size("targets") == 0).alias("unresolved"))


def public_jobs(jobs: DataFrame) -> DataFrame:
    """H42. What is told of a job: all but its result."""
    return jobs.select("job_id", "kind", "status", F.bround("progress", 4).alias("progress"), "message", "created_at", "updated_at")


def with_index_key(terms: DataFrame, content: str, model: str, config: str = "default-config") -> DataFrame:
    """H44. One row: the key of an ontology's vectors, by model, configuration, content and terms."""
    return terms.agg(T.fingerprint("id", T.entity_text("label", "kind", "note", "type", "domain", "range")).alias("f")).select(T.cache_key(F.lit(model), F.lit(config), T.content_hash(F.lit(content)), F.col("f")).alias("cache_key"))


def flat(request: dict) -> dict:
    """W03, A05. A nested request as one level of fields; nested values win over flat ones, and nulls are left out."""
    out = {k: v for k, v in request.items() if v is not None and not isinstance(v, dict)}
    for group, fields in request.items():
        if isinstance(fields, dict):
            out |= {f"{group}_{k}" if k in ("name", "content", "mode") else k: v for k, v in fields.items() if v is not None}
    return out


def wait_for(ready: Callable[[], bool], timeout: float, poll: float = 1.0, strict: bool = False, now: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> bool:
    """W09, H64. Ask until something is ready or time is over; a strict wait that ends without it is an error."""
    end = now() + timeout
    while not ready():
        if now() >= end:
            if strict:
                raise TimeoutError("not ready in time")
            return False
        sleep(poll)
    return True


def check_model(call: Callable[[], object]) -> dict:
    """W13. Whether a model answers, and with which status."""
    try:
        call()
    except Throttled:
        return {"valid": False, "status": 429}
    except Exception as e:
        return {"valid": False, "status": 504 if is_timeout(e) else 502}
    return {"valid": True, "status": 200}


def match_route(routes: DataFrame, requests: DataFrame) -> DataFrame:
    """A02. Requests (method, path) with the operation of routes (operation, method, template): exact first, then by template."""
    pattern = F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace("template", r"([.+?*()\[\]^$])", "\\\\$1"), r"\{[^}/]+\}", "[^/]+"), F.lit("$"))
    r = routes.withColumn("pattern", pattern).withColumn("exact", ~F.col("template").contains("{"))
    hit = requests.join(r, "method").where(F.regexp_like("path", F.col("pattern")))
    best = hit.groupBy("method", "path").agg(F.min_by("operation", F.struct(~F.col("exact"), "operation")).alias("operation"))
    return requests.join(best, ["method", "path"], "left")


def provider_enabled(provider: str, enabled: Iterable[str]) -> None:
    """A08. An error if a profile doesn't allow a provider."""
    if provider not in set(enabled):
        raise ValueError(f"provider {provider} is not enabled here")


def run_batch(rules: DataFrame, terms: DataFrame, make: Callable[[int, str], R.Outcome], **signals) -> tuple[DataFrame, DataFrame, DataFrame]:
    """W01, W05, W06, W08. Resolve rules, build shapes of the resolved ones: (resolutions, outcomes, summary).

    One rule is a batch of one. The resolutions are read twice and written once.
    """
    from graphloom.operators.graph import shared

    resolved = shared(grounding.resolve(rules, terms, **signals), "resolved")
    todo = rules.join(resolved.where(F.size("targets") > 0).select("rule_id"), "rule_id", "left_semi")
    outcomes = shared(R.build_shapes(todo, make), "outcomes")
    return resolved, outcomes, R.batch_summary(outcomes)


def run_stream(rules, terms: DataFrame, make: Callable[[int, str], R.Outcome], sink: Callable[[DataFrame, int], None], checkpoint: str):
    """W45. A stream of rules, each micro-batch resolved and built; sink takes the outcomes."""

    def step(batch: DataFrame, epoch: int) -> None:
        sink(run_batch(batch, terms, make)[1], epoch)

    return rules.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
