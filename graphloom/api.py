"""The engine's face: one method an operation, parameters checked before a plan is made.

Models and rankers are injected callables; transport, documents of the contract and live connectors are
not part of the library.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import responses
from graphloom.functions import text as T
from graphloom.operators import constraints, graph, grounding, shape_source, shapes, subtrees, validation, workflow
from graphloom.sources import rdf, rules


class GraphloomError(ValueError):
    """An error with a status and a code, its text free of secrets."""

    def __init__(self, message: str, code: str = "invalid_request", status: int = 400, secrets: tuple[str, ...] = ()):
        for s in sorted({s for s in secrets if s}, key=len, reverse=True):
            message = message.replace(s, "[redacted]")
        super().__init__(message)
        self.code, self.status = code, status

    def payload(self, request_id: str = "") -> dict:
        """A06."""
        return {"status": "error", "error": str(self), "code": self.code, "request_id": request_id}


@dataclass(frozen=True)
class ResolveParams:
    """Options of a resolution, within their limits."""

    label_threshold: float = grounding.LABEL
    strong_label_threshold: float = grounding.STRONG_LABEL
    semantic_threshold: float = grounding.SEMANTIC
    semantic_margin: float = grounding.SEMANTIC_MARGIN
    semantic_max_targets: int = grounding.MAX_SEMANTIC_TARGETS
    top_k: int = grounding.TOP_K

    def __post_init__(self) -> None:
        grounding.check_params(self.label_threshold, self.strong_label_threshold, self.semantic_threshold, self.semantic_margin)
        object.__setattr__(self, "top_k", max(1, min(grounding.MAX_TOP_K, self.top_k)))
        object.__setattr__(self, "semantic_max_targets", max(1, min(grounding.MAX_SEMANTIC_LIMIT, self.semantic_max_targets)))


@dataclass(frozen=True)
class Settings:
    """W46. Operational limits; each has a least value."""

    requests_per_minute: int = 1000
    burst_per_second: int = 200
    expensive_per_minute: int = 120
    jobs_per_minute: int = 60
    request_mb: int = 256
    ontology_mb: int = 200
    batch_mb: int = 50
    profile_mb: int = 20
    shape_mb: int = 50
    concurrent_jobs: int = 50
    concurrent_batches: int = 20
    queued_jobs: int = 500
    idle_seconds: float = 1800.0
    job_seconds: float = 7200.0
    extra: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        for name, value in vars(self).items():
            if name != "extra" and value <= 0:
                raise GraphloomError(f"{name} must be over zero")


class Engine:
    """Operations over a session."""

    def __init__(self, spark: SparkSession, settings: Settings | None = None):
        self.spark, self.settings = spark, settings or Settings()

    def parse_ontology(self, filename: str, content: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        """terms, prefixes and triples of an ontology document."""
        if len(content.encode()) > self.settings.ontology_mb << 20:
            raise GraphloomError("the ontology is too large", "payload_too_large", 413)
        fmt = {"rdf": "xml", "owl": "xml", "xml": "xml"}.get(filename.rsplit(".", 1)[-1].lower(), "turtle")
        try:
            _, bound = rdf.parse(content, fmt)
        except rdf.RdfError as e:
            raise GraphloomError(str(e), "ontology_parse_error") from e
        docs = self.spark.createDataFrame([(filename, content, fmt)], "doc_id string, content string, fmt string")
        triples = rdf.read_documents(docs, format_col="fmt")
        prefixes = self.spark.createDataFrame(list(bound.items()), "prefix string, ns string")
        names = F.create_map(*[F.lit(x) for p, n in bound.items() for x in (n, p)]) if bound else F.create_map().cast("map<string,string>")
        return graph.catalog(triples, names), prefixes, triples

    def parse_rules(self, filename: str, content: str, fmt: str = "") -> DataFrame:
        """Rules of a batch document, with their ids."""
        docs = self.spark.createDataFrame([(filename, filename, fmt, content)], "doc_id string, filename string, fmt string, content string")
        return rules.parse_rules(docs).withColumn("rule_id", F.col("ord").cast("bigint"))

    def search(self, terms: DataFrame, query: str, types: list[str] | None = None) -> DataFrame:
        return graph.search_terms(terms, query, types)

    def rank(self, rules_: DataFrame, terms: DataFrame, vectors: DataFrame | None = None, queries: DataFrame | None = None, types: list[str] | None = None, top_k: int = grounding.LEXICAL_TOP_K) -> DataFrame:
        """R33. Terms by vectors if both sides have them, else by words; method says which."""
        top_k = max(1, min(grounding.MAX_TOP_K, top_k))
        if vectors is not None and queries is not None:
            return grounding.rank_semantic(queries, vectors, types, top_k).withColumn("method", F.lit("semantic"))
        return grounding.rank_lexical(rules_, terms, types, top_k).withColumn("method", F.lit("lexical"))

    def resolve(self, rules_: DataFrame, terms: DataFrame, params: ResolveParams | None = None, index_map: DataFrame | None = None, semantic: DataFrame | None = None, selection: DataFrame | None = None) -> DataFrame:
        """Targets and roles of each rule."""
        p = params or ResolveParams()
        out = grounding.resolve(rules_, terms, index_map, semantic, selection, p.label_threshold, p.strong_label_threshold, p.semantic_threshold, p.semantic_margin, p.semantic_max_targets)
        return out.join(grounding.classify_roles(out, terms), "rule_id", "left")

    def build_shapes(self, rules_: DataFrame, make: Callable[[int, str], responses.Outcome]) -> DataFrame:
        return responses.build_shapes(rules_, make)

    def consolidate(self, constraints_: DataFrame) -> DataFrame:
        return constraints.consolidate(constraints_, ["target_class", "path"])

    def merge(self, constraints_: DataFrame, strategy: str = "generated-priority") -> DataFrame:
        """S25. One of two strategies; anything else is an error."""
        if strategy in ("generated-priority", "priority-llm", "priority_llm"):
            return constraints.merge_priority(constraints_)
        if strategy == "restrictive":
            return constraints.merge(constraints_, ["target_class", "path"])
        raise GraphloomError("the merge strategy is neither generated-priority nor restrictive")

    def normalise(self, constraints_: DataFrame) -> DataFrame:
        return constraints.normalise(constraints.normalise_literals(constraints_).drop("changed"), ["target_class", "path"])

    def validate(self, triples: DataFrame, types: DataFrame, params: DataFrame) -> DataFrame:
        return validation.validate(triples, types, params)

    def _triples(self, name: str, content: str) -> DataFrame:
        fmt = {"rdf": "xml", "owl": "xml", "xml": "xml"}.get(name.rsplit(".", 1)[-1].lower(), "turtle")
        rdf.parse(content, fmt)
        return rdf.read_documents(self.spark.createDataFrame([(name, content, fmt)], "doc_id string, content string, fmt string"), format_col="fmt")

    def validate_document(self, content: str, profiles: list[tuple[str, str]], prefixes: str = "", inference: str = "rdfs") -> dict:
        """V01-V03. A document of shapes against profiles (name, content), shapes themselves: one of four outcomes, as error_type.

        parse: the document isn't Turtle. profile: a profile isn't, or its shapes ask for themselves. profile_error:
        there are violations. none: there are none; warnings and infos don't count. Counts and results come with the last two.
        """
        names = [n for n, _ in profiles]
        out = {"valid": False, "syntax_valid": None, "profile_valid": None, "profile_count": len(names), "profile_names": names}
        if len(content.encode()) > self.settings.shape_mb << 20 or any(len(c.encode()) > self.settings.profile_mb << 20 for _, c in profiles):
            raise GraphloomError("the document or a profile is too large", "payload_too_large", 413)
        try:
            data = graph.shared(self._triples("shape.ttl", f"{prefixes}\n{content}").drop("doc_id"), "document")
        except rdf.RdfError as e:
            return out | {"syntax_valid": False, "error_type": "parse", "error": str(e)}
        try:
            parts = [self._triples(n, c).drop("doc_id") for n, c in profiles]
            params = shape_source.parameters(_union(parts)) if parts else self.spark.createDataFrame([], shape_source.PARAMS)
            types = graph.rdfs_closure(data) if inference == "rdfs" else data.where(F.col("p") == graph.RDF + "type").select("s", F.col("o").alias("type"))
            results = validation.validate(data, types, params)
        except (rdf.RdfError, shape_source.PathCycleError, validation.ShapeRecursionError) as e:
            return out | {"syntax_valid": True, "profile_valid": False, "error_type": "profile", "error": str(e)}
        counts = validation.severity_counts(results).first().asDict()
        good = counts["violation_count"] == 0
        return out | counts | {"valid": good, "syntax_valid": True, "profile_valid": good, "error_type": "none" if good else "profile_error", "error": None, "results": results}

    def export(self, triples: DataFrame) -> DataFrame:
        """Sorted lines of N-Triples."""
        return rdf.to_ntriples(triples).select("line").distinct().orderBy("line")

    def prepare_export(self, documents: list[tuple[str, str]], path: str | None = None, prefixes: dict[str, str] | None = None) -> tuple[DataFrame, dict[str, int]]:
        """S76, S77. Reviewed documents (name, Turtle) as one graph without repeats, with counts; written as Turtle to path, if given."""
        if not documents or any(not c.strip() for _, c in documents):
            raise GraphloomError("a reviewed shape document is empty")
        try:
            parts = [self._triples(n, c).drop("doc_id") for n, c in documents]
        except rdf.RdfError as e:
            raise GraphloomError(str(e), "shape_parse_error") from e
        out, counts = subtrees.export(_union(parts))
        if path:
            subtrees.write_turtle(out, path, prefixes)
        return out, counts | {"documents": len(documents)}

    def generate(self, rules_: DataFrame, terms: DataFrame, make: Callable[[int, str], responses.Outcome], **signals) -> tuple[DataFrame, DataFrame, DataFrame]:
        """W01, W05. Resolve rules and build their shapes: resolutions, outcomes, and a summary."""
        return workflow.run_batch(rules_, terms, make, **signals)

    def generate_one(self, number: str, title: str, text: str, terms: DataFrame, make: Callable[[int, str], responses.Outcome], **signals) -> tuple[DataFrame, DataFrame, DataFrame]:
        """W06. A batch of one rule."""
        if not (title.strip() or text.strip()):
            raise GraphloomError("a rule has a title or a text")
        return self.generate(self.spark.createDataFrame([(1, number, title, text)], "rule_id bigint, number string, title string, text string"), terms, make, **signals)

    def generate_stream(self, rules_: DataFrame, terms: DataFrame, make: Callable[[int, str], responses.Outcome], sink: Callable[[DataFrame, int], None], checkpoint: str):
        """W45. As generate, over a stream of rules."""
        return workflow.run_stream(rules_, terms, make, sink, checkpoint)

    def create_index(self, terms: DataFrame, key: str, embed: Callable, vectors: DataFrame | None = None, batch: int = 8) -> DataFrame:
        """R60, R61. Vectors of the terms that have none under this key, by an injected embedder."""
        todo = terms if vectors is None else grounding.pending_vectors(terms, vectors, key)
        return grounding.embed_terms(todo, key, embed, batch)

    def index_status(self, jobs: DataFrame, vectors: DataFrame, keys: DataFrame) -> DataFrame:
        """R62."""
        return grounding.index_status(jobs, vectors, keys)

    def cancel_index(self, jobs: DataFrame, model: str | None = None, ontology_hash: str | None = None) -> DataFrame:
        """R63."""
        return grounding.cancelled(jobs, model, ontology_hash)

    def baseline(self, triples: DataFrame, normalise: Callable, validate: Callable, candidates_of: Callable, edges_of: Callable, generate: Callable | None = None) -> tuple[DataFrame, bool]:
        """S61. A baseline, from an injected service or as given, cut to what conforms."""
        return shapes.build_baseline(triples, normalise, validate, candidates_of, edges_of, generate)

    def check_model(self, call: Callable[[], object]) -> dict:
        """W13."""
        return workflow.check_model(call)

    def capabilities(self) -> dict:
        """A08. The operations, and the limits in force."""
        return {"operations": sorted(ENDPOINTS), "limits": {k: v for k, v in vars(self.settings).items() if k != "extra"}, "providers": sorted(self.settings.extra.get("providers", []))}

    def health(self) -> dict:
        return {"status": "ok", "spark": self.spark.version}

    def provenance(self, operation: str, request: dict, outcomes: DataFrame) -> DataFrame:
        """W11, W12. One row: the operation, a hash of the request without its secrets, and distinct targets."""
        clean = repr(sorted((k, v) for k, v in request.items() if k.lower() not in T.SECRET_FIELDS))
        return outcomes.agg(F.lit(operation).alias("operation"), F.sha2(F.lit(clean), 256).alias("request_hash"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("targets")))).alias("targets"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: A01. Operation ids, and the methods that carry them out.
ENDPOINTS = {
    "system.capabilities": "capabilities",
    "system.health": "health",
    "workflows.rule.generate": "generate_one",
    "workflows.batch.generate": "generate",
    "batches.generate": "generate_stream",
    "ontology.parse": "parse_ontology",
    "ontology.search": "rank",
    "ontology.terms": "search",
    "ontology.index.create": "create_index",
    "ontology.index.get": "index_status",
    "ontology.index.delete": "cancel_index",
    "rules.parse": "parse_rules",
    "rules.resolve-targets": "resolve",
    "shapes.build": "build_shapes",
    "shapes.consolidate": "consolidate",
    "shapes.merge": "merge",
    "shapes.normalize": "normalise",
    "shapes.validate": "validate_document",
    "shapes.prepare-export": "prepare_export",
    "baselines.generate": "baseline",
    "models.check": "check_model",
    "provenance.record": "provenance",
}


def dispatch(engine: Engine, operation: str, *args, **options):
    """A04. Carry out an operation by its id."""
    if operation not in ENDPOINTS:
        raise GraphloomError(f"no operation {operation}", "not_found", 404)
    return getattr(engine, ENDPOINTS[operation])(*args, **options)
