"""Queries of the ranking and grounding operators over the fixture schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.functions import values as V
from graphloom.operators import grounding as G
from graphloom.plans import fixtures as X
from graphloom.plans import ontology
from graphloom.plans import sql as S
from graphloom.plans.registry import query, table

# --- oracle parts ---------------------------------------------------------------------------------
_WHOLE = "title || chr(10) || text"
READY = f"""ready AS (SELECT rule_id, {S.norm("title")} AS title_norm, {S.norm("text")} AS body_norm, {S.norm(_WHOLE)} AS norm,
  list_distinct({S.tokens(_WHOLE)}) AS rule_tokens, list_distinct({S.tokens("title")}) AS title_tokens, list_distinct({S.tokens("text")}) AS body_tokens FROM rules)"""
_LOCAL = S.local("iri")
_PARTS = S.tokens("alias", True)
ALIASES = f"""plain AS (
  SELECT ord, type, 0 AS k, label AS alias, 'label' AS source FROM terms WHERE trim(label) <> ''
  UNION ALL SELECT ord, type, 1, {S.camel(_LOCAL)}, 'local-name' FROM terms WHERE {_LOCAL} <> '' AND {S.norm(_LOCAL)} <> {S.norm("label")}),
cut AS (SELECT ord, type, k + 2 AS k, array_to_string({_PARTS}[2:], ' ') AS alias, source || '-without-leading-relation' AS source FROM plain
  WHERE len({_PARTS}) >= 3 AND list_contains({S.words(T.RELATION_WORDS)}, {_PARTS}[1])),
aliases AS (SELECT * FROM (SELECT ord AS term_ord, type, row_number() OVER (PARTITION BY ord ORDER BY k) - 1 AS pos, source, {S.norm("alias")} AS alias_norm, {S.tokens("alias")} AS alias_tokens
  FROM (SELECT * FROM plain UNION ALL SELECT * FROM cut)) WHERE alias_norm <> '' AND len(alias_tokens) > 0)"""
EVIDENCE = f"""pairs AS (SELECT r.*, a.*, list_sort(list_intersect(list_distinct(a.alias_tokens), r.rule_tokens)) AS overlap,
    {S.phrase("r.norm", "a.alias_norm")} AS is_phrase, len(list_intersect(list_distinct(a.alias_tokens), r.rule_tokens)) / len(list_distinct(a.alias_tokens)) AS ratio FROM ready r, aliases a),
by_alias AS (SELECT rule_id, term_ord, term_ord * 8 + pos AS step,
    CASE WHEN is_phrase THEN least(0.98::DOUBLE, 0.78::DOUBLE + least(0.16::DOUBLE, 0.04::DOUBLE * len(alias_tokens)) + CASE WHEN source = 'label' THEN 0.03::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN type = 'property' THEN 0.02::DOUBLE ELSE 0.0::DOUBLE END)
      ELSE least(0.85::DOUBLE, 0.62::DOUBLE + least(0.18::DOUBLE, 0.12::DOUBLE * ratio) + CASE WHEN type = 'property' THEN 0.03::DOUBLE ELSE 0.0::DOUBLE END) END AS score,
    CASE WHEN is_phrase THEN 'exact ' || source || ' phrase in ' || ({S.location(S.phrase("title_norm", "alias_norm"), S.phrase("body_norm", "alias_norm"))}) || ': ' || alias_norm
      ELSE source || ' token overlap in ' || ({S.location("list_has_any(overlap, title_tokens)", "list_has_any(overlap, body_tokens)")}) || ': ' || array_to_string(overlap, ', ') END AS reason
  FROM pairs WHERE is_phrase OR (len(alias_tokens) >= 2 AND len(overlap) > 0 AND ratio >= 0.67)),
noted AS (SELECT ord AS term_ord, type, list_distinct({S.tokens("label || ' ' || note || ' ' || comment")}) AS note_tokens, {S.side('"domain"')} AS d, {S.side('"range"')} AS g FROM terms),
by_note AS (SELECT rule_id, term_ord, 1099511627776 + term_ord AS step, least(0.78::DOUBLE, 0.54::DOUBLE + 0.05::DOUBLE * len(overlap)) + CASE WHEN type = 'property' THEN 0.04::DOUBLE ELSE 0.0::DOUBLE END AS score,
    'ontology note/comment overlap in ' || ({S.location("list_has_any(overlap, title_tokens)", "list_has_any(overlap, body_tokens)")}) || ': ' || array_to_string(overlap[1:5], ', ') AS reason
  FROM (SELECT r.*, n.*, list_sort(list_intersect(n.note_tokens, r.rule_tokens)) AS overlap FROM ready r, noted n)
  WHERE len(overlap) >= 2 AND (type <> 'property' OR (len(d) > 0 AND len(g) > 0 AND list_has_all(rule_tokens, d) AND list_has_all(rule_tokens, g)))),
evidence AS (SELECT * FROM by_alias UNION ALL SELECT * FROM by_note)"""
# the winner is the step with the greatest score, the first of equal ones: every target is one term here
MERGED = """best AS (SELECT e.rule_id, t.iri AS target, min(step) AS seen, round(max(score), 3) AS score, arg_min(term_ord, step) AS term_ord FROM evidence e JOIN terms t ON t.ord = e.term_ord GROUP BY ALL),
label AS (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY score DESC, seen) AS rank FROM best)"""
_WITH = f"WITH {X.TERMS_SQL}, {X.RULES_SQL}, {READY}, {ALIASES}, {EVIDENCE}, {MERGED}"
PICKED = f"""picked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY rank) AS pos FROM
  (SELECT *, max(score) OVER (PARTITION BY rule_id) AS top FROM label) WHERE score >= greatest({G.LABEL}::DOUBLE, top - {G.LABEL_MARGIN}::DOUBLE)) WHERE pos <= {G.MAX_TARGETS})"""


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.rules(spark, sf_dir)


@query("resolve_label_aliases", f"WITH {ontology.TERMS_SQL}, {ALIASES} SELECT term_ord, CAST(pos AS INT) AS pos, source, alias_norm, array_to_string(alias_tokens, ' ') AS alias_tokens FROM aliases")
def label_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R34"""
    return G.aliases(ontology.terms(spark, sf_dir)).select("term_ord", "pos", "source", "alias_norm", F.array_join("alias_tokens", " ").alias("alias_tokens"))


@query("resolve_label_evidence", f"{_WITH} SELECT rule_id, term_ord, step, round(score, 9) AS score, reason FROM evidence")
def label_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R35-R38, R05-R07"""
    out = G.evidence(rules(spark, sf_dir), X.terms(spark))
    return out.select("rule_id", "term_ord", "step", F.round("score", 9).alias("score"), "reason")


@query("resolve_label_candidates", f"{_WITH} SELECT rule_id, target, score, rank FROM label")
def label_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R39, R40"""
    return G.label_candidates(rules(spark, sf_dir), X.terms(spark)).select("rule_id", "target", "score", "rank")


@query("resolve_label_targets", f"{_WITH}, {PICKED} SELECT rule_id, pos, target, score FROM picked")
def label_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step 0 of the build plan"""
    return G.label_targets(G.label_candidates(rules(spark, sf_dir), X.terms(spark))).select("rule_id", "pos", "target", "score")


_LEXICAL = f"""lex AS (SELECT rule_id, ord AS term_ord, id AS entity_id, least(99, raw) AS score FROM (
  SELECT r.rule_id, t.*, coalesce(list_sum(list_transform(toks, lambda k: CASE WHEN contains(hay, k) THEN CASE WHEN contains(lower(label), k) THEN 20 ELSE 8 END ELSE 0 END)), 0)
    + CASE WHEN type = 'property' AND regexp_matches(body, 'required|mandatory|exactly|format|greater|less|one of', 'i') THEN 7 ELSE 0 END
    + CASE WHEN type = 'class' AND regexp_matches(body, 'record|instance|class|closed', 'i') THEN 5 ELSE 0 END AS raw
  FROM (SELECT rule_id, title || chr(10) || text AS body, {S.lexical(_WHOLE)} AS toks FROM rules) r,
    (SELECT *, lower(label || ' ' || iri || ' ' || kind || ' ' || type || ' ' || "domain" || ' ' || "range" || ' ' || note) AS hay FROM terms) t) WHERE raw > 0),
lexical AS (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY score DESC, term_ord) AS rank FROM lex)"""


@query("rank_lexical_terms", f"WITH {X.TERMS_SQL}, {X.RULES_SQL}, {_LEXICAL} SELECT rule_id, entity_id, CAST(score AS INT) AS score, CAST(rank AS INT) AS rank FROM lexical WHERE rank <= 8")
def rank_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R10, R30"""
    return G.rank_lexical(rules(spark, sf_dir), X.terms(spark)).select("rule_id", "entity_id", "score", "rank")


@query("rank_lexical_properties", f"WITH {X.TERMS_SQL}, {X.RULES_SQL}, {_LEXICAL}, p AS (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY score DESC, term_ord) AS r FROM lex JOIN (SELECT ord AS term_ord, type FROM terms) USING (term_ord) WHERE type = 'property') SELECT rule_id, entity_id, CAST(score AS INT) AS score, CAST(r AS INT) AS rank FROM p WHERE r <= 3")
def rank_lexical_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R30 with allowed types"""
    return G.rank_lexical(rules(spark, sf_dir), X.terms(spark), ["property"], 3).select("rule_id", "entity_id", "score", "rank")


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Queries are the vectors whose id is divisible by 100, of all vectors; the type is the label's parity."""
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("rule_id"), F.col("embedding").alias("vec"))
    v = e.select(F.col("vec_id").alias("term_ord"), F.concat(F.lit("t"), F.col("vec_id").cast("string")).alias("entity_id"), F.when(F.col("label") % 2 == 0, "class").otherwise("property").alias("type"), F.col("embedding").alias("vec"))
    return q, v


_COS = "SELECT q.vec_id AS rule_id, e.vec_id AS term_ord, CASE WHEN e.label % 2 = 0 THEN 'class' ELSE 'property' END AS type, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS cosine FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0"


@query("rank_semantic_terms", f"SELECT rule_id, 't' || term_ord AS entity_id, round(cosine, 6) AS cosine, CAST(greatest(1, least(99, round_even(cosine * 100, 0))) AS INT) AS score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY cosine DESC, term_ord) AS rank FROM ({_COS})) WHERE rank <= 8")
def rank_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R31, R32"""
    out = G.rank_semantic(*_vectors(spark, sf_dir))
    return out.select("rule_id", "entity_id", F.round("cosine", 6).alias("cosine"), "score", "rank")


@query("rank_semantic_classes", f"SELECT rule_id, 't' || term_ord AS entity_id, CAST(greatest(1, least(99, round_even(cosine * 100, 0))) AS INT) AS score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY cosine DESC, term_ord) AS rank FROM ({_COS}) WHERE type = 'class') WHERE rank <= 10")
def rank_semantic_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R32 with allowed types"""
    q, v = _vectors(spark, sf_dir)
    return G.rank_semantic(q, v, ["class"], 10).select("rule_id", "entity_id", "score", "rank")


def _index_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of every tenth size name their terms."""
    p = table(spark, sf_dir, "part").where("p_size % 10 = 0")
    refs = F.array(F.lit("fx:partSize"), F.lit("Line Item"), F.lit("nothing such"))
    return p.select(F.concat(F.lit("R"), F.col("p_partkey").cast("string")).alias("number"), F.posexplode(refs).alias("pos", "ref"))


_INDEX = "idx AS (SELECT p_partkey AS rule_id, pos, target FROM part, (VALUES (0, 'fx:partSize'), (1, 'fx:LineItem')) v(pos, target) WHERE p_size % 10 = 0)"


@query("resolve_index_targets", f"WITH {_INDEX} SELECT rule_id, CAST(pos + 1 AS INT) AS rank, target, CAST(1 AS DOUBLE) AS score FROM idx")
def index_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R41, H43"""
    return G.index_candidates(rules(spark, sf_dir), X.terms(spark), _index_map(spark, sf_dir)).select("rule_id", "rank", "target", "score")


def _semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ranker's scores, 0 to 100, for two properties and a class, by the rule's number."""
    r = rules(spark, sf_dir)
    score = lambda k: (F.col("rule_id") * k % 60 + 40).cast("int")
    items = [("fx:partSize", 7), ("fx:Part", 11), ("fx:orderDate", 13)]
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("key"), score(k).alias("score"), F.lit(n).alias("rank")) for n, (i, k) in enumerate(items)]))
    found = r.select("rule_id", rows.alias("x")).select("rule_id", "x.*", F.array(F.lit("ranker")).alias("reasons"))
    return G.coerce_ranked(found, X.terms(spark))


_RANKED = """sem AS (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY score DESC, seen) AS rank FROM (
  SELECT rule_id, target, n AS seen, round((rule_id * k % 60 + 40) / 100.0::DOUBLE, 3) AS score FROM rules, (VALUES ('fx:partSize', 7, 0), ('fx:Part', 11, 1), ('fx:orderDate', 13, 2)) v(target, k, n)))"""
_SEMANTIC = f"""{_RANKED}, top AS (SELECT rule_id, target AS t0, score AS s0 FROM sem WHERE rank = 1),
near AS (SELECT rule_id, target, s0, row_number() OVER (PARTITION BY rule_id ORDER BY rank) AS pos FROM sem JOIN top USING (rule_id)
  WHERE s0 >= 0.6 AND (rank = 1 OR (score >= greatest(0.6::DOUBLE, s0 - 0.16::DOUBLE) AND list_sort([t0, target]) = ['fx:Part', 'fx:partSize'])))"""


@query("resolve_ranked_candidates", f"WITH {X.RULES_SQL}, {_RANKED} SELECT rule_id, target, score, CAST(rank AS INT) AS rank FROM sem")
def ranked_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R42, R43"""
    return _semantic(spark, sf_dir).select("rule_id", "target", "score", "rank")


@query("resolve_semantic_targets", f"WITH {X.RULES_SQL}, {_SEMANTIC} SELECT rule_id, CAST(pos AS INT) AS pos, target FROM near")
def semantic_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R45, R46"""
    return G.semantic_targets(_semantic(spark, sf_dir), X.terms(spark)).select("rule_id", "pos", "target")


_CASCADE = f"""{_INDEX}, {_SEMANTIC}, tops AS (SELECT rule_id, max(score) AS best FROM label GROUP BY rule_id),
o1 AS (SELECT rule_id, 'index' AS resolved_by, CAST(1 AS DOUBLE) AS confidence, list(target ORDER BY pos) AS targets FROM idx GROUP BY rule_id),
lt AS (SELECT rule_id, list(target ORDER BY pos) AS targets FROM picked GROUP BY rule_id),
o2 AS (SELECT rule_id, 'label' AS resolved_by, best AS confidence, targets FROM lt JOIN tops USING (rule_id) WHERE best >= 0.86 AND rule_id NOT IN (SELECT rule_id FROM o1)),
o3 AS (SELECT rule_id, 'semantic' AS resolved_by, any_value(s0) AS confidence, list(target ORDER BY pos) AS targets FROM near
  WHERE rule_id NOT IN (SELECT rule_id FROM o1 UNION ALL SELECT rule_id FROM o2) GROUP BY rule_id),
o4 AS (SELECT rule_id, 'label' AS resolved_by, best AS confidence, targets FROM lt JOIN tops USING (rule_id) WHERE best >= 0.68 AND best < 0.86
  AND rule_id NOT IN (SELECT rule_id FROM o1 UNION ALL SELECT rule_id FROM o2 UNION ALL SELECT rule_id FROM o3)),
won AS (SELECT * FROM o1 UNION ALL SELECT * FROM o2 UNION ALL SELECT * FROM o3 UNION ALL SELECT * FROM o4),
resolved AS (SELECT rule_id, coalesce(resolved_by, 'none') AS resolved_by, confidence, coalesce(targets, []) AS targets FROM rules LEFT JOIN won USING (rule_id))"""


def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.resolve(rules(spark, sf_dir), X.terms(spark), _index_map(spark, sf_dir), _semantic(spark, sf_dir))


@query("resolve_cascade", f"{_WITH}, {PICKED}, {_CASCADE} SELECT rule_id, resolved_by, CASE resolved_by WHEN 'index' THEN 'explicit' WHEN 'label' THEN 'lexical' WHEN 'semantic' THEN 'semantic_similarity' ELSE 'none' END AS score_kind, confidence, array_to_string(targets, ' ') AS targets FROM resolved")
def cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R49, R59"""
    return resolved(spark, sf_dir).select("rule_id", "resolved_by", V.score_kind("resolved_by").alias("score_kind"), "confidence", F.array_join("targets", " ").alias("targets"))


@query("resolve_summary", f"{_WITH}, {PICKED}, {_CASCADE} SELECT count(*) AS total, count_if(resolved_by = 'index') AS \"index\", count_if(resolved_by = 'label') AS label, count_if(resolved_by = 'semantic') AS semantic, count_if(resolved_by = 'llm') AS llm, count_if(resolved_by = 'none') AS \"none\", count_if(resolved_by IN ('index', 'label', 'semantic')) AS without_llm, count_if(resolved_by IN ('label', 'semantic')) AS without_llm_excluding_index FROM resolved")
def resolve_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R52"""
    return G.summary(resolved(spark, sf_dir))


_ROLES = f"""{_CASCADE}, asked AS (SELECT rule_id, unnest(targets) AS target, unnest(range(len(targets))) AS pos FROM resolved),
det AS (SELECT a.rule_id, a.pos, t.* FROM asked a JOIN terms t ON t.iri = a.target),
sides AS (SELECT rule_id, list("domain") FILTER (type = 'property') AS ds, list("range") FILTER (type = 'property') AS rs, flatten(list(superclasses) FILTER (type = 'class')) AS sc FROM det GROUP BY rule_id),
roles AS (SELECT rule_id, pos, iri, CASE WHEN type = 'property' THEN 'path' WHEN list_contains(coalesce(sc, []), iri) THEN 'related' WHEN list_contains(coalesce(ds, []), iri) THEN 'focus' WHEN list_contains(coalesce(rs, []), iri) THEN 'related' ELSE 'focus' END AS role
  FROM det JOIN sides USING (rule_id)),
added AS (SELECT DISTINCT s.rule_id, t.ord, t.iri FROM sides s, terms t WHERE t.type = 'class' AND list_contains(coalesce(s.ds, []), t.iri) AND NOT EXISTS (SELECT 1 FROM roles r WHERE r.rule_id = s.rule_id AND r.iri = t.iri)),
every AS (SELECT rule_id, iri, role, pos AS place FROM roles UNION ALL SELECT rule_id, iri, 'focus', 1000000 + ord FROM added),
grouped AS (SELECT rule_id, array_to_string(list(iri ORDER BY place) FILTER (role = 'focus'), ' ') AS focus_nodes, array_to_string(list(iri ORDER BY place) FILTER (role = 'path'), ' ') AS constraint_paths, array_to_string(list(iri ORDER BY place) FILTER (role = 'related'), ' ') AS related_terms FROM every GROUP BY rule_id)"""


@query("roles_of_targets", f"{_WITH}, {PICKED}, {_ROLES} SELECT rule_id, coalesce(focus_nodes, '') AS focus_nodes, coalesce(constraint_paths, '') AS constraint_paths, coalesce(related_terms, '') AS related_terms FROM grouped")
def roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R50"""
    out = G.classify_roles(resolved(spark, sf_dir), X.terms(spark))
    return out.select("rule_id", *[F.array_join(c, " ").alias(c) for c in ("focus_nodes", "constraint_paths", "related_terms")])


@query("roles_primary_term", f"{_WITH}, {PICKED}, {_ROLES} SELECT rule_id, coalesce(nullif(split_part(coalesce(focus_nodes, ''), ' ', 1), ''), nullif(split_part(coalesce(constraint_paths, ''), ' ', 1), ''), nullif(split_part(coalesce(related_terms, ''), ' ', 1), '')) AS primary_term FROM grouped")
def primary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R54"""
    out = G.classify_roles(resolved(spark, sf_dir), X.terms(spark))
    return out.select("rule_id", G.primary_term("focus_nodes", "constraint_paths", "related_terms").alias("primary_term"))


@query("resolve_target_details", f"{_WITH}, {PICKED}, {_CASCADE}, asked AS (SELECT rule_id, unnest(targets) AS target, unnest(range(len(targets))) AS pos FROM resolved) SELECT a.rule_id, CAST(a.pos AS INT) AS pos, a.target, t.type, t.kind, t.label, t.iri IS NULL AS missing FROM asked a LEFT JOIN terms t ON t.iri = a.target")
def details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R51, R53"""
    return G.target_details(resolved(spark, sf_dir), X.terms(spark))


_POOL = f"""sel AS (SELECT rule_id, target FROM rules, (VALUES ('fx:Nation'), ('fx:Customer')) v(target) WHERE rule_id % 4 = 0),
lexn AS (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY score DESC, term_ord) AS rank FROM lex),
broad AS (SELECT rule_id, t.iri AS target, 0.01::DOUBLE AS score, 3 AS source, t.n AS place FROM rules, (SELECT iri, row_number() OVER (ORDER BY type, label, ord) AS n FROM terms) t WHERE t.n <= 25),
pool0 AS (SELECT rule_id, target, score, 0 AS source, rank AS place FROM label UNION ALL SELECT l.rule_id, t.iri, l.score / 100.0::DOUBLE, 2, l.rank FROM lexn l JOIN terms t ON t.ord = l.term_ord WHERE rank <= 25 UNION ALL SELECT * FROM broad),
pool1 AS (SELECT rule_id, target, arg_min(score, source * 1000 + place) AS score, min(source * 1000 + place) AS o FROM pool0 GROUP BY rule_id, target),
pool AS (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY o) AS rank FROM pool1)"""


@query("resolve_choice_pool", f"{_WITH}, {_LEXICAL}, {_POOL} SELECT rule_id, target, round(score, 3) AS score, CAST(rank AS INT) AS rank FROM pool WHERE rank <= 25")
def choice_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R47"""
    r, t = rules(spark, sf_dir), X.terms(spark)
    label = G.label_candidates(r, t)
    return G.choice_pool(r, t, label, label.limit(0)).select("rule_id", "target", F.round("score", 3).alias("score"), "rank")


@query("resolve_choice", f"{_WITH}, {_LEXICAL}, {_POOL} SELECT rule_id, target, round(greatest(0.75::DOUBLE, score), 3) AS score, CAST(row_number() OVER (PARTITION BY rule_id ORDER BY rank) AS INT) AS rank FROM (SELECT * FROM pool WHERE rank <= 25) JOIN sel USING (rule_id, target)")
def choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R48"""
    r, t = rules(spark, sf_dir), X.terms(spark)
    label = G.label_candidates(r, t)
    selection = r.where("rule_id % 4 = 0").select("rule_id", F.explode(F.array(F.lit("fx:Nation"), F.lit("fx:Customer"))).alias("target"))
    return G.chosen(G.choice_pool(r, t, label, label.limit(0)), selection).select("rule_id", "target", F.round("score", 3).alias("score"), "rank")
