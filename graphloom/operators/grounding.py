"""Grounding rules in an ontology's terms: candidates by label, vector and choice, the cascade, and roles.

Tables: terms (ord, id, type, label, iri, full_iri, kind, domain, range, superclasses, comment, note) and
rules (rule_id, number, title, text). Rules may be many, terms are a catalog. Candidate pairs come from
an equality join on stemmed tokens, or on runs of three characters, never from all pairs: a phrase that a
rule holds shares all of its tokens with the rule. Vectors meet in blocks. The catalog is written before it is
joined, so that the planner knows its size and broadcasts it where it is small; rows by rule are never broadcast,
however small their files are: where two such tables meet, a hint asks for a sort-merge join.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.functions import values as V
from graphloom.operators import graph as G

# fixed values: thresholds and widths of the cascade
LABEL, STRONG_LABEL, SEMANTIC = 0.68, 0.86, 0.60
LABEL_MARGIN, SEMANTIC_MARGIN = 0.22, 0.16
MAX_TARGETS, MAX_SEMANTIC_TARGETS, TOP_K, LEXICAL_TOP_K = 8, 4, 10, 8
MAX_TOP_K, MAX_SEMANTIC_LIMIT = 50, 20
#: Rows of a side that is broadcast to rows by rule; more of them are shuffled.
BROADCAST_ROWS = 100_000
#: Queries and vectors of a block.
QUERY_BLOCK, VECTOR_BLOCK = 1024, 4096

TERM_FIELDS = ["id", "type", "label", "iri", "full_iri", "kind", "domain", "range", "superclasses", "comment", "note"]


def check_params(label: float = LABEL, strong: float = STRONG_LABEL, semantic: float = SEMANTIC, margin: float = SEMANTIC_MARGIN) -> None:
    """V09. A margin is below its threshold, and a strong label no weaker than a label."""
    if not margin < semantic:
        raise ValueError("the semantic margin must be below the semantic threshold")
    if strong < label:
        raise ValueError("the strong label threshold must not be below the label threshold")


def looked_up(df: DataFrame, tag: str) -> DataFrame:
    """df, written, for a join with rows by rule: it is broadcast if it is small, and never the other side."""
    out = G.shared(df, tag)
    return F.broadcast(out) if out.count() <= BROADCAST_ROWS else out.hint("merge")


def target(c: str = "") -> Column:
    return F.coalesce(V.term_target(f"{c}iri", f"{c}full_iri", f"{c}id"), F.lit(""))


def aliases(terms: DataFrame) -> DataFrame:
    """R34. (term_ord, pos, source, alias_norm, alias_tokens, type): a term's label, its other local name, and both without a leading relation word."""
    local = T.local_name(F.coalesce(T.filled("iri"), T.filled("full_iri"), F.lit("")))
    label = F.trim(T.text("label"))
    plain = F.array(
        F.when(label != "", F.struct(label.alias("alias"), F.lit("label").alias("source"))),
        F.when((local != "") & (T.normalise(local) != T.normalise(label)), F.struct(T.split_camel(local).alias("alias"), F.lit("local-name").alias("source"))),
    )
    plain = F.filter(plain, lambda a: a.isNotNull())
    words = lambda a: T.tokens(a["alias"], keep_stopwords=True)
    cut = F.filter(plain, lambda a: (F.size(words(a)) >= 3) & F.try_element_at(words(a), F.lit(1)).isin(T.RELATION_WORDS))
    cut = F.transform(cut, lambda a: F.struct(F.array_join(F.slice(words(a), 2, 1 << 20), " ").alias("alias"), F.concat(a["source"], F.lit("-without-leading-relation")).alias("source")))
    out = terms.select(F.col("ord").alias("term_ord"), "type", F.posexplode(F.concat(plain, cut)).alias("pos", "a"))
    out = out.select("term_ord", "type", "pos", "a.source", T.normalise("a.alias").alias("alias_norm"), T.tokens("a.alias").alias("alias_tokens"))
    return out.where((F.col("alias_norm") != "") & (F.size("alias_tokens") > 0))


def prepared(rules: DataFrame) -> DataFrame:
    """Rules with their normalised texts and distinct tokens; evidence() writes them, so that each is computed once."""
    whole = F.concat(T.text("title"), F.lit("\n"), T.text("text"))
    # a file of few megabytes holds a million rules, and would be one task
    return rules.select("rule_id", "title", "text").repartition("rule_id").select(
        "rule_id",
        T.normalise("title").alias("title_norm"),
        T.normalise("text").alias("body_norm"),
        T.normalise(whole).alias("norm"),
        F.array_distinct(T.tokens(whole)).alias("rule_tokens"),
        F.array_distinct(T.tokens("title")).alias("title_tokens"),
        F.array_distinct(T.tokens("text")).alias("body_tokens"),
    )


def phrase_score(n_tokens: Column, source: Column, type_: Column) -> Column:
    """R35."""
    base = 0.78 + F.least(F.lit(0.16), 0.04 * n_tokens) + F.when(source == "label", 0.03).otherwise(0.0) + F.when(type_ == "property", 0.02).otherwise(0.0)
    return F.least(F.lit(0.98), base)


def overlap_score(ratio: Column, type_: Column) -> Column:
    """R36."""
    return F.least(F.lit(0.85), 0.62 + F.least(F.lit(0.18), 0.12 * ratio) + F.when(type_ == "property", 0.03).otherwise(0.0))


def note_score(n_shared: Column, type_: Column) -> Column:
    """R37."""
    return F.least(F.lit(0.78), 0.54 + 0.05 * n_shared) + F.when(type_ == "property", 0.04).otherwise(0.0)


def within(part: Column, whole: Column) -> Column:
    """A non-empty set that another holds."""
    return (F.size(part) > 0) & (F.size(F.array_except(part, whole)) == 0)


def evidence(rules: DataFrame, terms: DataFrame) -> DataFrame:
    """R35-R38. (rule_id, term_ord, step, score, reason): each alias's and each note's evidence, step in catalog order."""
    ready = G.shared(prepared(rules), "ready")
    of_rule = ready.hint("merge")
    rule_words = ready.select("rule_id", F.explode("rule_tokens").alias("tok"))
    named = G.shared(aliases(terms), "aliases")
    alias_words = named.select("term_ord", "pos", F.explode(F.array_distinct("alias_tokens")).alias("tok"))
    shared = rule_words.join(alias_words, "tok").groupBy("rule_id", "term_ord", "pos").agg(F.array_sort(F.collect_list("tok")).alias("overlap"))
    ratio = F.size("overlap") / F.size(F.array_distinct("alias_tokens"))
    overlaps = (F.size("alias_tokens") >= 2) & (ratio >= 0.67)
    # a phrase that a rule holds shares all its tokens: texts are joined to what may be evidence alone
    shared = shared.join(named, ["term_ord", "pos"]).where(overlaps | (ratio == 1)).join(of_rule, "rule_id")
    phrase = T.contains_phrase("norm", "alias_norm")
    by_alias = shared.where(phrase | overlaps).select(
        "rule_id",
        "term_ord",
        (F.col("term_ord") * 8 + F.col("pos")).cast("bigint").alias("step"),
        F.when(phrase, phrase_score(F.size("alias_tokens"), F.col("source"), F.col("type"))).otherwise(overlap_score(ratio, F.col("type"))).alias("score"),
        F.when(phrase, F.concat(F.lit("exact "), "source", F.lit(" phrase in "), T.match_location("alias_norm", "title_norm", "body_norm"), F.lit(": "), "alias_norm"))
        .otherwise(F.concat("source", F.lit(" token overlap in "), T.overlap_location("overlap", "title_tokens", "body_tokens"), F.lit(": "), F.array_join("overlap", ", ")))
        .alias("reason"),
    )
    noted = terms.select(
        F.col("ord").alias("term_ord"),
        "type",
        F.array_distinct(T.tokens(F.concat_ws(" ", T.text("label"), T.text("note"), T.text("comment")))).alias("note_tokens"),
        T.side_tokens("domain").alias("domain_tokens"),
        T.side_tokens("range").alias("range_tokens"),
    )
    noted = G.shared(noted, "noted")
    note_words = noted.select("term_ord", F.explode("note_tokens").alias("tok"))
    shared = rule_words.join(note_words, "tok").groupBy("rule_id", "term_ord").agg(F.array_sort(F.collect_list("tok")).alias("overlap")).where(F.size("overlap") >= 2)
    shared = shared.join(noted, "term_ord").join(of_rule, "rule_id")
    mentioned = within(F.col("domain_tokens"), F.col("rule_tokens")) & within(F.col("range_tokens"), F.col("rule_tokens"))
    by_note = shared.where((F.col("type") != "property") | mentioned).select(
        "rule_id",
        "term_ord",
        (F.lit(1 << 40) + F.col("term_ord")).cast("bigint").alias("step"),
        note_score(F.size("overlap"), F.col("type")).alias("score"),
        F.concat(F.lit("ontology note/comment overlap in "), T.overlap_location("overlap", "title_tokens", "body_tokens"), F.lit(": "), F.array_join(F.slice("overlap", 1, 5), ", ")).alias("reason"),
    )
    return by_alias.unionByName(by_note)


def merged(found: DataFrame, terms: DataFrame) -> DataFrame:
    """R39. Candidates per rule and target: a higher score replaces, an equal or lower one adds its reason."""
    of = terms.select(F.col("ord").alias("term_ord"), target().alias("target")).where("target <> ''")
    steps = found.join(of, "term_ord").groupBy("rule_id", "target").agg(F.array_sort(F.collect_list(F.struct("step", "score", "reason", "term_ord"))).alias("steps"))
    start = F.struct(F.lit(None).cast("double").alias("score"), F.array().cast("array<string>").alias("reasons"), F.lit(None).cast("bigint").alias("term_ord"))

    def fold(acc: Column, s: Column) -> Column:
        fresh = F.struct(F.bround(s["score"], 3).alias("score"), F.array(s["reason"]).alias("reasons"), s["term_ord"].cast("bigint").alias("term_ord"))
        more = F.struct(acc["score"].alias("score"), F.array_distinct(F.concat(acc["reasons"], F.array(s["reason"]))).alias("reasons"), acc["term_ord"].alias("term_ord"))
        return F.when(acc["score"].isNull() | (s["score"] > acc["score"]), fresh).otherwise(more)

    best = F.aggregate("steps", start, fold)
    return steps.select("rule_id", "target", F.element_at("steps", 1)["step"].alias("seen"), best.alias("b")).select("rule_id", "target", "seen", "b.score", "b.reasons", "b.term_ord")


def ranked(candidates: DataFrame) -> DataFrame:
    """Candidates with their rank within a rule: the best first, then the first seen."""
    return candidates.withColumn("rank", F.row_number().over(W.partitionBy("rule_id").orderBy(F.desc("score"), "seen")))


def label_candidates(rules: DataFrame, terms: DataFrame) -> DataFrame:
    """R40. (rule_id, target, seen, score, reasons, term_ord, rank)."""
    terms = G.shared(terms, "terms")
    return ranked(merged(evidence(rules, terms), terms))


def label_targets(candidates: DataFrame, threshold: float = LABEL, max_targets: int = MAX_TARGETS, margin: float = LABEL_MARGIN) -> DataFrame:
    """R44. Of ranked candidates those within margin of the best and at threshold, at most max_targets a rule."""
    best = F.max("score").over(W.partitionBy("rule_id"))
    # the difference is taken to a few digits, so that a candidate on the edge is one for any order of summing
    kept = candidates.withColumn("best", best).where(F.col("score") >= F.greatest(F.lit(threshold), F.col("best") - margin)).drop("best")
    return kept.withColumn("pos", F.row_number().over(W.partitionBy("rule_id").orderBy("rank"))).where(F.col("pos") <= max_targets)


def rank_lexical(rules: DataFrame, terms: DataFrame, allowed_types: list[str] | None = None, top_k: int = LEXICAL_TOP_K) -> DataFrame:
    """R30. (rule_id, entity_id, term_ord, score, rank): tokens found anywhere in a term's text, repeats counting again.

    A token need only be part of a word: it is looked up by the rarest of its runs of three characters among
    those of all terms' texts, each distinct token once, and what is found is verified. Terms that a rule's
    wording alone speaks for are alike but for their order, so that the first top_k of their type are enough.
    """
    rule = T.text("rule")
    r = rules.select("rule_id", F.concat(T.text("title"), F.lit("\n"), T.text("text")).alias("rule")).repartition("rule_id")
    r = r.select("rule_id", T.lexical_tokens("rule").alias("toks"), rule.rlike("(?i)required|mandatory|exactly|format|greater|less|one of").alias("asks"), rule.rlike("(?i)record|instance|class|closed").alias("about"))
    r = G.shared(r, "tokens")
    t = terms if not allowed_types else terms.where(F.col("type").isin(allowed_types))
    hay = F.lower(F.concat_ws(" ", *[T.text(c) for c in ("label", "iri", "kind", "type", "domain", "range", "note")]))
    t = G.shared(t.select(F.col("ord").alias("term_ord"), F.col("id").alias("entity_id"), "type", hay.alias("hay"), F.lower(T.text("label")).alias("low")), "texts")
    hits = looked_up(token_hits(r.select(F.explode("toks").alias("tok")).distinct(), t), "hits")
    said = r.select("rule_id", "asks", "about", F.explode("toks").alias("tok")).groupBy("rule_id", "asks", "about", "tok").agg(F.count("*").alias("times"))
    of = ["rule_id", "asks", "about", "term_ord", "entity_id", "type"]
    found = said.join(hits, "tok").groupBy(*of).agg(F.sum(F.col("times") * F.when(F.col("named"), 20).otherwise(8)).alias("points"), F.array_sort(F.collect_set("tok")).alias("matched"))
    first = t.withColumn("nr", F.row_number().over(W.partitionBy("type").orderBy("term_ord"))).where(F.col("nr") <= top_k).select("term_ord", "entity_id", "type")
    first = looked_up(first, "first")
    spoken = r.select("rule_id", "asks", "about", F.explode(F.array(F.when(F.col("asks"), "property"), F.when(F.col("about"), "class"))).alias("type")).join(first, "type")
    spoken = spoken.join(found.select("rule_id", "term_ord").hint("merge"), ["rule_id", "term_ord"], "left_anti").select(*of, F.lit(0).cast("bigint").alias("points"), F.array().cast("array<string>").alias("matched"))
    raw = F.col("points") + F.when((F.col("type") == "property") & F.col("asks"), 7).otherwise(0) + F.when((F.col("type") == "class") & F.col("about"), 5).otherwise(0)
    reasons = F.array(F.lit("lexical match"), F.when(F.size("matched") > 0, F.concat(F.lit("matched: "), F.array_join(F.slice("matched", 1, 4), ", "))).otherwise("rule signal"))
    out = found.unionByName(spoken).select("rule_id", "term_ord", "entity_id", F.least(F.lit(99), raw.cast("int")).alias("score"), reasons.alias("reasons"))
    return out.withColumn("rank", F.row_number().over(W.partitionBy("rule_id").orderBy(F.desc("score"), "term_ord"))).where(F.col("rank") <= top_k)


def token_hits(tokens: DataFrame, texts: DataFrame) -> DataFrame:
    """(tok, term_ord, entity_id, type, named): the texts (term_ord, entity_id, type, hay, low) that hold a token (tok) of three characters or more.

    named: whether low holds it too. Of a token's runs of three characters the one that the fewest texts have
    leads to the texts that are looked at.
    """
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.substr(F.col(c), i, F.lit(3))))
    posted = texts.where(F.length("hay") > 2).select("term_ord", F.explode(grams("hay")).alias("gram"))
    asked = tokens.where(F.length("tok") > 2).select("tok", F.explode(grams("tok")).alias("gram"))
    wanted = asked.select("gram").distinct()
    often = G.shared(posted.join(wanted, "gram", "left_semi"), "postings")
    counts = often.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = asked.join(counts, "gram", "left").groupBy("tok").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    near = rarest.join(often, "gram").select("tok", "term_ord").join(texts, "term_ord")
    return near.where(F.contains("hay", "tok")).select("tok", "term_ord", "entity_id", "type", F.contains("low", "tok").alias("named"))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """R31. In double precision; zero if either vector is zero."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    n = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.when(n == 0, 0.0).otherwise(dot / n)


def rank_semantic(queries: DataFrame, vectors: DataFrame, allowed_types: list[str] | None = None, top_k: int = LEXICAL_TOP_K) -> DataFrame:
    """R32. (rule_id, entity_id, term_ord, cosine, score, rank) of queries (rule_id, vec) against vectors (term_ord, entity_id, type, vec).

    Exact: both sides are dealt into blocks, each block of queries meets each block of vectors, and a pair
    of blocks gives top_k a query, which are merged. A matrix product finds what can be among them; their
    cosines are then summed in the order of dimensions, so that equal vectors tie. Rows without a vector
    aren't ranked; vectors of several lengths are an error.
    """
    v = vectors if not allowed_types else vectors.where(F.col("type").isin(allowed_types))
    held = lambda df: df.where("vec is not null and size(vec) > 0 and not exists(vec, x -> x is null)")
    q = G.shared(held(queries).select("rule_id", F.col("vec").cast("array<double>").alias("vec")), "queries")
    v = G.shared(held(v).select("term_ord", "entity_id", F.col("vec").cast("array<double>").alias("vec")), "vectors")
    of = lambda n, most: max(1, -(-n // most))
    nq, nv = of(q.count(), QUERY_BLOCK), of(v.count(), VECTOR_BLOCK)
    qb = q.groupBy(F.pmod(F.xxhash64("rule_id"), F.lit(nq)).alias("qb")).agg(F.collect_list(F.struct("rule_id", "vec")).alias("x")).select("qb", F.col("x.rule_id").alias("rules"), F.col("x.vec").alias("q"))
    vb = v.groupBy(F.pmod(F.xxhash64("term_ord"), F.lit(nv)).alias("vb")).agg(F.collect_list(F.struct("term_ord", "entity_id", "vec")).alias("x")).select("vb", F.col("x.term_ord").alias("ords"), F.col("x.entity_id").alias("entities"), F.col("x.vec").alias("v"))
    pairs = qb.withColumn("vb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(nv - 1).cast("bigint")))).join(vb, "vb").select("rules", "q", "ords", "entities", "v")
    rule_type, ord_type = (df.schema[c].dataType.simpleString() for df, c in ((q, "rule_id"), (v, "term_ord")))
    best = pairs.mapInArrow(_best_pairs(top_k), f"rule_id {rule_type}, term_ord {ord_type}, entity_id string, cosine double")
    out = best.withColumn("rank", F.row_number().over(W.partitionBy("rule_id").orderBy(F.desc("cosine"), "term_ord"))).where(F.col("rank") <= top_k)
    return out.withColumn("score", F.greatest(F.lit(1), F.least(F.lit(99), F.bround(F.col("cosine") * 100).cast("int"))))


def _best_pairs(top_k: int):
    """For mapInArrow: of each pair of blocks (rules, q, ords, entities, v) the top_k vectors of each query, by cosine and then by order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = lambda c: np.stack([np.asarray(x.values) for x in c])
        fold = lambda a, b: reduce(lambda s, d: s + a[:, d] * b[:, d], range(a.shape[1]), np.zeros(len(a)))
        for batch in batches:
            for rules, q, ords, entities, v in zip(*batch.columns, strict=True):
                a, b = matrix(q), matrix(v)
                na, nb = np.sqrt(fold(a, a)), np.sqrt(fold(b, b))
                scale = na[:, None] * nb[None]
                near = np.where(scale > 0, a @ b.T / np.where(scale > 0, scale, 1), 0.0)
                if near.shape[1] > top_k:
                    least = np.partition(near, -top_k, axis=1)[:, -top_k]
                    rows, at = np.nonzero(near >= least[:, None] - 1e-9)
                else:
                    rows, at = (x.ravel() for x in np.indices(near.shape))
                n = na[rows] * nb[at]
                exact = np.where(n > 0, fold(a[rows], b[at]) / np.where(n > 0, n, 1), 0.0)
                number = np.asarray(ords.values)[at]
                order = np.lexsort((number, -exact, rows))
                place = np.arange(len(order)) - np.searchsorted(rows[order], rows[order], "left")
                keep = order[place < top_k]
                yield pa.RecordBatch.from_arrays([rules.values.take(pa.array(rows[keep])), ords.values.take(pa.array(at[keep])), entities.values.take(pa.array(at[keep])), pa.array(exact[keep])], ["rule_id", "term_ord", "entity_id", "cosine"])

    return run


def coerce_ranked(found: DataFrame, terms: DataFrame, compat: bool = False) -> DataFrame:
    """R42. Ranked items (rule_id, key, score, reasons) as candidates of known terms; scores of 0-100 become 0-1.

    compat: a score of exactly 1 stays 1 on a 0-100 scale too, as where only scores over 1 are divided.
    """
    score = F.when(F.col("score") > 1.0, F.col("score") / 100.0).otherwise(F.col("score").cast("double"))
    score = score if compat else F.col("score") / 100.0
    terms = G.shared(terms, "terms")
    known = looked_up(lookup(terms), "names")
    out = found.join(known, found["key"] == known["ref"]).select("rule_id", "term_ord", F.bround(score, 3).alias("score"), "reasons", F.col("rank").cast("bigint").alias("seen"))
    of = terms.select(F.col("ord").alias("term_ord"), target().alias("target"))
    return ranked(out.join(of, "term_ord").where("target <> ''"))


def lookup(terms: DataFrame, names: tuple[str, ...] = ("id", "iri", "full_iri", "label")) -> DataFrame:
    """H43. (ref, term_ord): each name of each term; the last term of a name has it."""
    return terms.select("ord", F.explode(V.term_refs(*names)).alias("ref")).groupBy("ref").agg(F.max("ord").alias("term_ord"))


def related(a: Column, b: Column) -> Column:
    """R46. A property's domain or range names the class; either may be the property."""

    def names(p: Column, c: Column) -> Column:
        refs = F.filter(F.array(V.target_ref(c["target"]), V.target_ref(c["full_iri"]), V.target_ref(c["label"])), lambda x: x.isNotNull())
        side = lambda x: F.coalesce(F.array_contains(refs, V.target_ref(x)), F.lit(False))
        return (p["type"] == "property") & (c["type"] == "class") & (side(p["domain"]) | side(p["range"]))

    return F.coalesce(names(a, b) | names(b, a), F.lit(False))


def semantic_targets(candidates: DataFrame, terms: DataFrame, threshold: float = SEMANTIC, max_targets: int = MAX_SEMANTIC_TARGETS, margin: float = SEMANTIC_MARGIN) -> DataFrame:
    """R45. The best candidate, and those within margin that a domain or range ties to it."""
    terms = G.shared(terms, "terms")
    detail = terms.select(F.col("ord").alias("term_ord"), F.struct(target().alias("target"), *[F.col(c) for c in ("type", "full_iri", "label", "domain", "range")]).alias("d"))
    c = candidates.join(detail, "term_ord")
    w = W.partitionBy("rule_id").orderBy("rank")
    c = c.withColumn("first", F.first("d").over(w)).withColumn("best", F.first("score").over(w))
    kept = c.where((F.col("best") >= threshold) & ((F.col("rank") == 1) | (F.col("score") >= F.greatest(F.lit(threshold), F.col("best") - margin)) & related(F.col("first"), F.col("d"))))
    return kept.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= max_targets).drop("d", "first", "best")


def index_candidates(rules: DataFrame, terms: DataFrame, index_map: DataFrame) -> DataFrame:
    """R41. Terms that index_map (number, pos, ref) names for a rule's number, with score 1."""
    terms = G.shared(terms, "terms")
    known = looked_up(lookup(terms), "names")
    asked = rules.where(T.text("number") != "").select("rule_id", "number").join(index_map.hint("merge"), "number").select("rule_id", "pos", "ref")
    of = terms.select(F.col("ord").alias("term_ord"), target().alias("target"))
    out = asked.join(known, "ref").join(of, "term_ord")
    return out.select("rule_id", "target", F.col("pos").cast("bigint").alias("seen"), F.lit(1.0).alias("score"), F.array(F.lit("explicit index_map")).alias("reasons"), "term_ord", F.row_number().over(W.partitionBy("rule_id").orderBy("pos")).alias("rank"))


def choice_pool(rules: DataFrame, terms: DataFrame, label: DataFrame, semantic: DataFrame, top_k: int = TOP_K) -> DataFrame:
    """R47. What a model may choose from: label, vector and lexical candidates, then the catalog, each target once."""
    limit = max(top_k, 25)
    terms = G.shared(terms, "terms")
    pick = lambda d, source: d.select("rule_id", "target", "score", "reasons", "term_ord", F.lit(source).alias("source"), F.col("rank").alias("at"))
    words = rank_lexical(rules, terms, None, limit)
    of = terms.select(F.col("ord").alias("term_ord"), target().alias("target")).where("target <> ''")
    words = words.join(of, "term_ord").withColumn("score", F.bround(F.col("score") / 100.0, 3))
    # the first of the catalog, a bounded number of rows: for every rule
    by = [T.text("type"), T.text("label"), F.col("ord")]
    broad = terms.orderBy(*by).limit(limit).select(F.col("ord").alias("term_ord"), target().alias("target"), F.row_number().over(W.orderBy(*by)).alias("rank")).where("target <> ''")
    broad = rules.select("rule_id").crossJoin(F.broadcast(broad)).select("*", F.lit(0.01).alias("score"), F.array(F.lit("llm broad candidate pool")).alias("reasons"))
    pool = pick(label, 0).unionByName(pick(semantic, 1)).unionByName(pick(words, 2)).unionByName(pick(broad, 3))
    first = F.struct("source", "at", "score", "reasons", "term_ord")
    pool = pool.groupBy("rule_id", "target").agg(F.min_by(first, F.struct("source", "at")).alias("c")).select("rule_id", "target", "c.*")
    return pool.withColumn("rank", F.row_number().over(W.partitionBy("rule_id").orderBy("source", "at"))).where(F.col("rank") <= limit)


def chosen(pool: DataFrame, selection: DataFrame) -> DataFrame:
    """R48. Candidates of the pool that the selection (rule_id, target) names, in the pool's order, with a score of 0.75 at least."""
    out = pool.join(selection.select("rule_id", "target").distinct().hint("merge"), ["rule_id", "target"], "left_semi")
    out = out.select("rule_id", "target", F.col("rank").cast("bigint").alias("seen"), F.greatest(F.lit(0.75), "score").alias("score"), F.concat("reasons", F.array(F.lit("llm selected from allowed list"))).alias("reasons"), "term_ord")
    return out.withColumn("rank", F.row_number().over(W.partitionBy("rule_id").orderBy("seen")))


def resolve(
    rules: DataFrame,
    terms: DataFrame,
    index_map: DataFrame | None = None,
    semantic: DataFrame | None = None,
    selection: DataFrame | None = None,
    label_threshold: float = LABEL,
    strong_threshold: float = STRONG_LABEL,
    semantic_threshold: float = SEMANTIC,
    semantic_margin: float = SEMANTIC_MARGIN,
    semantic_max: int = MAX_SEMANTIC_TARGETS,
) -> DataFrame:
    """R49. (rule_id, resolved_by, confidence, targets): index, strong label, vector, choice, label, or none.

    semantic: ranked candidates, already coerced; selection: (rule_id, target) that a model chose of the
    pool. The costly signals come in as tables that hold what was asked for; each stage gives at most
    one outcome a rule, and the earliest stage's stays: label evidence is computed once for both of its
    stages, and one aggregation by rule takes the place of a chain of anti-joins.
    """
    check_params(label_threshold, strong_threshold, semantic_threshold, semantic_margin)

    def outcome(picked: DataFrame, stage: Column, by: str) -> DataFrame:
        order = F.array_sort(F.collect_list(F.struct("rank", "target")))
        return picked.withColumn("stage", stage).groupBy("rule_id", "stage").agg(F.lit(by).alias("resolved_by"), F.min_by("score", "rank").alias("confidence"), F.transform(order, lambda s: s["target"]).alias("targets"))

    label = label_candidates(rules, terms)
    best = F.max("score").over(W.partitionBy("rule_id"))
    picked = label_targets(label.withColumn("top", best), label_threshold).where(F.col("top") >= label_threshold)
    found = outcome(picked, F.when(F.col("top") >= strong_threshold, 1).otherwise(4), "label")
    if index_map is not None:
        found = found.unionByName(outcome(index_candidates(rules, terms, index_map), F.lit(0), "index"))
    if semantic is not None:
        found = found.unionByName(outcome(semantic_targets(semantic, terms, semantic_threshold, semantic_max, semantic_margin), F.lit(2), "semantic"))
    if selection is not None:
        near = semantic if semantic is not None else rules.sparkSession.createDataFrame([], "rule_id bigint, target string, score double, reasons array<string>, term_ord int, rank int")
        asked = rules.join(selection.select("rule_id").distinct().hint("merge"), "rule_id", "left_semi")
        found = found.unionByName(outcome(chosen(choice_pool(asked, terms, label, near), selection), F.lit(3), "llm"))
    first = found.groupBy("rule_id").agg(F.min_by(F.struct("resolved_by", "confidence", "targets"), "stage").alias("o"))
    out = rules.select("rule_id").join(first.hint("merge"), "rule_id", "left")
    return out.select("rule_id", F.coalesce("o.resolved_by", F.lit("none")).alias("resolved_by"), "o.confidence", F.coalesce("o.targets", F.array().cast("array<string>")).alias("targets"))


def classify_roles(resolved: DataFrame, terms: DataFrame) -> DataFrame:
    """R50, H37. (rule_id, focus_nodes, constraint_paths, related_terms) of resolved (rule_id, targets).

    Properties are paths. A class that another chosen class is a kind of is related; else a chosen
    property's domain is a focus, its range related, any other class a focus. Domains of chosen
    properties that are classes of the catalog join the focus, in catalog order; the rest is related.
    """
    terms = G.shared(terms, "terms")
    known = lookup(terms)
    fields = [F.col(c) for c in ("type", "domain", "range", "superclasses")]
    detail = terms.select(F.col("ord").alias("term_ord"), target().alias("own"), V.term_refs("id", "iri", "full_iri", "label").alias("refs"), *fields)
    asked = resolved.select("rule_id", F.posexplode("targets").alias("pos", "ref"))
    picked = asked.join(known, "ref", "left").join(detail, "term_ord", "left")
    side = lambda c: F.array_distinct(F.filter(F.collect_list(F.when((F.col("type") == "property") & ~T.text(c).isin("", "—"), F.col(c))), lambda x: x.isNotNull()))
    sides = picked.groupBy("rule_id").agg(
        side("domain").alias("domains"),
        side("range").alias("ranges"),
        F.array_distinct(F.flatten(F.collect_list(F.when(F.col("type") == "class", F.coalesce("superclasses", F.array().cast("array<string>")))))).alias("supers"),
    )
    p = picked.join(sides.hint("merge"), "rule_id")
    hit = lambda c: F.arrays_overlap("refs", c)
    role = F.when(F.col("term_ord").isNull(), "rest").when(F.col("type") == "property", "path")
    role = role.when(hit("supers"), "related").when(hit("domains"), "focus").when(hit("ranges"), "related").otherwise("focus")
    role = F.when(F.col("type").isNotNull() & ~F.col("type").isin("property", "class"), "rest").otherwise(role)
    own = p.select("rule_id", F.when(F.col("term_ord").isNull(), F.col("ref")).otherwise(F.col("own")).alias("target"), role.alias("role"), F.col("pos").cast("bigint").alias("at"))
    added = sides.select("rule_id", F.explode("domains").alias("ref")).join(known, "ref").join(detail.where("type = 'class'"), "term_ord")
    added = added.select("rule_id", F.col("own").alias("target"), F.lit("domain").alias("role"), (F.lit(1 << 20) + F.col("term_ord")).cast("bigint").alias("at"))
    every = own.unionByName(added).where("target <> ''")
    of = lambda *roles: F.array_distinct(F.transform(F.array_sort(F.filter("all", lambda s: s["role"].isin(*roles))), lambda s: s["target"]))
    rows = every.groupBy("rule_id").agg(F.collect_list(F.struct("at", "target", "role")).alias("all"))
    rows = rows.select("rule_id", of("focus").alias("focus"), of("path").alias("path"), of("related").alias("rel"), of("domain").alias("dom"), of("rest").alias("rest"))
    focus = F.array_distinct(F.concat("focus", F.array_except("dom", "rel")))
    rest = F.array_except(F.array_except(F.array_except("rest", focus), "path"), "rel")
    return rows.select("rule_id", focus.alias("focus_nodes"), F.col("path").alias("constraint_paths"), F.concat("rel", rest).alias("related_terms"))


def primary_term(focus: Column | str, paths: Column | str, rel: Column | str) -> Column:
    """R54. The first of the focus, then of the paths, then of the related terms."""
    return F.coalesce(*[F.try_element_at(T.col(c), F.lit(1)) for c in (focus, paths, rel)])


def target_details(resolved: DataFrame, terms: DataFrame) -> DataFrame:
    """R51, R53. (rule_id, pos, target, type, kind, label, missing) of each target."""
    terms = G.shared(terms, "terms")
    known = terms.select(target().alias("target"), "ord", "type", "kind", "label").groupBy("target").agg(F.min_by(F.struct("type", "kind", "label"), "ord").alias("d"))
    out = resolved.select("rule_id", F.posexplode("targets").alias("pos", "target")).join(known, "target", "left")
    return out.select("rule_id", "pos", "target", "d.type", "d.kind", "d.label", F.col("d").isNull().alias("missing"))


def summary(resolved: DataFrame) -> DataFrame:
    """R52. One row: how many rules each stage resolved."""
    n = lambda *by: F.count_if(F.col("resolved_by").isin(*by))
    stages = ("index", "label", "semantic", "llm", "none")
    return resolved.agg(F.count("*").alias("total"), *[n(s).alias(s) for s in stages], n("index", "label", "semantic").alias("without_llm"), n("label", "semantic").alias("without_llm_excluding_index"))


def pending_vectors(terms: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """R61. Terms that the index kept under key doesn't hold yet."""
    return terms.join(vectors.where(F.col("cache_key") == key).select(F.col("term_id").alias("id")), "id", "left_anti")


def embed_terms(terms: DataFrame, key: str, embed, batch: int = 8) -> DataFrame:
    """R60, G20, G21. term_vectors rows by an injected function of a list of texts, in batches, where the rows are."""

    def run(batches):
        import pandas as pd

        for b in batches:
            texts, vectors = b["text"].tolist(), []
            for at in range(0, len(texts), batch):
                vectors += [[float(x) for x in v] for v in embed(texts[at : at + batch])]
            yield pd.DataFrame({"cache_key": key, "term_id": b["id"], "vec": vectors})

    body = T.entity_text("label", "kind", "note", "type", "domain", "range")
    return terms.select("id", body.alias("text")).mapInPandas(run, "cache_key string, term_id string, vec array<double>")


def index_status(jobs: DataFrame, vectors: DataFrame, keys: DataFrame) -> DataFrame:
    """R62. (cache_key, status): ready if vectors are kept, else its latest job's status, else missing."""
    ready = vectors.select("cache_key").distinct().withColumn("ready", F.lit(True))
    last = jobs.groupBy("cache_key").agg(F.max_by("status", "seq").alias("job"))
    out = keys.select("cache_key").join(ready, "cache_key", "left").join(last, "cache_key", "left")
    return out.select("cache_key", F.when(F.col("ready"), "ready").otherwise(F.coalesce("job", F.lit("missing"))).alias("status"))


def cancelled(jobs: DataFrame, model: str | None = None, ontology_hash: str | None = None) -> DataFrame:
    """R63. The running jobs that match, as cancelling events."""
    last = jobs.groupBy("cache_key").agg(F.max_by(F.struct("status", "model", "ontology_hash"), "seq").alias("j")).select("cache_key", "j.*")
    out = last.where("status = 'preparing'")
    out = out if model is None else out.where(F.col("model") == model)
    return (out if ontology_hash is None else out.where(F.col("ontology_hash") == ontology_hash)).withColumn("status", F.lit("cancelling"))
