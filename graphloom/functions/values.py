"""Coercions of literals and small settings as column expressions; the edge cases differ on purpose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.functions.text import col, filled, text

XSD = "http://www.w3.org/2001/XMLSchema#"
DECIMAL = "decimal(38,18)"


def decimal_value(x: Column | str) -> Column:
    """H03. A decimal, or null; the normaliser compares these."""
    return F.trim(text(x)).try_cast(DECIMAL)


def integer_value(x: Column | str) -> Column:
    """H01. A whole number of zero or more, 3.0 among them; null otherwise."""
    d = decimal_value(x)
    return F.when((d >= 0) & (d == F.floor(d)), F.floor(d).cast("bigint"))


def count_value(x: Column | str) -> Column:
    """S21. A count as a cardinality takes it: digits, perhaps with spaces around, a plus or grouping underscores."""
    bare = F.regexp_replace(F.trim(text(x)), r"^\+", "")
    return F.when(bare.rlike(r"^\d+(_\d+)*$"), F.replace(bare, F.lit("_"), F.lit("")).try_cast("bigint"))


def boolean_value(x: Column | str) -> Column:
    """H02. true, 1, false or 0 in any case; nothing else, unlike a cast."""
    t = F.lower(F.trim(text(x)))
    return F.when(t.isin("true", "1"), True).when(t.isin("false", "0"), False)


def typed_boolean(x: Column | str, datatype: Column | str) -> Column:
    """H05. As above, of typed booleans alone: a merge doesn't read texts as booleans."""
    return F.when(col(datatype).isin(XSD + "boolean", "xsd:boolean"), boolean_value(x))


def number_value(x: Column | str) -> Column:
    """H04, H06. A double, or null; merging and consolidating compare these."""
    return F.trim(text(x)).try_cast("double")


def truthy(x: Column | str, default: bool = False) -> Column:
    """H45. 1, true, yes and on; null takes the default."""
    return F.when(col(x).isNull(), F.lit(default)).otherwise(F.lower(F.trim(text(x))).isin("1", "true", "yes", "on"))


def term_target(iri: Column | str, full_iri: Column | str, id_: Column | str) -> Column:
    """H30. The first filled of iri, full iri and id."""
    return F.coalesce(filled(iri), filled(full_iri), filled(id_))


def term_key(full_iri: Column | str, iri: Column | str, id_: Column | str) -> Column:
    """H48. The first filled of full iri, iri and id."""
    return F.coalesce(filled(full_iri), filled(iri), filled(id_))


def term_refs(*names: Column | str) -> Column:
    """H31. The distinct filled names of a term."""
    return F.array_distinct(F.filter(F.array(*[text(n) for n in names]), lambda x: x != ""))


def target_ref(x: Column | str) -> Column:
    """H34. Trimmed; null if empty or a dash."""
    t = F.trim(text(x))
    return F.when(~t.isin("", "—"), t)


def ordered_distinct(values: Column) -> Column:
    """H32. Trimmed filled values, each where it comes first."""
    return F.array_distinct(F.filter(F.transform(values, lambda v: F.trim(text(v))), lambda v: v != ""))


def is_absolute_iri(x: Column | str) -> Column:
    """H27. http, https and urn only."""
    return text(x).rlike("^(https?://|urn:)")


def class_local_name(x: Column | str) -> Column:
    """H21. After the last # and /, trailing ones aside; Resource if nothing is left."""
    bare = F.regexp_replace(text(x), "[/#]+$", "")
    return F.coalesce(filled(F.regexp_replace(bare, "(?s)^.*[#/]", "")), F.lit("Resource"))


def score_kind(resolved_by: Column | str) -> Column:
    """R59. The scale that a confidence is on."""
    r = text(resolved_by)
    return F.when(r == "index", "explicit").when(r == "label", "lexical").when(r == "semantic", "semantic_similarity").when(r == "llm", "llm_selected_candidate").otherwise("none")


def model_id(x: Column | str) -> Column:
    """H40. A short hosted model name gets the catalog prefix, a legacy name first loses its own."""
    clean = F.trim(text(x))
    short = F.when(clean == "databricks-genie", clean).otherwise(F.regexp_replace(clean, "^databricks-", ""))
    return F.when((clean == "") | clean.contains("/") | clean.startswith("system.ai."), clean).otherwise(F.concat(F.lit("system.ai."), short))


def provider(explicit: Column | str, *models: Column | str) -> Column:
    """H66. A provider that is named, else the local one if any model's name has a slash, else what was given."""
    named = F.lower(F.trim(text(explicit)))
    slash = F.exists(F.array(*[text(m) for m in models]), lambda m: m.contains("/")) if models else F.lit(False)
    return F.when(named.isin("databricks", "huggingface"), named).when(slash, "huggingface").otherwise(named)


def semantic_error(provider_: Column, token: Column | str, url: Column | str) -> Column:
    """H39. Why semantic ranking is off: a hosted provider needs a token and an address; else null."""
    return F.when((provider_ == "databricks") & ((text(token) == "") | (text(url) == "")), "Semantic ranking needs a token and an address.")


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def client_id(peer: Column | str, forwarded: Column | str, trusted: list[str]) -> Column:
    """W43. The first forwarded address behind a trusted proxy if it is an address, else the peer's."""
    first = F.trim(F.element_at(F.split(text(forwarded), ","), 1))
    v4 = first.rlike(r"^((25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(25[0-5]|2[0-4]\d|1?\d?\d)$")
    v6 = first.rlike(r"^[0-9A-Fa-f:]*:[0-9A-Fa-f:.]*$") & (F.length(first) >= 2)
    return F.when(col(peer).isin(trusted) & (v4 | v6), first).otherwise(col(peer))


def within_mb(x: Column | str, limit_mb: float) -> Column:
    """W44. Whether a text's UTF-8 bytes are within a limit."""
    return F.octet_length(text(x)) <= int(limit_mb * 1024 * 1024)


def request_id(header: Column | str) -> Column:
    """H72. A header's first 80 characters, or twelve hexadecimal digits."""
    return F.coalesce(filled(F.substring(F.trim(text(header)), 1, 80)), F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 12))


def rdf_format(filename: Column | str, default: str = "turtle", baseline: bool = False) -> Column:
    """G01, G04, H52. The parser's name by a file's extension; baselines know fewer."""
    known = {".ttl": "turtle", ".turtle": "turtle", ".nt": "nt", ".rdf": "xml", ".owl": "xml", ".xml": "xml"}
    known |= {} if baseline else {".trig": "trig", ".nq": "nquads"}
    ext = F.lower(F.regexp_extract(text(filename), r"(\.[^.]+)$", 1))
    out = F.when(F.lit(False), F.lit(""))
    for k, v in known.items():
        out = out.when(ext == k, F.lit(v))
    return out.otherwise(F.lit(default))


def baseline_filename(x: Column | str, suffix: str = "_baseline.ttl") -> Column:
    """H25. An ontology's file name with its extension replaced."""
    return F.concat(F.coalesce(filled(F.regexp_replace(F.regexp_replace(F.coalesce(filled(x), F.lit("ontology.ttl")), "^.*/", ""), r"(?<=.)\.[^.]*$", "")), F.lit("ontology")), F.lit(suffix))


def baseline_policy(mode: Column | str, available: Column, on_failure: Column | str) -> Column:
    """W04. What becomes of a requested baseline: off, its mode, generated only, or an error."""
    m = col(mode)
    return F.when(text(m).isin("", "off", "none"), "off").when(available, m).when(col(on_failure) == "continue", "off").otherwise("error")


def merge_strategy(x: Column | str) -> Column:
    """H51, S25. generated-priority, its aliases among them, or restrictive; null if unknown."""
    t = F.lower(F.trim(F.coalesce(filled(x), F.lit("generated-priority"))))
    return F.when(t.isin("generated-priority", "priority-llm", "priority_llm"), "generated-priority").when(t == "restrictive", "restrictive")


def is_merge_mode(x: Column | str) -> Column:
    """H51. Whether a baseline mode asks for merging."""
    return F.lower(F.trim(text(x))).isin("merge", "both", "evidence-and-merge")


def is_evidence_mode(x: Column | str) -> Column:
    """S30, H29. Whether a baseline mode lets the baseline be shown as evidence; none given does."""
    return F.lower(F.trim(text(x))).isin("", "baseline", "both", "evidence", "evidence-and-merge")


def shape_status(valid: Column, skipped: Column) -> Column:
    """W07. valid, else skipped, else invalid."""
    return F.when(F.coalesce(valid, F.lit(False)), "valid").when(F.coalesce(skipped, F.lit(False)), "skipped").otherwise("invalid")
