"""Text functions as column expressions: normalising, stemming, tokens, names, redaction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: words that carry no evidence, words that open relation names, irregular stems
STOPWORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "can", "each", "every", "for", "from", "have", "has", "in", "is", "it", "its", "must", "of", "on", "one", "or", "shall", "the", "to", "with"]
RELATION_WORDS = ["has", "have", "is", "are", "was", "were", "requires", "require", "required", "produces", "produce", "assigned", "assigns", "assign", "inspects", "inspect", "inspected", "located", "locates", "links", "link", "linked"]
IRREGULAR = {"located": "locate", "locates": "locate", "linked": "link", "links": "link", "inspected": "inspect", "inspects": "inspect", "assigned": "assign", "assigns": "assign", "produces": "produce", "required": "require", "requires": "require"}
SUFFIXES = ["ing", "ed", "es", "s"]
LEXICAL_STOPWORDS = ["the", "and", "for", "with", "must", "shall", "every", "each", "value", "record"]
SECRET_FIELDS = ["api_key", "authorization", "databricks_token", "hf_token", "huggingface_token", "password", "secret", "token"]


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def text(x: Column | str) -> Column:
    """Null is the empty text."""
    return F.coalesce(col(x).cast("string"), F.lit(""))


def split_camel(x: Column | str) -> Column:
    """R01. A space between a small letter or digit and a capital, and before the last of several capitals."""
    once = F.regexp_replace(text(x), "([a-z0-9])([A-Z])", "$1 $2")
    return F.regexp_replace(once, "([A-Z]+)([A-Z][a-z])", "$1 $2")


def normalise(x: Column | str) -> Column:
    """R02. Words of a-z and 0-9, one space apart; any other character parts words."""
    return F.trim(F.regexp_replace(F.lower(split_camel(x)), "[^a-z0-9]+", " "))


def stem(t: Column) -> Column:
    """R03. Irregular forms, else the longest of the suffixes that leaves over three letters goes."""
    irregular = F.create_map(*[F.lit(x) for pair in IRREGULAR.items() for x in pair])
    return F.coalesce(F.try_element_at(irregular, t), F.regexp_replace(t, f"^(.{{4,}}?)(?:{'|'.join(SUFFIXES)})$", "$1"))


def tokens(x: Column | str, keep_stopwords: bool = False) -> Column:
    """R04. Stemmed words in order; stop words go after stemming."""
    out = F.filter(F.transform(F.split(normalise(x), " "), stem), lambda t: t != "")
    return out if keep_stopwords else F.filter(out, lambda t: ~t.isin(STOPWORDS))


def contains_phrase(normalised: Column | str, alias_normalised: Column | str) -> Column:
    """R05. Whole words of a normalised text; an empty phrase is in no text."""
    pad = lambda c: F.concat(F.lit(" "), col(c), F.lit(" "))
    return (col(alias_normalised) != "") & pad(normalised).contains(pad(alias_normalised))


def location(in_title: Column, in_body: Column) -> Column:
    return F.when(in_title & in_body, "title+text").when(in_title, "title").when(in_body, "text").otherwise("combined text")


def match_location(alias: Column | str, title: Column | str, body: Column | str) -> Column:
    """R06. Where a normalised phrase stands."""
    return location(contains_phrase(title, alias), contains_phrase(body, alias))


def overlap_location(overlap: Column | str, title_tokens: Column | str, body_tokens: Column | str) -> Column:
    """R07. Where any of the shared tokens stands."""
    return location(F.arrays_overlap(col(overlap), col(title_tokens)), F.arrays_overlap(col(overlap), col(body_tokens)))


def after_last(x: Column, mark: str) -> Column:
    return F.element_at(F.split(x, mark.replace("#", "\\#"), -1), -1)


def local_name(iri: Column | str) -> Column:
    """R08. What follows the last # and /, and then the first colon; angle brackets go."""
    bare = F.regexp_replace(text(iri), "(?s)^<(.*)>$", "$1")
    tail = F.regexp_replace(bare, "(?s)^.*[#/]", "")
    return F.regexp_replace(tail, "(?s)^[^:]*:", "")


def side_tokens(x: Column | str) -> Column:
    """R09. Tokens of a domain or range; the empty text and a dash have none."""
    tail = F.regexp_replace(F.regexp_replace(text(x), "(?s)^.*[#/]", ""), "(?s)^[^:]*:", "")
    return F.when(text(x).isin("", "—"), F.array().cast("array<string>")).otherwise(F.array_distinct(tokens(tail)))


def lexical_tokens(x: Column | str) -> Column:
    """R10. Lower-cased words of over two letters but for a few, repeats included."""
    words = F.split(F.trim(F.regexp_replace(F.lower(text(x)), "[^a-z0-9]+", " ")), " ")
    return F.filter(words, lambda t: (F.length(t) > 2) & ~t.isin(LEXICAL_STOPWORDS))


def filled(x: Column | str) -> Column:
    return F.nullif(text(x), F.lit(""))


def entity_text(label: Column | str, kind: Column | str, note: Column | str, type_: Column | str, domain: Column | str, range_: Column | str) -> Column:
    """R11. What is embedded of a term: its filled parts, and a property's domain and range."""
    sides = F.when(col(type_) == "property", F.concat(F.lit("domain "), text(domain), F.lit(" range "), text(range_)))
    return F.trim(F.concat_ws(". ", filled(label), filled(kind), filled(note), sides))


def content_hash(x: Column | str) -> Column:
    """G61. SHA-256 in hexadecimal digits."""
    return F.sha2(text(x), 256)


def redact(x: Column | str, secrets: list[str] | None = None) -> Column:
    """R15. Known secrets, the longest first, and what follows names of secrets."""
    out = text(x)
    for s in sorted({s for s in secrets or [] if s}, key=len, reverse=True):
        out = F.replace(out, F.lit(s), F.lit("[redacted]"))
    out = F.regexp_replace(out, r"(?i)(authorization\s*[:=]\s*bearer\s+)[^\s,;]+", "$1[redacted]")
    return F.regexp_replace(out, r"(?i)((?:api[_-]?key|token|password|secret)\s*[:=]\s*)[^\s,;]+", "$1[redacted]")


def collect_secrets(value: object) -> list[str]:
    """R14. The values under secret names anywhere in a request, for redact(); driver-side."""
    if isinstance(value, dict):
        own = [str(v) for k, v in value.items() if str(k).strip().lower() in SECRET_FIELDS and v]
        return own + [s for k, v in value.items() if str(k).strip().lower() not in SECRET_FIELDS for s in collect_secrets(v)]
    return [s for v in value for s in collect_secrets(v)] if isinstance(value, list | tuple) else []


def redact_fields(row: Column, names: list[str], secrets: list[str] | None = None) -> Column:
    """H62. A struct with its secret-named fields replaced and its texts redacted."""
    return F.struct(*[(F.lit("[redacted]") if n.lower() in SECRET_FIELDS else redact(row[n], secrets)).alias(n) for n in names])


def rule_text(number: Column | str, title: Column | str, body: Column | str) -> Column:
    """R20. A rule as text: its number and title where filled, then its constraint."""
    line = lambda name, c: F.when(text(c) != "", F.concat(F.lit(f"{name}: "), text(c)))
    return F.trim(F.concat_ws("\n", line("Rule number", number), line("Rule title", title), F.lit("Data constraint:"), text(body)))


def without_prefix_lines(document: Column | str, prefixes: Column | str) -> Column:
    """R21. A document without the prefix lines that the editor's block has already."""
    held = F.transform(F.split(text(prefixes), "\n"), F.trim)
    repeated = lambda line: F.lower(F.trim(line)).rlike(r"^@?prefix\b") & F.array_contains(held, F.trim(line))
    return F.array_join(F.filter(F.split(text(document), "\n"), lambda line: ~repeated(line)), "\n")


def fingerprint(ids: Column | str, texts: Column | str) -> Column:
    """R12. SHA-1 over id|text of all terms in the order of their ids; an aggregate."""
    pairs = F.array_sort(F.collect_list(F.struct(text(ids).alias("i"), text(texts).alias("t"))))
    return F.sha1(F.array_join(F.transform(pairs, lambda p: F.concat(p["i"], F.lit("|"), p["t"])), ""))


def config_fingerprint(config: dict[str, Column], secret: list[str] = SECRET_FIELDS) -> Column:
    """R13. SHA-1 of a configuration's fields by name; secrets enter as SHA-256 only."""
    parts = [F.concat(F.lit(f'"{k}":"'), F.sha2(text(c), 256) if k in secret else text(c), F.lit('"')) for k, c in sorted(config.items())]
    return F.sha1(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")))


def cache_key(model: Column, config: Column, ontology_hash: Column, terms: Column) -> Column:
    """H38. What an embedding index is kept under."""
    return F.sha2(F.concat_ws("|", model, config, F.coalesce(F.nullif(ontology_hash, F.lit("")), F.lit("no-content-hash")), terms), 256)


def concat_all(parts: list[Column]) -> Column:
    return reduce(lambda a, b: F.concat(a, b), parts)
