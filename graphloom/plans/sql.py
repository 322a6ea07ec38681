"""The text functions as DuckDB expressions, for the oracles; the word lists are the library's own."""

from __future__ import annotations

from graphloom.functions import text as T


def words(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def camel(x: str) -> str:
    return rf"regexp_replace(regexp_replace(coalesce({x}, ''), '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g')"


def norm(x: str) -> str:
    return f"trim(regexp_replace(lower({camel(x)}), '[^a-z0-9]+', ' ', 'g'))"


def stem(t: str) -> str:
    irregular = " ".join(f"WHEN {t} = '{a}' THEN '{b}'" for a, b in T.IRREGULAR.items())
    suffix = " ".join(f"WHEN length({t}) > {len(s) + 3} AND suffix({t}, '{s}') THEN left({t}, length({t}) - {len(s)})" for s in T.SUFFIXES)
    return f"(CASE {irregular} {suffix} ELSE {t} END)"


def tokens(x: str, keep_stopwords: bool = False) -> str:
    out = f"list_transform(string_split({norm(x)}, ' '), lambda t: {stem('t')})"
    keep = "t <> ''" if keep_stopwords else f"t <> '' AND NOT list_contains({words(T.STOPWORDS)}, t)"
    return f"list_filter({out}, lambda t: {keep})"


def lexical(x: str) -> str:
    return f"list_filter(string_split(trim(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9]+', ' ', 'g')), ' '), lambda t: length(t) > 2 AND NOT list_contains({words(T.LEXICAL_STOPWORDS)}, t))"


def local(x: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace(coalesce({x}, ''), '^<(.*)>$', '\1'), '^.*[#/]', ''), '^[^:]*:', '')"


def side(x: str) -> str:
    return f"(CASE WHEN coalesce({x}, '') IN ('', '—') THEN CAST([] AS VARCHAR[]) ELSE list_distinct({tokens(local(x))}) END)"


def phrase(text: str, alias: str) -> str:
    return f"({alias} <> '' AND contains(' ' || {text} || ' ', ' ' || {alias} || ' '))"


def location(a: str, b: str) -> str:
    return f"CASE WHEN ({a}) AND ({b}) THEN 'title+text' WHEN {a} THEN 'title' WHEN {b} THEN 'text' ELSE 'combined text' END"


def literal(v: object) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).upper()
    if isinstance(v, list):
        return "CAST([" + ", ".join(literal(x) for x in v) + "] AS VARCHAR[])"
    return str(v) if isinstance(v, int | float) else "'" + str(v).replace("'", "''") + "'"


def values(name: str, columns: list[str], rows: list[tuple]) -> str:
    """A common table expression of literal rows."""
    body = ", ".join("(" + ", ".join(literal(v) for v in r) + ")" for r in rows)
    return f"{name}({', '.join(columns)}) AS (VALUES {body})"
