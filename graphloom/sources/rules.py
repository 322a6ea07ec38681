"""Rule documents as rows: Markdown by column expressions, HTML by a parser where the documents are."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import col, text

HEADING = r"(?im)^\s*##\s+Rule\s*$"
BODY = r"(?im)^\s*###\s+(?:Data constraint|Business rule)\s*$"
#: HTML documents that are decoded, parsed and handed on at once, however many a batch holds.
PAGES = 64
RULE = "doc_id string, ord int, number string, title string, text string, source_format string"


def document_format(fmt: Column | str, filename: Column | str, content: Column | str) -> Column:
    """G06. html or md, by what is said, the extension, or the content; null if none tells."""
    said = F.regexp_replace(F.lower(F.trim(text(fmt))), r"^\.+", "")
    ext = F.lower(F.regexp_extract(text(filename), r"(\.[^./]+)$", 1))
    low = F.lower(text(content))
    html = low.contains("<section") | low.contains("<html") | low.contains("<!doctype html")
    return (
        F.when(said.isin("html", "htm"), "html").when(said.isin("md", "markdown"), "md").when(ext.isin(".html", ".htm"), "html").when(ext.isin(".md", ".markdown"), "md")
        .when(html, "html").when(text(content).rlike(HEADING), "md")
    )


def unix_lines(x: Column | str) -> Column:
    return F.regexp_replace(text(x), "\r\n?", "\n")


def metadata(content: Column | str, label: str) -> Column:
    """G08. The first `- Label: value` of a document."""
    return F.trim(F.regexp_extract(unix_lines(content), rf"(?im)^[ \t]*-[ \t]*{label}[ \t]*:[ \t]*(.*)$", 1))


def without_label(x: Column | str, name: str) -> Column:
    """G10. A field without its own name in front."""
    return F.trim(F.regexp_replace(text(x), rf"(?i)^\s*{name}\s*:\s*", ""))


def parse_markdown(docs: DataFrame, doc_col: str = "doc_id", content_col: str = "content") -> DataFrame:
    """G07. RULE rows: a rule a heading, its text up to the first line of dashes; what is missing is empty."""
    parts = docs.select(F.col(doc_col).cast("string").alias("doc_id"), F.posexplode(F.split(unix_lines(content_col), HEADING)).alias("ord", "part")).where("ord > 0")
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    parts = parts.withColumn("block", strip(F.col("part")))
    field = lambda name: F.trim(F.regexp_extract("block", rf"(?im)^[ \t]*-[ \t]*{name}[ \t]*:[ \t]*(.*)$", 1))
    after = F.try_element_at(F.split("block", BODY, 2), F.lit(2))
    body = strip(F.element_at(F.split(F.coalesce(after, F.lit("")), r"(?m)^\s*---\s*$", 2), 1))
    return parts.select("doc_id", "ord", field("Number").alias("number"), field("Title").alias("title"), body.alias("text"), F.lit("md").alias("source_format"))


def markdown_metadata(docs: DataFrame, doc_col: str = "doc_id", content_col: str = "content") -> DataFrame:
    return docs.select(F.col(doc_col).cast("string").alias("doc_id"), *[metadata(content_col, k).alias(k.lower()) for k in ("Ontology", "Author", "Date", "Description")])


def join_paragraphs(paragraphs: Column | str, whole: Column | str) -> Column:
    """G11. Filled paragraphs with a blank line between them, else the whole text."""
    kept = F.filter(F.transform(col(paragraphs), F.trim), lambda p: p != "")
    return F.when(F.size(kept) > 0, F.array_join(kept, "\n\n")).otherwise(F.trim(text(whole)))


class _Node:
    def __init__(self, tag: str, classes: set[str]):
        self.tag, self.classes, self.children = tag, classes, []

    def find(self, test) -> Iterator[_Node]:
        for c in self.children:
            if isinstance(c, _Node):
                if test(c):
                    yield c
                yield from c.find(test)

    def texts(self) -> Iterator[str]:
        for c in self.children:
            if isinstance(c, _Node):
                yield from c.texts()
            elif c.strip():
                yield c.strip()


class _Tree(HTMLParser):
    VOID = {"br", "hr", "img", "input", "link", "meta", "wbr"}

    def __init__(self, content: str):
        super().__init__(convert_charrefs=True)
        self.root = _Node("", set())
        self.open = [self.root]  # no node refers to its parent, so that a tree goes without a cycle
        self.feed(content)
        self.close()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        n = _Node(tag, set((dict(attrs).get("class") or "").split()))
        self.open[-1].children.append(n)
        if tag not in self.VOID:
            self.open.append(n)

    def handle_endtag(self, tag: str) -> None:
        at = next((k for k in range(len(self.open) - 1, 0, -1) if self.open[k].tag == tag), 0)
        if at:
            del self.open[at:]

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def html_rules(content: str, section: str = "section", classes: tuple[str, ...] = ("rule",)) -> list[tuple[str, str, str]]:
    """G09. (number, title, text) of each rule section."""
    import re

    out = []
    first = lambda n, *names: next(n.find(lambda c: not c.classes.isdisjoint(names)), None)
    plain = lambda n, name: "" if n is None else re.sub(rf"^\s*{name}\s*:\s*", "", " ".join(n.texts()), flags=re.I).strip()
    for s in _Tree(content or "").root.find(lambda c: c.tag == section and (not classes or not c.classes.isdisjoint(classes))):
        body = first(s, "data-constraint", "business-rule")
        body = s if body is None and not classes else body
        ps = [t for t in (" ".join(p.texts()) for p in body.find(lambda c: c.tag == "p")) if t] if body is not None else []
        out.append((plain(first(s, "number"), "Number"), plain(first(s, "title"), "Title"), "\n\n".join(ps) if ps else "\n".join(body.texts()) if body is not None else ""))
    return out


def parse_html(docs: DataFrame, doc_col: str = "doc_id", content_col: str = "content", section: str = "section", classes: tuple[str, ...] = ("rule",)) -> DataFrame:
    """G09-G11. RULE rows of HTML documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, PAGES):
                doc, content = (b.slice(at, PAGES).column(c).to_pylist() for c in ("doc_id", "content"))
                rows = [(d, k, *r, "html") for d, c in zip(doc, content, strict=True) for k, r in enumerate(html_rules(c, section, classes), 1)]
                yield pa.RecordBatch.from_arrays([pa.array(column, f.type) for column, f in zip(zip(*rows, strict=True) if rows else [()] * len(out), out, strict=True)], schema=out)

    out = pa.schema([(name, pa.int32() if kind == "int" else pa.string()) for name, kind in map(str.split, RULE.split(", "))])
    return docs.select(F.col(doc_col).cast("string").alias("doc_id"), F.col(content_col).alias("content")).mapInArrow(run, RULE)


def parse_rules(docs: DataFrame) -> DataFrame:
    """G14, H55. RULE rows of documents (doc_id, fmt, filename, content) of either format; an unknown format fails the query."""
    fmt = document_format("fmt", "filename", "content")
    d = docs.withColumn("f", F.coalesce(fmt, F.raise_error(F.concat(F.lit("no rule format: "), text("filename")))))
    return parse_markdown(d.where("f = 'md'")).unionByName(parse_html(d.where("f = 'html'")))


def invalid_rules(rules: DataFrame) -> DataFrame:
    """G15, G16. Rules without a number, title or text, and what they lack."""
    lack = F.filter(F.array(*[F.when(text(c) == "", c) for c in ("number", "title", "text")]), lambda x: x.isNotNull())
    return rules.withColumn("lacks", lack).where(F.size("lacks") > 0)


def profiles(payload: DataFrame, doc_col: str = "doc_id", items_col: str = "profiles") -> DataFrame:
    """G17. (doc_id, nr, name, content) of filled profiles; a name that is missing counts all items."""
    p = payload.select(F.col(doc_col).alias("doc_id"), F.posexplode(items_col).alias("i", "p"))
    name = F.coalesce(F.nullif(F.trim(text("p.name")), F.lit("")), F.concat(F.lit("profile-"), (F.col("i") + 1).cast("string"), F.lit(".ttl")))
    return p.select("doc_id", (F.col("i") + 1).alias("nr"), name.alias("name"), F.col("p.content").alias("content")).where(F.trim(text("content")) != "")


def baseline_payload(payload: Column, purpose: str = "evidence") -> Column:
    """G05. What a baseline's map holds for a purpose: for merging its merge_content if the key is there, even empty."""
    if purpose == "merge":
        return F.when(F.map_contains_key(payload, "merge_content"), payload["merge_content"]).otherwise(payload["content"])
    return payload["content"]
