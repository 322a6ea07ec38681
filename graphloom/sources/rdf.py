"""RDF as rows: N-Triples by column expressions, Turtle and RDF/XML by a parser where the documents are.

triples (doc_id, s, s_kind, p, o, o_kind, o_dt, o_lang); kinds are iri, bnode and literal. Blank nodes
are renamed by document, so that documents may be united as they are.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import text

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
XSD = "http://www.w3.org/2001/XMLSchema#"
TRIPLE = "doc_id string, s string, s_kind string, p string, o string, o_kind string, o_dt string, o_lang string"
#: Rows that a parser gathers of small documents before it hands them on.
BATCH = 10_000
_LINE = r"^\s*(<[^>]*>|_:\S+)\s+(<[^>]*>)\s+(<[^>]*>|_:[^\s.]+|\"(?:[^\"\\]|\\.)*\")(?:@([A-Za-z0-9-]+)|\^\^<([^>]*)>)?\s*(?:<[^>]*>\s*)?\.\s*(?:#.*)?$"
#: The pieces of an escaped text: an escape, or what stands between two.
_PIECES = r"\\\\u[0-9A-Fa-f]{4}|\\\\U[0-9A-Fa-f]{8}|\\\\.|[^\\\\]+"
_BLANK_LINE = r"^\s*(?:#.*)?$"


class RdfError(ValueError):
    """A document that isn't RDF, with what the parser said."""


def unescaped(c: Column) -> Column:
    """A text of N-Triples with its escapes decoded, each once, from left to right."""
    piece = lambda x: (
        F.when(x.rlike(r"^\\u.{4}$"), F.decode(F.unhex(F.substring(x, 3, 4)), "UTF-16BE"))
        .when(x.rlike(r"^\\U.{8}$"), F.decode(F.unhex(F.substring(x, 3, 8)), "UTF-32"))
        .when(x == "\\t", "\t")
        .when(x == "\\n", "\n")
        .when(x == "\\r", "\r")
        .when(x == "\\b", "\b")
        .when(x == "\\f", "\f")
        .when(x.startswith("\\"), F.substring(x, 2, 1))
        .otherwise(x)
    )
    return F.when(F.contains(c, F.lit("\\")), F.array_join(F.transform(F.regexp_extract_all(c, F.lit(_PIECES.replace("\\\\", "\\")), F.lit(0)), piece), "")).otherwise(c)


def bad_lines(lines: DataFrame, line_col: str = "value") -> DataFrame:
    """The lines that are neither a triple nor blank nor a comment."""
    return lines.where(F.col(line_col).isNotNull() & ~F.col(line_col).rlike(_LINE) & ~F.col(line_col).rlike(_BLANK_LINE))


def from_ntriples(lines: DataFrame, line_col: str = "value", doc_col: str = "doc_id", skip_bad: bool = False) -> DataFrame:
    """G02. N-Triples and N-Quads lines as triples, without Python.

    Null and blank lines and comments hold none. Any other line that isn't a triple fails the query, or is
    left out with skip_bad; bad_lines() gives these.
    """
    part = lambda i: F.regexp_extract(line_col, _LINE, i)
    good = F.col(line_col).rlike(_LINE)
    if not skip_bad:
        wrong = F.raise_error(F.concat(F.lit("not a triple: "), F.col(line_col))).cast("boolean")
        good = F.when(good, True).when(F.col(line_col).isNull() | F.col(line_col).rlike(_BLANK_LINE), False).otherwise(wrong)
    rows = lines.where(good).select(F.col(doc_col).cast("string").alias("doc_id"), *[part(i).alias(c) for i, c in enumerate(("rs", "rp", "ro", "lang", "dt"), 1)])
    kind = lambda c: F.when(F.col(c).startswith("<"), "iri").when(F.col(c).startswith("_:"), "bnode").otherwise("literal")
    body = unescaped(F.expr("substring(ro, 2, length(ro) - 2)"))
    node = lambda c: F.when(F.col(c).startswith("<"), unescaped(F.expr(f"substring({c}, 2, length({c}) - 2)"))).otherwise(F.concat("doc_id", F.lit(":"), F.expr(f"substring({c}, 3)")))
    literal = kind("ro") == "literal"
    return rows.select(
        "doc_id",
        node("rs").alias("s"),
        kind("rs").alias("s_kind"),
        node("rp").alias("p"),
        F.when(literal, body).otherwise(node("ro")).alias("o"),
        kind("ro").alias("o_kind"),
        F.when(literal, F.when(F.col("lang") != "", RDF + "langString").when(F.col("dt") != "", F.col("dt")).otherwise(XSD + "string")).alias("o_dt"),
        F.when(literal & (F.col("lang") != ""), F.lower("lang")).alias("o_lang"),
    )


def to_ntriples(triples: DataFrame) -> DataFrame:
    """S77. (doc_id, line) of triples, in canonical form; sort them for a canonical document.

    A blank node whose name isn't plain letters and digits is written as z0 and its bytes in hexadecimal, as is
    one that begins with z0, so that different nodes stay different.
    """
    esc = F.replace(text("o"), F.lit("\\"), F.lit("\\\\"))
    for a, b in [("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ('"', '\\"')]:
        esc = F.replace(esc, F.lit(a), F.lit(b))
    node = lambda c, k: F.when(F.col(k) == "bnode", F.concat(F.lit("_:"), F.when(F.col(c).rlike("^(?!z0)[A-Za-z0-9]+$"), F.col(c)).otherwise(F.concat(F.lit("z0"), F.lower(F.hex(F.encode(c, "UTF-8"))))))).otherwise(F.concat(F.lit("<"), c, F.lit(">")))
    mark = F.when(text("o_lang") != "", F.concat(F.lit("@"), "o_lang")).when(~text("o_dt").isin("", XSD + "string"), F.concat(F.lit("^^<"), "o_dt", F.lit(">"))).otherwise("")
    obj = F.when(F.col("o_kind") == "literal", F.concat(F.lit('"'), esc, F.lit('"'), mark)).otherwise(node("o", "o_kind"))
    return triples.select("doc_id", F.concat(node("s", "s_kind"), F.lit(" <"), "p", F.lit("> "), obj, F.lit(" .")).alias("line"))


TOKEN = re.compile(
    r"""(?P<ws>\s+|\#[^\n]*)|(?P<iri><[^<>"{}|^`\\\s]*>)|(?P<long>\"\"\"(?:[^\\]|\\.)*?\"\"\"|'''(?:[^\\]|\\.)*?''')|(?P<str>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
    |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<dt>\^\^)|(?P<bnode>_:[\w.-]*[\w-])|(?P<num>[+-]?(?:\d+\.\d*[eE][+-]?\d+|\.?\d+[eE][+-]?\d+|\d*\.\d+|\d+))
    |(?P<name>(?:[^\W\d_][\w.-]*)?:(?:[\w%\\:-][\w%\\.:~/-]*(?<![.]))?)|(?P<word>[A-Za-z]+)|(?P<punct>[;,.\[\](){}=])""",
    re.VERBOSE | re.DOTALL,
)
_ESCAPE = re.compile(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", re.DOTALL)
_PLAIN = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f"}


def _unescape(s: str) -> str:
    return _ESCAPE.sub(lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "uU" and len(m[1]) > 1 else _PLAIN.get(m[1], m[1]), s) if "\\" in s else s


class Turtle:
    """A recursive-descent parser of Turtle, and of TriG without keeping graph names.

    rows: (s, s_kind, p, o, o_kind, o_dt, o_lang); prefixes: name to namespace, the last declaration's.
    """

    def __init__(self, content: str, base: str = ""):
        self.rows: list[tuple] = []
        self.prefixes: dict[str, str] = {}
        self.base, self.fresh = base, 0
        self.toks: list[tuple[str, str]] = []
        at = 0
        while at < len(content):
            m = TOKEN.match(content, at)
            if m is None:
                raise RdfError(f"unexpected {content[at : at + 20]!r}")
            if m.lastgroup != "ws":
                self.toks.append((m.lastgroup, m[0]))
            at = m.end()
        self.i = 0
        while self.i < len(self.toks):
            self._statement()

    def _peek(self) -> tuple[str, str]:
        return self.toks[self.i] if self.i < len(self.toks) else ("end", "")

    def _next(self) -> tuple[str, str]:
        t = self._peek()
        self.i += 1
        return t

    def _want(self, value: str) -> None:
        if self._next()[1] != value:
            raise RdfError(f"{value!r} is missing before {self._peek()[1]!r}")

    def _iri(self, raw: str) -> str:
        iri = _unescape(raw[1:-1])
        return iri if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", iri) else self.base + iri

    def _blank(self) -> tuple[str, str]:
        self.fresh += 1
        return f"genid{self.fresh}", "bnode"

    def _statement(self) -> None:
        kind, value = self._peek()
        low = value.lower()
        if low in ("@prefix", "prefix", "@base", "base"):
            self._next()
            if low.endswith("prefix"):
                name = self._next()[1]
                if not name.endswith(":"):
                    raise RdfError(f"{name!r} is no prefix")
                self.prefixes[name[:-1]] = self._iri(self._next()[1])
            else:
                self.base = self._iri(self._next()[1])
            if low[0] == "@":
                self._want(".")
            return
        if value == "{" or low == "graph":
            if low == "graph":
                self._next()
                self._node()
            self._graph()
            return
        if kind in ("iri", "name") and self.i + 1 < len(self.toks) and self.toks[self.i + 1][1] == "{":
            self._next()
            self._graph()
            return
        self._triples()
        self._want(".")

    def _graph(self) -> None:
        self._want("{")
        while self._peek()[1] != "}":
            self._triples()
            if self._peek()[1] == ".":
                self._next()
        self._next()

    def _triples(self) -> None:
        if self._peek()[1] == "[":
            s = self._node()
            if self._peek()[1] in (".", "}"):
                return
        else:
            s = self._node()
        self._verbs(s)

    def _verbs(self, s: tuple) -> None:
        if s[1] == "literal":
            raise RdfError("a literal can't be a subject")
        while True:
            kind, value = self._peek()
            if kind == "word" and value == "a":
                self._next()
                p = RDF + "type"
            else:
                node = self._node()
                if node[1] != "iri":
                    raise RdfError(f"{node[0]!r} can't be a predicate")
                p = node[0]
            while True:
                o = self._node()
                self.rows.append((s[0], s[1], p, *((*o, None, None) if len(o) == 2 else o)))
                if self._peek()[1] != ",":
                    break
                self._next()
            while self._peek()[1] == ";":
                self._next()
                if self._peek()[1] in (".", "]", ";", "}"):
                    continue
                break
            else:
                return
            if self._peek()[1] in (".", "]", "}"):
                return

    def _node(self) -> tuple:
        kind, value = self._next()
        if kind == "iri":
            return self._iri(value), "iri"
        if kind == "name":
            prefix, _, local = value.partition(":")
            if prefix not in self.prefixes:
                raise RdfError(f"prefix {prefix!r} isn't bound")
            return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local), "iri"
        if kind == "bnode":
            return value[2:], "bnode"
        if kind in ("str", "long"):
            body = _unescape(value[3:-3] if kind == "long" else value[1:-1])
            after = self._peek()
            if after[0] == "lang":
                self._next()
                return body, "literal", RDF + "langString", after[1][1:].lower()
            if after[0] == "dt":
                self._next()
                return body, "literal", self._node()[0], None
            return body, "literal", XSD + "string", None
        if kind == "num":
            return value, "literal", XSD + ("double" if "e" in value.lower() else "decimal" if "." in value else "integer"), None
        if kind == "word" and value in ("true", "false"):
            return value, "literal", XSD + "boolean", None
        if value == "[":
            b = self._blank()
            if self._peek()[1] != "]":
                self._verbs(b)
            self._want("]")
            return b
        if value == "(":
            members = []
            while self._peek()[1] != ")":
                members.append(self._node())
            self._next()
            if not members:
                return RDF + "nil", "iri"
            cells = [self._blank() for _ in members]
            for k, (cell, m) in enumerate(zip(cells, members, strict=True)):
                self.rows.append((*cell, RDF + "first", *((*m, None, None) if len(m) == 2 else m)))
                rest = cells[k + 1] if k + 1 < len(cells) else (RDF + "nil", "iri")
                self.rows.append((*cell, RDF + "rest", *rest, None, None))
            return cells[0]
        raise RdfError(f"unexpected {value!r}" if kind != "end" else "unexpected end")


def parse_xml(content: str) -> tuple[list[tuple], dict[str, str]]:
    """Rows and prefixes of RDF/XML: typed nodes, property attributes, resources, parse types."""
    prefixes: dict[str, str] = {}
    try:
        parser = ET.XMLPullParser(["start-ns", "end"])
        parser.feed(content)
        for event, value in parser.read_events():
            if event == "start-ns":
                prefixes[value[0]] = value[1]
        root = ET.fromstring(content)
    except ET.ParseError as e:
        raise RdfError(str(e)) from e
    rows: list[tuple] = []
    fresh = 0
    lang_name, base_name = "{http://www.w3.org/XML/1998/namespace}lang", "{http://www.w3.org/XML/1998/namespace}base"
    name = lambda tag: tag[1:].replace("}", "", 1)
    q = lambda x: f"{{{RDF}}}{x}"
    skip = {q(x) for x in ("about", "ID", "nodeID", "resource", "datatype", "parseType")} | {lang_name, base_name}

    def blank() -> tuple[str, str]:
        nonlocal fresh
        fresh += 1
        return f"genid{fresh}", "bnode"

    def resolve(x: str, base: str) -> str:
        return x if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", x) else base.split("#")[0] + x

    def literal(value: str, dt: str | None, lang: str | None) -> tuple:
        return value, "literal", dt or (RDF + "langString" if lang else XSD + "string"), lang.lower() if lang and not dt else None

    def node(e: ET.Element, base: str, lang: str | None) -> tuple[str, str]:
        base, lang, a = e.get(base_name, base), e.get(lang_name, lang), e.attrib
        if q("about") in a:
            s = resolve(a[q("about")], base), "iri"
        elif q("ID") in a:
            s = resolve("#" + a[q("ID")], base), "iri"
        elif q("nodeID") in a:
            s = a[q("nodeID")], "bnode"
        else:
            s = blank()
        if e.tag != q("Description"):
            rows.append((*s, RDF + "type", name(e.tag), "iri", None, None))
        for k, v in a.items():
            if k not in skip and k.startswith("{"):
                rows.append((*s, name(k), *((v, "iri", None, None) if k == q("type") else literal(v, None, lang))))
        nth = 0
        for child in e:
            p = name(child.tag)
            if child.tag == q("li"):
                nth += 1
                p = f"{RDF}_{nth}"
            prop(s, p, child, base, lang)
        return s

    def prop(s: tuple, p: str, e: ET.Element, base: str, lang: str | None) -> None:
        base, lang, a = e.get(base_name, base), e.get(lang_name, lang), e.attrib
        kind = a.get(q("parseType"))
        if q("resource") in a:
            o = (resolve(a[q("resource")], base), "iri", None, None)
        elif q("nodeID") in a:
            o = (a[q("nodeID")], "bnode", None, None)
        elif kind == "Resource":
            b = blank()
            for child in e:
                prop(b, name(child.tag), child, base, lang)
            o = (*b, None, None)
        elif kind == "Collection":
            members = [node(c, base, lang) for c in e]
            cells = [blank() for _ in members]
            for k, (cell, m) in enumerate(zip(cells, members, strict=True)):
                rows.append((*cell, RDF + "first", *m, None, None))
                rows.append((*cell, RDF + "rest", *(cells[k + 1] if k + 1 < len(cells) else (RDF + "nil", "iri")), None, None))
            o = (*cells[0], None, None) if cells else (RDF + "nil", "iri", None, None)
        elif len(e):
            o = (*node(e[0], base, lang), None, None)
        elif any(k not in skip for k in a) and not (e.text or "").strip():
            b = blank()
            for k, v in a.items():
                if k not in skip:
                    rows.append((*b, name(k), *literal(v, None, lang)))
            o = (*b, None, None)
        else:
            o = literal(e.text or "", a.get(q("datatype")), lang)
        rows.append((*s, p, *o))

    for e in root if root.tag == q("RDF") else [root]:
        node(e, root.get(base_name, ""), root.get(lang_name))
    return rows, prefixes


def parse(content: str, fmt: str = "turtle") -> tuple[list[tuple], dict[str, str]]:
    """G02. Rows and prefixes of a document; where its format fails, the other of Turtle and XML is tried once.

    An empty document is an error.
    """
    if not (content or "").strip():
        raise RdfError("the document is empty")
    as_turtle = lambda: (lambda t: (t.rows, t.prefixes))(Turtle(content))
    first, second = (lambda: parse_xml(content), as_turtle) if fmt == "xml" else (as_turtle, lambda: parse_xml(content))
    try:
        return first()
    except RdfError as e:
        try:
            return second()
        except RdfError:
            raise e from None


def read_documents(docs: DataFrame, doc_col: str = "doc_id", content_col: str = "content", format_col: str | None = None) -> DataFrame:
    """G02, G03, S07, S08. triples of documents, each parsed where it is; blank nodes carry their document's id.

    A document that isn't RDF fails the query with its id.
    """
    fmt = F.col(format_col) if format_col else F.lit("turtle")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = TRIPLE.replace(" string", "").split(", ")
        held: list[tuple] = []
        for b in batches:
            for doc, content, f in zip(b["doc_id"], b["content"], b["fmt"], strict=True):
                try:
                    rows, _ = parse(content, f)
                except RdfError as e:
                    raise RdfError(f"{doc}: {e}") from e
                blank = lambda x, kind: f"{doc}:{x}" if kind == "bnode" else x  # noqa: B023, E731
                held += dict.fromkeys((doc, blank(s, sk), sk, p, blank(o, ok), ok, dt, lang) for s, sk, p, o, ok, dt, lang in rows)
                if len(held) >= BATCH:
                    yield pd.DataFrame(held, columns=names)
                    held = []
        if held:
            yield pd.DataFrame(held, columns=names)

    rows = docs.select(F.col(doc_col).cast("string").alias("doc_id"), F.col(content_col).alias("content"), fmt.alias("fmt"))
    return rows.mapInPandas(run, TRIPLE)


def read_prefixes(docs: DataFrame, doc_col: str = "doc_id", content_col: str = "content", format_col: str | None = None) -> DataFrame:
    """(doc_id, prefix, ns) that documents declare."""
    fmt = F.col(format_col) if format_col else F.lit("turtle")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        for b in batches:
            for doc, content, f in zip(b["doc_id"], b["content"], b["fmt"], strict=True):
                held += [(doc, *declared) for declared in parse(content, f)[1].items()]
                if len(held) >= BATCH:
                    yield pd.DataFrame(held, columns=["doc_id", "prefix", "ns"])
                    held = []
        if held:
            yield pd.DataFrame(held, columns=["doc_id", "prefix", "ns"])

    rows = docs.select(F.col(doc_col).cast("string").alias("doc_id"), F.col(content_col).alias("content"), fmt.alias("fmt"))
    return rows.mapInPandas(run, "doc_id string, prefix string, ns string")


def read_files(spark: SparkSession, path: str, fmt: str = "turtle") -> DataFrame:
    """triples of files below a path: N-Triples by lines and in parallel, others a document a file."""
    if fmt in ("nt", "nquads"):
        lines = spark.read.text(path).select("value", F.element_at(F.split(F.input_file_name(), "/"), -1).alias("doc_id"))
        return from_ntriples(lines)
    docs = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("doc_id"), F.col("value").alias("content"), F.lit(fmt).alias("fmt"))
    return read_documents(docs, format_col="fmt")
