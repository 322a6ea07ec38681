"""RDF files as a data source: spark.dataSource.register(RdfSource), then spark.read.format("rdf").load(path).

N-Triples and N-Quads are read in ranges of bytes, each line by the range that it begins in, so that a file of
any size is many tasks; other formats are a document a file. Files are listed and read by pyarrow's file
systems (local paths, s3, gs, hdfs); where only Spark's own readers reach a store, rdf.read_files is the way.

Options: path (a file, a folder, or with * in the last part), format (turtle, xml, nt or nquads; by the file's name if unset), mode (failfast, or
dropmalformed: lines and documents that aren't RDF are left out), splitBytes (64 MB), predicates (white space
between IRIs: only triples of these), pushdown (true: filters on s, p, o and the kinds are applied while reading;
the session must have spark.sql.python.filterPushdown.enabled).
"""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from graphloom.sources import rdf

SPLIT = 64 << 20
#: Rows of a batch, and bytes that are read at once.
_ROWS, _READ = 10_000, 1 << 20
_SUFFIXES = {"ttl": "turtle", "turtle": "turtle", "n3": "turtle", "trig": "turtle", "nt": "nt", "nq": "nquads", "nquads": "nquads", "rdf": "xml", "owl": "xml", "xml": "xml"}
_LINE, _BLANK = re.compile(rdf._LINE, re.ASCII), re.compile(rdf._BLANK_LINE)
_COLUMNS = [c.split()[0] for c in rdf.TRIPLE.split(", ")]
_SCHEMA = pa.schema([(c, pa.string()) for c in _COLUMNS])


@dataclass
class Range(InputPartition):
    """Lines that begin in a range of bytes of a file, or all of a document."""

    path: str
    fmt: str
    begin: int
    end: int


def _lines(file: pa.NativeFile, begin: int, end: int) -> Iterator[bytes]:
    """The lines that begin in [begin, end)."""
    at, rest = begin, b""
    if begin:  # a line that began before is the former range's, also one that ends just here
        file.seek(begin - 1)
        at, skip = begin - 1, True
    else:
        skip = False
    while at < end:
        piece = file.read(_READ)
        lines = (rest + piece).split(b"\n")
        rest = lines.pop()
        for line in lines:
            begins, at = at, at + len(line) + 1
            if skip:
                skip = False
                continue
            if begins >= end:
                return
            yield line
        if not piece:
            if rest and not skip and at < end:
                yield rest
            return


def line_triple(line: str, doc: str) -> tuple | None:
    """The triple of a line, None for a blank one or a comment; other lines are an error."""
    m = _LINE.match(line)
    if m is None:
        if _BLANK.match(line):
            return None
        raise rdf.RdfError(f"not a triple: {line}")
    node = lambda x: (rdf._unescape(x[1:-1]), "iri") if x[0] == "<" else (f"{doc}:{x[2:]}", "bnode")
    s, p, o = m[1], node(m[2])[0], m[3]
    if o[0] != '"':
        return (doc, *node(s), p, *node(o), None, None)
    lang = m[4].lower() if m[4] else None
    return (doc, *node(s), p, rdf._unescape(o[1:-1]), "literal", rdf.RDF + "langString" if lang else m[5] or rdf.XSD + "string", lang)


class RdfReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        if "path" not in options:
            raise ValueError("a path is asked for")
        self.path, self.fmt = options["path"], options.get("format")
        self.split = int(options.get("splitBytes", SPLIT))
        self.mode = options.get("mode", "failfast").lower()
        if self.mode not in ("failfast", "dropmalformed"):
            raise ValueError(f"no mode: {self.mode}")
        self.allowed: dict[str, set] = {}
        if options.get("predicates"):
            self.allowed["p"] = set(options["predicates"].split())

    def _files(self) -> list[tuple[str, int]]:
        system, path = fs.FileSystem.from_uri(self.path) if re.match(r"\w+:", self.path) else (fs.LocalFileSystem(), self.path)
        folder, _, name = path.rstrip("/").rpartition("/")
        if "*" in name:
            found = [f for f in system.get_file_info(fs.FileSelector(folder)) if fnmatch.fnmatch(f.base_name, name)]
        else:
            at = system.get_file_info(path)
            if at.type == fs.FileType.NotFound:
                raise FileNotFoundError(self.path)
            found = [at] if at.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path, recursive=True))
        return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))

    def partitions(self) -> list[Range]:
        out = []
        for path, size in self._files():
            fmt = self.fmt or _SUFFIXES.get(path.rpartition(".")[2].lower(), "turtle")
            step = self.split if fmt in ("nt", "nquads") else max(size, 1)
            out += [Range(path, fmt, at, min(at + step, size)) for at in range(0, size, step)]
        return out or [Range("", "nt", 0, 0)]

    def _rows(self, part: Range) -> Iterator[tuple]:
        if not part.path:
            return
        system = fs.FileSystem.from_uri(self.path)[0] if re.match(r"\w+:", self.path) else fs.LocalFileSystem()
        doc = part.path.rpartition("/")[2]
        drop = self.mode == "dropmalformed"
        with system.open_input_file(part.path) as file:
            if part.fmt not in ("nt", "nquads"):
                try:
                    rows, _ = rdf.parse(file.read().decode(), part.fmt)
                except (rdf.RdfError, UnicodeDecodeError) as e:
                    if drop:
                        return
                    raise rdf.RdfError(f"{doc}: {e}") from e
                blank = lambda x, kind: f"{doc}:{x}" if kind == "bnode" else x
                yield from {(doc, blank(s, sk), sk, p, blank(o, ok), ok, dt, lang): None for s, sk, p, o, ok, dt, lang in rows}
                return
            for line in _lines(file, part.begin, part.end):
                try:
                    row = line_triple(line.decode().rstrip("\r"), doc)
                except (rdf.RdfError, UnicodeDecodeError) as e:
                    if drop:
                        continue
                    raise rdf.RdfError(f"{doc}: {e}") from e
                if row:
                    yield row

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        tests = [(_COLUMNS.index(c), values) for c, values in self.allowed.items()]
        held: list[tuple] = []
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], schema=_SCHEMA)
        for row in self._rows(partition):
            if all(row[i] in values for i, values in tests):
                held.append(row)
                if len(held) >= _ROWS:
                    yield batch(held)
                    held = []
        if held:
            yield batch(held)


class PushingReader(RdfReader):
    """Applies filters for equal values while it reads; the others go back to Spark."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and isinstance(f.value, str):
                values = {f.value}
            elif isinstance(f, In) and len(f.attribute) == 1:
                values = {v for v in f.value if isinstance(v, str)}
            else:
                yield f
                continue
            column = f.attribute[0]
            self.allowed[column] = self.allowed[column] & values if column in self.allowed else values


class RdfSource(DataSource):
    """Triples (doc_id, s, s_kind, p, o, o_kind, o_dt, o_lang); blank nodes carry the name of their file."""

    @classmethod
    def name(cls) -> str:
        return "rdf"

    def schema(self) -> str:
        return rdf.TRIPLE

    def reader(self, schema) -> RdfReader:
        options = dict(self.options)
        return (PushingReader if options.get("pushdown", "false").lower() == "true" else RdfReader)(options)
