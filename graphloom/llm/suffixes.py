"""Repeated byte ranges by a logarithmic family of sparse suffix arrays.

Of each text the suffixes are sampled whose first GRAM bytes hash least among the starts of some LENGTH-byte
window (with room for HEAD bytes in it), so that equal windows, wherever they stand, sample the suffix at the
same place in them. A batch's suffix array is its sampled suffixes in the order of their first HEAD bytes, one
entry for all that agree in these, in buckets by the hash of those bytes: a bucket is sorted, and arrays with
the same buckets are merge-scanned side by side without a shuffle. Levels of the family are such arrays, each
larger than the next; a new batch is scanned against every level for heads that both hold, and arrays of
about equal size merge, so that an entry is rewritten a logarithm of the batches' number of times.

Suffixes with a repeated head are looked at in full. The windows that a suffix was sampled for are taken in
groups of up to SIZES[0] neighbouring starts, by the place of the suffix in them. What all windows of a group
share (its core) must be repeated for any of them to be, and where the text of the whole group stands again,
all are. Only groups between the two are taken apart, into smaller groups and then into single windows. Texts are compared by 128-bit hashes
that are counted map-side, so that a string of very many documents is one row of each task.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm._shared import drop, materialize, shared_dir
from graphloom.llm.passages import _seed_filter

#: Bytes of a string that must not repeat, bytes that suffixes are ordered by, bytes that decide on sampling.
LENGTH, HEAD, GRAM = 400, 64, 16
#: Neighbouring window starts that are judged at once, first and then where that doesn't decide.
SIZES = (48, 8, 1)
#: Batches that find_repeats() deals documents into.
BATCHES = 4
#: A table of asks or spans of documents is broadcast up to so many bytes; a larger one is an ordinary join.
SENT_BYTES = 32 << 20
#: Bytes of text that are scanned at once, and window starts of a piece of a longer text.
_PIECE = 1 << 18
#: Rows of an Arrow batch.
_ROWS = 1 << 16
_PLACE = np.uint64((1 << 22) - 1)


def _least(key: np.ndarray, width: int) -> np.ndarray:
    """The least of each width neighbours."""
    out, have = key, 1
    while 2 * have <= width:
        out, have = np.minimum(out[:-have], out[have:]), 2 * have
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def sample(raw: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffix, first, last): the sampled suffixes of texts that stand end to end, and the window starts each is sampled for.

    begin holds where texts begin, and the end. Of suffixes that hash alike in a window the first is taken.
    """
    left = np.repeat(begin[1:], np.diff(begin)) - np.arange(len(raw))
    starts = np.flatnonzero(left >= LENGTH)
    if not len(starts):
        return (np.zeros(0, np.int64),) * 3
    word = np.ndarray(len(raw) - 7, "<u8", raw.tobytes(), strides=(1,)).copy()
    h = word[:-8] * np.uint64(0x9E3779B97F4A7C15) + word[8:] * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    at = (_least(h, LENGTH - HEAD + 1)[starts] & _PLACE).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return at[first], starts[first], starts[np.concatenate([first[1:], [len(at)]]) - 1]


def column_bytes(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, offset, bytes, where texts begin and the end) of a column of texts, some at a time; nulls are empty.

    A long text comes in pieces from its offset on, which share LENGTH - 1 bytes: no window start is in two.
    """
    column = column.cast(pa.large_string()).fill_null("")
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(off, off[a] + _PIECE, "right")) - 1)
        if b > a + 1 or off[b] - off[a] <= _PIECE:
            yield a, 0, data[off[a] : off[b]], off[a : b + 1] - off[a]
        else:
            for at in range(0, int(off[b] - off[a]) - LENGTH + 1, _PIECE):
                piece = data[off[a] + at : min(off[a] + at + _PIECE + LENGTH - 1, off[b])]
                yield a, at, piece, np.array([0, len(piece)])
        a = b


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as a binary column."""
    ends = np.arange(0, (len(rows) + 1) * rows.shape[1], rows.shape[1], dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(rows))])


def _head_keys(heads: np.ndarray) -> np.ndarray:
    """64-bit hashes of heads, rows of HEAD bytes."""
    words, k = np.ascontiguousarray(heads).view("<u8").reshape(len(heads), HEAD // 8), np.zeros(len(heads), np.uint64)
    for i in range(HEAD // 8):
        k = (k + words[:, i]) * np.uint64(0x9E3779B97F4A7C15)
        k ^= k >> np.uint64(31)
    return k


def suffixes(docs: DataFrame) -> DataFrame:
    """(head, y): the heads of the sampled suffixes of docs (y, text)."""
    schema = pa.schema([("head", pa.binary()), ("y", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            for first, _, raw, begin in column_bytes(b.column(1)):
                at = sample(raw, begin)[0]
                for x in range(0, len(at), _ROWS):
                    p = at[x : x + _ROWS]
                    row = first + np.searchsorted(begin, p, "right") - 1
                    yield pa.RecordBatch.from_arrays([_binary(raw[p[:, None] + np.arange(HEAD)]), pa.array(ids[row])], schema=schema)

    return docs.select("y", "text").mapInArrow(scan, "head binary, y bigint")


class Family:
    """Suffix arrays of the texts so far: tables (head, n, doc) in buckets, sorted by head, each larger than the next.

    n suffixes have the head, doc is the smallest document with one. Tables stand in the shared folder;
    a lost executor loses nothing of them.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.buckets = spark, int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[tuple[str, str, int]] = []  # table, path, entries

    def _write(self, entries: DataFrame) -> tuple[str, str, int]:
        name = f"graphloom_suffixes_{uuid.uuid4().hex}"
        path = f"{shared_dir(self.spark)}/graphloom/{name}"
        entries.write.bucketBy(self.buckets, "head").sortBy("head").option("path", path).saveAsTable(name)
        return name, path, self.spark.table(name).count()

    def _drop(self, level: tuple[str, str, int]) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {level[0]}")
        gone = self.spark.range(0)
        gone._graphloom_path = level[1]
        drop(gone)

    def add(self, docs: DataFrame) -> DataFrame:
        """(head), written: heads of docs (y, text) that repeat in them or stand in a level; then docs are part of the family."""
        own = self._write(suffixes(docs).groupBy("head").agg(F.count("*").alias("n"), F.min("y").alias("doc")))
        batch = self.spark.table(own[0])
        found = batch.where("n > 1").select("head")
        for name, _, _ in self.levels:
            found = found.unionByName(batch.join(self.spark.table(name).select("head"), "head", "left_semi").select("head"))
        found = materialize(found.distinct(), "heads")
        while self.levels and self.levels[-1][2] < 2 * own[2]:
            level = self.levels.pop()
            a, b = self.spark.table(level[0]).alias("a"), self.spark.table(own[0]).alias("b")
            zero = F.lit(0).cast("bigint")
            merged = a.join(b, F.col("a.head") == F.col("b.head"), "full_outer").select(
                F.coalesce("a.head", "b.head").alias("head"), (F.coalesce("a.n", zero) + F.coalesce("b.n", zero)).alias("n"), F.least("a.doc", "b.doc").alias("doc")
            )
            before, own = own, self._write(merged)
            self._drop(level)
            self._drop(before)
        self.levels.append(own)
        return found

    def close(self) -> None:
        for level in self.levels:
            self._drop(level)
        self.levels = []


def _filter(spark: SparkSession, heads: DataFrame):
    """A broadcast filter of the heads, of bounded size, or None where they are too many for it: then all suffixes are looked at."""
    slots = 16

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                k = _head_keys(np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint8).reshape(-1, HEAD)) & _mask(slots)
                shift = np.uint64(slots.bit_length() - 1)
                yield pa.RecordBatch.from_arrays([pa.array((k & np.uint64(slots - 1)).astype(np.int32)), pa.array((k >> shift).astype(np.int64))], ["slot", "key"])

    return slots, _seed_filter(heads.mapInArrow(keyed, "slot int, key bigint"), slots)


def _mask(slots: int) -> np.uint64:
    return np.uint64((slots << 32) - 1)


_ENTRY = "y bigint, core binary, whole binary, n int, first int, last int, suffix int, spans binary"
_ENTRY_SCHEMA = pa.schema([("y", pa.int64()), ("core", pa.binary()), ("whole", pa.binary()), ("n", pa.int32()), ("first", pa.int32()), ("last", pa.int32()), ("suffix", pa.int32()), ("spans", pa.binary())])


def _described(ids: list, base: list, text: bytes | memoryview, p: np.ndarray, first: np.ndarray, last: np.ndarray, of: np.ndarray, size: int) -> Iterator[pa.RecordBatch]:
    """_ENTRY of the groups of size windows among those of suffixes p: starts that are size * g to size * g + size - 1 before p.

    of is each suffix's document, as a place in ids and in base, which is added to its places in text. A row
    is one text of a group, however often a document has it here (n, and all its starts in spans, pairs of
    first and last); first, last and suffix are of one of them.
    """
    digest = xxhash.xxh3_128_digest
    low = (p - last) // size
    times = (p - first) // size - low + 1
    up = np.repeat(np.arange(len(p)), times)
    g = np.arange(len(up)) - np.repeat(np.cumsum(times) - times, times) + low[up]
    core = p[up] - size * g
    a, z = np.maximum(first[up], core - size + 1), np.minimum(last[up], core)
    held: dict[tuple[int, bytes], list] = {}
    for r, x, y, k, c, q in zip(of[up].tolist(), a.tolist(), z.tolist(), g.tolist(), core.tolist(), p[up].tolist(), strict=True):
        # the place of the suffix in its windows is a part of what is compared
        whole = digest(b"%d %d " % (q - x, q - y) + text[x : y + LENGTH])
        one = held.get((r, whole))
        if one is None:
            held[r, whole] = [whole if size == 1 else digest(b"%d " % k + text[c : c + LENGTH - size + 1]), x, y, q, [x, y]]
        else:
            one[4] += [x, y]
    items = list(held.items())
    for at in range(0, len(items), _ROWS):
        part = [(ids[r], base[r], w, v) for (r, w), v in items[at : at + _ROWS]]
        columns = (
            [y for y, *_ in part], [v[0] for *_, v in part], [w for _, _, w, _ in part], [len(v[4]) // 2 for *_, v in part],
            [v[1] + m for _, m, _, v in part], [v[2] + m for _, m, _, v in part], [v[3] + m for _, m, _, v in part],
            [(np.array(v[4], np.int64) + m).astype("<i4").tobytes() for _, m, _, v in part],
        )
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ENTRY_SCHEMA, strict=True)], schema=_ENTRY_SCHEMA)


def _groups(docs: DataFrame, size: int, slots: int, known) -> DataFrame:
    """_ENTRY of docs (y, text): groups of windows of suffixes whose head is known to repeat."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            for at, offset, raw, begin in column_bytes(b.column(1)):
                p, first, last = sample(raw, begin)
                if known is not None and len(p):
                    on = np.concatenate([known.value.levels(_head_keys(raw[p[x : x + _ROWS, None] + np.arange(HEAD)]) & _mask(slots)) > 0 for x in range(0, len(p), _ROWS)])
                    p, first, last = p[on], first[on], last[on]
                if len(p):
                    yield from _described(ids[at : at + len(begin) - 1], (offset - begin[:-1]).tolist(), raw.tobytes(), p, first, last, np.searchsorted(begin, p, "right") - 1, size)

    return docs.select("y", "text").mapInArrow(scan, _ENTRY)


def _parts(docs: DataFrame, asked: DataFrame, size: int) -> DataFrame:
    """_ENTRY of the asked groups (y, held: first, last and suffix of each), taken apart into smaller ones."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for y, text, held in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                raw = text.as_buffer().to_pybytes()
                asks = np.frombuffer(held, "<i4").reshape(-1, 3).astype(np.int64)
                for x in range(0, len(asks), _ROWS):
                    first, last, p = asks[x : x + _ROWS].T
                    yield from _described([y], [0], raw, p, first, last, np.zeros(len(p), np.int64), size)

    return attached(docs, asked, "inner").select("y", "text", "held").mapInArrow(scan, _ENTRY)


def attached(docs: DataFrame, packed: DataFrame, how: str) -> DataFrame:
    """docs (y, text) with what belongs to them, packed (y, held binary) and written: broadcast up to SENT_BYTES, else shuffled by y."""
    size = packed.agg(F.coalesce(F.sum(F.octet_length("held")), F.lit(0)) + 64 * F.count("*")).first()[0]
    return docs.join(F.broadcast(packed) if size <= SENT_BYTES else packed, "y", how)


def _pack(spans: DataFrame) -> DataFrame:
    """(y, held): all spans (binary) of a document end to end; a document has no more than its windows."""
    return spans.groupBy("y").agg(F.expr("cast(unhex(array_join(collect_list(hex(spans)), '')) as binary)").alias("held"))


def _joined(packed: DataFrame) -> DataFrame:
    """packed (y, held) with spans that touch or overlap made one."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for held in b.column(1).to_pylist():
                x = runs(np.frombuffer(held, "<i4").reshape(-1, 2), 1, None)
                out.append(np.stack([x[:, 0], x[:, 1] - 1], 1).astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["y", "held"])

    return packed.mapInArrow(join, "y bigint, held binary")


def runs(spans: np.ndarray, length: int, size: int | None) -> np.ndarray:
    """The maximal runs (from, to exclusive) that strings of so many bytes cover, from spans (first, last start) in any order, up to size."""
    if not len(spans):
        return np.zeros((0, 2), np.int64)
    a, z = spans[:, 0].astype(np.int64), spans[:, 1].astype(np.int64) + length
    order = np.argsort(a, kind="stable")
    a, z = a[order], np.maximum.accumulate(z[order])
    first = np.flatnonzero(np.concatenate([[True], a[1:] > z[:-1]]))
    out = np.stack([a[first], z[np.concatenate([first[1:], [len(a)]]) - 1]], 1)
    return out if size is None else np.minimum(out, size)


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(y, doc_id, text) with a distinct y for each row: the id where ids are distinct and none is null, else a number in a written copy."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    n, held, distinct = rows.agg(F.count("*"), F.count("doc_id"), F.count_distinct("doc_id")).first()
    if n == held == distinct:
        return rows.select(F.col("doc_id").alias("y"), "doc_id", "text")
    return materialize(rows.select(F.monotonically_increasing_id().alias("y"), "doc_id", "text"), "numbered")


def repeated_spans(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """(y, held), written: the window starts (pairs of first and last, int32) of docs (y, text) whose LENGTH bytes stand elsewhere too."""
    spark = docs.sparkSession
    family = Family(spark)
    heads = None
    try:
        for i in range(batches):
            found = family.add(docs.where(F.pmod(F.xxhash64("y"), F.lit(batches)) == i))
            heads = found if heads is None else heads.unionByName(found)
    finally:
        family.close()
    slots, known = _filter(spark, heads.distinct())
    found, asked = [], None
    for size in SIZES:
        entries = materialize(_groups(docs, size, slots, known) if asked is None else _parts(docs, asked, size), "groups")
        drop(asked)
        texts = materialize(entries.groupBy("core", "whole").agg(F.sum("n").alias("n"), *[F.first(c).alias(c) for c in ("y", "first", "last", "suffix")]), "texts")
        again = entries.select("y", "whole", "spans").join(texts.where("n > 1").select("whole"), "whole", "left_semi")
        found.append(materialize(again.select("y", "spans"), "again"))
        drop(entries)
        if size > 1:
            # cores that groups with different texts share: one group of each text is taken apart
            open_ = texts.groupBy("core").agg(F.count("*").alias("texts")).where("texts > 1").select("core")
            asked = materialize(_pack(texts.join(open_, "core", "left_semi").select("y", _ints("first", "last", "suffix").alias("spans"))), "asked")
        drop(texts)
    if known is not None:
        known.unpersist()
    out = materialize(_joined(_pack(reduce(DataFrame.unionByName, found))), "spans")
    for x in found:
        drop(x)
    return out


def _ints(*names: str) -> Column:
    """Ints as bytes, four of each, the low ones first."""
    low_first = lambda c: F.expr("concat(substr(x, 7, 2), substr(x, 5, 2), substr(x, 3, 2), substr(x, 1, 2))".replace("x", f"lpad(hex({c}), 8, '0')"))
    return F.unhex(F.concat(*[low_first(c) for c in names]))


RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<bigint>"


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES) -> DataFrame:
    """One row a document: what is left of its UTF-8 bytes without those that a LENGTH-byte string covers which also starts elsewhere.

    RESULT: bytes, removed bytes, maximal removed runs (n_spans, and in spans their from and to), and the
    SHA-256 of the other bytes end to end. A string that overlaps itself counts, in other documents and in
    the same one; no match crosses documents, and all are judged on the texts as given. Null texts are
    empty; a text shorter than LENGTH loses nothing. Rows that repeat an id, null ids too, are documents of
    their own, so that equal ones lose all. Other columns are ignored.
    """
    rows = numbered(docs, id_col, text_col)
    spans = repeated_spans(rows.select("y", "text"), batches)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.int64()))])

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            out: list[tuple] = []
            for doc, text, held in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                raw = memoryview(text.as_buffer()) if text.is_valid else memoryview(b"")
                gone = runs(np.frombuffer(held or b"", "<i4").reshape(-1, 2), LENGTH, len(raw))
                kept, at = hashlib.sha256(), 0
                for a, z in gone.tolist():
                    kept.update(raw[at:a])
                    at = z
                kept.update(raw[at:])
                out.append((doc, len(raw), int((gone[:, 1] - gone[:, 0]).sum()), len(gone), kept.hexdigest(), gone.ravel().tolist()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * len(schema), schema, strict=True)], schema=schema)

    return attached(rows, spans, "left").select("doc_id", "text", "held").mapInArrow(cut, RESULT)


#: The query over `documents` as DuckDB SQL: every window by itself.
ORACLE = """
WITH d AS (SELECT row_number() OVER () AS y, doc_id, encode(coalesce(text, '')) AS b FROM documents),
h AS (SELECT y, doc_id, b, octet_length(b) AS n FROM d),
w AS (SELECT y, s, hash(b[s + 1 : s + 400]) AS k FROM (SELECT y, b, unnest(range(greatest(n - 399, 0))) AS s FROM h)),
f AS (SELECT y, s FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
g AS (SELECT y, s, sum(fresh) OVER (PARTITION BY y ORDER BY s) AS run FROM (SELECT y, s, CASE WHEN s > lag(s) OVER (PARTITION BY y ORDER BY s) + 400 THEN 1 ELSE 0 END AS fresh FROM f)),
r AS (SELECT y, min(s) AS a, max(s) + 400 AS z FROM g GROUP BY y, run),
p AS (SELECT y, lag(z, 1, 0) OVER (PARTITION BY y ORDER BY a) AS x, a AS e FROM r UNION ALL SELECT y, max(z), NULL FROM r GROUP BY y),
q AS (SELECT h.y, string_agg(hex(b[coalesce(x, 0) + 1 : coalesce(e, n)]), '' ORDER BY x) AS kept FROM h LEFT JOIN p ON p.y = h.y GROUP BY h.y),
c AS (SELECT y, sum(z - a) AS removed, count(*) AS spans FROM r GROUP BY y)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(kept)) AS kept_sha256
FROM h JOIN q USING (y) LEFT JOIN c USING (y)"""
