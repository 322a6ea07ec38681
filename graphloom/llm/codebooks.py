"""Vector codes by small codebooks, one for each part of a vector.

Each round broadcasts a kd-tree per codebook, of at most ENTRIES entries, and every part looks for its nearest
entry by branch and bound, many vectors at a time: a node is left out only if its box is farther than the best
entry so far, so that boxes at an equal distance are visited and the least index of the nearest entries is
kept. All is in whole numbers. New entries come from sums that are added up in each task and then over the
tasks, so that a vector of very many rows is one sum of each task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm._shared import materialize
from graphloom.llm.whitening import usable

#: How values become whole numbers; parts of a vector, entries of a codebook, rounds.
SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
#: Entries of a leaf of the tree.
LEAF = 8
#: Vectors that are looked up at once.
_ROWS = 1 << 14
#: Whole numbers are below this, so that squared distances fit 64 bits.
_LARGEST = 1 << 28


class Tree:
    """A kd-tree over the entries of a codebook (rows of whole numbers)."""

    def __init__(self, entries: np.ndarray, leaf: int = LEAF):
        self.entries = entries
        self.nodes: list[tuple] = []  # (low, high, ids) of leaves, (low, high, axis, split, left, right) of others
        self._grow(np.arange(len(entries)), leaf)

    def _grow(self, ids: np.ndarray, leaf: int) -> int:
        x = self.entries[ids]
        low, high, at = x.min(0), x.max(0), len(self.nodes)
        self.nodes.append(())
        axis = int((high - low).argmax())
        if len(ids) <= leaf or low[axis] == high[axis]:
            self.nodes[at] = (low, high, np.sort(ids))
        else:
            order = ids[np.argsort(x[:, axis], kind="stable")]
            split = self.entries[order[(len(order) - 1) // 2], axis]
            if split == high[axis]:  # equal values stay together, and neither side is empty
                split = np.sort(x[:, axis])[np.sort(x[:, axis]) < split][-1]
            under = self.entries[ids, axis] <= split
            self.nodes[at] = (low, high, axis, split, self._grow(ids[under], leaf), self._grow(ids[~under], leaf))
        return at

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry of each row; of several the least index."""
        best = np.full(len(x), np.iinfo(np.int64).max)
        index = np.full(len(x), len(self.entries))
        self._visit(0, np.arange(len(x)), x, best, index)
        return index, best

    def _visit(self, at: int, rows: np.ndarray, x: np.ndarray, best: np.ndarray, index: np.ndarray) -> None:
        low, high, *rest = self.nodes[at]
        off = np.maximum(np.maximum(low - x[rows], x[rows] - high), 0)
        rows = rows[(off * off).sum(1) <= best[rows]]
        if not len(rows):
            return
        if len(rest) == 1:
            ids = rest[0]
            apart = x[rows][:, None] - self.entries[ids][None]
            far = (apart * apart).sum(2)
            pick = far.argmin(1)  # ids ascend: the first is the least index
            d, i = far[np.arange(len(rows)), pick], ids[pick]
            nearer = (d < best[rows]) | ((d == best[rows]) & (i < index[rows]))
            best[rows[nearer]], index[rows[nearer]] = d[nearer], i[nearer]
            return
        axis, split, left, right = rest
        under = x[rows, axis] <= split
        near_left, near_right = rows[under], rows[~under]
        self._visit(left, near_left, x, best, index)
        self._visit(right, near_right, x, best, index)
        self._visit(right, near_left, x, best, index)
        self._visit(left, near_right, x, best, index)


def _whole(column: pa.Array, dims: int) -> np.ndarray:
    """Vectors as rows of whole numbers: floor of SCALE times each value."""
    x = np.floor(SCALE * np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)).reshape(-1, dims)
    if np.abs(x).max(initial=0) >= _LARGEST:
        raise ArithmeticError("a value is too large for a code")
    return x.astype(np.int64)


def _gathered(batches: Iterator[pa.RecordBatch], column: int, dims: int) -> Iterator[tuple[list[pa.RecordBatch], np.ndarray]]:
    """Batches in portions of about _ROWS rows, with their vectors."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= _ROWS:
            yield held, np.concatenate([_whole(x.column(column), dims) for x in held])
            held = []
    if sum(x.num_rows for x in held):
        yield held, np.concatenate([_whole(x.column(column), dims) for x in held])


def _first(rows: DataFrame, parts: int, entries: int, dims: int) -> np.ndarray:
    """The first codebooks (part, entry, place): the vectors of the smallest ids; a bounded number of rows."""
    found = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    x = np.floor(SCALE * np.array([[float(c) for c in r.v] for r in found], np.float64))
    if np.abs(x).max(initial=0) >= _LARGEST:
        raise ArithmeticError("a value is too large for a code")
    return x.astype(np.int64).reshape(len(found), parts, dims // parts).transpose(1, 0, 2)


def _moved(rows: DataFrame, books: np.ndarray, dims: int) -> np.ndarray:
    """The codebooks after one round: the floor of the mean of each entry's parts; unused entries stay."""
    parts, entries, wide = books.shape
    trees = rows.sparkSession.sparkContext.broadcast([Tree(b) for b in books])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts * entries, wide + 1), object)
        some = False
        for _, x in _gathered(batches, 0, dims):
            some = True
            for p, tree in enumerate(trees.value):
                y = x[:, p * wide : (p + 1) * wide]
                at, _ = tree.nearest(y)
                sums = np.zeros((entries, wide + 1), np.int64)
                np.add.at(sums, at, np.concatenate([y, np.ones((len(y), 1), np.int64)], 1))
                total[p * entries : (p + 1) * entries] += sums
        if some:
            for at in np.flatnonzero(total[:, wide]).tolist():
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([[int(v) for v in total[at]]], pa.list_(pa.int64()))], ["at", "sums"])

    sums = [F.sum(F.get("sums", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in range(wide + 1)]
    out = books.copy()
    for r in rows.select("v").mapInArrow(add, "at int, sums array<bigint>").groupBy("at").agg(*sums).collect():
        *s, n = (int(r[f"s{i}"]) for i in range(wide + 1))
        out[r["at"] // entries, r["at"] % entries] = [v // n for v in s]
    trees.unpersist()
    return out


def train(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (part, entry, place) of rows (vec_id, v) with usable vectors; (parts, 0, 0) if there are none."""
    low, high = rows.agg(F.min(F.size("v")), F.max(F.size("v"))).first()
    if low is None:
        return np.zeros((parts, 0, 0), np.int64)
    if low != high or low % parts:
        raise ValueError(f"vectors have between {low} and {high} dimensions; one number of them that {parts} divides is asked for")
    books = _first(rows, parts, entries, low)
    for _ in range(rounds):
        books = _moved(rows, books, low)
    return books


def encode(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """rows with code (two hex digits a part) and error (the sum of the parts' squared distances) in place of v."""
    parts, entries, wide = books.shape
    if entries > 256:
        raise ValueError("an index has two hex digits")
    trees = rows.sparkSession.sparkContext.broadcast([Tree(b) for b in books])
    keep = [f for f in rows.schema if f.name != "v"]
    order = [f.name for f in keep]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, x in _gathered(batches, len(order), parts * wide):
            at, far = zip(*(t.nearest(x[:, p * wide : (p + 1) * wide]) for p, t in enumerate(trees.value)), strict=True)
            text, error, done = np.stack(at, 1).astype(np.uint8), np.sum(far, 0), 0
            for b in held:
                n = b.num_rows
                codes = [r.tobytes().hex() for r in text[done : done + n]]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(codes, pa.string()), pa.array(error[done : done + n])], [*order, "code", "error"])
                done += n

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), "code string", "error bigint"])
    return rows.select(*order, "v").mapInArrow(code, schema)


def digest(books: np.ndarray) -> str:
    """The SHA-256 of all entries' components in decimal, by part, entry and place."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) of each usable vector.

    Rows whose vector is null, empty, or holds nulls or values that aren't finite are left out; all others
    are in the codebooks' sums and are encoded, also those with a null or a repeated id. Codebooks start
    from the smallest ids, null ones last, equal ones by their vectors; with fewer rows than entries there
    are as many entries as rows. label_error is the error summed over equal labels, nulls together; sums are
    made in each task first and joined back, so that one label of very many rows is an ordinary skewed join.
    No rows give none. Vectors of several lengths, or of one that the parts don't divide, are an error, as
    are values of a million or more. Other columns are ignored.
    """
    rows = vectors.where(usable(vector_col)).select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    books = train(rows)
    if not books.size:
        return rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error"), F.lit(0).cast("bigint").alias("label_error"), F.lit("").alias("codebooks_sha256")).where("false")
    coded = materialize(encode(rows, books), "codes")
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "label", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _oracle() -> str:
    """The same in whole numbers of SQL: all distances, and the least of distance * ENTRIES + index."""
    far = " + ".join(f"(r.x[{i}] - b.x[{i}]) * (r.x[{i}] - b.x[{i}])" for i in range(1, 5))
    assign = lambda book: f"SELECT r.k, r.p, min(({far}) * {ENTRIES} + b.e) AS best FROM parts r JOIN {book} b ON r.p = b.p GROUP BY r.k, r.p"
    floor = lambda i: f"CAST((sum(r.x[{i}]) - ((sum(r.x[{i}]) % count(*) + count(*)) % count(*))) // count(*) AS BIGINT)"
    move = lambda book, a: f"SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM {book} b LEFT JOIN (SELECT r.p, a.best % {ENTRIES} AS e, [{', '.join(floor(i) for i in range(1, 5))}] AS x FROM parts r JOIN {a} a ON r.k = a.k AND r.p = a.p GROUP BY r.p, a.best % {ENTRIES}) m ON m.p = b.p AND m.e = b.e"
    return f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS k, vec_id, label, list_transform(embedding, lambda c: CAST(floor({SCALE} * CAST(c AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
parts AS (SELECT k, CAST(p AS INTEGER) AS p, v[p * 4 + 1 : p * 4 + 4] AS x FROM kept, range({PARTS}) t(p)),
b0 AS (SELECT p, CAST(k - 1 AS INTEGER) AS e, x FROM parts WHERE k <= {ENTRIES}),
a0 AS ({assign("b0")}), b1 AS ({move("b0", "a0")}), a1 AS ({assign("b1")}), b2 AS ({move("b1", "a1")}), a2 AS ({assign("b2")}),
coded AS (SELECT k, string_agg(printf('%02x', best % {ENTRIES}), '' ORDER BY p) AS code, CAST(sum(best // {ENTRIES}) AS BIGINT) AS error FROM a2 GROUP BY k),
sha AS (SELECT sha256(string_agg(x[1] || ',' || x[2] || ',' || x[3] || ',' || x[4], ',' ORDER BY p, e)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM kept JOIN coded USING (k), sha"""


#: The query over `embeddings` as DuckDB SQL.
ORACLE = _oracle()
