"""Whitening of embeddings by a tiled covariance.

Entries are integers (floor of SCALE times the value, plus SHIFT). Dimensions are cut into tiles, and a pair
of tiles is a key: a block of rows sends each of its column blocks to the keys that need it, where the two
blocks of a pair are multiplied, and the products are summed per key. A task holds the blocks of one row
block and pair at a time, and sums are added up map-side, so neither rows nor tiles meet in one place.

Columns are centred before they are multiplied: by the whole number m nearest to the mean, which keeps every
product exact. With D = S - n * m, the sum of all centred entries of a column, n * n * V = n * G - D D' is the
exact covariance, of which each entry is rounded once. Sums are exact, so a rerun gives the same bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from graphloom.llm._shared import materialize

#: How values become whole numbers.
SCALE, SHIFT = 1024, 100_000
#: Components at most.
COMPONENTS = 8
#: Dimensions of a tile and rows of a block.
TILE, BLOCK = 32, 4096
#: Dimensions at most: the covariance is assembled and decomposed on the driver, eight bytes for each pair.
MOST_DIMENSIONS = 2048
#: Eigenvalues below this share of the largest are zero: their components have no direction to tell.
_RANK = 1e-12


def usable(column: str) -> Column:
    """Whether a vector is neither null nor empty and holds neither nulls nor values that aren't finite."""
    x = F.col(column)
    finite = lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) != float("inf"))
    return x.isNotNull() & (F.size(x) > 0) & F.forall(x, finite)


def _whole(columns: pa.Array, dims: int) -> np.ndarray:
    """The vectors of a list column as rows of whole numbers."""
    values = np.asarray(columns.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dims)
    scaled = np.floor(SCALE * values)
    if np.abs(scaled).max(initial=0) > 2.0**48:
        raise ArithmeticError("a value is too large to be a whole number")
    return scaled.astype(np.int64) + SHIFT


def _dims(vectors: DataFrame, column: str) -> int:
    """How many dimensions all vectors have; 0 if there are none."""
    low, high = vectors.agg(F.min(F.size(column)), F.max(F.size(column))).first()
    if low != high:
        raise ValueError(f"vectors have between {low} and {high} dimensions")
    if (low or 0) > MOST_DIMENSIONS:
        raise ValueError(f"{low} dimensions; at most {MOST_DIMENSIONS} are decomposed")
    return low or 0


def column_sums(vectors: DataFrame, column: str, dims: int) -> tuple[int, list[int]]:
    """(rows, the exact sum of each dimension), added up in each task first."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * dims
        for b in batches:
            x = _whole(b.column(0), dims)
            n += len(x)
            total = [t + int(s) for t, s in zip(total, x.sum(0), strict=True)]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n, *total], pa.int64()), pa.array(range(-1, dims), pa.int32())], ["v", "i"])

    found = {r.i: int(r.v) for r in vectors.select(column).mapInArrow(add, "v bigint, i int").groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()}
    return found.get(-1, 0), [found.get(i, 0) for i in range(dims)]


def tile_products(vectors: DataFrame, column: str, dims: int, centre: list[int]) -> np.ndarray:
    """G, as objects: the exact sums of products of each two dimensions, centred by whole numbers.

    The shuffle is by row block and pair of tiles; a column block goes to as many keys as there are tiles.
    """
    tiles = -(-dims // TILE)
    cut = lambda x, t: x[:, t * TILE : (t + 1) * TILE]
    schema = pa.schema([("block", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("left", pa.bool_()), ("entries", pa.binary())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        nr, held = (TaskContext.get().partitionId() << 32), []

        def sent() -> Iterator[pa.RecordBatch]:
            nonlocal nr, held
            x = np.concatenate(held) - np.array(centre, np.int64)
            for at in range(0, len(x), BLOCK):
                y = x[at : at + BLOCK]
                narrow = "<i4" if np.abs(y).max() < 1 << 31 else "<i8"
                part = [narrow[2:].encode() + np.ascontiguousarray(cut(y, t)).astype(narrow).tobytes() for t in range(tiles)]
                rows = [(nr, i, j, left, part[i if left else j]) for i in range(tiles) for j in range(i, tiles) for left in ((True, False) if i != j else (True,))]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                nr += 1
            held = []

        for b in batches:
            held.append(_whole(b.column(0), dims))
            if sum(map(len, held)) >= BLOCK:
                yield from sent()
        if held and sum(map(len, held)):
            yield from sent()

    def matrix(raw: bytes, t: int) -> np.ndarray:
        return np.frombuffer(raw, f"<i{raw[:1].decode()}", offset=1).reshape(-1, min(TILE, dims - t * TILE)).astype(np.int64)

    def multiply(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        _, i, j = (int(k) for k in key)
        by = {bool(r.left): r.entries for r in group.itertuples(index=False)}
        a = matrix(by[True], i)
        b = a if i == j else matrix(by[False], j)
        if float(np.abs(a).max()) * float(np.abs(b).max()) * len(a) < 2.0**53:
            g = np.rint(a.T.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)  # exact: no sum leaves the whole numbers of a double
        elif float(np.abs(a).max()) * float(np.abs(b).max()) * len(a) < 2.0**62:
            g = a.T @ b
        else:
            raise ArithmeticError("products are too large for 64 bits")
        return pd.DataFrame({"i": i, "j": j, "at": np.arange(g.size), "g": g.ravel()})

    blocks = vectors.select(column).mapInArrow(deal, "block bigint, i int, j int, left boolean, entries binary")
    products = blocks.groupBy("block", "i", "j").applyInPandas(multiply, "i int, j int, at int, g bigint")
    sums = products.groupBy("i", "j", "at").agg(F.sum(F.col("g").cast("decimal(38,0)")).alias("g"))
    out = np.zeros((dims, dims), object)
    for r in sums.toLocalIterator():
        wide = min(TILE, dims - r.j * TILE)
        p, q = r.i * TILE + r["at"] // wide, r.j * TILE + r["at"] % wide
        out[p, q] = out[q, p] = int(r.g)
    return out


def covariance(products: np.ndarray, n: int, rest: list[int]) -> np.ndarray:
    """V, each entry rounded once: (n * G - D D') / n^2."""
    d = len(rest)
    return np.array([[(n * products[i, j] - rest[i] * rest[j]) / (n * n) for j in range(d)] for i in range(d)]).reshape(d, d)


def components(v: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(directions as columns, eigenvalues, shares of the trace) by falling eigenvalue; a direction's largest entry is positive.

    Where an eigenvalue is zero, so is the direction.
    """
    e, p = np.linalg.eigh(v)
    order = np.argsort(-e, kind="stable")[:most]
    e, p = e[order], p[:, order]
    p = p * np.where(np.take_along_axis(p, np.abs(p).argmax(0)[None], 0) < 0, -1.0, 1.0)
    none = e <= _RANK * max(e.max(initial=0), 0)
    trace = float(np.trace(v))
    return np.where(none, 0.0, p), np.where(none, 0.0, e), np.where(none, 0.0, e) / (trace if trace > 0 else 1.0)


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): each row on each of the first components.

    Rows whose vector is null, empty, or holds nulls or values that aren't finite are left out; all others
    are fitted and returned, also those with a null or a repeated id. n rows; deviation is the exact sum over
    dimensions of (n * x - S)^2, and its not fitting 64 bits is an error. A component without variance
    gives 0 everywhere, as one row or equal rows do, and is left out of identity_error. No rows give none.
    Vectors of several lengths are an error. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.where(usable(vector_col)).select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).alias("v"))
    schema = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    dims = _dims(rows, "v")
    if not dims:
        return spark.createDataFrame([], schema)
    n, sums = column_sums(rows, "v", dims)
    centre = [(2 * s + n) // (2 * n) for s in sums]
    v = covariance(tile_products(rows, "v", dims, centre), n, [s - n * m for s, m in zip(sums, centre, strict=True)])
    p, e, share = components(v, most)
    k = len(e)
    onto = p / np.where(e > 0, np.sqrt(np.where(e > 0, e, 1.0)), 1.0)
    total = np.array(sums, np.int64)
    out = pa.schema([("vec_id", pa.int64()), ("deviation", pa.int64()), ("w", pa.list_(pa.float64()))])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _whole(b.column(1), dims)
            if float(np.abs(x).max(initial=0)) * n >= 2.0**62:
                raise ArithmeticError("entries are too large for 64 bits")
            y = x * n - total
            if ((y.astype(np.float64) ** 2).sum(1) >= 2.0**63).any():
                raise ArithmeticError("a deviation doesn't fit 64 bits")
            w = (y / n) @ onto
            ends = pa.array(np.arange(0, (len(x) + 1) * k, k, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array((y * y).sum(1)), pa.ListArray.from_arrays(ends, pa.array(w.ravel()))], schema=out)

    done = materialize(rows.mapInArrow(project, "vec_id bigint, deviation bigint, w array<double>"), "whitened")
    error = identity_error(done, "w", [i for i in range(k) if e[i] > 0])
    shares = F.array(*[F.lit(float(x)) for x in share])
    return done.select("vec_id", "deviation", F.posexplode("w").alias("c", "whitened")).select(
        "vec_id", (F.col("c") + 1).alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation", "whitened", F.get(shares, F.col("c")).alias("explained"), F.lit(float(error)).alias("identity_error")
    )


def identity_error(rows: DataFrame, column: str, among: list[int]) -> float:
    """The largest absolute entry of the covariance of a column of vectors minus the identity, over these entries; centred, divisor n."""
    if not among:
        return 0.0
    w = lambda i: F.get(F.col(column), F.lit(i)).cast(DoubleType())
    mean = rows.agg(*[F.avg(w(i)).alias(f"m{i}") for i in among]).first()
    pairs = [(i, j) for i in among for j in among if i <= j]
    found = rows.agg(*[F.avg((w(i) - mean[f"m{i}"]) * (w(j) - mean[f"m{j}"])).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(found[f"c{i}_{j}"] - (i == j)) for i, j in pairs)
