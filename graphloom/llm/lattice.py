"""Near-duplicate embeddings by hashing to the E8 lattice.

Each table projects vectors by a random matrix to a few blocks of eight coordinates and decodes each
block to the nearest point of the lattice E8; the points together name a cell. A vector stands in its
own cell and visits the cells of its next nearest lattice points; where one meets another, their
cosine is taken exactly. Equal vectors are one. What a cell finds is counted and kept as a spanning
forest, never emitted as pairs; crowded cells are dealt out as pairs of parts.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from graphloom.llm._shared import connected_components, frames, groups, materialize

TABLES, BLOCKS, PROBES = 6, 3, 6
#: The side that unit vectors' projections are divided by: at cosine 0.95 a pair meets in some table 99 times in 100.
SIDE = 2.75
#: A crowded cell is split into parts of about this many.
PART = 2048


def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for s, t in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = s, t
            out.append(v)
    out += [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


ROOTS = _roots()


def _d8(x: np.ndarray) -> np.ndarray:
    """The nearest integer points with an even sum."""
    r = np.rint(x)
    error = x - r
    at = np.abs(error).argmax(-1)[..., None]
    step = np.where(np.take_along_axis(error, at, -1) >= 0, 1.0, -1.0) * (r.sum(-1, keepdims=True) % 2 != 0)
    np.put_along_axis(r, at, np.take_along_axis(r, at, -1) + step, -1)
    return r


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The nearest points of E8: of its two cosets, the nearer one's."""
    a, b = _d8(x), _d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(-1) <= ((x - b) ** 2).sum(-1))[..., None], a, b)


def codes(x: np.ndarray, tables: int = TABLES, blocks: int = BLOCKS, probes: int = PROBES, side: float = SIDE, seed: int = 8) -> np.ndarray:
    """int32 (rows, tables, 1 + probes): the own cell's code and those of the nearest others, of unit rows x."""
    n, d = x.shape
    out = np.empty((n, tables, 1 + probes), np.int32)
    rng = np.random.default_rng([seed, d])
    for t in range(tables):
        y = (x @ (rng.normal(size=(d, 8 * blocks)) / side)).reshape(n, blocks, 8)
        own = nearest_e8(y)
        rest = y - own
        farther = (ROOTS**2).sum(1) - 2 * rest @ ROOTS.T  # by how much each neighbour's square distance is more
        order = np.argsort(farther.reshape(n, -1), 1, kind="stable")[:, :probes]
        cells = np.repeat(own[:, None], 1 + probes, 1)
        for p in range(probes):
            cells[np.arange(n), p + 1, order[:, p] // len(ROOTS)] += ROOTS[order[:, p] % len(ROOTS)]
        points = np.rint(cells.reshape(n, 1 + probes, -1) * 2).astype(np.int64)
        mix = np.random.default_rng([seed, t, 1]).integers(1, 1 << 62, 8 * blocks, dtype=np.int64) | 1
        out[:, t] = ((points * mix).sum(-1) ^ (d * 0x9E3779B1 + t)) >> 29
    return out


def _prepare(vectors: DataFrame, kind: str) -> DataFrame:
    """(raw, codes) of distinct valid vectors, raw their bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            raw = np.array(list(whole["raw"]), object)
            sizes = np.array([len(r) for r in raw])
            for size in np.unique(sizes).tolist():
                for at in np.array_split(np.flatnonzero(sizes == size), max(1, int((sizes == size).sum()) // 512)):
                    x = np.stack([np.frombuffer(r, kind) for r in raw[at]]).astype(np.float64)
                    yield whole.iloc[at].assign(codes=[c.tobytes() for c in codes(_unit(x))])

    return frames(vectors, run, "node bigint, least bigint, n bigint, raw binary, codes binary")


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _pack(rows: DataFrame, kind: str) -> DataFrame:
    """(vec_id, raw): raw null where a vector is null, zero or holds null or non-finite components."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            raw = []
            for v in b["v"]:
                x = np.array([np.nan if c is None else c for c in v] if v is not None and v.dtype == object else [] if v is None else v, kind)
                raw.append((x + 0.0).tobytes() if len(x) and np.isfinite(x).all() and x.any() else None)
            yield pd.DataFrame({"vec_id": b["vec_id"], "raw": raw})

    return frames(rows, run, "vec_id bigint, raw binary")


def _cell(g: pd.DataFrame, kind: str, at_least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one cell's part pair: (node, linked copies) and the links of a spanning forest."""
    t, i, j = (int(g[c].iloc[0]) for c in ("t", "i", "j"))
    g = g.sort_values("node")
    node, part = g["node"].to_numpy(np.int64), g["part"].to_numpy()
    own, n = g["own"].to_numpy(bool), g["n"].to_numpy(np.int64)
    x = _unit(np.stack([np.frombuffer(r, kind) for r in g["raw"]]).astype(np.float64))
    code = np.stack([np.frombuffer(c, np.int32) for c in g["codes"]]).reshape(len(g), -1, 1 + PROBES)
    links, label = np.zeros(len(g), np.int64), np.arange(len(g))
    for a in range(0, len(g), 512):
        near = x[a : a + 512] @ x[a:].T >= at_least
        near &= own[a : a + 512, None] | own[None, a:]
        p, q = np.nonzero(near)
        keep = p < q
        p, q = p[keep] + a, q[keep] + a
        if i != j:
            keep = part[p] != part[q]
            p, q = p[keep], q[keep]
        if not len(p):
            continue
        # a pair counts where it meets first
        first = np.ones(len(p), bool)
        for s in range(t):
            first &= (code[p, s, :1] != code[q, s]).all(1) & (code[p, s] != code[q, s, :1]).all(1)
        first &= own[p] | (code[p, t, :1] != code[q, t, 1:]).all(1)
        p, q = p[first], q[first]
        np.add.at(links, p, n[q])
        np.add.at(links, q, n[p])
        while True:
            u, v = label[p], label[q]
            rest = np.flatnonzero(u != v)
            if not len(rest):
                break
            lo, hi = sorted((u[rest[0]], v[rest[0]]))
            label[label == hi] = lo
            p, q = p[rest[1:]], q[rest[1:]]
    some, moved = np.flatnonzero(links), np.flatnonzero(label != np.arange(len(g)))
    return node[some], links[some], node[moved], node[label[moved]]


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", at_least: float = 0.95) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of vectors.

    n_links: other rows found with a cosine of at_least or more, in double precision; equal vectors are
    always found, others by hashing, which at the threshold itself misses about one pair in a hundred,
    and fewer above. component_id: the smallest vec_id reachable over links. Vectors that are null, zero,
    empty or hold null or non-finite components link with nothing and are their own component; vectors
    of different lengths never link. Rows with a null id take part; alone, their component is null
    and they are kept. Other columns are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    kind = "<f8" if isinstance(vectors.schema[vector_col].dataType, ArrayType) and isinstance(vectors.schema[vector_col].dataType.elementType, DoubleType) else "<f4"
    packed = materialize(_pack(vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).alias("v")), kind), "vectors")
    distinct = packed.where("raw is not null").groupBy("raw").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
    distinct = distinct.select(F.monotonically_increasing_id().alias("node"), "least", "n", "raw")
    nodes = materialize(_prepare(distinct, kind), "codes")

    def stand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                code = np.stack([np.frombuffer(c, np.int32) for c in b["codes"]]).reshape(len(b), -1, 1 + PROBES)
                _, tables, cells = code.shape
                yield pd.DataFrame({
                    "node": np.repeat(b["node"].to_numpy(np.int64), tables * cells),
                    "t": np.tile(np.repeat(np.arange(tables), cells), len(b)),
                    "cell": code.ravel(),
                    "own": np.tile(np.arange(cells) == 0, len(b) * tables),
                })

    standing = frames(nodes.select("node", "codes"), stand, "node bigint, t int, cell int, own boolean")
    met = standing.groupBy("t", "cell").agg(F.count("*").alias("m"), F.count_if("own").alias("owners")).where("m > 1 and owners > 0")
    met = met.select("t", "cell", F.ceil(F.col("m") / PART).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    crowd = standing.join(met, ["t", "cell"]).withColumn("part", part)
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(F.least(k, "part").alias("i"), F.greatest(k, "part").alias("j"))))
    crowd = crowd.select("node", "t", "cell", "own", "part", pair.alias("p")).select("node", "t", "cell", "own", "part", "p.i", "p.j")
    dealt = crowd.join(nodes.select("node", "n", "raw", "codes"), "node")
    dealt = dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "t", "cell", "i", "j").sortWithinPartitions("t", "cell", "i", "j")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in groups(batches, ["t", "cell", "i", "j"]):
            if len(g) > 1:
                node, links, u, v = _cell(g, kind, at_least)
                if len(node):
                    yield pd.DataFrame({"u": np.concatenate([node, u]), "v": pd.array([*([None] * len(node)), *v.tolist()], "Int64"), "links": np.concatenate([links, np.zeros(len(u), np.int64)])})

    found = materialize(frames(dealt, run, "u bigint, v bigint, links bigint"), "links")
    links = found.where("v is null").groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("links"))
    parts = connected_components(found.where("v is not null").select("u", "v"))
    whole = nodes.select("node", "least", "n", "raw").join(parts, "node", "left").join(links, "node", "left").withColumn("root", F.coalesce("component", "node"))
    named = whole.groupBy("root").agg(F.min("least").alias("component_id"))
    of = whole.join(named, "root").select("raw", "component_id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = packed.join(of, "raw", "left")
    n_links, component = F.coalesce("n_links", F.lit(0)).cast("bigint"), F.when(F.col("raw").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", n_links.alias("n_links"), component.alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
