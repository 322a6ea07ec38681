"""What several operators need: shared storage, columns by name, and distributed components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset.

    A folder of our own is made only in local mode, where driver and executors are one machine; elsewhere
    an unset folder is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not found:
        import tempfile

        found = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Spark's setting (4.1; without effect before): the shuffle files of an execution go when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: the lineage ends here.

    Lost executors do not matter afterwards, and nothing of it is computed twice. The shuffle files that
    the write made go with its end, where otherwise they stay on disk until the driver collects garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/graphloom/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._graphloom_path = path
    return out


def drop(df: DataFrame | None) -> None:
    """Remove what materialize() wrote, when nothing lazy reads it any more."""
    path = getattr(df, "_graphloom_path", None)
    if path:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def frames(df: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """mapInPandas that keeps bigint columns with nulls as they are, where pandas would make them floats."""
    out = to_arrow_schema(StructType.fromDDL(schema))
    ints = {pa.int64(): pd.Int64Dtype()}.get

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in run(b.to_pandas(types_mapper=ints) for b in batches):
            yield pa.RecordBatch.from_pandas(got, schema=out, preserve_index=False)

    return df.mapInArrow(go, schema)


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: One odd factor for each place of a word; places repeat behind 65,536 bytes.
_FACTORS = np.random.default_rng(20240229).integers(0, 1 << 63, 1 << 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Bytes of texts that are hashed at once; a longer text is hashed by itself.
_PIECE = 1 << 18


def column_words(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The words of a column of texts as 64-bit hashes: (first row, hashes, words of each row), for some rows at a time.

    Words are what white space (space, tab to carriage return) parts, A-Z lower-cased. A hash is the sum
    of a word's bytes, each times the factor of its place; nulls have no words.
    """
    column = column.cast(pa.large_string()).fill_null("")
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(off, off[a] + _PIECE, "right")) - 1)
        raw = _LOWER[data[off[a] : off[b]]]
        row_at = off[a:b] - off[a]
        blank = _SPACE[raw]
        first = ~blank
        inner = row_at[(row_at > 0) & (row_at < len(raw))]
        follows = first.copy()  # a byte whose word began before it
        follows[1:] &= first[:-1]
        follows[:1] = False
        follows[inner] = False
        starts = np.flatnonzero(first & ~follows)
        counts = np.diff(np.searchsorted(starts, np.concatenate([row_at, [len(raw)]])))
        if len(starts):
            size = np.diff(np.concatenate([starts, [len(raw)]]))
            place = np.arange(starts[0], len(raw)) - np.repeat(starts, size)
            value = (raw[starts[0] :].astype(np.uint64) + np.uint64(1)) * _FACTORS[place & 0xFFFF]
            value[blank[starts[0] :]] = 0
            h = np.add.reduceat(value, starts - starts[0])
            h ^= h >> np.uint64(31)
            h *= np.uint64(0x9FB21C651E98DF25)
            h ^= h >> np.uint64(28)
        else:
            h = np.zeros(0, np.uint64)
        yield a, h, counts
        a = b


def groups(batches: Iterator[pd.DataFrame], names: list[str]) -> Iterator[pd.DataFrame]:
    """The runs of rows that agree in the integer columns names, of batches that are sorted by them."""
    held: list[pd.DataFrame] = []
    key = None
    for b in batches:
        if not len(b):
            continue
        at = b[names].to_numpy(np.int64)
        starts = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(1)) + 1).tolist()]
        for x, y in zip(starts, [*starts[1:], len(b)], strict=True):
            now = tuple(at[x])
            if held and now != key:
                yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
                held = []
            key = now
            held.append(b.iloc[x:y])
    if held:
        yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of a graph of bigint nodes: edges (u, v) to (node, component), component the smallest node.

    Alternating large-star and small-star rounds, each written to the shared folder. Minima are
    aggregated map-side and joined back, so that a hub is never gathered into one task: its rows are
    an ordinary skewed join that adaptive execution splits. Nulls and loops are ignored; a node
    without an edge isn't listed; no edges give no rows.
    """
    u, v = F.col("u"), F.col("v")
    state = edges.where(u.isNotNull() & v.isNotNull() & (u != v))
    state = materialize(state.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct(), "edges")
    summary = None
    for _ in range(max_rounds):
        now = state.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == summary or now[0] == 0:
            break
        summary = now
        both = state.select("u", "v").unionByName(state.select(v.alias("u"), u.alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        # large star: neighbours above a node move to the least node of its neighbourhood
        large = (
            state.select(v.alias("k"), u.alias("y"))
            .join(least, "k")
            .select(F.col("y").alias("u"), F.col("m").alias("v"))
            .where(u != v)
            .distinct()
        )
        large = materialize(large, "large")
        # small star: neighbours below a node, and the node, move to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where(u != v)
        after = materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        drop(large)
        drop(state)
        state = after
    else:
        raise RuntimeError(f"no fixpoint after {max_rounds} rounds")
    own = state.select(v.alias("node"), v.alias("component")).distinct()
    return state.select(u.alias("node"), v.alias("component")).unionByName(own)
