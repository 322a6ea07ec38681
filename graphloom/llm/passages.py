"""Repeated passages across documents by collinear chaining of shared k-mer seeds.

Words are hashed and every run of K words is a seed: a passage of n words of which 80 % are equal, the
rest replaced, shares n / 5 - 3 seeds at least, whatever is replaced. Minimizers of LONG words are seeds
as well, so that every exact run of MIN_WORDS words holds one. Each occurrence of a seed of several
documents is an anchor against the first document that holds it and against the last one before its
own: at most two anchors an occurrence, never all pairs, and whatever fragments of it stand elsewhere,
an exact passage meets a document that holds LONG of its words in one piece.

Anchors that overlap on one diagonal are one fragment, a run of equal words. The fragments of two
documents are chained in order, with gap costs, by a Fenwick tree that holds the best chain so far for
each position. Chains are cut into pieces at wide gaps. A piece whose fragments alone make a passage is
sure of it; of these, a document keeps the ones that together cover all the others' words. The
other pieces stay if they have words that no sure one covers. All that stay are aligned word by word
through edits, as far as they score: first on the words near by, and where that isn't far enough, on
whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm._shared import column_words, drop, frames, materialize
from graphloom.llm.ngram_lm import Filter, build

K, WINDOW = 4, 1
#: A passage has so many words at least, and so large a share of them equal.
MIN_WORDS, MIN_IDENTITY = 45, 0.8
#: Long seeds: of an exact run of 45 words one is taken at least.
LONG, LONG_WINDOW = 40, 6
#: A piece of a chain is worth aligning if it has so many seeds: a run of seven equal words, or several shorter ones.
MIN_SEEDS = 4
#: What a seed scores in a chain, and what each word between two fragments costs on either side.
ANCHOR, GAP = 8.0, 0.05
#: Words around a piece that the first alignment reads; one that reaches their end is repeated on whole texts.
MARGIN = 128
#: Words that alignment looks ahead for three equal ones, and how far its score may fall.
LOOK, DROP, EDIT = 16, 20.0, 1.5
#: Bytes of the filter of repeated seeds at most; a fuller filter lets more seeds pass and changes no result.
FILTER_BYTES = 64 << 20
#: Seeds that a task holds at once, and characters whose seeds make one slot.
_HOLD, _SLOT_CHARS = 1 << 21, 1 << 24
#: Pieces whose words are cut out of one copy of a text.
_ASKS = 512
#: Rows of seeds and anchors that are handled at once.
_ROWS = 1 << 17
_TOP = np.uint64(1 << 63)
_WORD = re.compile("[^ \t\n\v\f\r]+")


def word_hashes(text: str | None) -> np.ndarray:
    """The hashes of a text's words."""
    return np.concatenate([h for _, h, _ in column_words(pa.array([text], pa.string()))])


def _minimizers(h: np.ndarray, size: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(seed, place in h) of the minimizers of the k-mers of texts that stand end to end, size words each."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    mers = np.zeros(n, np.uint64)
    for i in range(k):
        mers = mers * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
    mers ^= mers >> np.uint64(32)
    mers *= np.uint64(0xD6E8FEB86659FD93)
    mers ^= mers >> np.uint64(32)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(h))  # words from here to the end of the text
    if window == 1:
        at = np.flatnonzero(left[:n] >= k)
    elif n < window:
        at = np.zeros(0, np.int64)
    else:
        view = np.lib.stride_tricks.sliding_window_view(mers, window)
        ok = np.flatnonzero(left[: len(view)] >= k + window - 1)
        at = view[ok].argmin(1) + ok
        at = at[np.diff(at, prepend=-1) != 0]
    return mers[at], at


def seeds(h: np.ndarray, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(seed, position) of the minimizers of one document's k-mers."""
    s, at = _minimizers(h, np.array([len(h)]), k, window)
    return s, at.astype(np.int32)


def _column_seeds(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(seed, row, position) of a column of texts, some rows at a time; the top bit of long seeds is set."""
    for first, h, size in column_words(column):
        begin, doc = np.cumsum(size) - size, np.repeat(np.arange(len(size)), size)
        (s, p), (t, q) = _minimizers(h, size, K, WINDOW), _minimizers(h, size, LONG, LONG_WINDOW)
        at = np.concatenate([p, q])
        yield np.concatenate([s & ~_TOP, t | _TOP]), first + doc[at], (at - begin[doc[at]]).astype(np.int32)


def _mask(slots: int) -> np.uint64:
    """The low bits of a seed by which repeated seeds are told: 32 and those of its slot."""
    return np.uint64((slots << 32) - 1)


def repeated_seeds(docs: DataFrame, slots: int) -> DataFrame:
    """(slot, key): the low bits of the seeds that several documents (text) hold, and of few others.

    slots is a power of two. Seeds that agree in the low bits, and rows that repeat a text, may let a seed
    pass that one document holds only; none that several hold is missing. A task counts a seed once for
    all the documents it holds at a time, so that a seed of very many documents is a few keys of its slot.
    """
    schema = pa.schema([("slot", pa.int32()), ("one", pa.binary()), ("many", pa.binary())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        shift = np.uint64(slots.bit_length() - 1)

        def flush() -> pa.RecordBatch:
            # each document gives a seed once, so that one that stands here twice is of several
            s = np.sort(np.concatenate(held))
            start = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            many = np.diff(np.concatenate([start, [len(s)]])) > 1
            s = s[start]
            slot = (s & np.uint64(slots - 1)).astype(np.int32)
            order = np.argsort(slot, kind="stable")
            key, many, slot = (s >> shift).astype("<u4")[order], many[order], slot[order]
            cuts = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]])).tolist()
            runs = list(zip(cuts, [*cuts[1:], len(slot)], strict=True))
            cut = lambda on: [key[a:b][on[a:b]].tobytes() for a, b in runs]
            return pa.RecordBatch.from_arrays([pa.array(slot[cuts]), pa.array(cut(~many), pa.binary()), pa.array(cut(many), pa.binary())], schema=schema)

        for b in batches:
            for s, row, _ in _column_seeds(b.column(0)):
                s = s & _mask(slots)
                order = np.lexsort((s, row)) if len(np.unique(row)) > 1 else np.argsort(s)
                s, row = s[order], row[order]
                held.append(s[np.concatenate([[True], (s[1:] != s[:-1]) | (row[1:] != row[:-1])])] if len(s) else s)
                size += len(held[-1])
                if size >= _HOLD:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from graphloom.llm._shared import groups

        for g in groups(batches, ["slot"]):
            many = [np.frombuffer(x, "<u4") for x in g["many"]]
            s = np.sort(np.concatenate([np.frombuffer(x, "<u4") for x in g["one"]] + many * 2))
            s = np.unique(s[1:][s[1:] == s[:-1]])
            for at in range(0, len(s), _ROWS):
                yield pd.DataFrame({"slot": int(g["slot"].iloc[0]), "key": s[at : at + _ROWS].astype(np.int64)})

    parts = docs.select("text").mapInArrow(scan, "slot int, one binary, many binary")
    return frames(parts.repartition(slots, "slot").sortWithinPartitions("slot"), merge, "slot int, key bigint")


def _seed_filter(repeated: DataFrame, slots: int):
    """A Bloom filter of the repeated seeds, of bounded size: it only saves shuffling seeds that can't match."""
    n = repeated.count()
    bits = max(2, min(12, FILTER_BYTES * 8 // max(1, n)))
    if n * bits // 8 > 2 * FILTER_BYTES:
        return None  # too many repeated seeds to tell them apart in a bounded filter: all seeds are shuffled

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from graphloom.llm._shared import groups

        for g in groups(gathered(batches), ["slot"]):
            slot = int(g["slot"].iloc[0])
            keys = g["key"].to_numpy(np.int64).view(np.uint64) * np.uint64(slots) + np.uint64(slot)
            yield pd.DataFrame({"slot": [slot], "cells": [build(keys, np.ones(len(keys), np.int64), 7, bits).tobytes()]})

    cells = [np.zeros(1, np.uint64)] * slots
    for r in frames(repeated.repartition(slots, "slot").sortWithinPartitions("slot"), make, "slot int, cells binary").toLocalIterator():
        cells[r.slot] = np.frombuffer(bytes(r.cells), np.uint64)
    return repeated.sparkSession.sparkContext.broadcast(Filter(cells, 7))


def gathered(batches: Iterator[pd.DataFrame], rows: int = _ROWS) -> Iterator[pd.DataFrame]:
    """The same rows in fewer, larger batches."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += len(b)
        if size >= rows:
            yield pd.concat(held, ignore_index=True)
            held, size = [], 0
    if size:
        yield pd.concat(held, ignore_index=True)


def holders(seed: np.ndarray, y: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of occurrences sorted by (seed, y, pos): where each seed begins, where its y does, and where the y before does (or -1)."""
    new_seed = np.concatenate([[True], seed[1:] != seed[:-1]])
    new_doc = new_seed | np.concatenate([[True], y[1:] != y[:-1]])
    begin = np.flatnonzero(new_seed)[np.cumsum(new_seed) - 1]
    runs, of = np.flatnonzero(new_doc), np.cumsum(new_doc) - 1
    own = runs[of]
    return begin, own, np.where(own > begin, runs[np.maximum(of - 1, 0)], -1)


ANCHORS = "y bigint, x bigint, y_pos int, x_pos int"


def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """ANCHORS of occurrences (seed, y, y_pos) that are sorted: against the first holder and the last one before.

    x_pos is ~x_pos for long seeds.
    """
    kept = tuple(np.zeros(0, np.int64) for _ in range(3))  # of the last seed so far the rows that later ones look back to
    held: list[pa.RecordBatch] = []

    def run() -> pa.RecordBatch:
        nonlocal kept
        n = len(kept[0])
        s, y, p = (np.concatenate([k, *(b.column(c).to_numpy().astype(np.int64) for b in held)]) for c, k in enumerate(kept))
        begin, own, before = holders(s, y, p)
        late = np.arange(len(s)) >= n
        a = np.flatnonzero(late & (y[begin] != y))
        c = np.flatnonzero(late & (before >= 0) & (y[before] != y[begin]))
        at, to = np.concatenate([a, c]), np.concatenate([begin[a], before[c]])
        last = np.unique([x for x in (begin[-1], before[-1], own[-1]) if x >= 0])
        kept = s[last], y[last], p[last]
        return pa.RecordBatch.from_arrays([pa.array(y[at]), pa.array(y[to]), pa.array(p[at].astype(np.int32)), pa.array(np.where(s[at] < 0, ~p[to], p[to]).astype(np.int32))], ["y", "x", "y_pos", "x_pos"])

    for b in batches:
        if b.num_rows:
            held.append(b)
        if sum(x.num_rows for x in held) >= _ROWS:
            yield run()
            held = []
    if held:
        yield run()


def chains(y: np.ndarray, x: np.ndarray, weight: np.ndarray | None = None) -> list[list[int]]:
    """Chains of anchors (indices, y ascending), the best first; no anchor is in two.

    An anchor scores ANCHOR times its weight (1) and each word between two anchors costs GAP on either
    side. With that cost the best predecessor of an anchor is the one with the greatest
    score + GAP * (y + x) among those before it in both, which a Fenwick tree over the ranks of x
    answers while y grows.
    """
    n = len(y)
    if n == 1:
        return [[0]]
    order = np.argsort(y, kind="stable")
    rank = np.searchsorted(np.unique(x), x) + 1
    top = int(rank.max(initial=0))
    tree_score, tree_from = [float("-inf")] * (top + 1), [-1] * (top + 1)
    score, back = [0.0] * n, [-1] * n
    ys, xs, ranks = y.tolist(), x.tolist(), rank.tolist()
    worth = [ANCHOR] * n if weight is None else (ANCHOR * weight).tolist()
    waiting: list[int] = []
    last = None
    for i in order.tolist():
        if ys[i] != last:
            for j in waiting:
                value, r = score[j] + GAP * (ys[j] + xs[j]), ranks[j]
                while r <= top:
                    if value > tree_score[r]:
                        tree_score[r], tree_from[r] = value, j
                    r += r & -r
            waiting, last = [], ys[i]
        best, came, r = float("-inf"), -1, ranks[i] - 1
        while r:
            if tree_score[r] > best:
                best, came = tree_score[r], tree_from[r]
            r -= r & -r
        gain = best - GAP * (ys[i] + xs[i])
        score[i], back[i] = (worth[i] + gain, came) if gain > 0 else (worth[i], -1)
        waiting.append(i)
    used, out = [False] * n, []
    for i in sorted(range(n), key=lambda i: (-score[i], ys[i], xs[i])):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(i)
            i = back[i]
        if chain:
            out.append(chain[::-1])
    return out


def _run(a: np.ndarray, b: np.ndarray, i: int, j: int) -> int:
    """How many words are equal from a[i] and b[j] on."""
    n, step, done = min(len(a) - i, len(b) - j), 32, 0
    while done < n:
        m = min(step, n - done)
        differ = np.flatnonzero(a[i + done : i + done + m] != b[j + done : j + done + m])
        if len(differ):
            return done + int(differ[0])
        done += m
        step *= 4
    return n


def _common(a: list, b: list) -> int:
    """The most words that two short runs have in common in order."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def extend(a: np.ndarray, b: np.ndarray, i: int, j: int) -> tuple[int, int, int]:
    """Align from a[i], b[j] rightwards: (words of a, words of b, equal words) up to the best score.

    Behind a difference it goes on at the nearest two words that are equal on the same diagonal or three
    on another; words that are equal in order before these count as well.
    """
    at_i, at_j, equal, score = i, j, 0, 0.0
    best = (0.0, i, j, 0)
    while True:
        n = _run(a, b, at_i, at_j)
        at_i, at_j, equal, score = at_i + n, at_j + n, equal + n, score + n
        if score > best[0]:
            best = (score, at_i, at_j, equal)
        ahead: dict[tuple, int] = {}
        right = b[at_j : at_j + LOOK + 3].tolist()
        for q in range(len(right) - 2):
            ahead.setdefault(tuple(right[q : q + 3]), q)
        left = a[at_i : at_i + LOOK + 3].tolist()
        on = [x == y for x, y in zip(left, right, strict=False)]
        step = next(((p, p) for p in range(min(LOOK + 1, len(on) - 1)) if on[p] and on[p + 1]), None)
        for p in range(len(left) - 2):
            q = ahead.get(tuple(left[p : p + 3]))
            if q is not None and (step is None or max(p, q) < max(step)):
                step = (p, q)
        if step is None:
            # single words at the end of a passage
            for p, same in enumerate(on):
                equal, score = equal + same, score + (1 if same else -EDIT)
                if score > best[0]:
                    best = (score, at_i + p + 1, at_j + p + 1, equal)
            break
        between = sum(on[: step[0]]) if step[0] == step[1] else _common(left[: step[0]], right[: step[1]])
        at_i, at_j, equal, score = at_i + step[0], at_j + step[1], equal + between, score + between - EDIT * (max(step) - between)
        if score < best[0] - DROP:
            break
    return best[1] - i, best[2] - j, best[3]


def align(a: np.ndarray, b: np.ndarray, anchors: list[tuple[int, int]], k: int = K) -> list[tuple[int, int, int, int, int]]:
    """Passages (a from, a to, b from, b to, equal words) through the anchors, in order, none twice."""
    out, done = [], -1
    for i, j in anchors:
        if i < done:
            continue
        size = _run(a, b, i, j)
        if size < k:
            continue
        right = extend(a, b, i, j)
        left = extend(a[:i][::-1], b[:j][::-1], 0, 0)
        begin = max(i - left[0], done, 0)
        cut = begin - (i - left[0])
        out.append((begin, i + right[0], j - left[1] + cut, j + right[1], left[2] - min(left[2], cut) + right[2]))
        done = i + right[0]
    return out


PASSAGE = "doc_id bigint, from_word int, to_word int, ref_id bigint, ref_from int, ref_to int, equal_words int"
_PIECE = "y bigint, x bigint, nr int, y_at array<int>, x_at array<int>, y_to int, x_to int, sure int"


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """(rows, names): rows are (y, text), one for each document, names (y, doc_id, text_hash) or None if y is the id.

    Where rows repeat an id, each text of an id is a document by itself, and documents are numbered in
    the order of their ids and their texts' hashes; rows that are equal in both are one document.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("y"), F.col(text_col).alias("text")).where("y is not null")
    if rows.groupBy("y").count().where("count > 1").isEmpty():
        return rows, None
    own = rows.where("text is not null").withColumn("text_hash", F.xxhash64("text")).dropDuplicates(["y", "text_hash"])
    own = own.orderBy("y", "text_hash").select(F.monotonically_increasing_id().alias("nr"), "y", "text_hash", "text")
    own = materialize(own, "numbered")
    return own.select(F.col("nr").alias("y"), "text"), own.select(F.col("nr").alias("y"), F.col("y").alias("doc_id"), "text_hash")


def find_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, min_identity: float = MIN_IDENTITY) -> DataFrame:
    """PASSAGE: passages of a document that an earlier one (a smaller id) holds too, fuzzy or exact.

    Words are what white space (space, tab to carriage return) parts, A-Z lower-cased; from_word to
    to_word (exclusive) are of the document, ref_ of the earlier one, which is the first that holds some of
    the passage's seeds or the last before the document. A passage has min_words words and min_identity of
    them equal, at least. One whose words others cover isn't listed. An occurrence is
    compared with these two holders alone: a passage may be missed of which both, and all documents between
    them, hold only fragments that are shorter than min_words.
    Rows with a null id, null and empty texts have no passages. Rows that repeat an id are one document if
    their texts are equal, and otherwise documents of their own, earlier or later by their texts' hashes,
    so that ref_id may equal doc_id; text_hash (xxhash64 of the text) is a further column then. Other
    columns are ignored.
    """
    rows, names = _numbered(docs, id_col, text_col)
    found = _passages(rows, min_words, min_identity)
    if names is None:
        return found
    ref = names.select(F.col("y").alias("ref_id"), F.col("doc_id").alias("__ref"))
    own = found.withColumnRenamed("doc_id", "y").join(names, "y").join(ref, "ref_id")
    return own.select("doc_id", "from_word", "to_word", F.col("__ref").alias("ref_id"), "ref_from", "ref_to", "equal_words", "text_hash")


def _passages(rows: DataFrame, min_words: int, min_identity: float) -> DataFrame:
    """PASSAGE of rows (y, text) whose y are distinct; written."""
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    slots = 1 << max(4, (max(n, chars // _SLOT_CHARS) - 1).bit_length())
    repeated = materialize(repeated_seeds(rows, slots), "seeds")
    known = _seed_filter(repeated, slots)
    occurrence = pa.schema([("seed", pa.int64()), ("y", pa.int64()), ("y_pos", pa.int32())])

    def occur(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            for s, row, at in _column_seeds(b.column(1)):
                if known is not None and len(s):
                    on = known.value.levels(s & _mask(slots)) > 0
                    s, row, at = s[on], row[on], at[on]
                if len(s):
                    yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array(ids[row]), pa.array(at)], schema=occurrence)

    occurrences = rows.select("y", "text").mapInArrow(occur, "seed bigint, y bigint, y_pos int").repartition(n, "seed").sortWithinPartitions("seed", "y", "y_pos")
    anchors = occurrences.mapInArrow(link, ANCHORS)

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for b in gathered(batches):
            rest = b if rest is None else pd.concat([rest, b], ignore_index=True)
            found, rest = _chained(rest, False, min_words, min_identity)
            if len(found):
                yield found
        if rest is not None and len(rest):
            yield _chained(rest, True, min_words, min_identity)[0]

    # all of a document's anchors meet in one task: two for each of its words at most
    wanted = materialize(frames(anchors.repartition(n, "y").sortWithinPartitions("y", "x", "y_pos"), chain, _PIECE), "chains")
    drop(repeated)
    near = materialize(_aligned(rows, wanted, MARGIN, min_words, min_identity), "aligned")
    open_ = near.where("open").select("y", "x", "nr").distinct()
    if open_.isEmpty():
        return near.select(F.col("y").alias("doc_id"), "from_word", "to_word", F.col("x").alias("ref_id"), "ref_from", "ref_to", "equal_words")
    far = _aligned(rows, wanted.join(open_, ["y", "x", "nr"], "left_semi"), None, min_words, min_identity)
    both = materialize(near.join(open_, ["y", "x", "nr"], "left_anti").unionByName(far), "aligned")
    drop(near)
    drop(wanted)
    return both.select(F.col("y").alias("doc_id"), "from_word", "to_word", F.col("x").alias("ref_id"), "ref_from", "ref_to", "equal_words")


def _aligned(rows: DataFrame, wanted: DataFrame, margin: int | None, min_words: int, min_identity: float) -> DataFrame:
    """The passages of pieces of chains; open if more words around the piece might lengthen one of them."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    around = lambda at, to: (
        F.greatest(F.lit(0), F.array_min(at) - margin) if margin is not None else F.lit(0),
        F.col(to) + margin if margin is not None else F.lit(2**31 - 1),
    )
    asked = None
    for d, at, to, side in (("y", "y_at", "y_to", 0), ("x", "x_at", "x_to", 1)):
        a, z = around(at, to)
        one = wanted.select(F.col(d).alias("doc"), F.struct("y", "x", "nr", F.lit(side).alias("side"), a.alias("a"), z.alias("z")).alias("ask"))
        asked = one if asked is None else asked.unionByName(one)
    # a document that very many ask for is asked in portions: each has a copy of the text
    many = asked.groupBy("doc").agg(F.count("*").alias("asks")).where(F.col("asks") > _ASKS)
    portion = F.coalesce(F.pmod(F.xxhash64("ask.y", "ask.x", "ask.nr"), F.ceil(F.col("asks") / _ASKS)), F.lit(0))
    asked = asked.join(many, "doc", "left").groupBy("doc", portion.alias("portion")).agg(F.collect_list("ask").alias("asks"))
    texts = rows.join(asked, rows["y"] == asked["doc"]).select("text", "asks")
    cut_schema = "y bigint, x bigint, nr int, side int, a int, more boolean, words binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("y", pa.int64()), ("x", pa.int64()), ("nr", pa.int32()), ("side", pa.int32()), ("a", pa.int32()), ("more", pa.bool_()), ("words", pa.binary())])
        batch = lambda held: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), out, strict=True)], schema=out)
        for b in batches:
            asks = b.column(1)
            for first, h, size in column_words(b.column(0)):
                h, ends, held, chars = h.astype("<u4"), np.cumsum(size), [], 0
                for i in range(len(size)):
                    words = h[ends[i] - size[i] : ends[i]]
                    for q in asks[first + i].as_py():
                        held.append((q["y"], q["x"], q["nr"], q["side"], q["a"], q["z"] < len(words), words[q["a"] : q["z"]].tobytes()))
                        chars += len(held[-1][-1])
                        if chars > 1 << 22:
                            yield batch(held)
                            held, chars = [], 0
                if held:
                    yield batch(held)

    pieces = texts.mapInArrow(cut, cut_schema)
    both = wanted.withColumn("side", F.lit(-1)).unionByName(pieces, allowMissingColumns=True).select("y", "x", "nr", "side", "y_at", "x_at", "y_to", "x_to", "sure", "a", "more", "words")

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list = []
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                if r.side < 0:
                    held = [r]
                    continue
                held.append(r)
                if r.side == 0 or len(held) < 3:
                    continue
                p, u, v = held
                a, b_ = np.frombuffer(u.words, "<u4"), np.frombuffer(v.words, "<u4")
                y0, x0 = int(u.a), int(v.a)
                ways = [(i - y0, j - x0) for i, j in zip(p.y_at.tolist(), p.x_at.tolist(), strict=True)]
                found = [f for f in align(a, b_, ways) if f[1] - f[0] >= min_words and f[4] >= min_identity * max(f[1] - f[0], f[3] - f[2])]
                if p.sure >= 0:
                    own = (ways[0][0], int(p.y_to) - y0, ways[0][1], int(p.x_to) - x0, int(p.sure))
                    if not any(f[0] <= own[0] and own[1] <= f[1] for f in found):
                        found.append(own)
                for f in found:
                    beyond = y0 and not f[0] or x0 and not f[2] or u.more and f[1] == len(a) or v.more and f[3] == len(b_)
                    out.append((p.y, p.x, p.nr, f[0] + y0, f[1] + y0, f[2] + x0, f[3] + x0, f[4], bool(beyond)))
            if out:
                yield pd.DataFrame(out, columns=["y", "x", "nr", "from_word", "to_word", "ref_from", "ref_to", "equal_words", "open"])

    return frames(both.repartition(n, "y", "x", "nr").sortWithinPartitions("y", "x", "nr", "side"), match, "y bigint, x bigint, nr int, from_word int, to_word int, ref_from int, ref_to int, equal_words int, open boolean")


def _fragments(y: np.ndarray, x: np.ndarray, yp: np.ndarray, xp: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, ...]:
    """(y, x, y from, x from, words): anchors that overlap or touch on one diagonal are one run of equal words."""
    size = np.where(long, LONG, K)
    order = np.lexsort((yp, yp - xp, x, y))
    y, x, yp, xp, size = y[order], x[order], yp[order], xp[order], size[order]
    line = np.ones(len(y), bool)
    line[1:] = (y[1:] != y[:-1]) | (x[1:] != x[:-1]) | (yp[1:] - xp[1:] != yp[:-1] - xp[:-1])
    lift = np.cumsum(line).astype(np.int64) << 32  # lines one above the other, so that one running maximum serves all
    reach = np.maximum.accumulate(lift + yp + size)
    fresh = line.copy()
    fresh[1:] |= lift[1:] + yp[1:] > reach[:-1]
    begin = np.flatnonzero(fresh)
    last = np.concatenate([begin[1:], [len(y)]]).astype(np.int64) - 1
    return y[begin], x[begin], yp[begin], xp[begin], (reach[last] - lift[last] - yp[begin]).astype(np.int64)


def _chained(b: pd.DataFrame, all_of_it: bool, min_words: int = MIN_WORDS, min_identity: float = MIN_IDENTITY) -> tuple[pd.DataFrame, pd.DataFrame]:
    """The pieces of chains worth aligning of all documents y in b but, if there may be more of it, the last."""
    columns = ["y", "x", "nr", "y_at", "x_at", "y_to", "x_to", "sure"]
    y, x, yp, xp = (b[c].to_numpy(t) for c, t in (("y", np.int64), ("x", np.int64), ("y_pos", np.int64), ("x_pos", np.int64)))
    cuts = np.flatnonzero(y[1:] != y[:-1]) + 1
    end = len(b) if all_of_it else int(cuts[-1]) if len(cuts) else 0
    rest = b.iloc[end:]
    if not end:
        return pd.DataFrame(columns=columns), rest
    y, x, yp, xp = y[:end], x[:end], yp[:end], xp[:end]
    long = xp < 0
    y, x, yp, xp, size = _fragments(y, x, yp, np.where(long, ~xp, xp), long)
    # pairs with too few seeds have no chain
    pair = np.concatenate([[True], (y[1:] != y[:-1]) | (x[1:] != x[:-1])])
    begin = np.flatnonzero(pair)
    count = np.diff(np.concatenate([begin, [len(y)]]))
    on = np.repeat(np.add.reduceat(size - K + 1, begin) >= MIN_SEEDS, count)
    y, x, yp, xp, size = y[on], x[on], yp[on], xp[on], size[on]
    starts = np.flatnonzero(np.concatenate([[True], (y[1:] != y[:-1]) | (x[1:] != x[:-1])])).tolist() if len(y) else []
    out: list[tuple] = []
    held: list[tuple] = []
    for a, z in zip(starts, [*starts[1:], len(y)][: len(starts)], strict=True):
        if held and held[0][0] != y[a]:
            out += _cover(held)
            held = []
        for c in chains(yp[a:z], xp[a:z], size[a:z] - K + 1):
            held += _split(int(y[a]), int(x[a]), [(int(yp[a + i]), int(xp[a + i]), int(size[a + i])) for i in c], min_words, min_identity)
    if held:
        out += _cover(held)
    nr: dict[tuple[int, int], int] = {}
    made = []
    for doc, ref, fragments, y_to, x_to, sure in out:
        nr[doc, ref] = nr.get((doc, ref), -1) + 1
        made.append((doc, ref, nr[doc, ref], [f[0] for f in fragments], [f[1] for f in fragments], y_to, x_to, sure))
    return pd.DataFrame(made, columns=columns), rest


def _split(doc: int, ref: int, chain: list[tuple[int, int, int]], min_words: int, min_identity: float) -> list[tuple]:
    """The pieces (doc, ref, fragments, y_to, x_to, sure) of a chain of fragments, cut where a gap is wide.

    sure is how many equal words the fragments alone hold if they make a passage, -1 otherwise.
    """
    pieces: list[list] = []
    y_to = x_to = 0
    for f in chain:
        if not pieces or max(f[0] - y_to, f[1] - x_to) > 2 * LOOK:
            pieces.append([])
            y_to = x_to = 0
        pieces[-1].append(f)
        y_to, x_to = max(y_to, f[0] + f[2]), max(x_to, f[1] + f[2])
    out = []
    for p in pieces:
        if sum(f[2] - K + 1 for f in p) < MIN_SEEDS:
            continue
        equal, y_to, x_to = 0, p[0][0], p[0][1]
        for i, j, n in p:
            skip = max(0, y_to - i, x_to - j)
            if skip < n:
                equal, y_to, x_to = equal + n - skip, i + n, j + n
        span = max(y_to - p[0][0], x_to - p[0][1])
        sure = equal if y_to - p[0][0] >= min_words and equal >= min_identity * span else -1
        out.append((doc, ref, p, y_to, x_to, sure))
    return out


def _cover(pieces: list[tuple]) -> list[tuple]:
    """Of one document's pieces the sure ones that cover all sure ones' words, and the others that have seeds outside these.

    Of the others that begin at the same place of the same document, as where a phrase is repeated over and
    over, so many stay as cover all of them.
    """
    if len(pieces) == 1:
        return pieces
    out = _fewest([p for p in pieces if p[5] >= 0])
    low = min(p[2][0][0] for p in pieces)
    covered = np.zeros(max(max(f[0] + f[2] for f in p[2]) for p in pieces) - low, bool)
    for p in out:
        covered[p[2][0][0] - low : p[3] - low] = True
    lone: dict[tuple[int, int], list[tuple]] = {}
    for p in pieces:
        if p[5] < 0 and sum(int((~covered[f[0] - low : f[0] + f[2] - low]).sum()) for f in p[2]) >= MIN_SEEDS:
            lone.setdefault((p[1], p[2][0][1]), []).append(p)
    for same in lone.values():
        out += _fewest(same)
    return out


def _fewest(pieces: list[tuple]) -> list[tuple]:
    """The fewest pieces whose extents together cover those of all; of equal ones that with the latest document."""
    out: list[tuple] = []
    best = None
    for p in sorted(pieces, key=lambda p: (p[2][0][0], -p[3], -p[1])):
        begin, end = p[2][0][0], p[3]
        reached = out[-1][3] if out else -1
        if best is not None and begin > reached:
            # nothing that begins later can begin in reach: the farthest so far is needed
            out.append(best)
            reached, best = best[3], None
        if end > reached and (best is None or end > best[3]):
            best = p
    if best is not None:
        out.append(best)
    return out


def remove_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words in spans (from, to) and the white space behind them."""
    if not spans:
        return text
    merged: list[list[int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    words = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for a, b in merged:
        if a >= len(words):
            break
        out.append(text[at : words[a][0]])
        at = words[b][0] if b < len(words) else len(text)
    out.append(text[at:])
    return "".join(out)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with their repeated passages cut out of all documents but the first that holds them.

    All rows and columns stay; a text that is nothing but repeats becomes empty. Rows with a null id and
    null texts stay as they are. Of rows that repeat an id, each text is a document by itself, and rows
    that are equal in both are one: what is cut from it is cut from all of them.
    """
    found = find_passages(docs, id_col, text_col, **options)
    by_text = "text_hash" in found.columns
    keys = [F.col("doc_id").alias("__doc"), *([F.col("text_hash").alias("__hash")] if by_text else [])]
    spans = found.groupBy(*keys).agg(F.collect_list(F.struct(F.col("from_word").alias("a"), F.col("to_word").alias("b"))).alias("__spans"))
    spans = materialize(spans, "spans")
    on = F.col(id_col).cast("bigint") == F.col("__doc")
    joined = docs.join(spans, on & (F.xxhash64(F.col(text_col)) == F.col("__hash")) if by_text else on, "left")

    @F.pandas_udf("string")
    def cut(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or s is None else remove_spans(t, [(r["a"], r["b"]) for r in s]) for t, s in zip(text, spans, strict=True)], dtype=object)

    text = F.when(F.col("__spans").isNull(), F.col(text_col)).otherwise(cut(F.col(text_col), "__spans"))
    return joined.withColumn(text_col, text).select(docs.columns)
