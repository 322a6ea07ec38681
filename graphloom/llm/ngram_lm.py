"""Language-model scores from a log-frequency Bloom filter of n-gram counts.

All pairs and triples of tokens of the training texts are counted. Those that occur twice or more go
into the filter: one entry for each level up to the quantised log-count; a count is read back by asking
for level after level until one is missing. Words are counted exactly.

The model interpolates as Witten and Bell do. With c* the quantised count read from the filter, T(h) the
exact sum of c*(h w) over all w, and E(h) the number of different words that follow h in the filter plus
the occurrences of h that none of them explains,

    P(w | u v) = (c*(u v w) + E(u v) P(w | v)) / (T(u v) + E(u v)),
    P(w | v) = (c*(v w) + E(v) P(w)) / (T(v) + E(v)),   P(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)),

and a history without any pair or triple in the filter takes the next shorter one. T is summed from the
levels that the filter itself gives, so that the shares of a history add up to one, whatever the
quantisation does; only a false positive of two levels at once could add to them.

Keys are told by 32 bits within a slot, and slots grow in number with the corpus. Filters and tables are
cut into parts by the key's slot, each of a bounded size, and broadcast; a worker asks the parts one
after the other for the tokens it holds. One part serves small corpora; more parts change nothing but
the order of additions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm._shared import column_words, drop, frames, groups, materialize

#: Bytes of filters, or of tables, in one broadcast part at most, but for what one slot holds.
PART_BYTES = 16 << 20
#: Bits of an entry in a filter by itself, and in the model, where a kept count has two entries at least.
BITS_PER_ENTRY, MODEL_BITS = 20, 14
LEVELS = 40
ADD = 0.1
#: Counts that the filter keeps at least.
LEAST = 2
END = np.uint64(0x6A09E667F3BCC909)
#: Tokens that a worker counts at once, those it holds while the parts pass by, those it asks for at once, and characters that make a slot.
COUNT, HOLD, STEP, _SLOT_CHARS = 1 << 18, 1 << 18, 1 << 16, 1 << 23
_WORD, _PAIR, _TRIPLE = 1, 2, 3


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def tokens(text: str | None) -> np.ndarray:
    """The hashes of a text's tokens: its words, A-Z lower-cased, and one end."""
    return np.concatenate([w for _, w, _ in column_tokens(pa.array([text], pa.string()))])


def column_tokens(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, tokens, tokens of each row) of a column of texts, some rows at a time."""
    for first, h, size in column_words(column):
        w = np.full(len(h) + len(size), END, np.uint64)
        inner = np.ones(len(w), bool)
        inner[np.cumsum(size + 1) - 1] = False
        w[inner] = h
        yield first, w, size + 1


def bigrams(w: np.ndarray) -> np.ndarray:
    """Keys of (previous token, token); their top 8 bits are those of the token's hash. An end comes before the first."""
    return pair_keys(np.concatenate([[END], w[:-1]]), w)


def pair_keys(before: np.ndarray, w: np.ndarray) -> np.ndarray:
    return _mix(before * np.uint64(0x9E3779B97F4A7C15) + w) >> np.uint64(8) | w & np.uint64(0xFF << 56)


def contexts(w: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The token before each token of texts that stand end to end, and the one before that; ends come before a text."""
    starts = np.cumsum(size) - size
    v = np.concatenate([[END], w[:-1]]) if len(w) else w
    v[starts] = END
    u = np.concatenate([[END], v[:-1]]) if len(w) else w
    u[starts] = END
    return v, u


def triple_keys(u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return _mix(u * np.uint64(0xC2B2AE3D27D4EB4F) + _mix(v * np.uint64(0x165667B19E3779F9) + w))


def level(count: np.ndarray) -> np.ndarray:
    """1 for a count of 1, 2 for 2 and 3, 3 for 4 to 7, and so on."""
    return np.minimum(np.frexp(count.astype(np.float64))[1], LEVELS)


#: The count that a level stands for: the geometric middle of its counts.
VALUE = np.array([0.0, 1.0] + [2.0 ** (q - 1) * 1.19 for q in range(2, LEVELS + 1)])


def _places(keys: np.ndarray, q: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """The upper half that chooses a 64-bit cell, and the four bits in it, of each key's entry for level q."""
    h = _mix(keys + np.uint64((q * 0x9E3779B97F4A7C15 + salt * 0xD6E8FEB86659FD93) & (1 << 64) - 1))
    bits = np.uint64(1) << (h & np.uint64(63))
    for shift in (6, 12, 18):
        bits |= np.uint64(1) << ((h >> np.uint64(shift)) & np.uint64(63))
    return h >> np.uint64(32), bits


def build(keys: np.ndarray, counts: np.ndarray, salt: int, bits_per_entry: int = BITS_PER_ENTRY) -> np.ndarray:
    """The cells of a filter for these keys and counts."""
    q = level(counts)
    cells = np.zeros(int(q.sum()) * bits_per_entry // 64 + 1, np.uint64)
    for k in range(1, int(q.max(initial=0)) + 1):
        at, bits = _places(keys[q >= k], k, salt)
        np.bitwise_or.at(cells, (at * np.uint64(len(cells)) >> np.uint64(32)).astype(np.int64), bits)
    return cells


class Filter:
    """The filters of all slots, end to end."""

    def __init__(self, slots: list[np.ndarray], salt: int):
        self.size = np.array([len(s) for s in slots], np.uint64)
        self.begin = np.concatenate([[0], np.cumsum(self.size)[:-1]]).astype(np.uint64)
        self.cells, self.salt = np.concatenate(slots), salt

    def levels(self, keys: np.ndarray) -> np.ndarray:
        out, on = np.zeros(len(keys), np.int64), np.arange(len(keys))
        n = np.uint64(len(self.size))
        for q in range(1, LEVELS + 1):
            k = keys[on]
            slot = (k % n).astype(np.int64)
            at, bits = _places(k, q, self.salt)
            cell = self.cells[(self.begin[slot] + (at * self.size[slot] >> np.uint64(32))).astype(np.int64)]
            on = on[cell & bits == bits]
            if not len(on):
                break
            out[on] = q
        return out


def _by_slot(slot: np.ndarray) -> tuple[np.ndarray, list[int], list[tuple[int, int]]]:
    """(order, slots, from and to of each in that order)."""
    order = np.argsort(slot, kind="stable")
    at = slot[order]
    cuts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])).tolist() if len(at) else []
    return order, at[cuts].tolist(), list(zip(cuts, [*cuts[1:], len(at)][: len(cuts)], strict=True))


def _told(keys: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """(slot, the 32 bits that tell a key within it); slots is a power of two."""
    return (keys & np.uint64(slots - 1)).astype(np.int64), (keys >> np.uint64(slots.bit_length() - 1)).astype("<u4")


def _gather(docs: DataFrame, slots: int) -> DataFrame:
    """(kind, slot, n, total, entries, keys, counts): what of words, pairs and triples occurs how often in docs (text).

    n: how many there are; keys and counts are of all words, and of pairs and triples that occur LEAST
    times. A task adds up what it holds at a time, so that a frequent n-gram is few rows of its slot.
    """
    schema = pa.schema([("kind", pa.int32()), ("slot", pa.int32()), ("one", pa.binary()), ("many", pa.binary()), ("times", pa.binary())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            w, sizes = (np.concatenate(x) for x in zip(*held, strict=True))
            v, u = contexts(w, sizes)
            for kind, all_keys in ((_WORD, w), (_PAIR, pair_keys(v, w)), (_TRIPLE, triple_keys(u, v, w))):
                keys, n = np.unique(all_keys, return_counts=True)
                slot, key = _told(keys, slots)
                order, full, runs = _by_slot(slot)
                n = n[order].astype("<u4")
                key = (keys if kind == _WORD else key)[order]
                single = (n == 1) if kind != _WORD else np.zeros(len(n), bool)
                cut = lambda x, on: [x[a:z][on[a:z]].tobytes() for a, z in runs]  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(full), pa.int32()), pa.array(full, pa.int32()), *(pa.array(c, pa.binary()) for c in (cut(key, single), cut(key, ~single), cut(n, ~single)))], schema=schema)

        for b in batches:
            for _, w, sizes in column_tokens(b.column(0)):
                held.append((w, sizes))
                size += len(w)
                if size >= COUNT:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in groups(batches, ["kind", "slot"]):
            kind = int(g["kind"].iloc[0])
            of = np.uint64 if kind == _WORD else "<u4"
            one = np.concatenate([np.frombuffer(k, of) for k in g["one"]])
            keys, inverse = np.unique(np.concatenate([one, *(np.frombuffer(k, of) for k in g["many"])]), return_inverse=True)
            times = np.concatenate([np.ones(len(one)), *(np.frombuffer(c, "<u4") for c in g["times"])])
            n = np.bincount(inverse, times, len(keys)).astype(np.int64)
            total, distinct = int(n.sum()), len(keys)
            if kind != _WORD:
                keys, n = keys[n >= LEAST], n[n >= LEAST]
            yield pd.DataFrame({"kind": [kind], "slot": [int(g["slot"].iloc[0])], "n": [distinct], "total": [total], "entries": [int(level(n).sum())], "keys": [keys.tobytes()], "counts": [n.tobytes()]})

    parts = docs.mapInArrow(count, "kind int, slot int, one binary, many binary, times binary")
    parts = parts.repartition(max(1, slots // 8), "slot").sortWithinPartitions("kind", "slot")
    return frames(parts, merge, "kind int, slot int, n bigint, total bigint, entries bigint, keys binary, counts binary")


class Part:
    """What is asked of one part of the slots: those that leave `number` when divided by 1 << shift."""

    def __init__(self, number: int, shift: int, slots: int, held: dict):
        self.number, self.shift, self.slots, self.held = number, shift, slots, held

    def own(self, keys: np.ndarray) -> np.ndarray:
        return np.flatnonzero((keys & np.uint64((1 << self.shift) - 1)) == np.uint64(self.number)) if self.shift else np.arange(len(keys))

    def levels(self, kind: int, keys: np.ndarray) -> np.ndarray:
        """Levels of n-grams of this part; a kept count has a level of two at least."""
        got = np.zeros(len(keys), np.int8)
        for at in range(0, len(keys), STEP):
            got[at : at + STEP] = self.held[kind].levels((keys[at : at + STEP] & np.uint64((self.slots << 32) - 1)) >> np.uint64(self.shift))
        got[got < int(level(np.array([LEAST]))[0])] = 0
        return got

    def look(self, kind: int, keys: np.ndarray) -> tuple[np.ndarray, ...]:
        """The table's columns for keys of this part, 0 for those it hasn't."""
        known, *columns = self.held[kind]
        if not len(known):
            return tuple(np.zeros(len(keys), c.dtype) for c in columns)
        if kind != _WORD:
            keys = keys & np.uint64((self.slots << 32) - 1)
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        hit = known[at] == keys
        return tuple(np.where(hit, c[at], c.dtype.type(0)) for c in columns)


def _broadcast(rows: DataFrame, slots: int, total: int, part_bytes: int, make) -> list:
    """Broadcasts of Part. rows: (kind, slot, a, b, c), written; make turns one part's rows into what it holds."""
    shift = 0
    while 1 << shift < slots and total >> shift > part_bytes:
        shift += 1
    spark, out, held, at = rows.sparkSession, [], [], 0
    last = (1 << shift) - 1
    part = F.pmod(F.col("slot"), F.lit(1 << shift)).alias("part")

    def done() -> None:
        out.append(spark.sparkContext.broadcast(Part(at, shift, slots, make(held, shift))))
        held.clear()

    for r in rows.select(part, "*").repartitionByRange(1 << shift, "part").sortWithinPartitions("part", "kind", "slot").toLocalIterator():
        while r.part > at:
            done()
            at += 1
        held.append((r.kind, r.slot, bytes(r.a), bytes(r.b), bytes(r.c)))
    while at <= last:
        done()
        at += 1
    return out


def _filters(counts: DataFrame, slots: int, part_bytes: int, bits: int) -> list:
    """The filters of pairs and triples; each slot's is built by the executors."""

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for kind, slot, shift, k, c in zip(b["kind"], b["slot"], b["shift"], b["keys"], b["counts"], strict=True):
                # the key within a part: all but the low bits that are the part's number
                keys = (np.frombuffer(k, "<u4").astype(np.uint64) * np.uint64(slots) + np.uint64(slot)) >> np.uint64(shift)
                yield pd.DataFrame({"kind": [kind], "slot": [slot], "a": [build(keys, np.frombuffer(c, np.int64), kind, bits).tobytes()], "b": [b""], "c": [b""]})

    total = (counts.where(F.col("kind") != _WORD).agg(F.sum("entries")).first()[0] or 0) * bits // 8
    shift = 0
    while 1 << shift < slots and total >> shift > part_bytes:
        shift += 1
    rows = counts.where(F.col("kind") != _WORD).select("kind", "slot", F.lit(shift).alias("shift"), "keys", "counts")
    built = materialize(frames(rows, cells, "kind int, slot int, a binary, b binary, c binary"), "cells")

    def make(held: list, shift: int) -> dict:
        found = {k: [np.zeros(1, np.uint64)] * (slots >> shift) for k in (_PAIR, _TRIPLE)}
        for kind, slot, a, _, _ in held:
            found[kind][slot >> shift] = np.frombuffer(a, np.uint64)
        return {k: Filter(f, k) for k, f in found.items()}

    out = _broadcast(built, slots, total, part_bytes, make)
    drop(built)
    return out


def _tables(counts: DataFrame, histories: DataFrame, slots: int, part_bytes: int) -> list:
    """The exact counts of words, and T and the number of followers of histories of one and of two tokens."""
    words = counts.where(F.col("kind") == _WORD).select("kind", "slot", F.col("keys").alias("a"), F.col("counts").alias("b"), F.lit(b"").alias("c"))
    rows = words.unionByName(histories)
    total = rows.agg(F.sum(F.length("a") * F.when(F.col("kind") == _WORD, 2).otherwise(4))).first()[0] or 0

    def make(held: list, shift: int) -> dict:
        out = {}
        for kind, of in ((_WORD, np.uint64), (_PAIR, "<u4"), (_TRIPLE, "<u4")):
            mine = [r for r in held if r[0] == kind]
            keys = [np.frombuffer(a, of).astype(np.uint64) * np.uint64(1 if kind == _WORD else slots) + np.uint64(0 if kind == _WORD else slot) for _, slot, a, _, _ in mine]
            columns = [(np.int64, 3)] if kind == _WORD else [("<f4", 3), ("<u4", 4)]
            key = np.concatenate([np.zeros(0, np.uint64), *keys])
            order = np.argsort(key)
            out[kind] = (key[order], *(np.concatenate([np.zeros(0, t), *(np.frombuffer(r[i], t) for r in mine)])[order] for t, i in columns))
        return out

    return _broadcast(rows, slots, total, part_bytes, make)


def _fold(id_col: str, n: int) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % n, F.lit(n - 1))


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Rows (first column, text) in portions of about HOLD tokens: their first column, tokens and how many each has."""
    ids, held, size = [], [], 0
    for b in batches:
        names = b.column(0).to_pylist()
        for first, w, sizes in column_tokens(b.column(1)):
            ids += names[first : first + len(sizes)]
            held.append((w, sizes))
            size += len(w)
            if size >= HOLD:
                yield ids, *(np.concatenate(x) for x in zip(*held, strict=True))
                ids, held, size = [], [], 0
    if held:
        yield ids, *(np.concatenate(x) for x in zip(*held, strict=True))


def _each(parts: list) -> Iterator[Part]:
    """The parts one after the other; where there are several, they don't stay in the worker's memory together."""
    part = None
    for p in parts:
        del part
        part = p.value if len(parts) == 1 or getattr(p, "_path", None) is None else p.load_from_path(p._path)
        yield part


def _levels(parts: list, pairs: np.ndarray, triples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    out = np.zeros(len(pairs), np.int8), np.zeros(len(pairs), np.int8)
    for part in _each(parts):
        for kind, keys, into in ((_PAIR, pairs, out[0]), (_TRIPLE, triples, out[1])):
            own = part.own(keys)
            into[own] = part.levels(kind, keys[own])
        del part
    return out


def _histories(docs: DataFrame, filters: list, slots: int) -> DataFrame:
    """(kind, slot, a, b, c): keys, T and number of followers of the histories of pairs and triples in the filters."""
    schema = pa.schema([("kind", pa.int32()), ("slot", pa.int32()), ("key", pa.binary()), ("gram", pa.binary()), ("level", pa.binary())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, w, sizes in _held(batches):
            v, u = contexts(w, sizes)
            pairs, triples = pair_keys(v, w), triple_keys(u, v, w)
            two, three = _levels(filters, pairs, triples)
            for kind, history, grams, got in ((_PAIR, v, pairs, two), (_TRIPLE, pair_keys(u, v), triples, three)):
                on = np.flatnonzero(got)
                _, first = np.unique(grams[on], return_index=True)
                on = on[first]
                slot, key = _told(history[on], slots)
                order, full, runs = _by_slot(slot)
                columns = key[order], _told(grams[on], slots)[1][order], got[on][order]
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(full), pa.int32()), pa.array(full, pa.int32()), *(pa.array([x[a:z].tobytes() for a, z in runs], pa.binary()) for x in columns)], schema=schema)

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in groups(batches, ["kind", "slot"]):
            key, gram, got = (np.concatenate([np.frombuffer(x, t) for x in g[c]]) for c, t in (("key", "<u4"), ("gram", "<u4"), ("level", np.int8)))
            both, first = np.unique(key.astype(np.uint64) << np.uint64(32) | gram, return_index=True)
            keys, inverse = np.unique((both >> np.uint64(32)).astype("<u4"), return_inverse=True)
            total = np.bincount(inverse, VALUE[got[first]], len(keys)).astype("<f4")
            yield pd.DataFrame({"kind": [int(g["kind"].iloc[0])], "slot": [int(g["slot"].iloc[0])], "a": [keys.tobytes()], "b": [total.tobytes()], "c": [np.bincount(inverse, minlength=len(keys)).astype("<u4").tobytes()]})

    parts = docs.select(F.lit(None).cast("int").alias("id"), "text").mapInArrow(find, "kind int, slot int, key binary, gram binary, level binary")
    parts = parts.repartition(max(1, slots // 8), "slot").sortWithinPartitions("kind", "slot")
    return frames(parts, merge, "kind int, slot int, a binary, b binary, c binary")


@dataclass
class Model:
    """n training tokens, v different ones, and how many texts; broadcasts of the filters' and the tables' parts."""

    n: int = 0
    v: int = 0
    texts: int = 0
    filters: list = field(default_factory=list)
    tables: list = field(default_factory=list)

    def probabilities(self, w: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the tokens of texts that stand end to end: exact counts, P(w), and P given the two tokens before."""
        if not self.n:
            return np.zeros(len(w), np.int64), np.ones(len(w)), np.ones(len(w))
        v, u = contexts(w, sizes)
        before, triples = pair_keys(u, v), triple_keys(u, v, w)
        del u
        two, three = _levels(self.filters, pair_keys(v, w), triples)
        del triples
        c = np.zeros(len(w), np.int64)
        after = {k: (np.zeros(len(w), np.float32), np.zeros(len(w), np.uint32)) for k in (_PAIR, _TRIPLE)}
        for part in _each(self.tables):
            own = part.own(w)
            (c[own],) = part.look(_WORD, w[own])
            for kind, keys in ((_PAIR, v), (_TRIPLE, before)):
                own = part.own(keys)
                for into, got in zip(after[kind], part.look(kind, keys[own]), strict=True):
                    into[own] = got
            del part
        # how often the histories occur: words exactly, pairs as the filter has them
        first = np.cumsum(sizes) - sizes
        of_v, of_uv = np.concatenate([[0], c[:-1]]), np.concatenate([[0], two[:-1]])
        of_v[first] = self.texts
        of_uv[first] = level(np.array([self.texts]))[0]
        unigram = p = (c + ADD) / (self.n + ADD * (self.v + 1))
        for kind, got, often in ((_PAIR, two, of_v), (_TRIPLE, three, VALUE[of_uv])):
            total, followers = after[kind][0].astype(np.float64), after[kind][1]
            escape = followers + np.maximum(0.0, often - total)
            p = np.where(total > 0, (VALUE[got] + escape * p) / np.maximum(total + escape, 1e-9), p)
        return c, unigram, p


def fit(docs: DataFrame, text_col: str = "text", part_bytes: int = PART_BYTES, bits: int = MODEL_BITS) -> Model:
    """A model of all texts of docs; a null text is an empty one. No rows give a model that knows nothing."""
    train = docs.select(F.col(text_col).alias("text"))
    size = train.agg(F.count("*").alias("texts"), F.sum(F.length("text")).alias("chars")).first()
    n = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slots = 1 << max(4, (max(n, (size.chars or 0) // _SLOT_CHARS) - 1).bit_length())
    counts = materialize(_gather(train, slots), "ngrams")
    stats = counts.where(F.col("kind") == _WORD).agg(F.sum("total").alias("n"), F.sum("n").alias("v")).first()
    if not stats.n:
        drop(counts)
        return Model()
    model = Model(stats.n, stats.v, size.texts)
    model.filters = _filters(counts, slots, part_bytes, bits)
    histories = materialize(_histories(train, model.filters, slots), "histories")
    model.tables = _tables(counts, histories, slots, part_bytes)
    drop(histories)
    drop(counts)
    return model


SCORE = "doc_id bigint, n_tokens bigint, n_known bigint, base_score double, score double"


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, part_bytes: int = PART_BYTES, bits: int = MODEL_BITS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per row of docs.

    Trained on the rows whose crc32(doc_id) mod folds is not 0, those with a null id among them. A null
    or empty text has one token, its end. Without training rows the model knows nothing and both scores
    are those of a certain text, 0. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), _fold(id_col, folds).alias("fold"))
    model = fit(rows.where("fold <> 0"), "text", part_bytes, bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
        for ids, w, sizes in _held(batches):
            c, unigram, p = model.probabilities(w, sizes)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            add = lambda x: np.bincount(doc, x, len(sizes))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes.astype(np.int64)), pa.array(add(c > 0).astype(np.int64)), pa.array(add(np.log10(unigram))), pa.array(add(np.log10(p)))], schema=schema)

    out = rows.select("doc_id", "text").mapInArrow(run, SCORE)
    return out.select("doc_id", (_fold("doc_id", folds) == 0).alias("held_out"), "n_tokens", "n_known", F.lit(model.n).cast("bigint").alias("train_tokens"), "base_score", "score")
