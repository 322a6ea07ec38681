"""SimHash near-duplicates by a self-join of binary tries over 64-bit fingerprints.

A fingerprint takes the majority of the bits of all word-shingle hashes. Equal fingerprints are one
node. Five tries over the nodes are rooted at one of five bit blocks each: fingerprints within four
bits agree on a block at least, so every linked pair stands below one root of one trie. Below it two
trie nodes are walked together, the differing bits so far add up, and a pair of nodes over the error
budget is left. What a root finds is kept as a spanning forest, never as all pairs of a group.

Near copies by the similarity of their shingles (without_near_copies) differ in far more bits than blocks can
bear. Their sketches have 256 bits, many tries are rooted at bits drawn at random, and the shingles of each
link of the forests are compared; where one fails, the pairs that a forest left out are looked for again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm._shared import connected_components, drop, frames, groups, materialize

SEED = 42
#: Pairs of trie nodes with no more pairs of fingerprints than this are compared at once.
LEAF = 4096
#: A root's fingerprints are split into parts of about this many; each pair of parts is a task's share.
PART = 100_000
#: Words of a wide sketch, the tries that it is rooted in, the bits of a root, and the budget of differing bits.
#: At a similarity of 0.8 two sketches differ in about 39 of 256 bits, with a deviation of 6.
WIDE, ROOTS, ROOT_BITS, WIDE_BUDGET = 4, 64, 20, 50
#: A root with no more nodes than this is compared without a trie.
SMALL = 64
#: Nodes and characters of a part of a class that is looked through again.
TORN, TORN_CHARS = 8192, 1 << 25


def shingles(text: str | None, words_per_shingle: int) -> np.ndarray:
    """XXH64 of each run of words, repeats included; of the whole sequence if it is shorter; none without a word."""
    import xxhash

    words = text.encode().lower().split() if text else []  # bytes: lower-cases A-Z, splits at \x20 \x09-\x0D
    n = words_per_shingle
    digest = xxhash.xxh64_intdigest
    if len(words) < n:
        return np.array([digest(b" ".join(words), SEED)] if words else [], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist(), strict=True)), np.uint64, len(words) - n + 1)


def _majority(h: np.ndarray) -> np.ndarray:
    """Of hashes in rows of 64-bit words, the words of the bits that over half of the rows have."""
    ones = np.zeros(h.shape[1] * 64, np.int64)
    for at in range(0, len(h), 65_536):
        bits = np.unpackbits(h[at : at + 65_536].astype(">u8").view(np.uint8), axis=1)
        for k in range(0, len(bits), 255):  # sums of bytes that can't overflow
            ones += bits[k : k + 255].sum(0, dtype=np.uint8)
    return np.packbits(ones * 2 > len(h)).view(">u8").astype(np.uint64)


def fingerprint(text: str | None, words_per_shingle: int = 4) -> int:
    """The unsigned 64-bit fingerprint of a text; zero if it has no word."""
    return int(_majority(shingles(text, words_per_shingle)[:, None])[0])


def sketch(h: np.ndarray) -> np.ndarray:
    """WIDE words of 64 bits, each the fingerprint of another hash of the distinct shingles h."""
    wide = np.empty((len(h), WIDE), np.uint64)
    for k in range(WIDE):
        x = h + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        wide[:, k] = x ^ (x >> np.uint64(31))
    return _majority(wide)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 4) -> DataFrame:
    """(doc_id, fp): one row per row of docs; fp holds the 64 bits as a signed bigint."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.array([fingerprint(t, words_per_shingle) for t in b["text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": b["doc_id"], "fp": fp})

    return frames(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id bigint, fp bigint")


def blocks(bits: int, budget: int) -> list[tuple[int, int]]:
    """budget + 1 blocks (shift, width) that cover the bits, the highest first."""
    n, out, top = budget + 1, [], bits
    for i in range(n):
        width = bits * (i + 1) // n - bits * i // n
        top -= width
        out.append((top, width))
    return out


class _Forest:
    """Labels of a set of items; union() keeps the least index of a class as its label."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def union(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.label[a], self.label[b]
            rest = np.flatnonzero(x != y)
            if not len(rest):
                return
            lo, hi = min(x[rest[0]], y[rest[0]]), max(x[rest[0]], y[rest[0]])
            self.label[self.label == hi] = lo
            a, b = a[rest[1:]], b[rest[1:]]


def trie_join(keys: np.ndarray, left: np.ndarray, right: np.ndarray | None, budget: int, bits: int = 64) -> np.ndarray:
    """Label each of keys (sorted, distinct) by the least one reachable over links found between left and right.

    left, right: indices of keys in order; right None: left with itself. Two trie nodes are runs of
    indices that agree on the bits above depth; they are walked together with the bits that differ so far.
    """
    forest = _Forest(len(keys))
    stack = [(left, left if right is None else right, bits, 0, right is None)]
    while stack:
        a, b, depth, differ, same = stack.pop()
        if not len(a) or not len(b) or same and len(a) == 1:
            continue
        la, lb = forest.label[a], forest.label[b]
        if la[0] == lb[0] and (la == la[0]).all() and (lb == la[0]).all():
            continue  # all of both nodes are linked already
        if len(a) * len(b) <= LEAF or depth == 0:
            i, j = np.nonzero(np.bitwise_count(keys[a][:, None] ^ keys[b][None, :]) <= budget)
            forest.union(a[i], b[j])
            continue
        # go down to the next bit at which either node branches
        x = keys[a[0]]
        spread = int(np.bitwise_or.reduce(keys[a] ^ x) | np.bitwise_or.reduce(keys[b] ^ x)) & ((1 << depth) - 1)
        if not spread:
            forest.union(np.concatenate([a[:-1], b[:1]]) if len(a) > 1 else b[:1], np.concatenate([a[1:], a[:1]]) if len(a) > 1 else a[:1])
            continue
        depth = spread.bit_length() - 1
        bit = np.uint64(1 << depth)
        cut_a, cut_b = int(np.count_nonzero(keys[a] & bit == 0)), int(np.count_nonzero(keys[b] & bit == 0))
        a0, a1, b0, b1 = a[:cut_a], a[cut_a:], b[:cut_b], b[cut_b:]
        if differ < budget:
            stack.append((a0, b1, depth, differ + 1, False))
            if not same:
                stack.append((a1, b0, depth, differ + 1, False))
        stack.append((a0, b0, depth, differ, same))
        stack.append((a1, b1, depth, differ, same))
    return forest.label


def near_links(nodes: DataFrame, budget: int = 4, bits: int = 64) -> DataFrame:
    """(u, v) bigint: links between the distinct fingerprints of nodes (fp) that span all pairs within budget bits.

    A root with many fingerprints is dealt out as pairs of its parts, so that no task holds more than
    two parts of about PART fingerprints, whatever the root holds.
    """
    own = [
        F.struct(F.lit(k).alias("block"), F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1)).alias("root"))
        for k, (shift, width) in enumerate(blocks(bits, budget))
    ]
    rooted = nodes.select("fp", F.explode(F.array(*own)).alias("at")).select("fp", "at.block", "at.root")
    size = rooted.groupBy("block", "root").agg(F.count("*").alias("n")).where("n > 1")
    size = size.select("block", "root", F.ceil(F.col("n") / PART).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    shared = rooted.join(size, ["block", "root"]).withColumn("part", part)
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: F.struct(F.least(x, "part").alias("i"), F.greatest(x, "part").alias("j"))))
    dealt = shared.select("block", "root", "part", "fp", pair.alias("p")).select("block", "root", "p.i", "p.j", "part", "fp")
    spark = nodes.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(n, "block", "root", "i", "j").sortWithinPartitions("block", "root", "i", "j")

    def links(g: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        raw = g["fp"].to_numpy(np.int64).view(np.uint64)
        keys, first = np.unique(raw, return_index=True)
        part = g["part"].to_numpy()[first]
        i, j = int(g["i"].iloc[0]), int(g["j"].iloc[0])
        label = trie_join(keys, np.flatnonzero(part == i), None if i == j else np.flatnonzero(part == j), budget, bits)
        moved = np.flatnonzero(label != np.arange(len(keys)))
        return keys[moved].view(np.int64), keys[label[moved]].view(np.int64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in groups(batches, ["block", "root", "i", "j"]):
            if len(g) > 1:
                u, v = links(g)
                if len(u):
                    yield pd.DataFrame({"u": u, "v": v})

    return frames(dealt, run, "u bigint, v bigint")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 4, budget: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per row of docs.

    fingerprint: 16 lower-case hex digits. component_id: the smallest doc_id reachable over links of
    at most budget differing bits. Null and empty texts have fingerprint zero and are linked like any
    other; rows with a null doc_id take part but never name a component (null where all ids of one
    are null); repeated rows stay repeated; an empty table gives no rows; other columns are ignored.
    """
    fps = materialize(fingerprints(docs, id_col, text_col, words_per_shingle), "fingerprints")
    nodes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    parts = connected_components(near_links(nodes.select("fp"), budget))
    root = F.coalesce("component", "fp").alias("root")
    member = nodes.join(parts.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", root)
    named = member.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = member.join(named, "root").select("fp", "component_id")
    return fps.join(by_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def wide_trie_join(keys: np.ndarray, left: np.ndarray, right: np.ndarray | None, budget: int) -> list[tuple[int, int]]:
    """Links between left and right (right None: left with itself) that span all pairs of keys within budget bits.

    keys: distinct rows of 64-bit words in lexical order; left and right index them in order. Two trie
    nodes are walked together: the bits in which each is of one value, and the two differ, add up, and
    a pair over budget is left; so is one whose rows are all linked. Near halves come before far ones.
    """
    label, links = np.arange(len(keys)), []
    members: dict[int, list[int]] = {}

    def join(x: int, y: int) -> None:  # the smaller class takes the larger one's label
        one, two = members.pop(x, [x]), members.pop(y, [y])
        if len(one) < len(two):
            one, two, x = two, one, y
        label[two] = x
        one.extend(two)
        members[x] = one

    stack = [(left, left if right is None else right, right is None)]
    while stack:
        a, b, same = stack.pop()
        if not len(a) or not len(b) or same and len(a) == 1:
            continue
        la, lb = label[a], label[b]
        if (la == la[0]).all() and (lb == la[0]).all():
            continue
        if len(a) * len(b) <= LEAF:
            d = np.bitwise_count(keys[a][:, None] ^ keys[b][None]).sum(2, dtype=np.int64)
            i, j = np.nonzero((d <= budget) & (la[:, None] != lb[None]))
            order = np.argsort(d[i, j], kind="stable")
            i, j = a[i[order]], b[j[order]]
            while len(i):  # the nearest pair that isn't linked yet
                links.append((int(i[0]), int(j[0])))
                join(int(label[i[0]]), int(label[j[0]]))
                rest = label[i] != label[j]
                i, j = i[rest], j[rest]
            continue
        x, y = keys[a[0]], keys[b[0]]
        vary = np.bitwise_or.reduce(keys[a] ^ x) | np.bitwise_or.reduce(keys[b] ^ y)
        if int(np.bitwise_count((x ^ y) & ~vary).sum()) > budget:
            continue
        word = int(np.flatnonzero(vary)[0])
        bit = np.uint64(1 << (int(vary[word]).bit_length() - 1))
        one_a, one_b = keys[a, word] & bit != 0, keys[b, word] & bit != 0
        a0, a1, b0, b1 = a[~one_a], a[one_a], b[~one_b], b[one_b]
        stack.append((a0, b1, False))
        if not same:
            stack.append((a1, b0, False))
        stack.append((a0, b0, same))
        stack.append((a1, b1, same))
    return links


def _small_links(run: np.ndarray, keys: np.ndarray, budget: int) -> list[tuple[int, int]]:
    """As wide_trie_join, for many small runs of rows at once: nearest pairs first, a spanning forest of each run."""
    p, q, d = [], [], []
    lag = 1
    while lag < len(run):
        at = np.flatnonzero(run[lag:] == run[:-lag])
        if not len(at):
            break
        far = np.bitwise_count(keys[at] ^ keys[at + lag]).sum(1, dtype=np.int64)
        near = far <= budget
        p.append(at[near])
        q.append(at[near] + lag)
        d.append(far[near])
        lag += 1
    if not p:
        return []
    p, q, d = np.concatenate(p), np.concatenate(q), np.concatenate(d)
    order = np.argsort(d, kind="stable")
    up: dict[int, int] = {}
    links = []
    for a, b in zip(p[order].tolist(), q[order].tolist(), strict=True):
        x, y = a, b
        while x in up:
            x = up[x]
        while y in up:
            y = up[y]
        if x != y:
            up[max(x, y)] = min(x, y)
            links.append((a, b))
    return links


def wide_pairs(keys: np.ndarray, label: np.ndarray, left: np.ndarray, right: np.ndarray | None, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of left and right (right None: left with itself) within budget bits whose labels differ, some at a time.

    keys: rows of 64-bit words in lexical order, repeats included; walked as by wide_trie_join.
    """
    stack = [(left, left if right is None else right, right is None)]
    while stack:
        a, b, same = stack.pop()
        if not len(a) or not len(b) or same and len(a) == 1:
            continue
        la, lb = label[a], label[b]
        if (la == la[0]).all() and (lb == la[0]).all():
            continue
        x, y = keys[a[0]], keys[b[0]]
        vary = np.bitwise_or.reduce(keys[a] ^ x) | np.bitwise_or.reduce(keys[b] ^ y)
        if len(a) * len(b) <= LEAF or not vary.any():
            step = max(1, LEAF // len(b))
            for at in range(0, len(a), step):
                some = a[at : at + step]
                near = np.bitwise_count(keys[some][:, None] ^ keys[b][None]).sum(2, dtype=np.int64) <= budget
                near &= label[some][:, None] != lb[None]
                if same:
                    near &= some[:, None] < b[None]
                i, j = np.nonzero(near)
                if len(i):
                    yield some[i], b[j]
            continue
        if int(np.bitwise_count((x ^ y) & ~vary).sum()) > budget:
            continue
        word = int(np.flatnonzero(vary)[0])
        bit = np.uint64(1 << (int(vary[word]).bit_length() - 1))
        one_a, one_b = keys[a, word] & bit != 0, keys[b, word] & bit != 0
        a0, a1, b0, b1 = a[~one_a], a[one_a], b[~one_b], b[one_b]
        stack.append((a0, b1, False))
        if not same:
            stack.append((a1, b0, False))
        stack.append((a0, b0, same))
        stack.append((a1, b1, same))


_WORDS = [f"s{k}" for k in range(WIDE)]


def _drawn() -> np.ndarray:
    """The bits of each root, the highest bit of a sketch's first word being 0."""
    rng = np.random.default_rng(20)
    return np.stack([rng.choice(64 * WIDE, ROOT_BITS, replace=False) for _ in range(ROOTS)])


def _dealt(nodes: DataFrame, *more: str) -> DataFrame:
    """Nodes below each of their roots: (root, i, j, part, node, s0.., more), sorted by root and pair of parts."""
    drawn = _drawn()

    def root(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), 1024):
                b = whole.iloc[at : at + 1024]
                wide = b[_WORDS].to_numpy(np.int64)
                bits = np.unpackbits(np.ascontiguousarray(wide, ">i8").view(np.uint8), axis=1)
                for t in range(ROOTS):
                    own = bits[:, drawn[t]].astype(np.int64) @ (1 << np.arange(ROOT_BITS)) | (t << ROOT_BITS)
                    yield b.assign(root=own)[["root", "node", *_WORDS, *more]]

    schema = ", ".join(f"{c} bigint" for c in ("root", "node", *_WORDS, *more))
    rooted = frames(nodes.select("node", *_WORDS, *more), root, schema)
    hot = rooted.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") > PART)
    hot = materialize(hot.select("root", F.ceil(F.col("n") / PART).cast("int").alias("parts")), "hot")
    small = hot.count() <= 100_000  # 12 bytes a row
    held = rooted.join(F.broadcast(hot) if small else hot, "root", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(F.least(k, "part").alias("i"), F.greatest(k, "part").alias("j"))))
    dealt = held.withColumn("part", part).withColumn("p", pair).select("root", "p.i", "p.j", "part", "node", *_WORDS, *more)
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, "root", "i", "j").sortWithinPartitions("root", "i", "j")


def similar_links(nodes: DataFrame, budget: int = WIDE_BUDGET) -> DataFrame:
    """(u, v) bigint: candidate links between nodes (node, s0..): spanning forests of pairs within budget bits below ROOTS roots.

    A root is ROOT_BITS bits of the sketch drawn at random. A root with many nodes is dealt out as pairs of
    its parts, so that no task holds more than two parts of about PART nodes.
    """
    def large(g: pd.DataFrame) -> list[tuple[int, int]]:
        i, j = int(g["i"].iloc[0]), int(g["j"].iloc[0])
        raw = g[_WORDS].to_numpy(np.int64).view(np.uint64)
        keys, first, of = np.unique(raw, axis=0, return_index=True, return_inverse=True)
        part, node = g["part"].to_numpy(), g["node"].to_numpy(np.int64)
        a = np.flatnonzero(part[first] == i)
        found = wide_trie_join(keys, a, None if i == j else np.flatnonzero(part[first] == j), budget)
        links = [(node[first[x]], node[first[y]]) for x, y in found]
        return links + [(node[first[of[k]]], node[k]) for k in range(len(node)) if first[of[k]] != k]  # equal sketches of other texts

    def some(g: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """Links of whole roots."""
        key = g[["root", "i", "j"]].to_numpy(np.int64)
        starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1)]))
        size = np.diff(np.concatenate([starts, [len(g)]]))
        run, of = np.repeat(np.arange(len(starts)), size), np.repeat(size, size)
        whole = np.flatnonzero((of > 1) & (of <= SMALL) & (g["i"].to_numpy() == g["j"].to_numpy()))
        node = g["node"].to_numpy(np.int64)
        links = [(node[whole[a]], node[whole[b]]) for a, b in _small_links(run[whole], g[_WORDS].to_numpy(np.int64).view(np.uint64)[whole], budget)]
        for k in np.flatnonzero((size > SMALL) | ((size > 1) & (key[starts, 1] != key[starts, 2]))).tolist():
            links += large(g.iloc[starts[k] : starts[k] + size[k]])
        if links:
            u, v = np.array(links, np.int64).T
            yield pd.DataFrame({"u": np.minimum(u, v), "v": np.maximum(u, v)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for b in batches:
            if not len(b):
                continue
            key = b[["root", "i", "j"]].to_numpy(np.int64)
            last = int(np.flatnonzero((key != key[-1]).any(1))[-1]) + 1 if (key != key[-1]).any() else 0
            if last:  # the root that the batch ends in may go on
                yield from some(pd.concat([*held, b.iloc[:last]], ignore_index=True))
                held = []
            elif held and tuple(held[-1][["root", "i", "j"]].iloc[-1]) != tuple(key[0]):
                yield from some(pd.concat(held, ignore_index=True))
                held = []
            held.append(b.iloc[last:])
        if held:
            yield from some(pd.concat(held, ignore_index=True))

    return frames(_dealt(nodes), run, "u bigint, v bigint").distinct()


def unlinked_pairs(nodes: DataFrame, budget: int = WIDE_BUDGET) -> DataFrame:
    """(u, v, d) bigint: all pairs of nodes (node, s0.., label) within budget bits below a common root whose labels differ; d: their bits.

    Each pair comes once, from the first root that it shares.
    """
    masks = np.zeros((ROOTS, WIDE), np.uint64)
    for t, bits in enumerate(_drawn()):
        np.bitwise_or.at(masks[t], bits // 64, np.uint64(1) << (63 - bits % 64).astype(np.uint64))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in groups(batches, ["root", "i", "j"]):
            label = g["label"].to_numpy(np.int64)
            if len(g) < 2 or (label == label[0]).all():
                continue
            keys = g[_WORDS].to_numpy(np.int64).view(np.uint64)
            order = np.lexsort(keys.T[::-1])
            keys, label, node, part = keys[order], label[order], g["node"].to_numpy(np.int64)[order], g["part"].to_numpy(np.int64)[order]
            i, j, t = int(g["i"].iloc[0]), int(g["j"].iloc[0]), int(g["root"].iloc[0]) >> ROOT_BITS
            for a, b in wide_pairs(keys, label, np.flatnonzero(part == i), None if i == j else np.flatnonzero(part == j), budget):
                apart = keys[a] ^ keys[b]
                first = ~((apart[:, None] & masks[None, :t]) == 0).all(2).any(1)
                u, v = node[a[first]], node[b[first]]
                if len(u):
                    yield pd.DataFrame({"u": np.minimum(u, v), "v": np.maximum(u, v), "d": np.bitwise_count(apart[first]).sum(1, dtype=np.int64)})

    return frames(_dealt(nodes, "label"), run, "u bigint, v bigint, d bigint")


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of shingles, each sorted and distinct; of two empty ones 1."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def _verified(links: DataFrame, texts: DataFrame, words_per_shingle: int, at_least: float) -> DataFrame:
    """Those of links (u, v) whose texts (node, text) have a similarity of at_least or more."""
    one = links.join(texts.select(F.col("node").alias("u"), F.col("text").alias("a")), "u")
    both = one.join(texts.select(F.col("node").alias("v"), F.col("text").alias("b")), "v").select("u", "v", "a", "b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in batches:
            of = [np.unique(shingles(a, words_per_shingle)) for a in g["a"]], [np.unique(shingles(b, words_per_shingle)) for b in g["b"]]
            yield g.loc[[similarity(a, b) >= at_least for a, b in zip(*of, strict=True)], ["u", "v"]]

    return frames(both, run, "u bigint, v bigint")


def similarities(one: list[np.ndarray], other: list[np.ndarray]) -> np.ndarray:
    """The similarity of each of one with each of the other: sets of shingles, each sorted and distinct."""
    size = np.array([len(x) for x in one])[:, None], np.array([len(x) for x in other])[None]
    both = np.zeros((len(one), len(other)))
    row = [np.repeat(np.arange(len(of)), [len(x) for x in of]) for of in (one, other)]
    known, at = np.unique(np.concatenate([*one, *other]), return_inverse=True)
    at = at[: len(row[0])], at[len(row[0]) :]
    for low in range(0, len(known), 8192):
        has = []
        for k, of in enumerate((one, other)):
            on = (at[k] >= low) & (at[k] < low + 8192)
            has.append(np.zeros((len(of), min(8192, len(known) - low)), np.float32))
            has[k][row[k][on], at[k][on] - low] = 1
        both += has[0] @ has[1].T
    return np.where(size[0] + size[1] > 0, both / np.maximum(size[0] + size[1] - both, 1), 1.0)


def torn_links(nodes: DataFrame, words_per_shingle: int, at_least: float, budget: int = WIDE_BUDGET) -> DataFrame:
    """(u, v): links that hold and span all pairs within budget bits, of one class and of two labels, whose texts hold.

    nodes: (node, s0.., text, wide, label), wide the class. A class is dealt out as pairs of its parts. A task compares the texts
    of its pairs where they are and gives a spanning forest; pairs that fail are never rows.
    """
    chars = F.sum(F.coalesce(F.length("text"), F.lit(0)))
    parts = F.ceil(F.greatest(F.count("*") / TORN, chars / TORN_CHARS)).cast("int")
    size = materialize(nodes.groupBy("wide").agg(F.greatest(parts, F.lit(1)).alias("parts")), "torn")
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(F.least(k, "part").alias("i"), F.greatest(k, "part").alias("j"))))
    held = nodes.join(size, "wide").withColumn("part", part).withColumn("p", pair)
    dealt = held.select("wide", "p.i", "p.j", "part", "node", *_WORDS, "label", "text")
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def links(g: pd.DataFrame) -> list[tuple[int, int]]:
        keys = g[_WORDS].to_numpy(np.int64).view(np.uint64)
        order = np.lexsort(keys.T[::-1])
        keys, part, node, text = keys[order], g["part"].to_numpy(np.int64)[order], g["node"].to_numpy(np.int64)[order], g["text"].to_numpy()[order]
        label = g["label"].to_numpy(np.int64)[order].copy()
        own: dict[int, np.ndarray] = {}
        found = []
        i, j = int(g["i"].iloc[0]), int(g["j"].iloc[0])
        for a, b in wide_pairs(keys, label, np.flatnonzero(part == i), None if i == j else np.flatnonzero(part == j), budget):
            for k in {*a.tolist(), *b.tolist()} - own.keys():
                own[k] = np.unique(shingles(text[k], words_per_shingle))
            (x, at_x), (y, at_y) = np.unique(a, return_inverse=True), np.unique(b, return_inverse=True)
            if len(a) * 8 < len(x) * len(y):
                holds = np.array([similarity(own[p], own[q]) >= at_least for p, q in zip(a.tolist(), b.tolist(), strict=True)])
            else:
                holds = similarities([own[k] for k in x.tolist()], [own[k] for k in y.tolist()])[at_x, at_y] >= at_least
            for p, q in zip(a[holds].tolist(), b[holds].tolist(), strict=True):
                if label[p] != label[q]:
                    found.append((int(node[p]), int(node[q])))
                    label[label == label[p]] = label[q]  # wide_pairs leaves what is of one label by now
        return found

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in groups(batches, ["wide", "i", "j"]):
            found = links(g) if len(g) > 1 and g["label"].nunique() > 1 else []
            if found:
                u, v = np.array(found, np.int64).T
                yield pd.DataFrame({"u": np.minimum(u, v), "v": np.maximum(u, v)})

    return frames(dealt.repartition(n, "wide", "i", "j").sortWithinPartitions("wide", "i", "j"), run, "u bigint, v bigint")


def verified_links(nodes: DataFrame, texts: DataFrame, words_per_shingle: int, at_least: float, links: DataFrame) -> DataFrame:
    """(u, v): those of links that hold, and as many of the pairs that the forests left out as it takes to join all that hold.

    A forest spans the pairs below a root, but a link of it may fail. What links join, though links that hold don't,
    is therefore looked through again, whole: all its pairs within the budget (see torn_links).
    """
    good = materialize(_verified(links, texts, words_per_shingle, at_least), "verified")
    if good.count() == links.count():
        return good
    label = lambda of, name: connected_components(of).select("node", F.col("component").alias(name))
    both = label(links, "wide").join(label(good, "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    both = materialize(both, "classes")
    torn = both.groupBy("wide").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("wide")
    again = nodes.select("node", *_WORDS).join(both.join(torn, "wide", "left_semi"), "node").join(texts.select("node", "text"), "node")
    return materialize(good.unionByName(torn_links(again, words_per_shingle, at_least)), "verified")


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 5, at_least: float = 0.8) -> DataFrame:
    """One row of docs for each group of near copies, with all its columns: that with the smallest id.

    Two texts are linked if the sets of their shingles have a Jaccard similarity of at_least or more; a group
    is what links reach. Texts with the same shingles are one node. Candidates are those of similar_links,
    made for 0.8 and more; each is verified on whole texts, so that no link is false, and where some fail the pairs
    that they stood for are verified too (see verified_links). A row is told by its
    id and its text's hash: of rows that repeat an id with other texts only the copies go, and of rows equal
    in both one stays, whichever. Null ids come after all others, so that a row with one stays only where
    its group has no id; of several rows with the least id, or with null ids alone, that with the least hash
    stays. Null and empty texts and texts without words are one group. An empty table gives no rows.
    """
    import xxhash

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own = [np.unique(shingles(t, words_per_shingle)) for t in b["text"]]
            node = np.array([xxhash.xxh64_intdigest(h.tobytes(), SEED) for h in own], np.uint64).view(np.int64)
            wide = np.array([sketch(h) for h in own], np.uint64).reshape(len(b), WIDE).view(np.int64)
            yield pd.DataFrame({"k": b["k"], "h": b["h"], "node": node} | {w: wide[:, i] for i, w in enumerate(_WORDS)})

    text_of = F.col(text_col).alias("text")
    key = [F.col(id_col).cast("bigint").alias("k"), F.xxhash64(text_col).alias("h")]
    schema = "k bigint, h bigint, node bigint, " + ", ".join(f"{w} bigint" for w in _WORDS)
    fps = materialize(frames(docs.select(*key, text_of), run, schema), "fingerprints")
    nodes = materialize(fps.groupBy("node").agg(F.min("h").alias("h"), *(F.min(w).alias(w) for w in _WORDS)), "nodes")
    links = materialize(similar_links(nodes), "candidates")
    ends = links.select(F.col("u").alias("node")).unionByName(links.select(F.col("v").alias("node"))).distinct()
    asked = nodes.select("node", "h").join(ends, "node")
    texts = docs.select(F.xxhash64(text_col).alias("h"), text_of).join(asked, "h").groupBy("node").agg(F.min("text").alias("text"))
    texts = materialize(texts, "texts")
    parts = connected_components(verified_links(nodes, texts, words_per_shingle, at_least, links))
    drop(texts)
    order = F.struct(F.col("k").isNull().alias("last"), F.col("k"), F.col("h"))
    of_fp = fps.groupBy("node").agg(F.min(order).alias("least")).join(parts, "node", "left").withColumn("root", F.coalesce("component", "node"))
    of_root = of_fp.groupBy("root").agg(F.min("least").alias("least"))
    stays = of_fp.select("node", "root").join(of_root, "root").select("node", F.col("least.k").alias("stay_k"), F.col("least.h").alias("stay_h"))
    rows = fps.groupBy("node", "k", "h").agg(F.count("*").alias("n")).join(stays, "node")
    rows = materialize(rows.withColumn("stays", F.col("k").eqNullSafe(F.col("stay_k")) & (F.col("h") == F.col("stay_h"))).select("k", "h", "n", "stays"), "copies")
    same = F.col(id_col).cast("bigint").eqNullSafe(F.col("__k")) & (F.xxhash64(text_col) == F.col("__h"))
    keys = lambda of: rows.where(of).select(F.col("k").alias("__k"), F.col("h").alias("__h"))
    kept = docs.join(keys("not stays"), same, "left_anti")
    if rows.where("stays and n > 1").isEmpty():
        return kept
    again = keys("stays and n > 1")
    one = kept.join(again, same).dropDuplicates(["__k", "__h"]).select(docs.columns)
    return kept.join(again, same, "left_anti").unionByName(one)
