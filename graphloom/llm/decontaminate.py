"""Benchmark decontamination by pigeonhole edit matching.

An item of n words may differ from a passage by a budget of word edits. It is split into budget + 1
pieces: a passage within the budget holds one piece at least unchanged. An Aho-Corasick automaton
finds all piece hits in a whole document at once; around each hit, the item is verified with Myers'
bit-parallel distance over words, as approximate search that may begin and end anywhere.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm._shared import frames

#: Share of an item's words that may be edited.
ERROR_RATE = 0.2
#: Benchmark items are read in blocks of so many characters; each block is one pass over the documents.
BLOCK_CHARS = 16 << 20
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """Lower-cased runs of letters and digits."""
    return _WORD.findall((text or "").lower())


def budget(n_words: int, error_rate: float = ERROR_RATE) -> int:
    return min(int(n_words * error_rate), max(0, n_words - 1))


def pieces(item: list[str], errors: int) -> list[tuple[int, int]]:
    """errors + 1 runs of words (from, to), as even as can be."""
    n = errors + 1
    return [(len(item) * i // n, len(item) * (i + 1) // n) for i in range(n)]


class Pattern:
    """An item for Myers' algorithm; integers hold as many bits as the item has words."""

    def __init__(self, item: list[str]):
        self.n = len(item)
        self.peq: dict[str, int] = {}
        for i, w in enumerate(item):
            self.peq[w] = self.peq.get(w, 0) | 1 << i

    def ends(self, text: list[str]) -> list[int]:
        """For each prefix of text, the least distance of the item to a passage that ends there."""
        n, get = self.n, self.peq.get
        mask, top = (1 << n) - 1, 1 << (n - 1)
        pv, mv, score, out = mask, 0, n, []
        for w in text:
            eq = get(w, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | ~(xh | pv) & mask
            mh = pv & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
            ph = ph << 1 & mask
            mh = mh << 1 & mask
            pv = mh | ~(xv | ph) & mask
            mv = ph & xv
            out.append(score)
        return out


def find(item: list[str], text: list[str]) -> tuple[int, int, int]:
    """(distance, from, to) of the first passage of text nearest to item, the longest that ends first."""
    if not text:
        return len(item), 0, 0
    ends = Pattern(item).ends(text)
    best = min(ends)
    to = ends.index(best) + 1
    back = Pattern(item[::-1])
    # the same distance from its end backwards gives where it begins
    from_end = back.ends(text[:to][::-1])
    size = max((k + 1 for k, d in enumerate(_anchored(item[::-1], text[:to][::-1])) if d == best), default=len(from_end))
    return best, to - size, to


def _anchored(item: list[str], text: list[str]) -> list[int]:
    """Distances of item to each prefix of text that is at most twice as long."""
    row = np.arange(len(item) + 1)
    out = []
    target = np.array(item, object)
    for j, w in enumerate(text[: 2 * len(item) + 1]):
        diagonal = row[:-1] + (target != w)
        step = np.concatenate([[j + 1], np.minimum(diagonal, row[1:] + 1)])
        index = np.arange(len(step))
        row = np.minimum.accumulate(step - index) + index
        out.append(int(row[-1]))
    return out


class Matcher:
    def __init__(self, items: list[tuple[int, str]], error_rate: float = ERROR_RATE):
        import ahocorasick

        self.items: list[tuple[int, list[str], int, Pattern]] = []
        hits: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            w = words(text)
            if not w:
                continue
            e = budget(len(w), error_rate)
            for a, b in pieces(w, e):
                hits.setdefault(" " + " ".join(w[a:b]) + " ", []).append((len(self.items), a))
            self.items.append((item_id, w, e, Pattern(w)))
        self.automaton = ahocorasick.Automaton()
        for piece, found in hits.items():
            self.automaton.add_word(piece, (len(piece), found))
        if hits:
            self.automaton.make_automaton()

    def matches(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, from word, to word), for each item within its budget its nearest passage."""
        if not self.items or not text:
            return []
        w = words(text)
        line = " " + " ".join(w) + " "
        near: dict[int, list[tuple[int, int]]] = {}
        for end, (size, found) in self.automaton.iter(line):
            at = end - size + 1  # of the space before the piece
            for k, offset in found:
                near.setdefault(k, []).append((at, offset))
        if not near:
            return []
        starts = np.cumsum([0, *(len(x) + 1 for x in w)])
        out = []
        for k, hits in near.items():
            item_id, item, errors, pattern = self.items[k]
            windows: list[list[int]] = []
            for x in sorted({int(np.searchsorted(starts, at)) - offset for at, offset in hits}):
                a, b = max(0, x - errors), min(len(w), x + len(item) + errors)
                if windows and a <= windows[-1][1]:
                    windows[-1][1] = max(b, windows[-1][1])
                else:
                    windows.append([a, b])
            best = None
            for a, b in windows:
                least = min(pattern.ends(w[a:b]), default=errors + 1)
                if least <= errors and (best is None or least < best[0]):
                    best = (least, a, b)
            if best:
                distance, x, y = find(item, w[best[1] : best[2]])
                out.append((item_id, distance, best[1] + x, best[1] + y))
        return out


MATCH = "doc_id bigint, item_id bigint, distance int, n_words int, from_word int, to_word int"


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", error_rate: float = ERROR_RATE) -> DataFrame:
    """MATCH: a row for each document and item of which a passage is within the item's budget of word edits.

    distance: the least number of words inserted, deleted or replaced; from_word, to_word: where the
    first such passage is in the document's words. The budget is error_rate of an item's words. Items
    are read in blocks of bounded size, each broadcast as one automaton and one pass over the
    documents. Null or wordless items and documents match nothing; equal items all match; a repeated
    document gives repeated rows; a null doc_id is kept. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    items = benchmark.where(F.col(item_text_col).isNotNull()).select(F.col(item_col).cast("bigint").alias("item_id"), F.col(item_text_col).alias("text"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n_blocks = -(-total // BLOCK_CHARS) or 1
    out = None
    for k in range(n_blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == k) if n_blocks > 1 else items
        # about BLOCK_CHARS characters: the query set, not the documents
        held = spark.sparkContext.broadcast(sorted(map(tuple, block.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1])))

        def run(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            matcher = Matcher(held.value, error_rate)
            size = {k: len(w) for k, w, *_ in matcher.items}
            for b in batches:
                found = []
                for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                    found += [(doc_id, i, d, size[i], x, y) for i, d, x, y in matcher.matches(text)]
                if found:
                    yield pd.DataFrame(found, columns=["doc_id", "item_id", "distance", "n_words", "from_word", "to_word"]).astype({"doc_id": "Int64", "item_id": "Int64"})

        part = frames(rows, run, MATCH)
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of docs whose text holds no benchmark passage, with all their columns.

    Each row is judged by its own text (told by its hash), whatever its id: a null or repeated id neither
    keeps a leaking row nor takes a clean one. Null and empty texts stay.
    """
    text = F.col(options.get("text_col", "text"))
    own = docs.select(F.xxhash64(text).alias("doc_id"), text.alias("text")).where("text is not null")
    leaks = find_leaks(own, benchmark, **{k: v for k, v in options.items() if k != "text_col"}).select(F.col("doc_id").alias("__leak")).distinct()
    return docs.join(leaks, F.xxhash64(text) == F.col("__leak"), "left_anti")
