"""Language identification by the nearest of several centroids per language.

A text is a vector of hashed character 1- to 3-grams over its lower-cased letters, weighted by
TF-IDF and normalised. Each language's training vectors are clustered by spherical k-means, so that
a language may have several centroids (spellings, mixtures, genres); a text takes the language of
the centroid with the highest cosine, and is rejected where it is too far from all of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm._shared import frames

#: Buckets of hashed n-grams, a power of two.
BUCKETS = 8192
#: Texts that the centroids are fitted on, for all languages together; each language gets an equal share.
FIT_ROWS = 1600
_GAP = re.compile(r"[\W\d_]+")
_STEP = 1 << 20


def counts(text: str) -> np.ndarray:
    """How often each bucket's n-grams occur in the whole text; n-grams may span the gap between two words."""
    out = np.zeros(BUCKETS, np.float64)
    letters = np.frombuffer((" " + _GAP.sub(" ", text.lower()).strip() + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    for at in range(0, max(1, len(letters) - 2), _STEP):
        a = letters[at : at + _STEP + 2].astype(np.uint64)
        one = a * np.uint64(0x9E3779B97F4A7C15)
        two = (one[:-1] ^ np.uint64(0x51)) * np.uint64(0xBF58476D1CE4E5B9) + one[1:]
        three = (two[:-1] ^ np.uint64(0x93)) * np.uint64(0x94D049BB133111EB) + one[2:]
        last = at + _STEP + 2 >= len(letters)
        for grams in (one if last else one[:-2], two if last else two[:-1], three):
            out += np.bincount((grams >> np.uint64(40)).astype(np.int64) & (BUCKETS - 1), minlength=BUCKETS)
    return out


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


@dataclass
class Centroids:
    languages: list[str]
    of: np.ndarray  # index of each centroid's language
    idf: np.ndarray
    matrix: np.ndarray  # centroids by buckets, rows of length 1

    def nearest(self, texts: list[str]) -> tuple[list[str | None], np.ndarray]:
        x = np.stack([np.sqrt(counts(t)) for t in texts]) * self.idf
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        cos = x @ self.matrix.T
        best = cos.argmax(1)
        return [self.languages[self.of[b]] for b in best], np.clip(cos[np.arange(len(best)), best], 0.0, 1.0)


def _kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means of unit rows; begins at the mean's nearest row and then at the row farthest from the chosen ones."""
    mean = x.mean(0)
    chosen = [int((x @ mean).argmax())]
    near = x @ x[chosen[0]]
    while len(chosen) < min(k, len(x)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, x @ x[chosen[-1]])
    c = x[chosen]
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        c = np.stack([m / max(np.linalg.norm(m), 1e-12) for m in (x[own == i].sum(0) if (own == i).any() else c[i] for i in range(len(c)))])
    return c


def fit(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 3, fit_rows: int = FIT_ROWS) -> Centroids | None:
    """Centroids from the rows where train holds and lang is not null; None if there is none with a letter.

    At most fit_rows texts are used, an equal share for each language, those with the least hashes of
    their ids: a bounded sample of labelled rows. The ids are chosen without reading texts. Document
    frequencies are those of all rows with a letter.
    """
    rows = docs.where(train & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("k"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    languages = sorted(r.lang for r in rows.groupBy("lang").agg(F.count("*")).collect())
    if not languages:
        return None
    share = max(1, fit_rows // len(languages))
    order = F.xxhash64("k")
    least = [rows.where(F.col("lang") == x).groupBy(order.alias("h")).agg(F.lit(1)).orderBy("h").limit(share).select("h") for x in languages]
    bounds = {}
    for x, d in zip(languages, least, strict=True):
        bounds[x] = d.agg(F.max("h")).first()[0]
    within = F.lit(False)
    for x, b in bounds.items():
        within = within | ((F.col("lang") == x) & (order <= b))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lang, text in zip(b["lang"], b["text"], strict=True):
                if has_letter(text):
                    yield pd.DataFrame({"lang": [lang], "vector": [counts(text).astype("<f4").tobytes()]})

    def held_by(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, df = 0, np.zeros(BUCKETS, np.int64)
        for b in batches:
            for text in b["text"]:
                if has_letter(text):
                    n, df = n + 1, df + (counts(text) > 0)
        yield pd.DataFrame({"n": [n], "df": [df.tobytes()]})

    def total(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, df = 0, np.zeros(BUCKETS, np.int64)
        for b in batches:
            n, df = n + int(b["n"].sum()), df + sum(np.frombuffer(x, np.int64) for x in b["df"])
        yield pd.DataFrame({"n": [n], "df": [df.tobytes()]})

    # a chosen id that is repeated is one text, so that no language crowds out another
    chosen = rows.where(within).groupBy("lang", "k").agg(F.min("text").alias("text"))
    got = chosen.select("lang", "text").mapInPandas(run, "lang string, vector binary").collect()
    if not got:
        return None
    got.sort(key=lambda r: (r.lang, r.vector))  # the same centroids for any order of rows
    raw = np.stack([np.frombuffer(r.vector, "<f4") for r in got])  # 32 KB a text: about 50 MB at most
    lang = np.array([r.lang for r in got])
    n, df = 0, np.zeros(BUCKETS, np.int64)
    parts = rows.select("text").mapInPandas(held_by, "n bigint, df binary").repartition(1)  # 64 KB a task
    for r in parts.mapInPandas(total, "n bigint, df binary").collect():
        n, df = n + r.n, df + np.frombuffer(r.df, np.int64)
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    x = np.sqrt(raw) * idf
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    names = sorted(set(lang))
    parts = [_kmeans(x[lang == n], per_language) for n in names]
    return Centroids(names, np.repeat(np.arange(len(names)), [len(p) for p in parts]), idf, np.concatenate(parts))


def predict(docs: DataFrame, model: Centroids | None, id_col: str = "doc_id", text_col: str = "text", reject_below: float = 0.25) -> DataFrame:
    """(doc_id, lang_pred, score, rejected), one row per row of docs; whole texts, no shuffle.

    score: the cosine of the nearest centroid. A text that is null or has no letter is 'und' with
    score 0; rejected marks these and texts whose best cosine is below reject_below, which keep the
    nearest language as their prediction. Without a model all are 'und'. Other columns are ignored.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model)  # at most a few centroids per language, of BUCKETS numbers each

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = held.value
        for whole in batches:
            for at in range(0, len(whole), 128):
                b = whole.iloc[at : at + 128]
                pred, score = np.array(["und"] * len(b), object), np.zeros(len(b))
                good = [i for i, t in enumerate(b["text"]) if m is not None and has_letter(t)]
                if good:
                    pred[good], score[good] = m.nearest([b["text"].iloc[i] for i in good])
                yield pd.DataFrame({"doc_id": b["doc_id"].to_numpy(), "lang_pred": pred, "score": score, "rejected": score < reject_below})

    return frames(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id bigint, lang_pred string, score double, rejected boolean")


def held_out(id_col: str = "doc_id", folds: int = 3, fold: int = 1) -> Column:
    """Whether crc32 of the id as text leaves fold; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected): fitted where crc32(doc_id) mod 3 is not 1, predicted for all rows."""
    out = predict(docs, fit(docs, ~held_out()))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
