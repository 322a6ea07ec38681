"""Toxic spans by a linear-chain conditional random field over tokens.

Labels are of documents; tokens get theirs by weak supervision: a word, or a word's first letters,
that is far commoner in toxic documents than in others marks the tokens of toxic documents that
carry it. The field has two tags, weights for all these features, a bias and transitions; it is trained
on all windows around marked tokens of the labelled documents it is fitted on. Scoring runs forward-backward over a whole text. Tokens without a
feature all have the same potential, so that a run of them is one power of a 2 by 2 matrix, taken
in closed form: exact, and a long text costs what its few marked tokens cost.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm._shared import drop, frames, materialize

#: Labelled documents of either class that the model is fitted on at most.
FIT_ROWS = 5000
#: A feature is kept if it is in so many of the fitted toxic documents at least, so many times likelier there, and not by chance.
LEAST_TOXIC, LEAST_RATIO = 3, 8.0
PREFIXES = (4, 5, 6)
#: Tokens on either side of a marked one that a training window holds.
WINDOW = 6
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
REMEMBER = 100_000


def words_of(text: str | None) -> list[str]:
    """The words of a text, each lower-cased by itself, so that they stand where the text has them."""
    if not text:
        return []
    return WORD.findall(text.lower()) if text.isascii() else [w.lower() for w in WORD.findall(text)]


def features(word: str) -> tuple[str, ...]:
    """The word, and its first letters where it is longer."""
    return ("=" + word, *(word[:n] for n in PREFIXES if len(word) > n))


@dataclass
class Field:
    weight: dict[str, float]
    bias: float
    stay: float  # toxic after toxic
    enter: float  # toxic after clean
    leave: float  # clean after toxic
    score_weights: tuple[float, float, float]  # of 1, the greatest marginal, log(1 + their sum)

    def __post_init__(self) -> None:
        self.known: dict[str, float] = {}
        m = np.exp(np.array([[0.0, self.enter + self.bias], [self.leave, self.stay + self.bias]]))
        self.values, self.vectors = np.linalg.eig(m)
        self.values, self.vectors = self.values.real, self.vectors.real
        self.inverse = np.linalg.inv(self.vectors)
        self.top = float(self.values.max())

    def emission(self, word: str) -> float:
        """The sum of a word's weights; 0.0 exactly if it has no feature."""
        got = self.known.get(word)
        if got is None:
            if len(self.known) >= REMEMBER:
                self.known.clear()
            got = self.known[word] = sum(self.weight.get(f, 0.0) for f in features(word))
        return got

    def power(self, n: int) -> np.ndarray:
        """The matrix of n tokens without features, divided by its greatest eigenvalue's power."""
        return (self.vectors * (self.values / self.top) ** n) @ self.inverse

    def marginals(self, words: list[str]) -> tuple[list[int], np.ndarray]:
        """Positions of the tokens with features, and the probability of the toxic tag at each."""
        known, emission = self.known, self.emission
        marked, extra = [], []
        for i, w in enumerate(words):
            e = known.get(w)
            if e is None:
                e = emission(w)
            if e:
                marked.append(i)
                extra.append(e)
        if not marked:
            return [], np.zeros(0)
        step = np.exp(np.array([[0.0, self.enter + self.bias], [self.leave, self.stay + self.bias]]))
        gaps = [marked[0] - 1, *(b - a - 1 for a, b in zip(marked, marked[1:], strict=False))]
        e = np.exp(np.clip(extra, -30, 30))
        forward, alphas = None, []
        between = {g: self.power(g) @ step for g in set(gaps) if g >= 0}
        for k, g in enumerate(gaps):
            if forward is None:
                first = np.array([1.0, np.exp(self.enter + self.bias)])
                forward = first if g < 0 else first @ between[g]
            else:
                forward = forward @ between[g]
            forward = forward * (1.0, e[k])
            forward = forward / forward.sum()
            alphas.append(forward)
        backward = self.power(len(words) - 1 - marked[-1]) @ np.ones(2)
        out = np.zeros(len(marked))
        for k in range(len(marked) - 1, -1, -1):
            p = alphas[k] * backward
            out[k] = p[1] / p.sum()
            if k:
                backward = between[gaps[k]] @ (backward * (1.0, e[k]))
                backward = backward / backward.sum()
        return marked, out

    def score(self, p: np.ndarray) -> float:
        a, b, c = self.score_weights
        z = a + (b * float(p.max()) + c * float(np.log1p(p.sum())) if len(p) else 0.0)
        return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))


def _train(windows: np.ndarray, tags: np.ndarray, times: np.ndarray, n_features: int, rounds: int = 150) -> tuple[np.ndarray, np.ndarray]:
    """Penalised likelihood of windows (rows of positions of up to 4 feature numbers, -1: none) by gradient steps.

    times: how often each window occurs. Returns the weights and (bias, stay, enter, leave).
    """
    b, t, _ = windows.shape
    total, each = times.sum(), times[:, None]
    on = windows >= 0
    at = np.where(on, windows, 0)
    w, g = np.zeros(n_features), np.array([-2.0, 0.0, 0.0, 0.0])
    moments = [np.zeros(n_features), np.zeros(n_features), np.zeros(4), np.zeros(4)]
    prev = np.concatenate([np.zeros((b, 1), int), tags[:, :-1]], 1)
    seen = np.array([(x * each).sum() for x in (tags, tags * prev, tags * (1 - prev), ((1 - tags) * prev)[:, 1:])], float)
    seen_w = np.bincount(at[on], np.broadcast_to((tags * each)[..., None], on.shape)[on], n_features)
    for step in range(1, rounds + 1):
        emit = (w[at] * on).sum(2) + g[0]
        trans = np.array([[0.0, g[2]], [g[3], g[1]]])
        fwd = np.zeros((t, b, 2))
        fwd[0] = np.stack([np.zeros(b), g[2] + emit[:, 0]], 1)
        for i in range(1, t):
            x = fwd[i - 1][:, :, None] + trans
            m = x.max(1)
            fwd[i] = m + np.log(np.exp(x - m[:, None]).sum(1))
            fwd[i][:, 1] += emit[:, i]
        z = np.logaddexp(fwd[-1][:, 0], fwd[-1][:, 1])
        bwd, p1, pair = np.zeros((b, 2)), np.zeros((b, t)), np.zeros((2, 2))
        for i in range(t - 1, -1, -1):
            p1[:, i] = np.exp(fwd[i][:, 1] + bwd[:, 1] - z)
            if i:
                right = bwd + np.stack([np.zeros(b), emit[:, i]], 1)
                pair += (np.exp(fwd[i - 1][:, :, None] + trans + right[:, None] - z[:, None, None]) * each[:, :, None]).sum(0)
                y = trans + right[:, None]
                m = y.max(2)
                bwd = m + np.log(np.exp(y - m[..., None]).sum(2))
        p1 *= each
        expect = np.array([p1.sum(), pair[1, 1], pair[0, 1] + p1[:, 0].sum(), pair[1, 0]])
        expect_w = np.bincount(at[on], np.broadcast_to(p1[..., None], on.shape)[on], n_features)
        for x, grad, m, v in ((w, (seen_w - expect_w) / total - 1e-4 * w, *moments[:2]), (g, (seen - expect) / total - 1e-4 * g, *moments[2:])):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            x += 0.12 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w, g


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Newton steps, slightly penalised."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (y - p) - 1e-2 * w)
    return w


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text is a multiple of 5; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS) -> Field | None:
    """A field from labelled rows that aren't held out; None if either class is missing.

    At most fit_rows documents of each class are used, those with the least hashes of their ids: a
    bounded sample of labelled rows, whole texts, written once. A document with several labels is toxic if
    one says so; null labels are ignored; of a chosen id that is repeated the least text is used. The
    chosen ids are broadcast, so that only their texts are shuffled.
    """
    one = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).cast("bigint").alias("k")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    picked = [one.where(F.col("toxic") == t).orderBy(F.xxhash64("k"), "k").limit(fit_rows) for t in (1, 0)]
    picked = [row for d in picked for row in d.collect()]  # at most 2 * fit_rows ids
    if len({r.toxic for r in picked}) < 2:
        return None
    spark = docs.sparkSession
    chosen = F.broadcast(spark.createDataFrame(picked, "k bigint, toxic int"))
    rows = docs.select(F.col(id_col).cast("bigint").alias("k"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(chosen, "k")
    rows = materialize(rows.groupBy("k", "toxic").agg(F.min("text").alias("text")).drop("k"), "fitted")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = (Counter(), Counter())
        docs_seen = [0, 0]
        for b in batches:
            for text, toxic in zip(b["text"], b["toxic"], strict=True):
                docs_seen[toxic] += 1
                seen[toxic].update({f for w in set(words_of(text)) for f in features(w)})
        f = sorted(seen[1])  # a feature of no toxic document is never kept
        yield pd.DataFrame({"f": ["", *f], "n1": [docs_seen[1], *(seen[1][x] for x in f)], "n0": [docs_seen[0], *(0 for x in f)]})
        g = sorted(x for x in seen[0])
        for at in range(0, len(g), 100_000):
            part = g[at : at + 100_000]
            yield pd.DataFrame({"f": part, "n1": 0, "n0": [seen[0][x] for x in part]})

    table = rows.mapInPandas(count, "f string, n1 bigint, n0 bigint").groupBy("f").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    total = rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()
    n1, n0 = (next((r.n for r in total if r.toxic == t), 0) for t in (1, 0))
    if not n1 or not n0:
        drop(rows)
        return None
    ratio = ((F.col("n1") + 0.1) / n1) / ((F.col("n0") + 0.1) / n0)
    # twice the log of how much likelier the counts are with the feature's own share of toxic documents than with that of all
    share = n1 / (n1 + n0)
    plain = F.col("n1") * F.log(F.col("n1") / ((F.col("n1") + F.col("n0")) * share))
    surplus = 2 * (plain + F.when(F.col("n0") > 0, F.col("n0") * F.log(F.col("n0") / ((F.col("n1") + F.col("n0")) * (1 - share)))).otherwise(0.0))
    tried = table.where((F.col("f") != "") & (F.col("n1") >= LEAST_TOXIC)).withColumn("surplus", surplus).withColumn("ratio", ratio)
    found = tried.select("f", "n1", "n0", "surplus", "ratio").where(F.col("ratio") >= LEAST_RATIO).orderBy("f").collect()  # of the fitted texts only
    # of so many features that are tried, chance leaves less than one beyond this
    chance = 2 * np.log(max(2, tried.count()))
    kept = [r for r in found if r.surplus > chance]
    number = {r.f: i for i, r in enumerate(kept)}
    sure = {r.f for r in kept if (r.n1 + 0.1) / n1 >= 4 * LEAST_RATIO * (r.n0 + 0.1) / n0}
    if not number:
        drop(rows)
        return None

    def window(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for text, toxic in zip(b["text"], b["toxic"], strict=True):
                words = words_of(text)
                found = [[number[f] for f in features(w) if f in number] for w in words]
                marked = [i for i, f in enumerate(found) if f]
                covered, out = -1, []
                for i in marked or [len(words) // 2]:
                    if i <= covered:
                        continue
                    covered = i + WINDOW
                    row, tags = [], []
                    for j in range(i - WINDOW, i + WINDOW + 1):
                        f = found[j] if 0 <= j < len(words) else []
                        row += (f + [-1] * 4)[:4]
                        tags.append(int(bool(toxic and 0 <= j < len(words) and any(x in sure for x in features(words[j])))))
                    out.append((row, tags))
                if out:
                    yield pd.DataFrame(out, columns=["row", "tags"])

    got = rows.mapInPandas(window, "row array<int>, tags array<int>").groupBy("row", "tags").agg(F.count("*").alias("times")).toPandas()
    width = 2 * WINDOW + 1
    windows, tags = np.stack(got["row"]).reshape(-1, width, 4).astype(np.int64), np.stack(got["tags"]).astype(np.int64)
    order = np.lexsort(np.concatenate([windows.reshape(len(windows), -1), tags], 1).T)  # the same field for any order of rows
    times = got["times"].to_numpy(float)
    w, (bias, stay, enter, leave) = _train(windows[order], tags[order], times[order], len(number))
    field = Field({f: float(w[i]) for f, i in number.items()}, float(bias), float(stay), float(enter), float(leave), (0.0, 0.0, 0.0))
    held = spark.sparkContext.broadcast(field)

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = held.value
        for b in batches:
            p = [m.marginals(words_of(t))[1] for t in b["text"]]
            yield pd.DataFrame({"toxic": b["toxic"], "top": [float(x.max()) if len(x) else 0.0 for x in p], "mass": [float(np.log1p(x.sum())) for x in p]})

    got = rows.mapInPandas(spread, "toxic int, top double, mass double").toPandas().sort_values(["toxic", "top", "mass"])
    drop(rows)
    x = np.stack([np.ones(len(got)), got["top"], got["mass"]], 1)
    y = got["toxic"].to_numpy(float)
    field.score_weights = tuple(float(v) for v in _logistic(x, y))
    return field


def score(docs: DataFrame, field: Field | None, id_col: str = "doc_id", text_col: str = "text", at_least: float = 0.5) -> DataFrame:
    """(doc_id, score, predicted, spans array<struct<start, end, p>>), one row per row of docs.

    spans: character offsets of the tokens of the whole text whose marginal is at_least or more.
    Empty and null texts get the score of a text without any marked token; without a field every
    score is 0. One pass, no shuffle; other columns are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(field)  # features of at most 2 * fit_rows texts

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = held.value
        for b in batches:
            scores, spans = [], []
            for text in b["text"]:
                marked, p = m.marginals(words_of(text)) if m is not None else ([], np.zeros(0))
                scores.append(m.score(p) if m is not None else 0.0)
                hit = {i: float(x) for i, x in zip(marked, p, strict=True) if x >= at_least}
                spans.append([(x.start(), x.end(), hit[i]) for i, x in enumerate(WORD.finditer(text)) if i in hit] if hit else [])
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": scores, "predicted": [int(s >= 0.5) for s in scores], "spans": spans})

    schema = "doc_id bigint, score double, predicted int, spans array<struct<start:int,end:int,p:double>>"
    return frames(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")), run, schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, spans): fitted where crc32(doc_id) mod 5 is not 0, scored for all rows."""
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted", "spans")


def keep_clean(docs: DataFrame, field: Field | None, text_col: str = "text") -> DataFrame:
    """The rows of docs that score below 0.5, with all their columns; no shuffle, no join."""
    held = docs.sparkSession.sparkContext.broadcast(field)

    @F.pandas_udf("boolean")
    def toxic(text: pd.Series) -> pd.Series:
        m = held.value
        return pd.Series([m is not None and m.score(m.marginals(words_of(t))[1]) >= 0.5 for t in text])

    return docs.where(~toxic(F.col(text_col)))
