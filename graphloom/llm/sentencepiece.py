"""SentencePiece encoding and decoding by an Aho-Corasick automaton and one pass of relaxation.

The automaton runs over a text once; at each position its output links name all pieces that end
there, and each may relax the best way to reach the position. In a unigram model the best way has
the highest sum of scores (Viterbi). In a BPE model sums of scores don't give the model's own
result, so there the relaxation takes the piece that the merge rules leave standing behind the best
way to the piece's start: exactly one does, and whether two pieces stand side by side depends on
these two alone. Either way the ids are those of the model's own encoder.
"""

from __future__ import annotations

import codecs
import re
import struct
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, BYTE = 1, 2, 3, 4, 6
#: Units and pairs of pieces that a worker remembers at most; then it starts afresh.
REMEMBER = 300_000

codecs.register_error("graphloom-bytes", lambda e: ("�" * (e.end - e.start), e.end))


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = raw[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(raw):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
            continue
        n = {1: 8, 5: 4}.get(key & 7) or number()
        yield key >> 3, raw[at : at + n]
        at += n


class Model:
    """A model file's pieces and rules; made on the driver, and once per Python worker."""

    def __init__(self, raw: bytes):
        import ahocorasick

        self.pieces: list[tuple[str, float, int]] = []
        trainer: dict[int, int | bytes] = {}
        rules: dict[int, int | bytes] = {}
        for number, value in _fields(raw):
            if number == 1:
                p = dict(_fields(value))
                self.pieces.append((p[1].decode(), struct.unpack("<f", p[2])[0] if 2 in p else 0.0, p.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                rules = dict(_fields(value))
        self.bpe = {1: False, 2: True}.get(trainer.get(3, 1))
        if self.bpe is None or rules.get(2) or rules.get(4, 1) or not rules.get(5, 1) or trainer.get(24) or any(k == USER_DEFINED for *_, k in self.pieces):
            raise ValueError("only unigram and BPE models that keep texts as they are can be read")
        self.prefix = bool(rules.get(3, 1))
        self.unknown = next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)
        self.byte = {int(p[1:-1], 16): i for i, (p, _, k) in enumerate(self.pieces) if k == BYTE}
        self.id = {p: i for i, (p, _, k) in enumerate(self.pieces) if k == NORMAL}
        self.score = [s for _, s, _ in self.pieces]
        self.worst = min((self.score[i] for i in self.id.values()), default=0.0) - 10.0
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id.items():
            self.automaton.add_word(p, (i, len(p)))
        if self.id:
            self.automaton.make_automaton()
        known = "".join(re.escape(p) for p in self.id if len(p) == 1)
        self.runs = re.compile(f"[{known}]+|." if known else ".", re.DOTALL)
        inner = any(SPACE in p.lstrip(SPACE) for p in self.id)
        self.units = re.compile(".+", re.DOTALL) if inner else re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        self.bytes = [int(p[1:-1], 16).to_bytes() if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else p.replace(SPACE, " ").encode() for p, _, k in self.pieces]
        self.unit: dict[str, bytes] = {}
        self.beside: dict[int, bool] = {}
        self.whole = [k == NORMAL and self.merged(p) == [i] for i, (p, _, k) in enumerate(self.pieces)] if self.bpe else []

    def merged(self, text: str) -> list[int]:
        """BPE by its definition: merge the best pair, the first of equal ones, until none is left."""
        parts = list(text)
        while len(parts) > 1:
            best = max(((self.score[i], -k) for k in range(len(parts) - 1) if (i := self.id.get(parts[k] + parts[k + 1])) is not None), default=None)
            if best is None:
                break
            k = -best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return [self.id.get(p, -1) for p in parts]

    def stands(self, a: int, b: int) -> bool:
        key = a << 24 | b
        got = self.beside.get(key)
        if got is None:
            if len(self.beside) >= REMEMBER:
                self.beside.clear()
            got = self.beside[key] = self.merged(self.pieces[a][0] + self.pieces[b][0]) == [a, b]
        return got

    def _walk(self, run: str) -> list[int]:
        """The ids of a run of characters that are all pieces of their own."""
        n = len(run)
        last, start = [-1] * (n + 1), [0] * (n + 1)
        if self.bpe:
            whole, stands, beside = self.whole, self.stands, self.beside
            for end, (i, size) in self.automaton.iter(run):
                end += 1
                if last[end] < 0:
                    at = end - size
                    if not at:
                        fits = whole[i]
                    elif (before := last[at]) >= 0:
                        fits = beside.get(before << 24 | i)
                        if fits is None:
                            fits = stands(before, i)
                    else:
                        continue
                    if fits:
                        last[end], start[end] = i, at
        else:
            best, score = [0.0] + [float("-inf")] * n, self.score
            for end, (i, size) in self.automaton.iter(run):
                end += 1
                if (s := best[end - size] + score[i]) > best[end]:
                    best[end], last[end], start[end] = s, i, end - size
        out = []
        while n:
            out.append(last[n])
            n = start[n]
        return out[::-1]

    def _encode(self, unit: str) -> bytes:
        out = array("i")
        for run in self.runs.findall(unit) if self.bpe else self._split(unit):
            if len(run) > 1 or run in self.id:
                out.extend(self._walk(run))
            elif self.byte:
                out.extend(self.byte[b] for b in run.encode())
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out.tobytes()

    def _split(self, unit: str) -> list[str]:
        """Unigram: where a character isn't a piece of its own, pieces that hold it may still match."""
        if all(c in self.id for c in unit):
            return [unit]
        n = len(unit)
        best, last, start = [0.0] + [float("-inf")] * n, [-1] * (n + 1), [0] * (n + 1)
        ends: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]
        for end, found in self.automaton.iter(unit) if self.id else ():
            ends[end + 1].append(found)
        for end in range(1, n + 1):
            ways = ends[end] + ([(-1, 1)] if unit[end - 1] not in self.id else [])
            for i, size in ways:
                s = best[end - size] + (self.score[i] if i >= 0 else self.worst)
                if s > best[end]:
                    best[end], last[end], start[end] = s, i, end - size
        cuts, end = [], n
        while end:
            cuts.append((start[end], end, last[end]))
            end = start[end]
        return [unit[a:b] for a, b, _ in reversed(cuts)]

    def encode(self, text: str) -> array:
        out, unit = array("i"), self.unit
        if not text:
            return out
        text = text.replace(" ", SPACE)
        for u in self.units.findall(SPACE + text if self.prefix else text):
            ids = unit.get(u)
            if ids is None:
                ids = self._encode(u)
                if len(u) < 64:
                    if len(unit) >= REMEMBER:
                        unit.clear()
                    unit[u] = ids
            out.frombytes(ids)
        return out

    def decode(self, ids) -> str:
        raw = b"".join(map(self.bytes.__getitem__, ids))
        if self.prefix and raw[:1] == b" ":
            raw = raw[1:]
        return raw.decode("utf-8", "graphloom-bytes")


_models: dict[int, Model] = {}


def _model(raw: bytes) -> Model:
    """The worker's own model of these bytes: workers outlive tasks."""
    key = hash(raw)
    if key not in _models:
        _models.clear()
        _models[key] = Model(raw)
    return _models[key]


def _load(docs: DataFrame, model_file: str):
    """Broadcast a model file: its size is that of a vocabulary, and does not grow with the documents."""
    with open(model_file, "rb") as f:
        raw = f.read()
    if len(raw) > 64 << 20:
        raise ValueError("a model file of over 64 MB is no vocabulary")
    Model(raw)
    return docs.sparkSession.sparkContext.broadcast(raw)


def encode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", decode_too: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids array<int>, decoded): ids of each whole text and, if asked for, their text again.

    One row per row of docs, in one pass without a shuffle. An empty text has no ids and decodes to an
    empty text; a null text has no ids and decodes to null. U+2581 stands for a space in every such
    model and decodes to one; any other text comes back as it was. Other columns are ignored.
    """
    model = _load(docs, model_file)
    schema = "doc_id bigint, n_tokens bigint, ids array<int>" + (", decoded string" if decode_too else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(model.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                flat, ends, decoded = array("i"), [0], []
                for text in b.column(1).to_pylist():
                    ids = m.encode(text or "")
                    flat.extend(ids)
                    ends.append(len(flat))
                    decoded.append(None if text is None else m.decode(ids))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.Array.from_buffers(pa.int32(), len(flat), [None, pa.py_buffer(flat)]))
                counts = pa.array([y - x for x, y in zip(ends, ends[1:], strict=False)], pa.int64())
                columns = [b.column(0), counts, lists] + ([pa.array(decoded, pa.string())] if decode_too else [])
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids", "decoded"][: len(columns)])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def decode(tokens: DataFrame, model_file: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text): the text of each row's ids; null ids give a null text, ids outside the model fail."""
    model = _load(tokens, model_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(model.value)
        for b in batches:
            texts = [None if ids is None else m.decode(ids) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id bigint, text string")
