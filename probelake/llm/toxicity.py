"""Toxicity with noisy-channel deobfuscation.

A character trigram model is counted over the whole corpus. A token that looks
disguised (digits or symbols among letters, tripled letters, letters spaced out)
becomes a lattice: each character may stand for itself, for the letters it imitates,
or, as a separator or repetition, for nothing. Viterbi decoding under the character
model restores the likeliest letters; the restored words are then scored by a
logistic model over words and word beginnings, learned from labelled documents.

Learning uses at most ``train_docs`` labelled documents (a documented bound), chosen
by a hash of the id; character counts cover all texts, and scoring reads whole texts.
Features are 64-bit hashes, counted batch by batch and added up by Spark.

Defined results: a null or empty text has the score of a text without evidence; with
no labels to learn from all scores are 0; very long texts and tokens are read whole, in
time and memory in proportion; of equally likely readings of a token the one found first
stands, and of equally good features the smaller hash; repeated rows give repeated
results; null ids stay null; further columns, whatever their names, are ignored (or kept
as they are by :func:`drop_toxic`); empty tables give no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probelake.llm.common import Memo, drop_stored, labelled_sample, once_in_worker, text_runs

#: Symbols of the character model: boundary, a-z, ß, à-ÿ, other letters, digits, the rest.
SYMBOLS = 62
_OTHER_LETTER, _DIGIT, _REST = 59, 60, 61
# Letters that a character commonly imitates.
IMITATES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s",
    "!": "i", "|": "il", "+": "t", "€": "e", "(": "c", "#": "h"
}
#: Log costs of the channel.
IMITATE, SKIP_SEPARATOR, SKIP_REPEAT, KEEP_ODD = -0.7, -0.5, -1.0, -2.0
_PUNCT = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())
_EDGE = "".join(c for c in _PUNCT if c not in "$@") + "“”„«»…–—"
_SPACED = re.compile(r"(?<!\S)[^\s](?:[ \t][^\s]){3,}(?!\S)")
_TRIPLE = re.compile(r"(\w)\1\1")
_TABLE: list[np.ndarray] = []


def symbol(c: str) -> int:
    """The character model's symbol of a lower-cased character."""
    o = ord(c)
    if 97 <= o <= 122:
        return o - 96
    if o == 0xDF:
        return 27
    if 0xE0 <= o <= 0xFF and o != 0xF7:
        return 28 + (o - 0xE0) - (o > 0xF7)
    if c.isspace():
        return 0
    return _OTHER_LETTER if c.isalpha() else _DIGIT if c.isdigit() else _REST


def symbols(text: str) -> np.ndarray:
    """The symbols of a text."""
    if not _TABLE:
        _TABLE.append(
            np.array([symbol(chr(i).lower()[:1]) if not 0xD800 <= i < 0xE000 else _REST for i in range(0x10000)], np.int32)
        )
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return np.where(codes < 0x10000, _TABLE[0][np.minimum(codes, 0xFFFF)], _REST)


def character_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Trigram counts of symbols over all texts (SYMBOLS cubed, a fixed size)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            for _, texts in text_runs(batch, 0):
                s = symbols("  " + "  ".join(t for t in texts if t) + "  ")
                total += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["key", "n"])

    found = docs.select(text_col).mapInArrow(run, "key int, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SYMBOLS**3, np.int64)
    counts[found["key"].to_numpy()] = found["n"].to_numpy()
    return counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)


class CharacterModel:
    """Interpolated trigram model: log P(c | a, b) as a dense table."""

    def __init__(self, counts: np.ndarray):
        c3 = counts.astype(np.float64)
        c2, c1 = c3.sum(0), c3.sum((0, 1))
        p1 = (c1 + 1.0) / (c1.sum() + SYMBOLS)
        p2 = (c2 + 5.0 * p1) / (c2.sum(1, keepdims=True) + 5.0)
        p3 = (c3 + 5.0 * p2[None]) / (c3.sum(2, keepdims=True) + 5.0)
        self.log_p = np.log(p3).astype(np.float32)

    def as_lists(self) -> list:
        return self.log_p.tolist()


class Restorer:
    """Restores disguised tokens by Viterbi decoding."""

    def __init__(self, log_p: np.ndarray):
        self.log_p = log_p.tolist()
        self.choices: dict[str, list[tuple[str, float, int]]] = {}

    def _choices(self, c: str) -> list[tuple[str, float, int]]:
        """What a character may stand for: (output, cost, symbol); an empty output drops it."""
        if c.isalpha():
            return [(c, 0.0, symbol(c))]
        out = [(x, IMITATE, symbol(x)) for x in IMITATES.get(c, "")]
        return [*out, ("", KEEP_ODD if c.isdigit() else SKIP_SEPARATOR, 0), (c, KEEP_ODD, symbol(c))]

    def decode(self, token: str) -> str:
        """The likeliest letters behind ``token`` (lower-cased)."""
        log_p, known = self.log_p, self.choices
        # state: the last two symbols; value: score and the letters so far
        beam: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        before = ""
        for c in token:
            choices = known.get(c)
            if choices is None:
                choices = self._choices(c)
                if len(known) < 4096:
                    known[c] = choices
            if c == before and c.isalpha():
                choices = [*choices, ("", SKIP_REPEAT, 0)]
            step: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (score, path) in beam.items():
                row = log_p[a][b]
                for out, cost, s in choices:
                    key, value = ((b, s), score + cost + row[s]) if out else ((a, b), score + cost)
                    if key not in step or value > step[key][0]:
                        step[key] = (value, (out, path) if out else path)
            beam, before = step, c
        _, path = max(((v + log_p[a][b][0], p) for (a, b), (v, p) in beam.items()), key=lambda x: x[0])
        letters = []
        while path:
            letters.append(path[0])
            path = path[1]
        return "".join(reversed(letters))

    def restore(self, token: str) -> str:
        """The word behind one token; a plain token is only trimmed, and one that reads best without letters is none."""
        core = token.strip(_EDGE)
        plain = core.strip("$@")
        if plain.isalpha() and not _TRIPLE.search(plain):
            edge = len(core) - len(plain)
            return self.decode(core) if edge == 1 else plain
        if not any(map(str.isalpha, plain)):
            if len(core) < 2 or not any(c in IMITATES for c in core):
                return ""
            found = self.decode(core)
            return found if any(map(str.isalpha, found)) else ""
        return self.decode(core if len(core) - len(plain) <= 1 else plain)


def feature_hashes(word: str) -> list[int]:
    """Hashes of a word and of its beginnings."""
    import xxhash

    names = [f"w:{word}", *[f"{n}:{word[:n]}" for n in (4, 5, 6, 7) if len(word) > n]] if word else []
    return [xxhash.xxh3_64_intdigest(x) - 2**63 for x in names]


class FeatureReader:
    """Features of texts, each distinct token being read once: hashes, or their places in an index."""

    def __init__(self, log_p: np.ndarray, index: dict[int, int] | None):
        self.restorer, self.index, self.memo = Restorer(log_p), index, Memo()

    def _of(self, word: str) -> tuple:
        found = feature_hashes(word)
        return tuple(found) if self.index is None else tuple(self.index[f] for f in found if f in self.index)

    def _read(self, tokens: list[str]) -> list[tuple]:
        return [self._of(self.restorer.restore(t)) for t in tokens]

    def of(self, texts: list[str | None]) -> list[set]:
        low = [(t or "").lower() for t in texts]
        split = [set(t.split()) for t in low]
        get, out = self.memo.reader(set().union(*split), self._read), []
        for t, ts in zip(low, split, strict=True):
            found = set().union(*map(get, ts)) if ts else set()
            for m in _SPACED.finditer(t):
                found.update(self._of(self.restorer.decode("".join(m.group().split()))))
            out.append(found)
        return out


def train_logistic(
    rows: list[list[int]], y: np.ndarray, weight: np.ndarray, n: int, shrink: float = 1e-4, steps: int = 300
) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic model over present features."""
    at = np.concatenate([np.full(len(r), i) for i, r in enumerate(rows)]).astype(np.int64) if rows else np.zeros(0, np.int64)
    feature = np.concatenate([np.array(r, np.int64) for r in rows]).astype(np.int64) if rows else np.zeros(0, np.int64)
    w, b = np.zeros(n), float(np.log((weight @ y + 1) / (weight @ (1 - y) + 1)))
    m1, m2, total = np.zeros(n + 1), np.zeros(n + 1), weight.sum()
    for k in range(1, steps + 1):
        z = np.bincount(at, w[feature], len(y)) + b
        e = weight * (1.0 / (1.0 + np.exp(-z)) - y) / total
        g = np.r_[np.bincount(feature, e[at], n) + shrink * w, e.sum()]
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        step = 0.1 * (m1 / (1 - 0.9**k)) / (np.sqrt(m2 / (1 - 0.999**k)) + 1e-8)
        w -= step[:-1]
        b -= step[-1]
    return w, b


class ToxicityModel:
    """Character model, feature index and weights: all of bounded size."""

    def __init__(self, log_p: np.ndarray, index: dict[int, int], w: np.ndarray, b: float, trained: bool):
        self.log_p, self.index, self.w, self.b, self.trained = log_p, index, w, b, trained

    @property
    def reader_name(self) -> str:
        """Names the reader of this character model and index in a worker."""
        places = np.array(sorted(self.index.items()), np.int64)
        return f"toxicity {zlib.crc32(places.tobytes(), zlib.crc32(self.log_p.tobytes()))}"


def _count_evidence(sample: DataFrame, log_p: np.ndarray) -> DataFrame:
    """Labelled documents that hold each feature: feature, pos, neg."""
    held, name = sample.sparkSession.sparkContext.broadcast(log_p), f"evidence {zlib.crc32(log_p.tobytes())}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = once_in_worker(name, lambda: FeatureReader(held.value, None))
        for batch in batches:
            label = batch.column(1).to_numpy()
            for a, texts in text_runs(batch, 0):
                found = [np.fromiter(f, np.int64, len(f)) for f in reader.of(texts)]
                for y in (0, 1):
                    of = [f for f, mark in zip(found, label[a : a + len(texts)], strict=True) if mark == y]
                    if of:
                        feature, n = np.unique(np.concatenate(of), return_counts=True)
                        counts = [pa.array(np.where(y == k, n, 0)) for k in (1, 0)]
                        yield pa.RecordBatch.from_arrays([pa.array(feature), *counts], names=["feature", "pos", "neg"])

    rows = sample.select("text", "label").mapInArrow(run, "feature long, pos long, neg long")
    return rows.groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def train_toxicity(
    docs: DataFrame, labels: DataFrame, may_learn: Column, id_col: str = "doc_id", text_col: str = "text",
    target: str = "toxic", train_docs: int = 16_000, features: int = 4000, least: int = 3
) -> ToxicityModel:
    """Count characters over all texts, then learn from a bounded sample of labels.

    ``may_learn`` is a condition on the columns ``id`` and ``label``.
    """
    log_p = CharacterModel(character_counts(docs, text_col)).log_p
    sample = labelled_sample(docs, labels, target, train_docs, may_learn, id_col, text_col)
    size = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not size.get(1) or not size.get(0):
        return ToxicityModel(log_p, {}, np.zeros(0), 0.0, False)
    ratio = F.log((F.col("pos") + 0.5) / (size[1] + 1) / ((F.col("neg") + 0.5) / (size[0] + 1)))
    counted = _count_evidence(sample, log_p).where(F.col("pos") >= least).withColumn("r", ratio).where("r > 1")
    best = counted.orderBy(F.desc(F.col("r") * F.sqrt("pos")), "feature").limit(features)
    model = ToxicityModel(
        log_p, {r["feature"]: i for i, r in enumerate(best.select("feature").collect())}, np.zeros(0), 0.0, True
    )
    held, name = docs.sparkSession.sparkContext.broadcast((log_p, model.index)), model.reader_name

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = once_in_worker(name, lambda: FeatureReader(*held.value))
        for batch in batches:
            found = [sorted(f) for _, texts in text_runs(batch, 0) for f in reader.of(texts)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, pa.list_(pa.int32())), *batch.columns[1:]], names=["found", "id", "label", "weight"]
            )

    wanted = sample.select("text", F.col("id").cast("string").alias("id"), "label", "weight")
    rows = wanted.mapInArrow(vectors, "found array<int>, id string, label int, weight double").toArrow()
    held.destroy()
    drop_stored(sample)
    order = np.argsort(rows["id"].to_numpy(zero_copy_only=False).astype(str), kind="stable")
    found = rows["found"].to_pylist()
    y, weight = rows["label"].to_numpy()[order].astype(float), rows["weight"].to_numpy()[order]
    model.w, model.b = train_logistic([found[i] for i in order], y, weight, len(model.index))
    return model


def _scores(model: ToxicityModel, reader: FeatureReader, texts: list[str | None]) -> np.ndarray:
    if not model.trained:
        return np.zeros(len(texts))
    z = np.array([model.w[list(f)].sum() if f else 0.0 for f in reader.of(texts)]) + model.b
    return 1.0 / (1.0 + np.exp(-z))


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score of each row."""
    held, name = docs.sparkSession.sparkContext.broadcast(model), model.reader_name

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        reader = once_in_worker(name, lambda: FeatureReader(model.log_p, model.index))
        for batch in batches:
            for a, texts in text_runs(batch, 1):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, len(texts)), pa.array(_scores(model, reader, texts))], names=[id_col, "score"]
                )

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double")


def drop_toxic(docs: DataFrame, model: ToxicityModel, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below ``least``, columns unchanged."""
    held, name = docs.sparkSession.sparkContext.broadcast(model), model.reader_name
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        reader = once_in_worker(name, lambda: FeatureReader(model.log_p, model.index))
        for batch in batches:
            for a, texts in text_runs(batch, at):
                yield batch.slice(a, len(texts)).filter(pa.array(_scores(model, reader, texts) < least))

    return docs.mapInArrow(run, docs.schema)
