"""Quality classifier: gated-attention multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Every passage is measured
(shares of character kinds, word lengths, repetition inside the passage and of what
came earlier in the document) and encoded by a small learned layer; gated attention
weighs the encodings, and the weighted sum is scored. Encoder, attention and scorer
are learned together from document labels only.

Learning uses at most ``train_docs`` labelled documents (a documented bound) and all
their passages, measured in tasks; the driver holds 16 numbers of each passage. Scoring
reads every passage of every text.

Defined results: a null or empty text is a bag of one empty passage; with no labels
of both kinds all scores are 0.5; very long texts are read whole, in memory in
proportion; texts of equal features tie, whatever their order; repeated rows give
repeated results; null ids stay null; further columns, whatever their names, are
ignored; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probelake.llm.common import drop_stored, labelled_sample, text_runs

PASSAGE = 64
# kinds of characters
_SPACE, _LINE, _LOWER, _UPPER, _DIGIT, _SYMBOL, _STOP, _REST = range(8)
KINDS = 8
FEATURES = KINDS - 1 + 9
_KIND_TABLE: list[np.ndarray] = []
_P = np.uint64(0x100000001B3)
_P_INVERSE = np.uint64(pow(0x100000001B3, -1, 2**64))


def _kinds() -> np.ndarray:
    if not _KIND_TABLE:
        table = np.full(0x10000, _REST, np.int8)
        for i in range(0x10000):
            c = chr(i)
            if c == "\n":
                table[i] = _LINE
            elif c.isspace() or i == 0:
                table[i] = _SPACE
            elif c.isupper():
                table[i] = _UPPER
            elif c.isalpha():
                table[i] = _LOWER
            elif c.isdigit():
                table[i] = _DIGIT
            elif c in "#*$%&|<>~^=+@_\\/{}[]":
                table[i] = _SYMBOL
            elif c in ".,;:!?":
                table[i] = _STOP
        _KIND_TABLE.append(table)
    return _KIND_TABLE[0]


def _repeats(keys: np.ndarray) -> np.ndarray:
    """True where a key has occurred at an earlier position."""
    _, first = np.unique(keys, return_index=True)
    out = np.ones(len(keys), bool)
    out[first] = False
    return out


def passage_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage and the index of its text, in order; every text has one passage at least."""
    joined = "\n\x00\n".join((t or "").replace("\x00", " ") for t in texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    kind = np.where(codes < 0x10000, _kinds()[np.minimum(codes, 0xFFFF)], _REST).astype(np.int8)
    if not len(codes):
        return np.zeros((len(texts), FEATURES)), np.arange(len(texts))
    owner = np.cumsum(codes == 0)
    word = kind > _LINE
    edge = np.diff(np.r_[False, word, False].astype(np.int8))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    doc = owner[begin] if len(begin) else np.zeros(0, np.int64)
    # passages: runs of PASSAGE words inside a text
    first_word = np.searchsorted(doc, np.arange(len(texts)))
    n_words = np.diff(np.r_[first_word, len(doc)])
    n_passages = np.maximum(1, -(-n_words // PASSAGE))
    passage_of_text = np.cumsum(n_passages) - n_passages
    total = int(n_passages.sum())
    of = np.repeat(np.arange(len(texts)), n_passages)
    x = np.zeros((total, FEATURES))
    if not len(begin):
        return x, of
    passage = passage_of_text[doc] + (np.arange(len(doc)) - first_word[doc]) // PASSAGE
    size = np.bincount(passage, minlength=total).astype(float)
    some = np.maximum(size, 1.0)
    length = (end - begin).astype(float)
    chars = np.bincount(passage, length, total)
    for k in range(_LOWER, KINDS):
        upto = np.r_[0, np.cumsum(kind == k)]
        x[:, k - _LOWER] = np.bincount(passage, upto[end] - upto[begin], total) / np.maximum(chars, 1.0)
    lines = np.r_[0, np.cumsum(kind == _LINE)]
    at_line = np.r_[lines[begin[1:]] - lines[end[:-1]] > 0, False]
    # a hash of every word from prefix sums
    power = np.cumprod(np.full(len(codes), _P, np.uint64))
    inverse = np.cumprod(np.full(len(codes), _P_INVERSE, np.uint64))
    prefix = np.r_[np.uint64(0), np.cumsum(codes.astype(np.uint64) * power)]
    h = (prefix[end] - prefix[begin]) * inverse[begin]
    same = np.r_[False, (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])]
    mixed = h * np.uint64(0x9E3779B97F4A7C15)
    three = mixed + np.r_[mixed[1:], mixed[:1]] * np.uint64(3) + np.r_[mixed[2:], mixed[:2]] * np.uint64(7)
    f = KINDS - 2
    x[:, f] = chars / some / 10.0
    x[:, f + 1] = np.bincount(passage, length**2, total) / some / 100.0
    x[:, f + 2] = np.bincount(passage, length <= 3, total) / some
    x[:, f + 3] = np.bincount(passage, length >= 15, total) / some
    x[:, f + 4] = np.bincount(passage, _repeats(h ^ (passage.astype(np.uint64) << np.uint64(20))), total) / some
    x[:, f + 5] = np.bincount(passage, same, total) / some
    x[:, f + 6] = np.bincount(passage, _repeats(three ^ (doc.astype(np.uint64) << np.uint64(17))), total) / some
    x[:, f + 7] = np.bincount(passage, at_line, total) / some
    x[:, f + 8] = np.minimum(size / PASSAGE, 1.0)
    ends_odd = kind[end - 1] == _SYMBOL
    x[:, f + 9] = np.bincount(passage, ends_odd, total) / some
    return x, of


@dataclass
class AttentionModel:
    """Encoder (we, be), gated attention (wv, wu, wa) and scorer (wc, bc)."""

    mean: np.ndarray
    scale: np.ndarray
    we: np.ndarray
    be: np.ndarray
    wv: np.ndarray
    wu: np.ndarray
    wa: np.ndarray
    wc: np.ndarray
    bc: np.ndarray
    trained: bool = True

    def forward(self, x: np.ndarray, of: np.ndarray, n: int) -> dict:
        z = (x - self.mean) / self.scale
        h = np.tanh(z @ self.we + self.be)
        tv, su = np.tanh(h @ self.wv), 1.0 / (1.0 + np.exp(-(h @ self.wu)))
        a = (tv * su) @ self.wa
        starts = np.searchsorted(of, np.arange(n))
        e = np.exp(a - np.maximum.reduceat(a, starts)[of])
        att = e / np.add.reduceat(e, starts)[of]
        bag = np.add.reduceat(att[:, None] * h, starts, axis=0)
        return {
            "z": z, "h": h, "tv": tv, "su": su, "att": att, "bag": bag, "starts": starts,
            "p": 1.0 / (1.0 + np.exp(-(bag @ self.wc + self.bc[0])))
        }

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not self.trained:
            return np.full(len(texts), 0.5)
        x, of = passage_features(texts)
        return self.forward(x, of, len(texts))["p"]


def fit(
    x: np.ndarray, of: np.ndarray, y: np.ndarray, weight: np.ndarray, width: int = 16, steps: int = 150, seed: int = 3,
    shrink: float = 1e-4
) -> AttentionModel:
    """Learn all layers by Adam on the weighted log loss of bags; ``of`` is sorted."""
    rng, n = np.random.RandomState(seed), len(y)
    d = x.shape[1]
    model = AttentionModel(
        x.mean(0), x.std(0) + 1e-3, rng.randn(d, width) / np.sqrt(d), np.zeros(width), rng.randn(width, width) / 4,
        rng.randn(width, width) / 4, rng.randn(width) / 4, np.zeros(width), np.zeros(1)
    )
    names = ["we", "be", "wv", "wu", "wa", "wc", "bc"]
    m1, m2 = {k: 0.0 for k in names}, {k: 0.0 for k in names}
    weight = weight / weight.sum()
    for step in range(1, steps + 1):
        s = model.forward(x, of, n)
        g = weight * (s["p"] - y)
        d_bag = g[:, None] * model.wc[None, :]
        d_h = s["att"][:, None] * d_bag[of]
        d_att = (s["h"] * d_bag[of]).sum(1)
        d_a = s["att"] * (d_att - np.add.reduceat(s["att"] * d_att, s["starts"])[of])
        d_tv = d_a[:, None] * model.wa * s["su"] * (1 - s["tv"] ** 2)
        d_su = d_a[:, None] * model.wa * s["tv"] * s["su"] * (1 - s["su"])
        d_h = d_h + d_tv @ model.wv.T + d_su @ model.wu.T
        d_z = d_h * (1 - s["h"] ** 2)
        grads = {
            "we": s["z"].T @ d_z, "be": d_z.sum(0), "wv": s["h"].T @ d_tv, "wu": s["h"].T @ d_su,
            "wa": ((s["tv"] * s["su"]) * d_a[:, None]).sum(0), "wc": s["bag"].T @ g, "bc": np.array([g.sum()]),
        }
        for k in names:
            value = getattr(model, k)
            grad = grads[k] + shrink * value
            m1[k] = 0.9 * m1[k] + 0.1 * grad
            m2[k] = 0.999 * m2[k] + 0.001 * grad * grad
            setattr(model, k, value - 0.03 * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8))
    return model


def _untrained() -> AttentionModel:
    zero = np.zeros((1, 1))
    return AttentionModel(*[zero] * 9, trained=False)


def train_quality(
    docs: DataFrame, labels: DataFrame, may_learn: Column, id_col: str = "doc_id", text_col: str = "text",
    target: str = "quality", train_docs: int = 4000
) -> AttentionModel:
    """Learn from a bounded sample; ``may_learn`` is a condition on the columns ``id`` and ``label``."""
    sample = labelled_sample(docs, labels, target, train_docs, may_learn, id_col, text_col)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, texts in text_runs(batch, 0):
                x, of = passage_features(texts)
                bounds = np.searchsorted(of, np.arange(len(texts) + 1))
                bags = [x[i:j].astype(np.float32).tobytes() for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bags, pa.binary()), *[c.slice(a, len(texts)) for c in batch.columns[1:]]],
                    names=["x", "id", "label", "weight"]
                )

    wanted = sample.select("text", F.col("id").cast("string").alias("id"), "label", "weight")
    rows = wanted.mapInArrow(encode, "x binary, id string, label int, weight double").toArrow()
    drop_stored(sample)
    y = rows["label"].to_numpy().astype(float)
    if not len(y) or y.min() == y.max():
        return _untrained()
    order = np.argsort(rows["id"].to_numpy(zero_copy_only=False).astype(str), kind="stable")
    bags = rows["x"].to_pylist()
    parts = [np.frombuffer(bags[i], np.float32).reshape(-1, FEATURES).astype(float) for i in order]
    of = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    return fit(np.concatenate(parts), of, y[order], rows["weight"].to_numpy()[order])


def score_quality(docs: DataFrame, model: AttentionModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score of each row."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, texts in text_runs(batch, 1):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, len(texts)), pa.array(held.value.score(texts))], names=[id_col, "score"]
                )

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double")
