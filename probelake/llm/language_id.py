"""Language identification with language-bitmask n-gram filters.

One Bloom filter holds the n-grams of all languages: each position is a bit mask
with one bit a language, an n-gram's positions are and-ed, and what is left names
all languages that contain it. A text's hits per language (population counts of the
bit planes over its n-grams) are corrected for the plane's false positives and
compared. Masks have one 64-bit word for every 64 languages.

Training uses at most ``train_docs`` documents of a language (a documented bound),
chosen by a hash of the id; prediction reads whole texts.

Defined results: ``und`` with score 0 for a null text or one without letters, and
for all texts if nothing can be learned; ties go to the language with more training
rows, then by name; very long texts are read whole, in memory in proportion; repeated
rows give repeated results; null ids stay null (and may be learned from); further
columns, whatever their names, are ignored; empty tables give no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probelake.llm.common import once_in_worker, store, text_runs
from probelake.llm.set_sketch import finish

SIZES = (2, 3, 4)
POSITIONS = 1 << 20
HASHES = 2
_LETTERS: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    """Lower-cased code point of each letter of the first plane, a space for the rest."""
    if not _LETTERS:
        table = np.full(0x10000, 32, np.uint32)
        for i in range(0x10000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                table[i] = ord(low) if len(low) == 1 else i
        _LETTERS.append(table)
    return _LETTERS[0]


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram size: 64-bit hashes and the index of the text of each."""
    joined = " " + " \x00 ".join(texts) + " "
    codes = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    ends = codes == 0
    owner = np.cumsum(ends)
    owner[ends] -= 1
    flat = np.where(codes < 0x10000, _letter_table()[np.minimum(codes, 0xFFFF)], codes)
    keep = ~((flat == 32) & np.r_[False, flat[:-1] == 32] & ~np.r_[True, owner[1:] != owner[:-1]])
    flat, owner = flat[keep].astype(np.uint64), owner[keep]
    for n in SIZES:
        if len(flat) < n:
            continue
        h = np.full(len(flat) - n + 1, n, np.uint64)
        for i in range(n):
            h = h * np.uint64(0x100000001B3) + flat[i : len(flat) - n + 1 + i]
        ok = owner[: len(h)] == owner[n - 1 :]
        yield finish(h[ok]), owner[: len(h)][ok]


def _positions(h: np.ndarray) -> list[np.ndarray]:
    return [((h >> np.uint64(20 * k)) & np.uint64(POSITIONS - 1)).astype(np.int64) for k in range(HASHES)]


def _clean(texts: list) -> list[str]:
    return [(t or "").replace("\x00", " ") for t in texts]


class LanguageFilters:
    """Trained masks: ``masks`` (words x positions, uint64) and the languages' order."""

    def __init__(self, languages: list[str], masks: np.ndarray):
        self.languages, self.masks = languages, masks
        fill = [((masks[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(languages))]
        self.false_positive = np.array(fill) ** HASHES

    def hits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Corrected hits (texts x languages) and n-grams of each text."""
        hits, total = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        for h, owner in grams(texts):
            if not len(h):
                continue
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            total[owner[starts]] += np.diff(np.r_[starts, len(owner)])
            at = _positions(h)
            for w, plane in enumerate(self.masks):
                mask = plane[at[0]]
                for p in at[1:]:
                    mask &= plane[p]
                for i in range(64 * w, min(64 * w + 64, len(self.languages))):
                    bit = ((mask >> np.uint64(i % 64)) & np.uint64(1)).astype(np.int32)
                    hits[owner[starts], i] += np.add.reduceat(bit, starts, dtype=np.int64)
        fp = self.false_positive
        return np.maximum(hits - total[:, None] * fp, 0.0) / (1.0 - np.minimum(fp, 0.999)), total

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        clean = _clean(texts)
        if not self.languages:
            return ["und"] * len(texts), [0.0] * len(texts)
        hits, _ = self.hits(clean)
        best, total = hits.argmax(1), hits.sum(1)
        lang, score = [], []
        for i, t in enumerate(clean):
            known = any(map(str.isalpha, t))
            lang.append(self.languages[best[i]] if known else "und")
            score.append(float(hits[i, best[i]] / total[i]) if known and total[i] > 0 else 0.0)
        return lang, score


def train_filters(
    docs: DataFrame, may_learn: Column, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text",
    train_docs: int = 3000, least_count: int = 3, least_share: float = 0.1
) -> LanguageFilters:
    """Learn which n-grams each language has: at least ``least_count`` times, and at
    least ``least_share`` as often as in the language where it is most frequent."""
    rows = docs.where(may_learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col).cast("string")).alias("h")
    )
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes, key=lambda x: (-sizes[x], x))
    words = max(1, -(-len(languages) // 64))
    masks = np.zeros((words, POSITIONS), np.uint64)
    if not languages:
        return LanguageFilters([], masks)
    index = {x: i for i, x in enumerate(languages)}
    rates = docs.sparkSession.createDataFrame(
        [(x, min(1.0, train_docs / n)) for x, n in sizes.items()], "lang string, rate double"
    )
    sample = rows.join(F.broadcast(rates), "lang").where(
        F.col("h") / F.lit(2.0**64) + 0.5 < F.col("rate")
    ).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for a, texts in text_runs(batch, 1):
                clean = _clean(texts)
                for lang in set(langs[a : a + len(texts)]):
                    hs = [h for h, _ in grams([t for t, x in zip(clean, langs[a:], strict=False) if x == lang])]
                    if hs:
                        h, n = np.unique(np.concatenate(hs), return_counts=True)
                        code = np.full(len(h), index[lang], np.int32)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(h.view(np.int64)), pa.array(code), pa.array(n.astype(np.int64))],
                            names=["gram", "lang", "n"]
                        )

    seen = sample.mapInArrow(count, "gram long, lang int, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    seen = store(seen, "language_grams")
    # masks only depend on n-grams seen often enough to tell languages apart
    total = {r["lang"]: r["n"] for r in seen.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    scale = docs.sparkSession.createDataFrame([(k, 1.0 / v) for k, v in total.items()], "lang int, scale double")
    seen = seen.join(F.broadcast(scale), "lang").withColumn("rate", F.col("n") * F.col("scale"))
    top = seen.groupBy("gram").agg(F.max("rate").alias("top"))
    held = seen.where(F.col("n") >= least_count).join(top, "gram").where(F.col("rate") >= least_share * F.col("top"))
    place = [F.shiftrightunsigned(F.col("gram"), 20 * k).bitwiseAND(POSITIONS - 1).cast("int") for k in range(HASHES)]
    bit = F.expr("shiftleft(1L, lang % 64)")
    bits = held.select(F.explode(F.array(*place)).alias("at"), (F.col("lang") / 64).cast("int").alias("word"), bit.alias("bit"))
    filled = bits.groupBy("word", "at").agg(F.bit_or("bit").alias("mask")).toArrow()
    masks[filled["word"].to_numpy(), filled["at"].to_numpy()] = filled["mask"].to_numpy().view(np.uint64)
    return LanguageFilters(languages, masks)


def identify(docs: DataFrame, filters: LanguageFilters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred and score of each row."""
    held = docs.sparkSession.sparkContext.broadcast((filters.languages, filters.masks))
    name = f"languages {filters.languages} {zlib.crc32(filters.masks.tobytes())}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = once_in_worker(name, lambda: LanguageFilters(*held.value))
        for batch in batches:
            for a, texts in text_runs(batch, 1):
                lang, score = model.predict(texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, len(texts)), pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                    names=[id_col, "lang_pred", "score"]
                )

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")
