"""Best-fit packing under several capacities.

A piece takes tokens, a place among a sequence's documents and attention cost (its length
squared); a sequence has a capacity of each. Pieces are counted by length: at most
``capacity`` distinct lengths, whatever the corpus size. The driver packs these counts,
longest first: bins in the same state (used tokens, documents and attention cost) form a
group, and a length's items go to the group that scores best among those with room in
every capacity, by the weighted dot product of item and residual or by the least residual
norm, as many at once as the group has bins. Unless narrower limits are given, documents
and attention have the capacities that a sequence of ``capacity`` tokens can reach, so
they steer the choice without forbidding what the tokens allow. The resulting plan says
which ranks of which length go to which bins; pieces get their rank inside their length
from two levels of bucket counts, so no length, however frequent, is sorted in one task.

Defined results: a null text counts as empty (only its end id); very long texts are read
whole and cut; equal scores go to the group that was opened first; repeated rows are
packed separately; null ids stay null; an empty table gives no rows; further columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import os
import string
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from probelake.llm.bpe_count import LONG, ArrayBpe, byte_alphabet, read_vocabulary
from probelake.llm.common import Memo, once_in_worker, store, text_runs, text_slices

CAPACITY = 2048
#: Bytes of texts whose words are found together: the more, the fewer repeated look-ups.
_RUN_BYTES = 4_000_000
#: Words merged in one array; arrays of more leave the processor's caches.
_TOGETHER = 8_000
#: Kinds of bytes in plain texts, whose only other bytes than ASCII are those of Latin-1 letters; any else (0) makes a text odd.
_SPACE, _LETTER, _DIGIT, _MARK = 1, 2, 3, 4
_LETTERS = string.ascii_letters + "".join(filter(str.isalpha, map(chr, range(0xC0, 0x100))))
_KIND, _LOWER = np.zeros(256, np.uint8), np.arange(256, dtype=np.uint8)
for _kind, _chars in (
    (_SPACE, " \t\n\r"), (_LETTER, _LETTERS), (_DIGIT, string.digits), (_MARK, string.punctuation.replace("'", ""))
):
    _KIND[list(_chars.encode())] = _kind
for _char in _LETTERS:
    _LOWER[_char.encode()[-1]] = _char.lower().encode()[-1]


class ChunkTokenizer:
    """Ids of texts as the library gives them, as little-endian bytes, each distinct part once.

    The vocabulary lower-cases, drops white space and never looks across it or beyond one
    word of its pre-tokenizer. Texts of plain characters are cut into these words as byte
    arrays, whose distinct words (the last byte with the end mark) are merged many at a
    time in one array; the library itself gets long words and the white-space-free chunks
    of other texts.
    """

    def __init__(self, spec: str, memo: int = 36_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library, self.bpe = Tokenizer.from_str(spec), ArrayBpe(spec)
        vocab = self.library.get_vocab()
        self.last = np.zeros(256, np.int64)
        for char, b in byte_alphabet().items():
            self.last[b] = vocab[f"{char}</w>"]
        self.pieces, self.chunks = Memo(memo), Memo(memo // 4)

    def _of_pieces(self, pieces: list[bytes]) -> list[bytes]:
        return [ids for i in range(0, len(pieces), _TOGETHER) for ids in self._merged(pieces[i : i + _TOGETHER])]

    def _merged(self, pieces: list[bytes]) -> list[bytes]:
        short = [p if len(p) <= LONG else b"" for p in pieces]
        lengths = np.fromiter(map(len, short), np.int64, len(short))
        codes, ends = np.frombuffer(b"".join(short), np.uint8), np.cumsum(lengths)[lengths > 0] - 1
        ids = self.bpe.first[codes]
        ids[ends] = self.last[codes[ends]]
        ids, seq = self.bpe.survivors(ids, np.repeat(np.arange(len(short)), lengths))
        at = (4 * np.cumsum(np.bincount(seq, minlength=len(short)))).tolist()
        all_ids = ids.astype("<u4").tobytes()
        out = [all_ids[a:b] for a, b in zip([0, *at[:-1]], at, strict=True)]
        long = [i for i, p in enumerate(pieces) if len(p) > LONG]
        for i, found in zip(long, self._of_chunks([pieces[i].decode() for i in long]), strict=True):
            out[i] = found
        return out

    def _of_chunks(self, chunks: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(chunks, add_special_tokens=False)]

    def _of_odd(self, texts: list[str]) -> list[bytes]:
        cut = [t.replace("\n", " ").replace("\t", " ").split(" ") for t in texts]
        get = self.chunks.reader(set().union(*cut), self._of_chunks)
        return [b"".join(map(get, c)) for c in cut]

    def ids(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        column = pc.fill_null(column, "").cast(pa.large_string())
        column.validate(full=True)  # bytes are only cut right in well-formed texts
        at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        codes = np.frombuffer(column.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
        at = at - at[0]
        if not len(codes):
            return [b""] * len(column)
        kind = np.take(_KIND, codes)
        begins = np.r_[True, kind[1:] != kind[:-1]] | (kind == _DIGIT)
        begins[at[at < len(codes)]] = True
        special = np.r_[(codes[:-1] == ord("<")) & (codes[1:] == ord("|")), False]
        odd = np.unique(np.searchsorted(at, np.flatnonzero(special | (kind == 0)), side="right") - 1).tolist()
        inside = kind > _SPACE
        for i in odd:
            inside[at[i] : at[i + 1]] = False

        raw = np.take(_LOWER, np.compress(inside, codes))
        offsets = np.append(np.flatnonzero(np.compress(inside, begins)), len(raw))
        words = pa.Array.from_buffers(
            pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(raw)]
        ).dictionary_encode()
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        get = self.pieces.reader(set(distinct), self._of_pieces)
        found = pa.array(list(map(get, distinct)), pa.large_binary()).take(words.indices)
        # where each text's words end, and so its ids
        ends = np.frombuffer(found.buffers()[1], np.int64)[found.offset :]
        ends = ends[np.searchsorted(np.flatnonzero(begins & inside), at)].tolist()
        every = memoryview(found.buffers()[2] or b"")
        out = [bytes(every[a:b]) for a, b in pairwise(ends)]
        rest = pa.record_batch([column.take(pa.array(odd, pa.int64()))], ["text"])
        for a, run in text_runs(rest, 0):
            for i, ids in zip(odd[a : a + len(run)], self._of_odd(run), strict=True):
                out[i] = ids
        return out


def token_pieces(
    docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Every row's ids plus the end id, cut into pieces of ``capacity``: id, piece, start, length, ids_crc32."""
    raw = read_vocabulary(vocabulary)
    spec, name = docs.sparkSession.sparkContext.broadcast(raw.decode()), f"chunks {zlib.crc32(raw)}"
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = once_in_worker(name, lambda: ChunkTokenizer(spec.value))
        for batch in batches:
            for a, texts in text_slices(batch, 1, _RUN_BYTES):
                rows: list[list] = [[], [], [], [], []]
                for i, ids in enumerate(tokenizer.ids(texts), a):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        for column, x in zip(rows, (i, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                            column.append(x)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int32()),
                        *[pa.array(x, pa.int64()) for x in rows[2:]]
                    ],
                    names=[id_col, "piece", "start", "length", "ids_crc32"],
                )

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(
        run, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long"
    )


class VectorPacker:
    """Packs counts of lengths; states of bins are (used tokens, documents, attention)."""

    def __init__(
        self, capacity: int, max_docs: int | None = None, max_attention: float | None = None, rule: str = "norm",
        weights=(1.0, 0.05, 0.05)
    ):
        self.capacity, self.rule, self.weights = capacity, rule, np.array(weights)
        # a sequence of so many tokens has no more documents and attention cost than this
        self.limits = np.array([capacity, max_docs or capacity, max_attention or capacity**2], float)

    def _item(self, length: int) -> tuple[float, float, float]:
        return float(length), 1.0, float(length) ** 2

    def pack(self, counts: dict[int, int]) -> tuple[list[tuple[int, int, int, int, int]], int]:
        """Plan rows (length, first rank, items, first bin, offset) and the number of bins."""
        plan: list[tuple[int, int, int, int, int]] = []
        states: dict[tuple, int] = {}
        names: list[tuple] = []
        left = np.zeros((64, 3))  # residual capacities of each state
        count = np.zeros(64, np.int64)
        spans: list[list[tuple[int, int]]] = []  # bins of each state: (first, how many)
        bins = 0

        def put(state: tuple, first: int, size: int) -> None:
            nonlocal left, count
            if not size:
                return
            i = states.setdefault(state, len(spans))
            if i == len(spans):
                spans.append([])
                names.append(state)
                if i == len(left):
                    left, count = np.vstack([left, np.zeros_like(left)]), np.concatenate([count, np.zeros_like(count)])
                left[i] = self.limits - state
            spans[i].append((first, size))
            count[i] += size

        for length in sorted(counts, reverse=True):
            n, rank, item = counts[length], 0, np.array(self._item(length))
            if (item > self.limits).any():
                raise ValueError(f"a piece of {length} tokens fits no sequence")
            while n:
                m = len(spans)
                fits = (count[:m] > 0) & (left[:m] >= item).all(axis=1)
                if not fits.any():
                    each = int(min(self.limits[item > 0] // item[item > 0]))
                    full, rest = divmod(n, each)
                    for j in range(each if full else 0):
                        plan.append((length, rank, full, bins, j * length))
                        rank += full
                    for j in range(rest):
                        plan.append((length, rank, 1, bins + full, j * length))
                        rank += 1
                    put(tuple(item * each), bins, full)
                    put(tuple(item * rest), bins + full, int(rest > 0))
                    bins += full + (rest > 0)
                    break
                where = np.flatnonzero(fits)
                after, unit = (left[where] - item) / self.limits, item / self.limits
                # the least residual norm, or the largest dot product of item and what is used
                score = -((after**2) @ self.weights) if self.rule == "norm" else ((1 - after) * unit) @ self.weights
                i = int(where[np.argmax(score)])
                first, size = spans[i].pop()
                use = min(n, size)
                if size > use:
                    spans[i].append((first + use, size - use))
                count[i] -= use
                plan.append((length, rank, use, first, int(names[i][0])))
                put(tuple(np.array(names[i]) + item), first, use)
                rank += use
                n -= use
        return plan, bins


#: Pieces of one bucket, and buckets of one coarse bucket, aimed at.
_ROWS = 2000


def _ranked(pieces: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """``pieces`` with ``p_rank``, their number from 0 among those of their length (in no particular order), and the lengths' counts."""
    # a number of its own for each row deals even equal rows to different buckets
    spread = F.xxhash64("length", F.monotonically_increasing_id())
    keyed = store(pieces.withColumn("p_hash", spread), "pieces")
    buckets = max(64, keyed.count() // _ROWS)
    keyed = keyed.withColumn("p_b", F.pmod("p_hash", F.lit(buckets))).withColumn("p_a", F.floor(F.col("p_b") / _ROWS))
    sums = store(keyed.groupBy("length", "p_a", "p_b").agg(F.count(F.lit(1)).alias("n")), "pack_counts")
    upto = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    counts = {int(r["length"]): int(r["n"]) for r in sums.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    coarse = sums.groupBy("length", "p_a").agg(F.sum("n").alias("n"))
    coarse = coarse.select("length", "p_a", F.coalesce(F.sum("n").over(upto("length").orderBy("p_a")), F.lit(0)).alias("p_far"))
    before = sums.select(
        "length", "p_a", "p_b", F.coalesce(F.sum("n").over(upto("length", "p_a").orderBy("p_b")), F.lit(0)).alias("p_near")
    )
    before = before.join(coarse, ["length", "p_a"]).select(
        "length", "p_b", (F.col("p_far") + F.col("p_near")).alias("p_before")
    )
    within = F.row_number().over(Window.partitionBy("length", "p_b").orderBy("p_hash")) - 1
    ranked = keyed.withColumn("p_in", within).join(before, ["length", "p_b"])
    return ranked.withColumn("p_rank", F.col("p_in") + F.col("p_before")), counts


def pack_pieces(
    pieces: DataFrame, capacity: int = CAPACITY, max_docs: int | None = None, max_attention: float | None = None,
    rule: str = "norm"
) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces; all capacities hold in every sequence."""
    ranked, counts = _ranked(pieces)
    plan, _ = VectorPacker(capacity, max_docs, max_attention, rule).pack(counts)
    # its rows follow the distinct lengths and the groups of bins, not the pieces
    found = pieces.sparkSession.sparkContext.broadcast(_steps(plan))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_length = found.value
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (0, 1))
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length):
                at = np.flatnonzero(length == x)
                start, first, offset = by_length[int(x)]
                k = np.searchsorted(start, rank[at], side="right") - 1
                seq[at], off[at] = first[k] + rank[at] - start[k], offset[k]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[2:], batch.column(0), pa.array(seq), pa.array(off)],
                names=[*kept, "length", "sequence_id", "offset"]
            )

    kept = [c for c in pieces.columns if c != "length"]
    kind = dict(pieces.dtypes)
    schema = ", ".join(f"`{c}` {kind[c]}" for c in kept) + ", length long, sequence_id long, offset long"
    return ranked.select("length", "p_rank", *kept).mapInArrow(place, schema)


def _steps(plan) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    out: dict[int, list] = {}
    for length, rank, _, first, offset in plan:
        out.setdefault(length, []).append((rank, first, offset))
    return {k: tuple(np.array(x, np.int64) for x in zip(*sorted(v), strict=True)) for k, v in out.items()}


def pack_documents(
    docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", **limits
) -> DataFrame:
    """Tokenize, cut and pack; see :func:`token_pieces` and :func:`pack_pieces`."""
    packed = pack_pieces(token_pieces(docs, vocabulary, capacity, id_col=id_col, text_col=text_col), capacity, **limits)
    return packed.select(id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
