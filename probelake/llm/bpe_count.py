"""Token counts by rank-synchronous array merging.

Pre-tokens are held as one ragged numpy array (symbol ids plus sequence ids).
Each round finds the lowest-ranked adjacent pair of every sequence and applies
it in all sequences at once, every occurrence from left to right; surviving
symbols are the tokens. A pair made by a merge never ranks below that merge, so
this gives the same symbols as merging one pair at a time. Long pre-tokens are merged
by an index from ranks to places, so a round costs what it merges and not the
sequence's length.

Defined results: a null or empty text has 0 bytes and 0 tokens. Very long texts and
pre-tokens are counted whole, in time and memory about in proportion. Repeated rows
give repeated results; null ids stay null; further columns, whatever their names, are
ignored; an empty table gives no rows. Ties cannot occur: ranks are distinct, and of
overlapping places the leftmost is merged.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from probelake.llm.common import Memo, once_in_worker, text_runs

#: White space of the pre-tokenizer's pattern, as a character class.
_WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_UNIT = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
#: The byte-level pre-tokenizer's pattern (a fixed value of the vocabulary file's library).
_PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces of more bytes than this are merged through the index of ranks.
LONG = 400


def byte_alphabet() -> dict[str, int]:
    """Printable stand-in of each byte in byte-level vocabularies, inverted."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ArrayBpe:
    """Counts the tokens of byte strings with a byte-level BPE vocabulary."""

    def __init__(self, spec: bytes | str):
        import regex

        j = json.loads(spec)
        model, byte_of = j["model"], byte_alphabet()
        vocab = model["vocab"]
        self.first = np.zeros(256, np.int64)
        for char, b in byte_of.items():
            self.first[b] = vocab[char]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.size = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.parts = np.array([[vocab[a], vocab[b]] for a, b in merges], np.int64).reshape(-1, 2)
        self.order = np.argsort(keys, kind="stable")
        self.keys, self.made = keys[self.order], made
        self.special = [t["content"] for t in j.get("added_tokens", [])]
        self.split = re.compile(
            "(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")"
        ) if self.special else None
        self.piece = regex.compile(_PIECE)
        self.units, self.pieces = Memo(), Memo()

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.order[at], len(self.keys))

    def merge(self, pieces: list[bytes]) -> np.ndarray:
        """Number of symbols left of each piece."""
        long = np.array([len(p) > LONG for p in pieces], bool)
        out = np.empty(len(pieces), np.int64)
        out[~long] = self._merge_together([p for p, x in zip(pieces, long, strict=True) if not x])
        out[long] = [self._merge_one(p) for p, x in zip(pieces, long, strict=True) if x]
        return out

    def _merge_one(self, piece: bytes) -> int:
        """Symbols left of one long piece; each round takes the lowest rank in all its places."""
        ids = self.first[np.frombuffer(piece, np.uint8)]
        n, none, left = len(ids), len(self.keys), len(ids)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        places: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def note(at: np.ndarray) -> None:
            rank = self._ranks(ids[at], ids[after[at]])
            at, rank = at[rank < none], rank[rank < none]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cut = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            for r, group in zip(rank[np.r_[0, cut]].tolist(), np.split(at, cut), strict=True):
                if r not in places:
                    places[r] = []
                    heapq.heappush(ranks, r)
                places[r].append(group)

        note(np.arange(n - 1))
        while ranks:
            r = heapq.heappop(ranks)
            found = places.pop(r)
            at = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
            a, b = self.parts[r]
            at = at[(ids[at] == a) & (after[at] < n)]
            at = at[ids[after[at]] == b]
            if not len(at):
                continue
            if a == b:  # of overlapping occurrences every second one stands, from the left
                begins = np.r_[True, after[at[:-1]] != at[1:]]
                place = np.arange(len(at))
                at = at[(place - np.maximum.accumulate(np.where(begins, place, 0))) % 2 == 0]
            gone = after[at]
            ids[at], ids[gone] = self.made[r], -1
            beyond = after[gone]
            after[at] = beyond
            inside = beyond < n
            before[beyond[inside]] = at[inside]
            left -= len(at)
            prior = before[at]
            note(np.unique(np.concatenate([prior[prior >= 0], at[inside]])))
        return left

    def _merge_together(self, pieces: list[bytes]) -> np.ndarray:
        """Symbols left of many short pieces, merged round by round in one array."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids = self.first[np.frombuffer(b"".join(pieces), np.uint8)]
        return np.bincount(self.survivors(ids, np.repeat(np.arange(len(pieces)), lengths))[1], minlength=len(pieces))

    def survivors(self, ids: np.ndarray, seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols left of sequences that are laid end to end, and the sequence of each."""
        ids, none, done = ids.copy(), len(self.keys), []
        rank = np.full(len(ids), none)
        inside = np.flatnonzero(seq[1:] == seq[:-1])
        rank[inside] = self._ranks(ids[inside], ids[inside + 1])
        while len(ids):
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            lowest = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.r_[starts, len(ids)])
            per_symbol = np.repeat(lowest, sizes)
            going = per_symbol < none
            done.append((ids[~going], seq[~going]))
            hit = (rank == per_symbol) & going
            # of overlapping occurrences (as in "aaa") every second one stands, from the left
            again = np.flatnonzero(hit[1:] & hit[:-1]) + 1
            for i in again.tolist():
                if hit[i - 1]:
                    hit[i] = False
            ids[hit] = self.made[per_symbol[hit]]
            keep = going & ~np.r_[False, hit[:-1]]
            ids, seq, rank, hit = ids[keep], seq[keep], rank[keep], hit[keep]
            # only pairs beside a merged symbol are new
            changed = np.flatnonzero(hit | np.r_[hit[1:], False])
            rank[changed] = none
            inside = changed[:-1] if len(changed) and changed[-1] == len(ids) - 1 else changed
            inside = inside[seq[inside] == seq[inside + 1]]
            rank[inside] = self._ranks(ids[inside], ids[inside + 1])
        if not done:
            return ids, seq
        ids, seq = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(seq, kind="stable")
        return ids[order], seq[order]

    def _count_units(self, units: list[str]) -> list[int]:
        split = [self.piece.findall(u) for u in units]
        get = self.pieces.reader(set().union(*split), lambda new: self.merge([p.encode() for p in new]).tolist())
        return [sum(map(get, ps)) for ps in split]

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text; special strings count one each."""
        found, extra = [], []
        for t in texts:
            if self.split and any(s in t for s in self.special):
                parts = self.split.split(t)
                extra.append(len(parts) // 2)
                found.append([u for part in parts[::2] for u in _UNIT.findall(part)])
            else:
                extra.append(0)
                found.append(_UNIT.findall(t))
        get = self.units.reader(set().union(*found), self._count_units)
        return [e + sum(map(get, us)) for e, us in zip(extra, found, strict=True)]


def read_vocabulary(path: str) -> bytes:
    """A vocabulary file as bytes: it is a few MB at most and is broadcast to the workers."""
    with open(path, "rb") as f:
        return f.read()


def token_counts(
    docs: DataFrame, vocabulary: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """n_bytes, n_tokens and ``over_limit`` (n_tokens > limit) of each row."""
    raw = read_vocabulary(vocabulary)
    spec, name = docs.sparkSession.sparkContext.broadcast(raw), f"bpe {zlib.crc32(raw)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = once_in_worker(name, lambda: ArrayBpe(spec.value))
        for batch in batches:
            n = [x for _, texts in text_runs(batch, 1) for x in counter.count([t or "" for t in texts])]
            n_bytes = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), n_bytes, pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
