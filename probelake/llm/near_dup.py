r"""Near-duplicate documents by SetSketch registers.

Words are ``[^\x20\x09-\x0D]+`` after lower-casing A-Z; a document's set holds its
distinct word shingles (the whole sequence as one where words are fewer). Steps:

1. one pass over the texts gives each document's set size, a 128-bit digest of the
   set and its registers; documents with equal digests are one class;
2. the registers' bands deal classes into buckets; members are compared with two
   centres of their bucket, first by likelihood, then on full sets;
3. where a bucket's other members still belong to several components, those outside
   the largest one are compared with all: registers alone find, block by block, the
   members that have a likely partner in another component (a pair counts in the first
   band in which it meets), and only these meet again with their full sets;
4. components of the verified links.

No link is taken unverified. Buckets of any size are handled: centres cost a row
a member, and blocks are bounded in rows and in bytes of sets.

Defined results: a null or empty text has an empty set and links with nothing;
repeated rows get equal results; different texts of one id are documents of their own,
whose component is the smallest id among the texts that they reach; a null id links with
nothing and has a null component; ties of equal estimates go by node number; very long
texts are read whole, in memory in proportion; further columns, whatever their names,
are ignored (or kept as they are by :func:`drop_near_duplicates`); empty tables give no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probelake.llm import set_sketch
from probelake.llm.common import OTHER_SPACE, Memo, connected_components, dealt_blocks, drop_stored, once_in_worker, store, text_runs

BANDS = 32
#: Rows, and bytes of full sets, aimed at in one block of a bucket.
BLOCK = 1024
BLOCK_BYTES = 8_000_000
#: Sub-keys that the copies of one set are dealt to.
SALTS = 32
_LOWER = {ord(c): ord(c.lower()) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"} | {ord(c): " " for c in OTHER_SPACE}
_MULT = np.uint64(0x9E3779B97F4A7C15)


class Shingler:
    """Distinct 64-bit shingle hashes of texts."""

    def __init__(self, size: int):
        import xxhash

        self.size, self.hash, self.memo = size, xxhash.xxh3_64_intdigest, Memo()

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        split = [[w for w in (t or "").translate(_LOWER).split(" ") if w] for t in texts]
        get = self.memo.reader(set().union(*split), lambda new: [self.hash(w.encode("utf-8")) for w in new])
        return [self._set(np.fromiter(map(get, ws), np.uint64, len(ws))) for ws in split]

    def _set(self, w: np.ndarray) -> np.ndarray:
        if not len(w):
            return w
        k = min(self.size, len(w))
        h = np.full(len(w) - k + 1, k, np.uint64)
        for i in range(k):
            h = set_sketch.finish(h * _MULT + w[i : len(w) - k + 1 + i])
        return np.unique(h)


def rows_per_band(threshold: float) -> int:
    """Rows at which a pair at the threshold agrees in about a third of the bands."""
    return max(2, int(np.floor(np.log(0.325) / np.log(threshold))))


def _sketches(docs: DataFrame, size: int, m: int) -> DataFrame:
    """id, mark, set size, digest and registers of each row of (id, mark, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        shingler = once_in_worker(f"shingles {size}", lambda: Shingler(size))
        for batch in batches:
            for a, texts in text_runs(batch, 2):
                sets = shingler.sets(texts)
                n = np.array([len(s) for s in sets], np.int64)
                full = [s for s in sets if len(s)]
                regs: list = [None] * len(sets)
                if full:
                    starts = np.cumsum([0, *map(len, full[:-1])])
                    made = set_sketch.registers(np.concatenate(full), starts, m)
                    for i, r in zip(np.flatnonzero(n), made, strict=True):
                        regs[i] = r.tobytes()
                digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                of = [c.slice(a, len(texts)) for c in batch.columns[:2]]
                yield pa.RecordBatch.from_arrays(
                    [*of, pa.array(n), pa.array(digests, pa.binary()), pa.array(regs, pa.binary())],
                    names=["id", "mark", "n", "digest", "regs"]
                )

    return docs.select("id", "mark", "text").mapInArrow(run, "id long, mark long, n long, digest binary, regs binary")


def _full_sets(docs: DataFrame, size: int) -> DataFrame:
    """node and set of each row of (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = once_in_worker(f"shingles {size}", lambda: Shingler(size))
        for batch in batches:
            for a, texts in text_runs(batch, 1):
                sets = [s.tobytes() for s in shingler.sets(texts)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, len(texts)), pa.array(sets, pa.binary())], names=["node", "set"]
                )

    return docs.select("node", "text").mapInArrow(run, "node long, set binary")


def _alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, on sorted distinct hashes."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _margin(threshold: float, m: int) -> float:
    """The least estimate worth verifying: four standard errors below the threshold."""
    return threshold - 4.0 * float(np.sqrt(threshold * (1 - threshold) / m))


def _likely_pairs(pairs: DataFrame, percent: int, m: int) -> DataFrame:
    """Pairs (u, v, and both n and regs) whose likelihood estimate comes near the threshold."""
    least = _margin(percent / 100, m)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            a = np.frombuffer(b"".join(pdf["regs_u"]), np.uint8).reshape(-1, m)
            b = np.frombuffer(b"".join(pdf["regs_v"]), np.uint8).reshape(-1, m)
            j = set_sketch.estimate((a > b).sum(1), (a < b).sum(1), pdf["n_u"].to_numpy(float), pdf["n_v"].to_numpy(float), m)
            yield pdf.loc[j >= least, ["u", "v"]]

    return pairs.mapInPandas(run, "u long, v long")


def _verified_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ok = [
                _alike(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), percent) for a,
                b in zip(pdf["set_u"], pdf["set_v"], strict=True)
            ]
            yield pdf.loc[np.array(ok, bool), ["u", "v"]]

    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("set").alias("set_u")), "u")
    both = both.join(sets.select(F.col("node").alias("v"), F.col("set").alias("set_v")), "v")
    return both.select("u", "v", "set_u", "set_v").mapInPandas(run, "u long, v long")


class _Block:
    """Queries and targets of one block of a bucket, and their likely pairs across components."""

    def __init__(self, pdf: pd.DataFrame, least: float, m: int, bands: int):
        self.pdf, self.least, self.m, self.bands = pdf, least, m, bands
        self.comps, self.n = pdf["comp"].to_numpy(), pdf["n"].to_numpy(float)
        self.regs = np.frombuffer(b"".join(pdf["regs"]), np.uint8).reshape(-1, m)
        is_query = pdf["query"].to_numpy(bool)
        self.queries, self.targets = np.flatnonzero(is_query), np.flatnonzero(~is_query)
        self.band = int(pdf["band"].iloc[0])

    def pairs(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query, likely targets, their estimates) for pairs that meet in no earlier band."""
        t, of_targets = self.targets, self.regs[self.targets]
        for i in self.queries:
            apart = np.count_nonzero(of_targets != self.regs[i], axis=1)
            ok = np.flatnonzero((apart <= (1.05 - self.least) * self.m) & (self.comps[t] != self.comps[i]))
            if not len(ok):
                continue
            same = (of_targets[ok] == self.regs[i]).reshape(len(ok), self.bands, -1).all(2)
            ok = ok[~same[:, : self.band].any(1)]
            above = np.count_nonzero(of_targets[ok] < self.regs[i], axis=1)
            j = set_sketch.estimate(above, apart[ok] - above, np.full(len(ok), self.n[i]), self.n[t[ok]], self.m)
            if (j >= self.least).any():
                yield i, t[ok[j >= self.least]], j[j >= self.least]


def _block_candidates(least: float, m: int, bands: int):
    """The rows of a block that have a likely partner in another component, by registers alone."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = np.zeros(len(pdf), bool)
        for i, partners, _ in _Block(pdf, least, m, bands).pairs():
            found[i] = True
            found[partners] = True
        return pdf.loc[found, ["band", "bucket", "i", "j", "node", "comp", "query"]]

    return run


def _block_links(percent: int, least: float, m: int, bands: int):
    """Verified links that join the components of a block's candidates."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        block, nodes, raw = _Block(pdf, least, m, bands), pdf["node"].to_numpy(), pdf["set"].tolist()
        found = [(x, int(i), int(k)) for i, partners, j in block.pairs() for x, k in zip(j.tolist(), partners, strict=True)]
        root: dict[int, int] = {}

        def top(x: int) -> int:
            while root.get(x, x) != x:
                root[x] = x = root.get(root[x], root[x])
            return x

        links = []
        for _, i, k in sorted(found, key=lambda x: (-x[0], nodes[x[1]], nodes[x[2]])):
            a, b = top(int(block.comps[i])), top(int(block.comps[k]))
            if a != b and _alike(np.frombuffer(raw[i], np.uint64), np.frombuffer(raw[k], np.uint64), percent):
                root[max(a, b)] = min(a, b)
                links.append((int(nodes[i]), int(nodes[k])))
        return pd.DataFrame(links, columns=["u", "v"], dtype="int64")

    return run


def _blocks(size: Column, of_bytes: Column) -> Column:
    return F.greatest(F.ceil(size / BLOCK), F.ceil(of_bytes / BLOCK_BYTES), F.lit(1)).cast("int")


def _residual_links(
    members: DataFrame, comps: DataFrame, sketches: DataFrame, sets: DataFrame, percent: int, m: int, bands: int
) -> DataFrame | None:
    """Links between members of a bucket that its centres have left in several components."""
    least = _margin(percent / 100, m)
    # what touches a centre has been compared
    rest = members.where("node <> centre AND node <> second").select("band", "bucket", "node")
    rest = rest.join(comps, "node", "left").select("band", "bucket", "node", F.coalesce("component", "node").alias("comp"))
    rest = store(rest.join(sketches.select("node", "n"), "node"), "labelled")
    key = ["band", "bucket"]
    several = rest.groupBy(*key).agg(F.min("comp").alias("a"), F.max("comp").alias("z")).where("a <> z").select(*key)
    open_ = rest.join(several, key, "left_semi")
    sizes = open_.groupBy(*key, "comp").agg(
        F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"), F.bit_xor(F.xxhash64("node")).alias("x")
    )
    main = F.max_by(F.struct("comp", "c", "s"), F.struct("c", "comp")).alias("m")
    per = sizes.groupBy(*key).agg(F.sum("c").alias("c"), F.sum("s").alias("s"), F.bit_xor("x").alias("x"), main)
    # bands often repeat a bucket: the first of each membership is enough
    per = per.groupBy("c", "x").agg(
        F.min_by(F.struct(*key, "m", "s"), "band").alias("b")
    ).select("b.band", "b.bucket", "b.m", "c", "b.s")
    per = store(
        per.select(
            *key, F.col("m.comp").alias("main"),
            _blocks(F.col("c") - F.col("m.c"), 8 * (F.col("s") - F.col("m.s"))).alias("q_blocks"),
            _blocks(F.col("c"), 8 * F.col("s")).alias("t_blocks")
        ),
        "open_buckets",
    )
    if not per.limit(1).count():
        return None
    rows = open_.join(per, key).join(sketches.select("node", "regs"), "node")
    place = F.xxhash64("node", F.lit(3))
    base = [*key, "node", "comp", "n", "regs"]
    targets = rows.select(
        *base, F.lit(False).alias("query"), F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1)).alias("i"),
        F.pmod(place, F.col("t_blocks")).cast("int").alias("j")
    )
    asks = rows.where("comp <> main").select(
        *base, F.lit(True).alias("query"), F.pmod(place, F.col("q_blocks")).cast("int").alias("i"),
        F.explode(F.sequence(F.lit(0), F.col("t_blocks") - 1)).alias("j")
    )
    at = [*key, "i", "j"]
    likely = dealt_blocks(targets.unionByName(asks), at).applyInPandas(
        _block_candidates(least, m, bands), "band int, bucket long, i int, j int, node long, comp long, query boolean"
    )
    likely = store(likely, "candidates")
    full = likely.join(sets, "node").join(sketches.select("node", "n", "regs"), "node")
    return store(dealt_blocks(full, at).applyInPandas(_block_links(percent, least, m, bands), "u long, v long"), "more_links")


def _joined(comps: DataFrame, more: DataFrame) -> DataFrame:
    """Components after further links: only the components that these touch are searched again."""
    ends = more.select(F.explode(F.array("u", "v")).alias("node")).distinct().select("node", F.col("node").alias("component"))
    known = comps.unionByName(ends.join(comps, "node", "left_anti"))
    of = lambda s: known.select(F.col("node").alias(s), F.col("component").alias(f"c_{s}"))
    between = more.join(of("u"), "u").join(of("v"), "v").select(F.col("c_u").alias("u"), F.col("c_v").alias("v"))
    again = connected_components(between).select(F.col("node").alias("component"), F.col("component").alias("joined"))
    return known.join(again, "component", "left").select("node", F.coalesce("joined", "component").alias("component"))


def _components(docs: DataFrame, shingle: int, percent: int, bands: int, id_col: str, text_col: str) -> DataFrame:
    """id, mark (a hash of the text), n, group (of linked texts, null without words) and component of each row."""
    r = rows_per_band(percent / 100)
    m = bands * r
    docs = docs.select(
        F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("mark"), F.col(text_col).alias("text")
    )
    rows = store(_sketches(docs, shingle, m), "sketches")
    full = rows.where("id IS NOT NULL AND n > 0").withColumn(
        "salt", F.pmod(F.xxhash64("id", F.lit(13)), F.lit(SALTS)).cast("int")
    )
    # equal digests mean equal sets, hence equal sizes and registers
    classes = full.groupBy("digest").agg(
        F.min(F.struct("id", "mark")).alias("rep"), F.first("n").alias("n"), F.first("regs").alias("regs"),
        F.collect_set("salt").alias("salts")
    )
    classes = store(
        classes.select("digest", "rep.id", "rep.mark", "n", "regs", "salts", F.monotonically_increasing_id().alias("node")),
        "classes"
    )

    keys = F.transform(
        F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.xxhash64(b, F.substring(F.col("regs"), b * r + 1, F.lit(r)))
    )
    banded = classes.select("node", F.posexplode(keys).alias("band", "bucket"))
    second = F.min(F.struct(F.xxhash64("node", F.lit(7)), "node"))["node"].alias("second")
    met = banded.groupBy("band", "bucket").agg(
        F.count(F.lit(1)).alias("c"), F.min("node").alias("centre"), second
    ).where("c > 1")
    members = store(banded.join(met, ["band", "bucket"]).select("band", "bucket", "node", "centre", "second"), "members")

    pairs = members.select("node", F.explode(F.array("centre", "second")).alias("c")).where("node <> c")
    pairs = pairs.select(F.least("node", "c").alias("u"), F.greatest("node", "c").alias("v")).distinct()
    of = lambda s: classes.select(
        F.col("node").alias(s), F.col("n").alias(f"n_{s}"), F.col("regs").alias(f"regs_{s}")
    )
    in_range = "100 * least(n_u, n_v) >= " + str(percent) + " * greatest(n_u, n_v)"
    likely = store(_likely_pairs(pairs.join(of("u"), "u").join(of("v"), "v").where(in_range), percent, m), "likely")
    wanted = classes.select("id", "mark", "node").join(members.select("node").distinct(), "node", "left_semi")
    texts = docs.where("id IS NOT NULL").join(wanted, ["id", "mark"]).groupBy("id", "mark").agg(
        F.first("node").alias("node"), F.first("text").alias("text")
    )
    sets = store(_full_sets(texts, shingle), "sets")
    links = store(_verified_pairs(likely, sets, percent), "links")
    drop_stored(likely)

    comps = connected_components(links)
    more = _residual_links(members, comps, classes, sets, percent, m, bands)
    if more is not None:
        comps = store(_joined(comps, more), "components")
    linked = classes.select("digest", "id", "node").join(comps, "node")
    least = linked.groupBy("component").agg(F.min("id").alias("least"))
    linked = linked.join(least, "component").select("digest", "component", "least")
    of_class = classes.select("digest", "id", "node", "salts").join(linked, "digest", "left")
    # a class is there once for each salt that its rows have, so a large group of copies meets it in many tasks
    of_class = of_class.select(
        "digest", F.explode("salts").alias("salt"), F.coalesce("component", "node").alias("group"),
        F.coalesce("least", "id").alias("component")
    )
    found = full.join(of_class, ["digest", "salt"]).select("id", "mark", "n", "group", "component")
    # rows without a set are kept out of the join: they would all meet in one task
    rest = rows.where("id IS NULL OR n = 0").select(
        "id", "mark", "n", F.lit(None).cast("long").alias("group"), F.col("id").alias("component")
    )
    return found.unionByName(rest)


def near_duplicates(
    docs: DataFrame, shingle: int = 3, percent: int = 85, bands: int = BANDS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """id, n_shingles, component_id (smallest id reachable) and ``kept`` of each row."""
    found = _components(docs, shingle, percent, bands, id_col, text_col)
    kept = F.coalesce(F.col("component") == F.col("id"), F.lit(True))
    return found.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), kept.alias("kept")
    )


def drop_near_duplicates(
    docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = BANDS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row of each group of near-duplicates: the least id's, and of its texts the one of least hash.

    Unlike texts that share an id all stay, as do rows without an id; of rows that repeat
    id and text one stays.
    """
    found = _components(docs, shingle, percent, bands, id_col, text_col).where("id IS NOT NULL")
    # texts without words are alike by id alone
    kept = store(
        found.groupBy("component", "group").agg(F.min(F.struct("id", "mark")).alias("k")).select("k.id", "k.mark"), "kept"
    )
    rows = docs.select(
        F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("mark")
    )
    known = rows.join(kept, ["id", "mark"], "left_semi").dropDuplicates(["id", "mark"])
    return known.select("row.*").unionByName(docs.where(F.col(id_col).isNull()))
