"""Near-duplicate vectors by an exact metric range join.

On unit vectors a cosine of at least c means a distance of at most
``sqrt(2 - 2c)``. Vectors with equal labels go to the cell of their nearest pivot;
by the triangle inequality a vector can only have a partner in the cell of pivot q,
its own being p, if it lies within the radius of the plane halfway between them,
``(d(x,q)^2 - d(x,p)^2) / (2 d(p,q)) <= radius``, so it is copied to those cells
and cells are joined independently. Pivots have two levels: a vector, or a copy of one,
is dealt to the groups of pivots that the bound allows, and inside each to its cells, so
the distances held at once are a block of rows by one group's pivots.

Every label of two vectors or more has pivots, chosen farthest first from a sample of
the label: one for each ``CELL`` vectors and two at least, but fewer where the bound
would copy the sample's vectors to over ``COPIES`` cells each, as it does for unrelated
vectors of many dimensions. They are chosen and used in tasks of one label's slice;
neither pivots nor samples reach the driver. Cells of any size are cut into blocks of core rows and member rows; a task returns counts and a
spanning set of links, never all pairs. Equal vectors are one class and count with their
multiplicity.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components, and those with a null label or id, have no links and are their own
component; vectors of different lengths never link; repeated rows and repeated ids are
separate vectors that link by their values, and a component's name is the smallest id in
it; a vector as near to two pivots belongs to the first; very long vectors are handled
whole; further columns, whatever their names, are ignored; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probelake.llm.common import connected_components, dealt_blocks, store

#: Vectors of one cell aimed at, rows of one block or slice, and pivots of one group.
CELL = 1024
BLOCK = 2048
GROUP = 128
#: Pivots of one label at most; cells beyond grow and are joined in blocks all the same.
MOST_PIVOTS = GROUP * GROUP
#: Copies of a vector, on average over the sample, beyond which fewer pivots are used.
COPIES = 8.0
#: Distances held at once.
_HELD = 2_000_000


def _vectors(table: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """id, label, the vector's float64 bytes (null if it links with nothing) and a digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            raw, digest = [], []
            for v, label in zip(batch.column(2), batch.column(1), strict=True):
                b = None
                if v.is_valid and label.is_valid and len(v.values) and not v.values.null_count:
                    x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                    if np.isfinite(x).all() and 0 < float(x @ x) < np.inf:
                        b = x.tobytes()
                raw.append(b)
                digest.append(xxhash.xxh3_128_digest(b) if b else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(raw, pa.binary()), pa.array(digest, pa.binary())],
                names=["id", "label", "vec", "digest"]
            )

    picked = table.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).alias("vec")
    )
    return picked.mapInArrow(run, "id long, label string, vec binary, digest binary")


def _unit(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of unit vectors."""
    return np.maximum(2.0 - 2.0 * x @ y.T, 0.0)


def choose_pivots(sample: np.ndarray, n: int, apart: float) -> np.ndarray:
    """Places of up to ``n`` rows of the sample, each next one farthest from those chosen."""
    chosen = [0]
    far = ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < n:
        i = int(np.argmax(far))
        if far[i] <= apart**2:
            break
        chosen.append(i)
        far = np.minimum(far, ((sample - sample[i]) ** 2).sum(1))
    return np.array(chosen)


def pivot_groups(sample: np.ndarray, n: int, apart: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """Pivots of two levels: group centres, and the pivots of each group (one group for few pivots)."""
    if n <= GROUP:
        return sample[:1], [sample[choose_pivots(sample, n, apart)]]
    groups = int(np.ceil(np.sqrt(n)))
    centres = sample[choose_pivots(sample, groups, apart)]
    own = np.concatenate([np.argmin(_squared(sample[i : i + BLOCK], centres), 1) for i in range(0, len(sample), BLOCK)])
    each = -(-n // len(centres))
    return centres, [sample[own == g][choose_pivots(sample[own == g], each, apart)] for g in range(len(centres))]


def _near(x: np.ndarray, pivots: np.ndarray, radius: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, cells they must be copied to, whether the cell is their own), in bounded blocks."""
    step = max(1, _HELD // len(pivots))
    for at in range(0, len(x), step):
        d2 = _squared(x[at : at + step], pivots)
        own = np.argmin(d2, 1)
        bound = 2.0 * np.sqrt(_squared(pivots[own], pivots)) * (radius + 1e-9) + 1e-9
        near = d2 - d2[np.arange(len(own)), own][:, None] <= bound
        near[np.arange(len(own)), own] = True
        rows, cells = np.nonzero(near)
        yield rows + at, cells, own[rows] == cells


def assign_cells(
    x: np.ndarray, centres: np.ndarray, groups: list[np.ndarray], radius: float
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, cell and whether it is the row's own cell, for every copy that the bounds ask for."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    first = np.cumsum([0, *map(len, groups)])
    parts = [np.concatenate(p) for p in zip(*_near(x, centres, radius), strict=True)]
    for g, pivots in enumerate(groups):
        here = np.flatnonzero(parts[1] == g)
        rows, core = parts[0][here], parts[2][here]
        for inner, cells, own in _near(x[rows], pivots, radius):
            found.append((rows[inner], first[g] + cells, core[inner] & own))
    return tuple(np.concatenate(p) for p in zip(*found, strict=True))


def fitted_pivots(sample: np.ndarray, n: int, radius: float, copies: float = COPIES) -> tuple[np.ndarray, list[np.ndarray]]:
    """The most pivots, from ``n`` downwards by halves, that copy a vector to ``copies`` cells on average or fewer."""
    while True:
        centres, groups = pivot_groups(sample, n, 4 * radius)
        some = sample[:: max(1, len(sample) // 1000)]
        if n <= 2 or len(assign_cells(some, centres, groups, radius)[0]) <= copies * len(some):
            return centres, groups
        n = max(2, n // 2)


def _assign(reps: DataFrame, radius: float, seed: int) -> DataFrame:
    """Copies of each vector: cell, core, node, weight, vec."""
    key = ["label", "bytes"]
    sizes = reps.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    wanted = F.least(F.greatest(F.ceil(F.col("n") / CELL), F.lit(2)), F.lit(MOST_PIVOTS)).cast("int")
    sizes = store(
        sizes.select(*key, "n", wanted.alias("wanted"), F.ceil(F.col("n") / BLOCK).cast("int").alias("slices")), "vector_labels"
    )
    chance = F.xxhash64("node", F.lit(seed)) / F.lit(2.0**64) + 0.5
    # three sampled vectors for each pivot wanted, and some more for small labels
    sampled = reps.join(sizes, key).where(chance * F.col("n") < 3 * F.col("wanted") + 60)

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        centres, groups = fitted_pivots(_unit(pdf["vec"].tolist()), int(pdf["wanted"].iloc[0]), radius)
        row = {
            "label": pdf["label"].iloc[0], "bytes": pdf["bytes"].iloc[0], "slices": pdf["slices"].iloc[0],
            "centres": centres.tobytes()
        }
        return pd.DataFrame([row | {"groups": [g.tobytes() for g in groups]}])

    chosen = sampled.select(*key, "node", "vec", "wanted", "slices").groupBy(*key)
    chosen = store(
        chosen.applyInPandas(choose, "label string, bytes int, slices int, centres binary, groups array<binary>"), "pivots"
    )
    # each slice of a label meets its pivots in one task
    cut = chosen.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    dealt = reps.join(chosen.select(*key, "slices"), key).withColumn(
        "slice", F.pmod(F.xxhash64("node", F.lit(9)), F.col("slices")).cast("int")
    )

    def place(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = ["cell", "core", "node", "weight", "vec"]
        if not len(left) or not len(right):
            return pd.DataFrame({c: [] for c in names})
        width = int(right["bytes"].iloc[0]) // 8
        of = lambda b: np.frombuffer(b, np.float64).reshape(-1, width)
        rows, cells, core = assign_cells(
            _unit(left["vec"].tolist()), of(right["centres"].iloc[0]), [of(b) for b in right["groups"].iloc[0]], radius
        )
        name = f"{right['label'].iloc[0]}|{width}|"
        out = left.iloc[rows][["node", "weight", "vec"]].reset_index(drop=True)
        return out.assign(cell=[f"{name}{c}" for c in cells], core=core)[names]

    by = [*key, "slice"]
    return dealt.select(*by, "node", "weight", "vec").groupBy(*by).cogroup(cut.groupBy(*by)).applyInPandas(
        place, "cell string, core boolean, node long, weight long, vec binary"
    )


def _block_join(least: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        core = pdf["query"].to_numpy(bool)
        nodes, weight = pdf["node"].to_numpy(), pdf["weight"].to_numpy()
        a, b = np.flatnonzero(core), np.flatnonzero(~core)
        if not len(a) or not len(b):
            return pd.DataFrame({"node": [], "links": [], "root": []}, dtype="int64")
        x = _unit(pdf["vec"].tolist())
        near = (x[a] @ x[b].T >= least) & (nodes[a][:, None] != nodes[b][None, :])
        links = near @ weight[b]
        out = [(int(nodes[i]), int(n), int(nodes[i])) for i, n in zip(a, links, strict=True) if n]
        seen = np.zeros(len(a), bool)
        for i in np.flatnonzero(links):
            if seen[i]:
                continue
            rows, cols = np.zeros(len(a), bool), near[i].copy()
            rows[i] = True
            while True:  # all that is reached inside this block
                more = near[:, cols].any(1) | rows
                if (more == rows).all():
                    break
                rows, cols = more, near[more].any(0)
            seen |= rows
            root = int(min(nodes[a][rows].min(), nodes[b][cols].min()))
            out += [(int(v), 0, root) for v in np.unique(np.r_[nodes[a][rows], nodes[b][cols]]) if v != root]
        return pd.DataFrame(out, columns=["node", "links", "root"], dtype="int64")

    return run


def vector_duplicates(
    table: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
    seed: int = 5
) -> DataFrame:
    """id, n_links, component_id (smallest id reachable) and ``kept`` of each row."""
    radius = float(np.sqrt(2.0 - 2.0 * cosine))
    vectors = store(_vectors(table, id_col, vec_col, label_col), "vectors")
    usable = vectors.where("vec IS NOT NULL AND id IS NOT NULL")
    # equal vectors of a label are one class; a class is known by its own number, as ids may repeat
    classes = usable.groupBy("label", "digest").agg(
        F.min("id").alias("rep"), F.count(F.lit(1)).alias("weight"), F.first("vec").alias("vec")
    )
    classes = store(classes.withColumn("node", F.monotonically_increasing_id()), "vector_classes")

    cells = store(
        _assign(classes.select("label", "node", "weight", "vec", F.length("vec").alias("bytes")), radius, seed), "cells"
    )
    count = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("c"), F.count_if("core").alias("k"))
    count = count.select(
        "cell", F.ceil(F.col("k") / BLOCK).cast("int").alias("q_blocks"),
        F.ceil(F.col("c") / BLOCK).cast("int").alias("t_blocks")
    ).where("q_blocks > 0")
    rows, place = cells.join(count, "cell"), F.xxhash64("node", F.lit(3))
    base = ["cell", "node", "weight", "vec"]
    targets = rows.select(
        *base, F.lit(False).alias("query"), F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1)).alias("i"),
        F.pmod(place, F.col("t_blocks")).cast("int").alias("j")
    )
    asks = rows.where("core").select(
        *base, F.lit(True).alias("query"), F.pmod(place, F.col("q_blocks")).cast("int").alias("i"),
        F.explode(F.sequence(F.lit(0), F.col("t_blocks") - 1)).alias("j")
    )
    found = store(
        dealt_blocks(targets.unionByName(asks), ["cell", "i", "j"]).applyInPandas(
            _block_join(cosine), "node long, links long, root long"
        ),
        "vector_links"
    )

    counted = found.groupBy("node").agg(F.sum("links").alias("links"))
    comps = connected_components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    linked = classes.select("node", "rep").join(comps, "node")
    least = linked.groupBy("component").agg(F.min("rep").alias("least"))
    linked = linked.join(least, "component").select("node", "least").join(counted, "node", "left")
    of_class = classes.select("label", "digest", "node", "rep", "weight").join(linked, "node", "left")
    of_class = of_class.select(
        "label", "digest", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        F.coalesce("least", "rep").alias("component")
    )
    known = usable.join(of_class, ["label", "digest"]).select("id", "n_links", "component")
    # rows that link with nothing are kept out of the join: they would all meet in one task
    rest = vectors.where("vec IS NULL OR id IS NULL").select(
        "id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component")
    )
    return known.unionByName(rest).select(
        F.col("id").alias(id_col), F.col("n_links").cast("long").alias("n_links"), F.col("component").alias("component_id"),
        F.coalesce(F.col("component") == F.col("id"), F.lit(True)).alias("kept")
    )
