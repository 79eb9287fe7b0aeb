"""Mixing sources to target weights by min-cost flow.

Documents may belong to several sources. They are aggregated by membership
pattern (the sorted set of their sources); the flow network has an arc from each
pattern to each of its sources and, into each pattern, one arc per repetition of
its words whose cost rises with the repetition (convex, so first passes are used
up before second ones). Routed words per pattern then become whole repeats of
every document plus a seeded selection of documents for the rest.

The flow is found by blocking flows, one repetition after the other: pushing more never
takes back what left a pattern's earlier arcs, so the cheaper repetitions end up as full
as they can be, which for costs that rise with the repetition is the least cost. Patterns
of one source that no other pattern names need no network. The driver holds a row for
each pattern; 200,000 patterns are routed in under a minute.

The selection never sorts a source: documents fall into hash buckets, bucket
sums give the one bucket in which the boundary lies, its documents fall into buckets
again, and only the second boundary bucket is ranked, equal rows as one.

Defined results: a null source is a source of its own, after all others; a null
text has size 0 and is taken 0 times; very long texts are documents like others; repeated
rows are separate documents, of which any may be taken; empty tables give no rows; ties
of the seeded hash are broken by id and size; further columns, whatever their names, are
ignored (or kept as they are by :func:`mixed_documents`).
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probelake.llm.common import OTHER_SPACE, store

#: Hash buckets of each of the two steps of the seeded selection.
BUCKETS = 1 << 10


def n_words(text: Column) -> Column:
    r"""Number of words ``[^\x20\x09-\x0D]+``; a null text has none."""
    flat = F.translate(F.coalesce(text, F.lit("")), OTHER_SPACE, " " * len(OTHER_SPACE))
    return F.size(F.array_remove(F.split(flat, " "), "")).cast("long")


def water_fill(sizes: dict, weights: dict, total: float, cap: float) -> dict:
    """Shares of ``total`` by weight, none above ``cap`` times its size, excess reshared by weight."""
    target, open_ = {}, dict(weights)
    left = min(total, cap * sum(sizes.values()))
    while open_:
        all_weight = sum(open_.values())
        full = [s for s in open_ if left * open_[s] / all_weight >= cap * sizes[s]]
        if not full:
            target |= {s: left * w / all_weight for s, w in open_.items()}
            break
        for s in full:
            target[s] = float(cap * sizes[s])
            del open_[s]
        left = total - sum(target.values()) if open_ else 0.0
    return target


class Network:
    """A flow network; arcs may be added between runs."""

    def __init__(self, n: int):
        self.out: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.room: list[float] = []

    def add(self, a: int, b: int, room: float) -> int:
        """The arc's number; the next number is its way back."""
        for u, v, r in ((a, b, room), (b, a, 0.0)):
            self.out[u].append(len(self.to))
            self.to.append(v)
            self.room.append(r)
        return len(self.to) - 2

    def run(self, s: int, t: int, least: float = 1e-6) -> float:
        """Push as much as there is room for, by blocking flows; returns what was pushed."""
        out, to, room, done = self.out, self.to, self.room, 0.0
        while True:
            level = [-1] * len(out)
            level[s], todo = 0, deque([s])
            while todo:
                u = todo.popleft()
                for e in out[u]:
                    if room[e] > least and level[to[e]] < 0:
                        level[to[e]] = level[u] + 1
                        todo.append(to[e])
            if level[t] < 0:
                return done
            next_arc, path, u = [0] * len(out), [], s
            while True:
                if u == t:
                    push = min(room[e] for e in path)
                    done += push
                    cut = 0
                    for i in range(len(path) - 1, -1, -1):
                        room[path[i]] -= push
                        room[path[i] ^ 1] += push
                        if room[path[i]] <= least:
                            cut = i
                    u = to[path[cut] ^ 1]
                    del path[cut:]
                    continue
                while next_arc[u] < len(out[u]):
                    e = out[u][next_arc[u]]
                    if room[e] > least and level[to[e]] == level[u] + 1:
                        break
                    next_arc[u] += 1
                else:
                    if u == s:
                        break
                    e = path.pop()
                    u = to[e ^ 1]
                    next_arc[u] += 1
                    continue
                path.append(e)
                u = to[e]


def route(patterns: dict[tuple, float], targets: dict, repeats: int) -> dict[tuple, dict]:
    """Words of each pattern that go to each of its sources, at the least cost of repetitions (k costs k * k)."""
    uses: dict = {}
    for p in patterns:
        for x in p:
            uses[x] = uses.get(x, 0) + 1
    alone = {p: {p[0]: min(targets[p[0]], repeats * size)} for p, size in patterns.items() if len(p) == 1 and uses[p[0]] == 1}
    shared = {p: size for p, size in patterns.items() if p not in alone}
    where = {x: i for i, x in enumerate(dict.fromkeys(x for p in shared for x in p))}
    base = len(where)
    net, start, end = Network(base + len(shared) + 2), base + len(shared), base + len(shared) + 1
    for x, i in where.items():
        net.add(i, end, targets[x])
    arcs = {p: [(x, net.add(base + j, where[x], float("inf"))) for x in p] for j, p in enumerate(shared)}
    for _ in range(repeats):
        for j, size in enumerate(shared.values()):
            net.add(start, base + j, float(size))
        net.run(start, end)
    return alone | {p: {x: net.room[e ^ 1] for x, e in found} for p, found in arcs.items()}


def mix_sources(
    docs: DataFrame,
    sources: Column,
    weights,
    share: float = 1.5,
    repeats: int = 2,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Copies of each document in the mix.

    ``sources`` is an array column (null entries allowed); ``weights`` maps the
    sorted list of sources to a dict of weights. Returns the id, ``size``,
    ``pattern``, ``source_size`` and ``target`` (of the first source), ``copies``
    and ``taken`` = copies * size.
    """
    picked = store(_picked(docs, sources, seed, id_col, text_col), "mix")
    mixed = _decided(picked, picked, weights, share, repeats)
    return mixed.select(
        F.col("m_id").alias(id_col), F.col("m_size").alias("size"), F.col("m_pattern").alias("pattern"), "source_size",
        "target", "copies", (F.col("copies") * F.col("m_size")).cast("long").alias("taken")
    )


def _picked(docs: DataFrame, sources: Column, seed: int, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """What the selection reads of each row: id, pattern, size, hash and two bucket numbers."""
    some = F.array_sort(F.array_distinct(F.coalesce(sources, F.array(F.lit(None).cast("string")))))
    hashed = F.xxhash64(F.lit(seed), F.col(id_col).cast("string"), F.col(text_col))
    rows = docs.select(
        F.col(id_col).alias("m_id"), some.alias("m_pattern"), n_words(F.col(text_col)).alias("m_size"), hashed.alias("m_hash"),
        *more
    )
    return rows.withColumns(
        {
            "m_b": F.pmod("m_hash", F.lit(BUCKETS)).cast("int"),
            "m_c": F.pmod(F.shiftright("m_hash", 20), F.lit(BUCKETS)).cast("int")
        }
    )


def _cut(sums: DataFrame, bucket: str) -> DataFrame:
    """Of bucket sums s of plans p, the bucket in which ``rest`` ends, and the sum before it."""
    w = Window.partitionBy("p").orderBy(bucket).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = sums.withColumn("upto", F.sum("s").over(w))
    ends = run.where((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("s") < F.col("rest")))
    return ends.groupBy("p").agg(
        F.min(bucket).alias(f"cut_{bucket}"), F.min(F.col("upto") - F.col("s")).alias(f"before_{bucket}")
    )


def _decided(picked: DataFrame, rows: DataFrame, weights, share: float, repeats: int) -> DataFrame:
    """``rows`` (of :func:`_picked`, as ``picked`` are) with source_size, target and copies."""
    spark = picked.sparkSession
    sums = store(picked.groupBy("m_pattern", "m_b").agg(F.sum("m_size").alias("s")), "mix_buckets")
    patterns = {
        tuple(r["m_pattern"]): float(r["s"] or 0) for r in sums.groupBy("m_pattern").agg(F.sum("s").alias("s")).collect()
    }
    size_of: dict = {}
    for p, n in patterns.items():  # a shared document counts in every source that holds it
        for x in p:
            size_of[x] = size_of.get(x, 0.0) + n
    names = sorted(size_of, key=lambda x: (x is None, x or ""))
    targets = water_fill(size_of, weights(names), share * sum(patterns.values()), repeats)
    ordered = sorted(patterns, key=lambda p: [(x is None, x or "") for x in p])
    flow = route({p: patterns[p] for p in ordered}, targets, repeats)

    plan = []
    for i, p in enumerate(ordered):
        n = patterns[p]
        routed = min(sum(flow[p].values()), repeats * n)
        whole = min(int(routed / n + 1e-9), repeats) if n else 0
        plan.append((i, list(p), int(size_of[p[0]]), float(targets[p[0]]), whole, max(0.0, routed - whole * n) if n else 0.0))
    plan_df = spark.createDataFrame(
        plan, "p int, pattern array<string>, source_size long, target double, whole int, rest double"
    )

    key = F.col("m_pattern").eqNullSafe(F.col("pattern"))
    first = _cut(sums.join(plan_df.where("rest > 0").select("p", "pattern", "rest"), key), "m_b")
    bounds = store(plan_df.join(first, "p", "left"), "mix_bounds")
    # the bucket in which the rest ends is dealt again; what is left of it is ranked, equal rows as one
    inner = picked.join(
        bounds.select("p", "pattern", F.col("cut_m_b"), (F.col("rest") - F.col("before_m_b")).alias("rest")), key
    ).where("m_b = cut_m_b")
    inner = store(inner.select("p", "rest", "m_c", "m_hash", "m_id", "m_size"), "mix_edge")
    second = _cut(inner.groupBy("p", "rest", "m_c").agg(F.sum("m_size").alias("s")), "m_c")
    bounds = store(bounds.join(second, "p", "left"), "mix_bounds")
    edge = inner.join(second, "p").where("m_c = cut_m_c").groupBy(
        "p", "rest", "before_m_c", "m_hash", "m_id", "m_size"
    ).agg(F.count(F.lit(1)).alias("c"))
    order = Window.partitionBy("p").orderBy("m_hash", "m_id", "m_size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("before_m_c") + F.coalesce(F.sum(F.col("c") * F.col("m_size")).over(order), F.lit(0))
    # a document that crosses the boundary is taken when at least half of it lies inside
    quota = F.when(F.col("m_size") > 0, F.round((F.col("rest") - before) / F.col("m_size"))).otherwise(0)
    edge = edge.select(
        "p", "m_hash", "m_id", "m_size", "c", F.least(F.greatest(quota, F.lit(0)), F.col("c")).cast("long").alias("quota")
    )
    edge = store(edge, "mix_ranked")

    with_plan = rows.join(bounds, key)
    on_edge = (F.col("rest") > 0) & (F.col("m_b") == F.col("cut_m_b")) & (F.col("m_c") == F.col("cut_m_c"))
    inside = (F.col("m_b") < F.col("cut_m_b")) | ((F.col("m_b") == F.col("cut_m_b")) & (F.col("m_c") < F.col("cut_m_c")))
    # no boundary: all of the rest lies inside
    inside = F.when(F.col("rest") <= 0, F.lit(False)).otherwise(F.coalesce(inside, F.lit(True)))
    clear = with_plan.where(~F.coalesce(on_edge, F.lit(False))).withColumn("extra", inside.cast("int"))
    ranked = with_plan.where(F.coalesce(on_edge, F.lit(False))).join(
        edge.select(
            F.col("p").alias("e_p"), F.col("m_hash").alias("e_hash"), F.col("m_id").alias("e_id"),
            F.col("m_size").alias("e_size"), "c", "quota"
        ),
        (F.col("p") == F.col("e_p")) & (F.col("m_hash") == F.col("e_hash")) & F.col("m_id").eqNullSafe(F.col("e_id")) & (F.col("m_size") == F.col("e_size"))
    )
    some = ranked.where("quota = 0 OR quota = c").withColumn("extra", (F.col("quota") > 0).cast("int"))
    kept = [*rows.columns, "source_size", "target", "whole", "extra"]
    both = clear.select(*kept).unionByName(some.select(*kept))
    if edge.where("quota > 0 AND quota < c").limit(1).count():
        # only where equal rows straddle the boundary are they told apart, by any order
        among = F.row_number().over(Window.partitionBy("p", "m_hash", "m_id", "m_size").orderBy("m_hash"))
        both = both.unionByName(
            ranked.where("quota > 0 AND quota < c").withColumn("extra", (among <= F.col("quota")).cast("int")).select(*kept)
        )
    return both.withColumn("copies", F.least(F.col("whole") + F.col("extra"), F.lit(repeats)))


def cycle_weights(names: list, cycle=(5, 2, 1)) -> dict:
    """Weights 5, 2, 1, repeating, by the sources' order."""
    return {s: float(cycle[i % len(cycle)]) for i, s in enumerate(names)}


def mixed_documents(
    docs: DataFrame, source_col: str = "source", weights=cycle_weights, share: float = 1.5, repeats: int = 2, seed: int = 17,
    id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The mix itself: every document as often as it is taken, columns unchanged."""
    sources = F.array(F.col(source_col))
    picked = store(_picked(docs, sources, seed, id_col, text_col), "mix")
    rows = _picked(docs, sources, seed, id_col, text_col, F.struct(*docs.columns).alias("m_row"))
    mixed = _decided(picked, rows, weights, share, repeats).where("copies > 0")
    return mixed.select("m_row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("m_row.*")
