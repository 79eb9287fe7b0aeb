"""Keyed operators: first and last rows, numbering, caps, alignment and set joins.

Order is always an explicit column (``path``, ``line_no`` or a key), never row order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probelake.functions import scores
from probelake.functions import text as T


def last_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key (a map filled in order); a partial aggregate, no sort."""
    return _one_per_key(df, keys, order, F.max_by)


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return _one_per_key(df, keys, order, F.min_by)


def _one_per_key(df: DataFrame, keys: list[str], order: list[str], pick) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*[F.col(c) for c in rest])
    return df.groupBy(*keys).agg(
        pick(row, F.struct(*[F.col(c) for c in order])).alias("row")
    ).select(*keys, "row.*").select(*df.columns)


def numbered(df: DataFrame, by: list[str], order: list[str | Column], name: str = "number") -> DataFrame:
    """Dense numbers from 0 inside each group."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)


def task_ids(tasks: DataFrame, order: list[str]) -> DataFrame:
    """``task_id`` = repository, underscore and the task's number in path order."""
    return numbered(tasks, ["reponame"], order, "number").withColumn(
        "task_id", F.concat_ws("_", "reponame", F.col("number").cast("string"))
    ).drop("number")


def capped(df: DataFrame, by: list[str], order: list[str | Column], n: int = 200) -> DataFrame:
    """The first ``n`` rows of each group."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("__rank", rank).where(F.col("__rank") <= n).drop("__rank")


def base_tasks(tasks: DataFrame, order: list[str], n: int = 200) -> DataFrame:
    """One task for each test path, the first one, at most ``n`` in a repository."""
    return capped(first_per_key(tasks, ["reponame", "testpath"], order), ["reponame"], [F.col(c) for c in order], n)


def named_tasks(tasks: DataFrame) -> DataFrame:
    """Tasks with a test name and a function name."""
    return tasks.where("testname IS NOT NULL AND testname <> '' AND funcname IS NOT NULL AND funcname <> ''")


def aligned(
    original: DataFrame, rewrite: DataFrame, order: list[str],
    keys: tuple[str, ...] = ("reponame", "testname", "classname", "funcname")
) -> tuple[DataFrame, DataFrame]:
    """The i-th rows of equal keys, kept on both sides; the rewrite takes task_id and testpath.

    Null keys match each other. Where a key has unequal counts the smaller one holds.
    """
    left, right = (numbered(named_tasks(df), list(keys), order, "__i") for df in (original, rewrite))
    slim = left.select(*keys, "__i", "task_id", "testpath")
    same = lambda a, b: _all([a[k].eqNullSafe(b[k]) for k in (*keys, "__i")])
    r = right.alias("r")
    l_ = slim.alias("l")
    on = _all([F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in (*keys, "__i")])
    taken = [F.col(f"l.{c}") if c in ("task_id", "testpath") else F.col(f"r.{c}") for c in rewrite.columns]
    kept = left.join(right.select(*keys, "__i"), same(left, right), "left_semi")
    return kept.drop("__i"), r.join(l_, on).select(*taken)


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def align_order() -> list[Column]:
    """Display order of aligned keys; a missing class sorts as its Python text."""
    return [F.col("testname"), F.coalesce("classname", F.lit("None")), F.col("funcname")]


def align_totals(original: DataFrame, rewrite: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows before and after alignment, per repository and overall (null)."""
    tagged = [
        df.select("reponame", F.lit(name).alias("stage")) for name,
        df in (("original", original), ("rewrite", rewrite), ("aligned", kept))
    ]
    both = tagged[0].unionByName(tagged[1]).unionByName(tagged[2])
    return both.rollup("reponame").agg(*[F.count_if(F.col("stage") == s).alias(s) for s in ("original", "rewrite", "aligned")])


def remaining(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work whose key is not done yet."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def members(df: DataFrame, allowed: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is in ``allowed``."""
    return df.join(allowed.select(*keys).distinct(), keys, "left_semi")


def kept_and_discarded(df: DataFrame, allowed: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Rows kept and discarded by a membership filter, and the kept percent, per group."""
    flag = allowed.select(*keys).distinct().withColumn("__in", F.lit(True))
    counted = df.join(flag, keys, "left").groupBy(*by).agg(
        F.count_if(F.coalesce("__in", F.lit(False))).alias("kept"), F.count_if(F.col("__in").isNull()).alias("discarded")
    )
    return counted.withColumn("kept_percent", T.percent(F.col("kept"), F.col("kept") + F.col("discarded")))


def common_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys on both sides, null-safe."""
    return a.select(*keys).intersect(b.select(*keys))


def missing_names(requested: DataFrame, found: DataFrame, key: str = "reponame") -> DataFrame:
    return requested.select(key).subtract(found.select(key))


def with_samples(tasks: DataFrame, n: int = 5) -> DataFrame:
    """Every task ``n`` times, numbered by sample_id."""
    return tasks.withColumn("sample_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def tagged_union(frames: dict[str, DataFrame], tag: str = "condition") -> DataFrame:
    out = None
    for name, df in frames.items():
        part = df.withColumn(tag, F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def merged_truths(truths: Column, more: Column) -> Column:
    """Sorted distinct texts of two arrays; nulls count as empty."""
    none = F.array().cast("array<string>")
    return F.array_sort(F.array_union(F.coalesce(truths, none), F.coalesce(more, none)))


def min_hop_rollup(dependencies: DataFrame, by: list[str]) -> DataFrame:
    """Least hops for each (group, file), as a list sorted by hops and file."""
    least = dependencies.groupBy(*by, "file").agg(F.min("hops").alias("hops"))
    items = F.array_sort(F.collect_list(F.struct("hops", "file")))
    return least.groupBy(*by).agg(
        F.transform(items, lambda x: F.struct(x["file"].alias("file"), x["hops"].alias("hops"))).alias("dependencies")
    )


def files_by_hops(dependencies: Column) -> Column:
    """Files in hop order, missing hops last, ties as given."""
    keyed = F.transform(
        dependencies,
        lambda d, i: F.struct(F.coalesce(d["hops"], F.lit(2**31 - 1)).alias("h"), i.alias("i"), d["file"].alias("file"))
    )
    return F.transform(F.array_sort(keyed), lambda x: x["file"])


def function_difficulty(reports: DataFrame, keep: str = "last", order: list[str] | None = None) -> DataFrame:
    """(reponame, funcname, difficulty) of a function report; of equal names the last or first row stands."""
    name = T.bare_name(F.col("test_function")) if keep == "last" else T.bare_name_before_bracket(F.col("test_function"))
    named = reports.withColumn("funcname", name).withColumn("difficulty", scores.difficulty(F.col("dependencies")))
    one = last_per_key if keep == "last" else first_per_key
    order = order or ["line_no"]
    return one(
        named.select("reponame", "funcname", "difficulty", *order), ["reponame", "funcname"], order
    ).select("reponame", "funcname", "difficulty")


def with_difficulty(tasks: DataFrame, difficulty: DataFrame) -> DataFrame:
    """Tasks with their difficulty, ``unknown`` without a report."""
    return tasks.join(difficulty, ["reponame", "funcname"], "left").withColumn(
        "difficulty", F.coalesce("difficulty", F.lit("unknown"))
    )
