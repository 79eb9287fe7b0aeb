"""Retrieval: BM25 ranks and the selection modes built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probelake.functions import text as T
from probelake.operators.keys import files_by_hops


def bm25_ranks(
    corpus: DataFrame, queries: DataFrame, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25, limit: int | None = None
) -> DataFrame:
    """Scores and ranks of every document of a query's repository.

    ``corpus``: reponame, path, tokens. ``queries``: reponame, query, tokens.
    Term weights: ln(N - df + .5) - ln(df + .5), negative ones replaced by epsilon times
    the mean over all terms; query terms count with their repeats. Documents without a
    common term score 0 and still rank. Ties go by path. Sums don't depend on the order of rows:
    equal documents score equally, and so does every run.
    """
    lengths = corpus.groupBy("reponame", "path").agg(F.sum(F.size("tokens")).alias("dl"))
    per_repo = lengths.groupBy("reponame").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    tf = corpus.select(
        "reponame", "path", F.explode("tokens").alias("term")
    ).groupBy("reponame", "path", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("reponame", "term").agg(F.count(F.lit(1)).alias("df"))
    weigh = F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    raw = df.join(per_repo, "reponame").withColumn("idf", weigh)
    # terms of one frequency weigh the same: the mean adds a product for each frequency, not millions of weights
    alike = df.groupBy("reponame", "df").agg(F.count(F.lit(1)).alias("terms")).join(per_repo, "reponame")
    mean = alike.groupBy("reponame").agg((_same_sum(F.col("terms") * weigh) / F.sum("terms")).alias("mean_idf"))
    idf = raw.join(mean, "reponame").select(
        "reponame", "term", F.when(F.col("idf") < 0, epsilon * F.col("mean_idf")).otherwise(F.col("idf")).alias("idf")
    )
    asked = queries.select(
        "reponame", "query", F.explode("tokens").alias("term")
    ).groupBy("reponame", "query", "term").agg(F.count(F.lit(1)).alias("qtf"))
    # the queries' terms are few: they get their weights, documents their lengths, before the two meet
    weighted = asked.join(idf, ["reponame", "term"]).select(
        "reponame", "query", "term", (F.col("qtf") * F.col("idf") * (k1 + 1)).alias("weight")
    )
    wanted = tf.join(asked.select("reponame", "term").distinct(), ["reponame", "term"], "left_semi")
    norm = lengths.join(per_repo, "reponame").select(
        "reponame", "path", (k1 * (1 - b + b * F.col("dl") / F.col("avgdl"))).alias("norm")
    )
    sized = wanted.join(norm, ["reponame", "path"]).select(
        "reponame", "path", "term", (F.col("tf") / (F.col("tf") + F.col("norm"))).alias("share")
    )
    hits = sized.join(weighted, ["reponame", "term"])
    scored = hits.groupBy("reponame", "query", "path").agg(
        _same_sum(F.col("weight") * F.col("share")).alias("score")
    )
    asks = queries.select("reponame", "query").distinct()
    best = Window.partitionBy("reponame", "query").orderBy(F.desc(F.round("score", 9)), "path")
    if limit is None:
        full = asks.join(lengths.select("reponame", "path"), "reponame").join(scored, ["reponame", "query", "path"], "left")
        return full.withColumn("score", F.coalesce("score", F.lit(0.0))).withColumn("rank", F.row_number().over(best))
    return _limited(asks, scored, lengths, best, limit)


def _same_sum(value: Column) -> Column:
    """A sum of doubles that is the same in any order: multiples of 2^-20 and of 2^-60 add up without rounding.

    That holds for sums below 2^33 of up to 2^14 values; beyond, the last bits may vary as in any sum.
    """
    high = F.rint(value * 2.0**20) / 2.0**20
    low = F.rint((value - high) * 2.0**60) / 2.0**60
    return F.sum(high) + F.sum(low)


def _limited(asks: DataFrame, scored: DataFrame, lengths: DataFrame, best, limit: int) -> DataFrame:
    """The first ``limit`` ranks: scored documents, and by path so many others as can come among them."""
    top = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit).drop("rank")
    # a path among the first `limit` + (scored documents) of a repository is the most that can be needed
    counted = asks.join(
        scored.groupBy("reponame", "query").agg(
            F.count(F.lit(1)).alias("hits"), F.count_if(F.round("score", 9) > 0).alias("above")
        ),
        ["reponame", "query"], "left"
    )
    needy = counted.where(F.coalesce("above", F.lit(0)) < limit).select(
        "reponame", "query", F.coalesce("hits", F.lit(0)).alias("hits")
    )
    by_path = Window.partitionBy("reponame").orderBy("path")
    placed = lengths.select("reponame", "path", F.row_number().over(by_path).alias("place"))
    near = needy.join(placed, "reponame").where(F.col("place") <= F.col("hits") + limit).select("reponame", "query", "path")
    zero = near.join(scored, ["reponame", "query", "path"], "left_anti").withColumn("score", F.lit(0.0))
    both = top.unionByName(zero.select(*top.columns))
    return both.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)


def rank_lists(ranks: DataFrame) -> DataFrame:
    """One row for each query with its paths in rank order."""
    items = F.array_sort(F.collect_list(F.struct("rank", "path")))
    return ranks.groupBy("reponame", "query").agg(F.transform(items, lambda x: x["path"]).alias("related_files_rank"))


def seeded_order(seed: int, *keys: str):
    """A shuffle as a column: a digest of seed and keys, the same in every run and in any SQL."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def seeded_sample(df: DataFrame, by: list[str], keys: list[str], n: int, seed: int = 42) -> DataFrame:
    """``n`` rows of each group without replacement, in seeded order."""
    w = Window.partitionBy(*by).orderBy(seeded_order(seed, *keys), *keys)
    return df.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= n).drop("__rank")


def selection(
    tasks: DataFrame, ranks: DataFrame, reports: DataFrame, modes: tuple[str, ...] = ("retrieval", "confusion", "oracle"),
    top: int = 20, seed: int = 42
) -> DataFrame:
    """Files for each task and mode: (task columns), mode, position, path.

    ``retrieval``: the top ranks, shuffled. ``confusion``: a sample beyond them.
    ``oracle``: the function report's files by hops. ``ranks`` has task_id, path and
    rank; ``reports`` has reponame, funcname (normalized) and dependencies.
    """
    tasks = tasks.select("task_id", "reponame", "funcname")
    ranked = tasks.join(ranks.select("task_id", "path", "rank"), "task_id")
    shuffled = Window.partitionBy("task_id").orderBy(seeded_order(seed, "task_id", "path"), "path")
    parts = {
        "retrieval": ranked.where(F.col("rank") <= top).withColumn("position", F.row_number().over(shuffled)),
        "confusion": ranked.where(F.col("rank") > top).withColumn(
            "position", F.row_number().over(shuffled)
        ).where(F.col("position") <= top),
        "oracle": tasks.withColumn("__name", T.bare_name(F.col("funcname")))
        .join(reports.select("reponame", F.col("funcname").alias("__name"), "dependencies"), ["reponame", "__name"])
        .select("task_id", "reponame", "funcname", F.posexplode(F.slice(files_by_hops(F.col("dependencies")), 1, top)).alias("position", "path"))
        .withColumn("position", F.col("position") + 1),
    }
    out = None
    for mode in modes:
        part = parts[mode].select("task_id", "reponame", "funcname", F.lit(mode).alias("mode"), "position", "path")
        out = part if out is None else out.unionByName(part)
    return out
