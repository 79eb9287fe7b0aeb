"""Queries over the driver's tables on inputs of their own."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from probelake.operators import prompts, retrieval
from probelake.plans import stand_ins


def shuffled_bytes(spark) -> int:
    return spark.sparkContext._jsc.sc().statusStore().executorList(False).head().totalShuffleWrite()


def test_negative_counts(spark):
    """The counts are those of the pairs, with repeats, unknown files, nulls and tests without a negative file."""
    tests = spark.createDataFrame(
        [("r", "a"), ("r", "a"), ("r", "b"), ("r", "c"), ("r", None), ("s", "a"), ("t", "a"), (None, "a")],
        "reponame string, test_file string"
    )
    reports = spark.createDataFrame(
        [
            ("r", "a", [("x", 1), ("x", 2), ("other", 1), (None, 1)]), ("r", "a", [("y", 1), ("x", 1)]), ("r", "b", []),
            ("r", "c", [("x", 1), ("y", 1), ("z", 1), ("c", 1)]), ("r", None, [("x", 1)]), ("s", "a", [("x", 1)]),
            ("r", "unasked", [("x", 1)]), ("r", "b", None)
        ],
        "reponame string, test_file string, dependencies array<struct<file:string, hops:int>>"
    )
    pool = [("r", "x"), ("r", "x"), ("r", "y"), ("r", "z"), ("r", "c"), ("s", "x"), ("s", None), ("u", "x"), (None, "x")]
    pool = spark.createDataFrame(pool, "reponame string, path string")
    _, pairs = prompts.candidate_files(tests, reports, pool)
    key = lambda r: (r.reponame, r.test_file or "", r.negative)
    wanted = sorted(map(key, pairs.groupBy("reponame", "test_file").agg(F.count(F.lit(1)).alias("negative")).collect()))
    assert wanted == [("r", "", 4), ("r", "a", 2), ("r", "b", 4), ("s", "a", 1)]
    assert sorted(map(key, prompts.negative_counts(tests, reports, pool).collect())) == wanted


def test_negative_pool_shuffles_no_pairs(spark, tmp_path):
    """400 suppliers of 25 nations and 40,000 parts: 640,000 pairs that are counted, not shuffled."""
    suppliers, parts = 400, 40000
    spark.range(suppliers).select(
        F.col("id").alias("s_suppkey"), (F.col("id") % 25).cast("int").alias("s_nationkey")
    ).write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(parts).select(F.col("id").alias("p_partkey")).write.parquet(f"{tmp_path}/part.parquet")
    # each supplier: one part of its own nation, twice, and one of another
    items = F.explode(F.array(F.col("id"), F.col("id"), F.col("id") + 1)).alias("l_partkey")
    spark.range(suppliers).select(F.col("id").alias("l_suppkey"), items).write.parquet(f"{tmp_path}/lineitem.parquet")
    before = shuffled_bytes(spark)
    got = stand_ins.negative_pool(spark, str(tmp_path)).collect()
    assert len(got) == suppliers and {r.negative for r in got} == {parts // 25 - 1}
    # the files of the pool take under a megabyte, the pairs took 8.8 MB
    assert shuffled_bytes(spark) - before < 4 * suppliers * parts / 25


def test_bm25_scores_do_not_depend_on_row_order(spark):
    """Scores are the same to the last bit however rows are dealt, equal for copies, and those of exact sums."""
    rng = random.Random(7)
    docs = {f"d{i:02d}": ["the", *(f"w{int(rng.paretovariate(0.4))}" for _ in range(800))] for i in range(40)}
    docs["copy"] = docs["d00"]
    query = ["the", *docs["d00"][1:300], *docs["d07"][1:60]]
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    frequency = Counter(t for tokens in docs.values() for t in set(tokens))
    idf = {t: math.log(n - f + 0.5) - math.log(f + 0.5) for t, f in frequency.items()}
    mean = math.fsum(idf.values()) / len(idf)
    idf = {t: w if w >= 0 else 0.25 * mean for t, w in idf.items()}
    asked = Counter(query)

    def exact(tokens):
        tf = Counter(tokens)
        return math.fsum(q * idf[t] * 2.5 * tf[t] / (tf[t] + 1.5 * (0.25 + 0.75 * len(tokens) / avg)) for t, q in asked.items())

    c = spark.createDataFrame([("r", p, t) for p, t in docs.items()], "reponame string, path string, tokens array<string>")
    q = spark.createDataFrame([("r", "q", query)], "reponame string, query string, tokens array<string>")
    runs, usual = [], spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in (1, 3, 7):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            runs.append({r.path: r.score for r in retrieval.bm25_ranks(c.repartition(parts), q).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", usual)
    assert runs[0] == runs[1] == runs[2] and runs[0]["copy"] == runs[0]["d00"]
    assert all(math.isclose(runs[0][p], exact(t), rel_tol=2e-15) for p, t in docs.items())
