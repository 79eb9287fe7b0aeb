"""Dataset reports: quality, types, stages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probelake.functions import text as T
from probelake.operators.keys import merged_truths
from probelake.functions.python_values import truths_of_runtime


def quality_by_repo(tasks: DataFrame) -> DataFrame:
    """total, quality, filtered and quality percent, per repository and overall (null); tasks without analysis count as quality."""
    good = F.coalesce(F.col("quality_analysis.is_quality"), F.col("quality_analysis").isNull())
    out = tasks.rollup("reponame").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(good).alias("quality"), F.count_if(~good).alias("filtered")
    )
    return out.withColumn("quality_percent", T.percent(F.col("quality"), F.col("total")))


def score_histogram(tasks: DataFrame) -> DataFrame:
    analysed = tasks.where("quality_analysis IS NOT NULL")
    return analysed.groupBy(
        F.coalesce("quality_analysis.complexity_score", F.lit(0)).alias("complexity_score")
    ).agg(F.count(F.lit(1)).alias("n")).orderBy("complexity_score")


def reason_histogram(tasks: DataFrame) -> DataFrame:
    """Reasons of filtered tasks, most common first."""
    dropped = tasks.where("quality_analysis IS NOT NULL AND NOT coalesce(quality_analysis.is_quality, false)")
    return dropped.groupBy(
        F.coalesce("quality_analysis.reason", F.lit("Unknown")).alias("reason")
    ).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "reason")


def quality_report(tasks: DataFrame) -> dict:
    """The whole report as one object; every part is already aggregated."""
    rows = quality_by_repo(tasks).collect()
    total = next(r for r in rows if r["reponame"] is None)
    return {
        "total_assertions": total["total"],
        "quality_assertions": total["quality"],
        "filtered_assertions": total["filtered"],
        "complexity_distribution": {str(r["complexity_score"]): r["n"] for r in score_histogram(tasks).collect()},
        "filter_reasons": {r["reason"]: r["n"] for r in reason_histogram(tasks).collect()},
        "repo_stats": {
            r["reponame"]: {
                "total": r["total"], "quality": r["quality"], "filtered": r["filtered"], "quality_percent": r["quality_percent"]
            } for r in rows if r["reponame"] is not None
        },
    }


def type_histogram(truths: DataFrame) -> DataFrame:
    """Count and percent of recorded value types, most common first."""
    typed = truths.select(F.col("runtime_ground_truth.type").alias("type")).where("type IS NOT NULL")
    counted = typed.groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    total = counted.agg(F.sum("n").alias("total"))
    return counted.join(F.broadcast(total)).select(
        "type", "n", T.percent(F.col("n"), F.col("total")).alias("percent")
    ).orderBy(F.desc("n"), "type")


def difficulty_counts(tasks: DataFrame) -> DataFrame:
    """Distinct functions of each difficulty, per repository."""
    return tasks.groupBy("reponame", "difficulty").agg(F.countDistinct("testpath", "funcname").alias("functions"))


def augment_truths(tasks: DataFrame, runtime: DataFrame, order: list[str]) -> DataFrame:
    """``ground_truth`` as the sorted distinct texts of the task and its recorded runtime value; the last record stands."""
    from probelake.operators.keys import last_per_key

    flat = runtime.select(
        "condition", "task_id", *order,
        *[F.col(f"runtime_ground_truth.{c}").alias(f"__{c}") for c in ("status", "value", "type")]
    )
    last = last_per_key(flat, ["condition", "task_id"], order).drop(*order)
    joined = tasks.join(last, ["condition", "task_id"], "left")
    more = truths_of_runtime(F.col("__status"), F.col("__value"), F.col("__type"), F.col("ground_truth"))
    return joined.withColumn("ground_truth", merged_truths(F.array("ground_truth"), more)).select(*tasks.columns)
