"""Evaluation of recorded predictions: call chains, outputs and executions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probelake.functions import python_values, scores
from probelake.functions import text as T
from probelake.operators.keys import with_difficulty

METRICS = ("precision", "recall", "f1", "exact_match")


def chain_truths(reports: DataFrame) -> DataFrame:
    """Truth files of each test file, itself excluded: reponame, test_file, truth_files."""
    files = F.transform(F.coalesce("dependencies", F.array().cast("array<struct<file:string, hops:int>>")), lambda d: d["file"])
    own = F.filter(files, lambda f: f != F.col("test_file"))
    return reports.select(
        "reponame", "test_file", F.explode_outer(own).alias("f")
    ).groupBy("reponame", "test_file").agg(F.array_sort(F.collect_set("f")).alias("truth_files"))


def evaluate_chains(predictions: DataFrame, reports: DataFrame) -> DataFrame:
    """Set metrics of every prediction that has a truth."""
    predicted = F.array_sort(F.array_distinct(python_values.file_list(F.col("response"))))
    joined = predictions.where("test_file IS NOT NULL AND test_file <> ''").withColumn("predicted_files", predicted).join(
        chain_truths(reports), ["reponame", "test_file"]
    )
    scored = joined.withColumn("m", scores.set_metrics(F.col("predicted_files"), F.col("truth_files")))
    return scored.select(
        "reponame", "ratio", "task_id", "test_file", "sample_id", F.size("truth_files").alias("num_truth_files"),
        F.size("predicted_files").alias("num_pred_files"), *[F.col(f"m.{m}").alias(m) for m in METRICS], "truth_files",
        "predicted_files"
    )


def chain_summary(evaluated: DataFrame) -> DataFrame:
    """Mean metrics of tasks, per ratio and per (ratio, repository); overall rows have a null repository."""
    per_task = evaluated.groupBy("ratio", "reponame", "test_file").agg(*[F.avg(m).alias(m) for m in METRICS])
    sets = per_task.groupingSets([["ratio"], ["ratio", "reponame"]], "ratio", "reponame")
    return sets.agg(*[F.avg(m).alias(m) for m in METRICS], F.count(F.lit(1)).alias("num_tasks"))


def pass_map(n: Column, c: Column, ks: tuple[int, ...] = scores.K_VALUES) -> Column:
    """pass@k for each k, keyed by text as JSON has it."""
    return F.map_from_arrays(F.array(*[F.lit(str(k)) for k in ks]), F.array(*[scores.pass_at_k(n, c, k) for k in ks]))


def require_truths(predictions: DataFrame, truths: DataFrame) -> None:
    """Raise if a predicted task has no truth."""
    n = predictions.select("condition", "task_id").distinct().join(truths, ["condition", "task_id"], "left_anti").count()
    if n:
        raise ValueError(f"{n} predicted tasks have no truth")


def common_tasks(predictions: DataFrame, conditions: tuple[str, str] = ("original", "rewrite")) -> DataFrame:
    """Predictions of tasks that both conditions have, per mode and repository."""
    keys = ["mode", "reponame", "task_id"]
    both = [predictions.where(F.col("condition") == c).select(*keys) for c in conditions]
    return predictions.join(both[0].intersect(both[1]), keys, "left_semi")


def evaluate_outputs(
    predictions: DataFrame, truths: DataFrame, difficulty: DataFrame, n: int | str = 5, ks: tuple[int, ...] = scores.K_VALUES
) -> DataFrame:
    """Correct samples and pass@k of each (mode, condition, task).

    ``n`` is the number of samples that pass@k assumes, or ``actual`` for those present.
    Truths: condition, task_id, reponame, funcname, ground_truth (array).
    """
    judged = predictions.withColumn("answer", T.answer(F.col("response"))).join(
        truths.select("condition", "task_id", "funcname", "ground_truth"), ["condition", "task_id"]
    )
    judged = judged.withColumn("correct", python_values.matches_any(F.col("answer"), F.col("ground_truth")))
    order = F.array_sort(F.collect_list(F.struct("sample_id", F.coalesce("answer", F.lit("")).alias("answer"))))
    grouped = judged.groupBy("mode", "condition", "reponame", "task_id").agg(
        F.first("funcname").alias("funcname"), F.first("ground_truth").alias("ground_truth"),
        F.transform(order, lambda x: x["answer"]).alias("predictions"), F.count_if("correct").cast("int").alias("num_correct"),
        F.count(F.lit(1)).cast("int").alias("num_samples")
    )
    size = F.col("num_samples") if n == "actual" else F.lit(n)
    return with_difficulty(grouped, difficulty).withColumn("pass_at_k", pass_map(size, F.col("num_correct"), ks))


def output_summary(evaluated: DataFrame) -> DataFrame:
    """Mean pass@k per (mode, condition, difficulty), with an ``overall`` row for each; in display order."""
    long = evaluated.select(
        "mode", "condition", F.explode(F.array(F.col("difficulty"), F.lit("overall"))).alias("difficulty"),
        F.explode("pass_at_k").alias("k", "value")
    )
    out = long.groupBy("mode", "condition", "difficulty", "k").agg(
        F.avg("value").alias("pass_at_k"), F.count(F.lit(1)).alias("problems")
    )
    return out.orderBy("mode", "condition", scores.difficulty_order(F.col("difficulty")), "k")


def execution_plan(predictions: DataFrame, tasks: DataFrame) -> DataFrame:
    """Predictions with their task's code, by (condition, task); unknown tasks are dropped."""
    wanted = tasks.select("condition", "task_id", "testpath", "classname", "funcname", "masked_code")
    joined = predictions.withColumn("answer", T.answer(F.col("response"))).join(wanted, ["condition", "task_id"])
    return joined.withColumn(
        "injected_code", T.fill_placeholder(F.col("masked_code"), F.col("answer"))
    ).withColumn("selector", T.test_selector(F.col("classname"), F.col("funcname")))


def evaluate_executions(results: DataFrame, ks: tuple[int, ...] = scores.K_VALUES) -> DataFrame:
    """pass@k of each (condition, mode, task) from recorded outcomes, with the samples present."""
    per = results.groupBy("condition", "mode", "reponame", "task_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("sample_id", "passed"))), lambda x: x["passed"]
        ).alias("execution_results"),
        F.count_if("passed").cast("int").alias("num_correct"), F.count(F.lit(1)).cast("int").alias("num_samples")
    )
    return per.withColumn("pass_at_k", pass_map(F.col("num_samples"), F.col("num_correct"), ks))


def execution_summary(evaluated: DataFrame) -> DataFrame:
    long = evaluated.select("condition", "mode", F.explode("pass_at_k").alias("k", "value"))
    return long.groupBy("condition", "mode", "k").agg(F.avg("value").alias("pass_at_k"), F.count(F.lit(1)).alias("problems"))
