"""Command lines: ``python -m probelake.cli COMMAND ...``.

Every command reads files, applies operators and writes a folder; paths may be any
that Spark reads. Nothing runs code or calls a model.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probelake.functions import python_source
from probelake.functions import text as T
from probelake.operators import evaluation, keys, prompts, reports, retrieval
from probelake.sources import records, schemas


def _write(df: DataFrame, path: str, by: tuple[str, ...] = ()) -> None:
    records.write_records(df, path, by)


def _reports(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """Reports at <folder>/<reponame>/<name>."""
    df = records.read_records(spark, f"{folder}/*/{name}", schema)
    return df.withColumn("reponame", F.element_at(F.split("path", "/"), -2))


def collect_tasks(spark: SparkSession, a: argparse.Namespace) -> None:
    """Masked tasks of every repository below a folder."""
    files = records.read_sources(spark, a.repos_dir)
    tests = records.rewritten_sources(files) if a.rewrites else records.test_sources(files)
    split = F.split("path", "/", 2)
    named = tests.select(split[0].alias("reponame"), split[1].alias("testpath"), "content")
    if a.rewrites:
        named = named.withColumn("testpath", T.original_path(F.col("testpath")))
    named = named.withColumn("testname", T.base_name(F.col("testpath")))
    tasks = python_source.extract_tasks(named, quality=not a.all_equalities)
    if a.reports_dir:
        known = _reports(spark, a.reports_dir, "report_functions.jsonl", schemas.FUNCTION_REPORT)
        tasks = keys.members(tasks, records.repos_with_reports(known, tasks), ["reponame"])
    _write(keys.task_ids(tasks, ["testpath", "ordinal"]).drop("ordinal"), a.output_dir, ("reponame",))


def align(spark: SparkSession, a: argparse.Namespace) -> None:
    """Original and rewritten tasks, paired by position."""
    side = lambda d: records.read_ordered_records(spark, f"{d}/*.jsonl", schemas.MASKED_TASK)
    original, rewrite = side(a.original_dir), side(a.rewrite_dir)
    left, right = keys.aligned(original, rewrite, ["path", "line_no"])
    _write(left.drop("path", "line_no"), f"{a.output_dir}/original", ("reponame",))
    _write(right.drop("path", "line_no"), f"{a.output_dir}/rewrite", ("reponame",))
    print(records.console_table(keys.align_totals(original, rewrite, left)))


def rank(spark: SparkSession, a: argparse.Namespace) -> None:
    """BM25 ranks of each test file's repository."""
    tasks = records.read_records(spark, f"{a.tasks_dir}/*.jsonl", schemas.MASKED_TASK)
    files = records.read_sources(spark, a.repos_dir).withColumn("reponame", F.split("path", "/", 2)[0]).withColumn("path", F.split("path", "/", 2)[1])
    corpus = records.corpus_sources(files).select("reponame", "path", T.space_tokens(F.col("content")).alias("tokens"))
    wanted = tasks.select("reponame", F.col("testpath").alias("path")).distinct()
    queries = files.join(wanted, ["reponame", "path"], "left_semi").select(
        "reponame", F.col("path").alias("query"), T.space_tokens(F.col("content")).alias("tokens")
    )
    lists = retrieval.rank_lists(retrieval.bm25_ranks(corpus, queries))
    none = F.array().cast("array<string>")
    out = tasks.join(
        lists.withColumnRenamed("query", "testpath"), ["reponame", "testpath"], "left"
    ).withColumn("related_files_rank", F.coalesce("related_files_rank", none))
    _write(
        out.select("task_id", "reponame", "testpath", "testname", "funcname", "related_files_rank"), a.output_dir, ("reponame",)
    )


def _template(spark: SparkSession, path: str | None, default: str) -> str:
    """A prompt's text from a file."""
    return spark.read.text(path, wholetext=True).first()["value"] if path else default


def _repo_files(spark: SparkSession, folder: str) -> DataFrame:
    """Sources at <folder>/<reponame>/<path>."""
    parts = F.split("path", "/", 2)
    return records.read_sources(spark, folder).select(parts[0].alias("reponame"), parts[1].alias("path"), "content")


def output_prompts(spark: SparkSession, a: argparse.Namespace) -> None:
    """Prompts of masked tasks, for each selection mode and sample."""
    tasks = records.read_ordered_records(spark, f"{a.tasks_dir}/*.jsonl", schemas.MASKED_TASK)
    tasks = keys.capped(tasks, ["reponame"], ["path", "line_no"], a.tasks)
    ranked = records.read_ordered_records(spark, f"{a.ranks_dir}/*.jsonl", schemas.RANKING)
    lists = keys.last_per_key(
        ranked.select("task_id", "related_files_rank", "path", "line_no"), ["task_id"], ["path", "line_no"]
    )
    ranks = lists.select(
        "task_id", F.posexplode("related_files_rank").alias("rank", "path")
    ).withColumn("rank", F.col("rank") + 1)
    chains = records.read_ordered_records(
        spark, f"{a.reports_dir}/*/report_functions.jsonl", schemas.FUNCTION_REPORT
    ).withColumn("reponame", F.element_at(F.split("path", "/"), -2))
    named = chains.select("reponame", T.bare_name(F.col("test_function")).alias("funcname"), "dependencies", "path", "line_no")
    known = keys.last_per_key(named, ["reponame", "funcname"], ["path", "line_no"])
    chosen = retrieval.selection(tasks, ranks, known, tuple(a.modes.split(",")))
    done = spark.read.json(a.done_dir).select("task_id", "mode", "sample_id") if a.done_dir else None
    template = _template(spark, a.template, "{related_files}\n{masked_code}\n")
    out = prompts.output_prompts(
        tasks, chosen, _repo_files(spark, a.repos_dir), _template(spark, a.system, ""), template, a.window, a.completion,
        a.samples, done
    )
    _write(out, a.output_dir, ("mode", "reponame"))


def chain_prompts(spark: SparkSession, a: argparse.Namespace) -> None:
    """Prompts that ask for a test's files, for each ratio and sample."""
    tasks = records.read_ordered_records(spark, f"{a.tasks_dir}/*.jsonl", schemas.MASKED_TASK)
    tests = keys.base_tasks(tasks.select("reponame", "testpath", "path", "line_no"), ["path", "line_no"], a.tasks)
    files, known = _repo_files(spark, a.repos_dir), _reports(spark, a.reports_dir, "report_files.jsonl", schemas.FILE_REPORT)
    template = _template(spark, a.template, "{files}\n{test_file}\n{test_code}\n")
    ratios = tuple(float(r) for r in a.ratios.split(","))
    out = prompts.chain_prompts(
        tests.withColumnRenamed("testpath", "test_file"), known, records.pool_sources(files).select("reponame", "path"), files,
        template, a.window, ratios, a.samples
    )
    _write(out, a.output_dir, ("ratio", "reponame"))


def evaluate_chains(spark: SparkSession, a: argparse.Namespace) -> None:
    """Set metrics of predicted call-chain files."""
    predictions = records.with_path_columns(
        records.read_records(spark, f"{a.predictions_dir}/*/*.jsonl", schemas.CHAIN_PREDICTION).drop("ratio"), "ratio"
    )
    evaluated = evaluation.evaluate_chains(
        predictions, _reports(spark, a.reports_dir, "report_files.jsonl", schemas.FILE_REPORT)
    )
    _write(evaluated, a.output_dir, ("ratio", "reponame"))
    print(records.console_table(evaluation.chain_summary(evaluated).orderBy("ratio", F.col("reponame").asc_nulls_first())))


def _predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Predictions at <folder>/<condition>/predictions/<mode>/<reponame>.jsonl."""
    df = records.read_records(spark, f"{folder}/*/predictions/*/*.jsonl", schemas.OUTPUT_PREDICTION)
    parts = F.split("path", "/")
    return df.select(
        "task_id", "sample_id", "response", "finish_reason", T.stem(F.col("path")).alias("reponame"),
        F.element_at(parts, -2).alias("mode"), F.element_at(parts, -4).alias("condition")
    )


def _tasks(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Tasks at <folder>/<condition>/<reponame>.jsonl."""
    df = records.read_records(spark, f"{folder}/*/*.jsonl", schema, "fail")
    return df.withColumn("condition", F.element_at(F.split("path", "/"), -2))


def evaluate_outputs(spark: SparkSession, a: argparse.Namespace) -> None:
    """pass@k of predicted values, by difficulty."""
    predictions, truths = evaluation.common_tasks(_predictions(spark, a.predictions_dir)), _tasks(
        spark, a.tasks_dir, schemas.AUGMENTED_TASK
    )
    evaluation.require_truths(predictions, truths)
    chains = records.with_path_columns(
        records.read_ordered_records(spark, f"{a.reports_dir}/*/report_functions.jsonl", schemas.FUNCTION_REPORT)
    ).withColumn("reponame", F.element_at(F.split("path", "/"), -2))
    difficulty = keys.function_difficulty(chains, "last")
    evaluated = evaluation.evaluate_outputs(predictions, truths, difficulty, "actual" if a.actual_samples else a.samples)
    _write(evaluated, a.output_dir, ("condition", "mode", "reponame"))
    print(records.console_table(evaluation.output_summary(evaluated)))


def evaluate_executions(spark: SparkSession, a: argparse.Namespace) -> None:
    """pass@k of recorded executions: condition, mode, reponame, task_id, sample_id, passed."""
    schema = "condition string, mode string, reponame string, task_id string, sample_id int, passed boolean"
    evaluated = evaluation.evaluate_executions(records.read_records(spark, a.results, schema, "fail").drop("path"))
    _write(evaluated, a.output_dir, ("condition", "mode"))
    print(records.console_table(evaluation.execution_summary(evaluated).orderBy("condition", "mode", "k")))


def augment(spark: SparkSession, a: argparse.Namespace) -> None:
    """Tasks whose truths include recorded runtime values."""
    tasks = _tasks(spark, a.data_dir, schemas.MASKED_TASK).drop("path")
    runtime = records.read_ordered_records(spark, f"{a.runtime_dir}/*.jsonl", schemas.RUNTIME_TRUTH)
    _write(reports.augment_truths(tasks, runtime, ["path", "line_no"]), a.output_dir, ("condition", "reponame"))


def quality_report(spark: SparkSession, a: argparse.Namespace) -> None:
    """Totals, scores and reasons of collected tasks."""
    report = reports.quality_report(records.read_records(spark, f"{a.data_dir}/*.jsonl", schemas.MASKED_TASK))
    print(report)
    if a.output:
        records.write_report(spark, report, a.output)


COMMANDS = {
    "collect-tasks": (
        collect_tasks,
        [
            ("repos_dir", {}), ("output_dir", {}), ("--reports_dir", {}), ("--rewrites", {"action": "store_true"}),
            ("--all_equalities", {"action": "store_true"})
        ]
    ),
    "align": (align, [("original_dir", {}), ("rewrite_dir", {}), ("output_dir", {})]),
    "rank": (rank, [("tasks_dir", {}), ("repos_dir", {}), ("output_dir", {})]),
    "output-prompts": (
        output_prompts,
        [
            ("tasks_dir", {}), ("ranks_dir", {}), ("reports_dir", {}), ("repos_dir", {}), ("output_dir", {}),
            ("--modes", {"default": "oracle"}), ("--template", {}), ("--system", {}), ("--done_dir", {}),
            ("--window", {"type": int, "default": 10240}), ("--completion", {"type": int, "default": 2048}),
            ("--samples", {"type": int, "default": 5}), ("--tasks", {"type": int, "default": 200}),
        ],
    ),
    "chain-prompts": (
        chain_prompts,
        [
            ("tasks_dir", {}), ("reports_dir", {}), ("repos_dir", {}), ("output_dir", {}),
            ("--ratios", {"default": "0.25,0.5"}), ("--template", {}),
            ("--window", {"type": int, "default": 20480}), ("--samples", {"type": int, "default": 5}),
            ("--tasks", {"type": int, "default": 200}),
        ],
    ),
    "evaluate-chains": (evaluate_chains, [("predictions_dir", {}), ("reports_dir", {}), ("output_dir", {})]),
    "evaluate-outputs": (
        evaluate_outputs,
        [
            ("predictions_dir", {}), ("tasks_dir", {}), ("reports_dir", {}), ("output_dir", {}),
            ("--samples", {"type": int, "default": 5}), ("--actual_samples", {"action": "store_true"})
        ]
    ),
    "evaluate-executions": (evaluate_executions, [("results", {}), ("output_dir", {})]),
    "augment": (augment, [("data_dir", {}), ("runtime_dir", {}), ("output_dir", {})]),
    "quality-report": (quality_report, [("data_dir", {}), ("--output", {})]),
}


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="probelake")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, (function, options) in COMMANDS.items():
        sub = commands.add_parser(name, help=function.__doc__)
        for flag, how in options:
            sub.add_argument(flag, **how)
    a = parser.parse_args(args)
    COMMANDS[a.command][0](spark or SparkSession.builder.appName("probelake").getOrCreate(), a)


if __name__ == "__main__":
    main()
