"""Prompts for recorded experiments, and the place where a model plugs in.

Prompts are tables: a task, a mode and a sample give one row with its text. A model is
any function from a prompt to an answer that the caller supplies; errors become rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probelake.functions import scores
from probelake.functions import text as T
from probelake.functions.python_values import SpaceTokenizer, token_count
from probelake.operators import context, keys


def output_prompts(
    tasks: DataFrame,
    chosen: DataFrame,
    files: DataFrame,
    system: str,
    template: str,
    window: int,
    completion: int,
    samples: int = 5,
    done: DataFrame | None = None,
    tokenizer_of: Callable[[], object] = SpaceTokenizer,
) -> DataFrame:
    """Prompts of masked tasks: task_id, reponame, mode, sample_id, files, prompt.

    ``tasks``: task_id, reponame, masked_code. ``chosen``: task_id, mode, position, path.
    ``files``: reponame, path, content. ``template`` may name ``{masked_code}`` and
    ``{related_files}``. Finished (task_id, mode, sample_id) rows of ``done`` are left out.
    """
    size = lambda text: token_count(text, tokenizer_of)
    bare = template.replace("{masked_code}", "").replace("{related_files}", "")
    tokenizer = tokenizer_of()
    fixed = [len(tokenizer.encode(x)) for x in (system, bare)]
    budget = scores.context_budget(
        F.lit(window), F.lit(completion), F.lit(fixed[0]), F.lit(fixed[1]), size(F.col("masked_code"))
    )
    sized = tasks.select("task_id", "reponame", "masked_code", budget.alias("budget"))
    related = chosen.select("task_id", "mode", "position", "path").join(sized.select("task_id", "reponame", "budget"), "task_id").join(
        files.select("reponame", "path", "content"), ["reponame", "path"], "left"
    )
    packed = context.packed_contexts(related, ["task_id", "mode"], False, tokenizer_of)
    prompts = packed.join(sized, "task_id").withColumn(
        "prompt", T.template(template, masked_code=F.col("masked_code"), related_files=F.col("context"))
    )
    out = keys.with_samples(prompts, samples)
    if done is not None:
        out = keys.remaining(out, done, ["task_id", "mode", "sample_id"])
    return out.select("task_id", "reponame", "mode", "sample_id", "files", "prompt")


def candidate_files(tests: DataFrame, reports: DataFrame, pool: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(positive, negative) files of each test file: the report's other files, and the pool without the report's.

    ``tests``: reponame, test_file. ``reports``: reponame, test_file, dependencies. ``pool``: reponame, path.
    """
    tests = tests.select("reponame", "test_file").distinct()
    own = reports.join(tests, ["reponame", "test_file"], "left_semi").select(
        "reponame", "test_file", F.explode("dependencies").alias("d")
    ).select("reponame", "test_file", F.col("d.file").alias("path")).distinct()
    positive = own.where("path <> test_file")
    negative = tests.join(
        pool.select("reponame", "path").distinct(), "reponame"
    ).join(own, ["reponame", "test_file", "path"], "left_anti")
    return positive, negative


def negative_counts(tests: DataFrame, reports: DataFrame, pool: DataFrame) -> DataFrame:
    """How many negative files ``candidate_files`` gives each test file: reponame, test_file, negative.

    The repository's pool less the report's files in it: no pair of a test and a file is made, the
    reports' files are shuffled once. Test files without a negative one have no row.
    """
    files = pool.select("reponame", "path").distinct()
    sizes = files.groupBy("reponame").agg(F.count(F.lit(1)).alias("size"))
    own = reports.select("reponame", "test_file", F.explode("dependencies").alias("d")).select(
        "reponame", "test_file", F.col("d.file").alias("path")
    )
    # dealt by file: the pool grows with the corpus and is not broadcast; distinct rows need no exchange of their own
    taken = own.join(files.hint("shuffle_hash"), ["reponame", "path"], "left_semi").distinct().groupBy(
        "reponame", "test_file"
    ).agg(F.count(F.lit(1)).alias("taken"))
    counted = tests.select("reponame", "test_file").distinct().join(sizes, "reponame").join(
        taken, ["reponame", "test_file"], "left"
    )
    left = F.col("size") - F.coalesce("taken", F.lit(0))
    return counted.select("reponame", "test_file", left.alias("negative")).where("negative > 0")


def chain_prompts(
    tests: DataFrame,
    reports: DataFrame,
    pool: DataFrame,
    sources: DataFrame,
    template: str,
    window: int,
    ratios: tuple[float, ...] = (0.25, 0.5),
    samples: int = 5,
    seed: int = 42,
    tokenizer_of: Callable[[], object] = SpaceTokenizer,
) -> DataFrame:
    """Prompts that ask for a test's files: reponame, test_file, ratio, sample_id, files_in_prompt, prompt.

    Positive and negative files get the parts of the budget that the ratio sets, in a
    seeded order of their own for each sample. ``sources``: reponame, path, content.
    """
    by = ["reponame", "test_file", "ratio", "sample_id"]
    bare = template
    for name in ("{test_file}", "{test_code}", "{files}"):
        bare = bare.replace(name, "")
    fixed = len(tokenizer_of().encode(bare))
    code = sources.select("reponame", F.col("path").alias("test_file"), F.col("content").alias("test_code"))
    asked = tests.select("reponame", "test_file").distinct().join(code, ["reponame", "test_file"])
    asked = keys.with_samples(asked.withColumn("ratio", F.explode(F.array(*[F.lit(r) for r in ratios]))), samples)
    total = F.lit(window) - fixed - token_count(F.col("test_code"), tokenizer_of)
    asked = asked.withColumn("parts", scores.split_budget(total, F.col("ratio")))

    def block(files: DataFrame, part: str) -> DataFrame:
        order = F.xxhash64(F.lit(seed), F.lit(part), F.col("sample_id"), F.col("path"))
        rows = asked.select(*by, F.col(f"parts.{part}").alias("budget")).join(files, ["reponame", "test_file"])
        return rows.join(
            sources.select("reponame", "path", "content"), ["reponame", "path"]
        ).select(*by, order.alias("position"), "path", "content", "budget")

    positive, negative = candidate_files(tests, reports, pool)
    both = context.two_sided_context(block(positive, "positive"), block(negative, "negative"), by, seed, tokenizer_of)
    prompt = T.template(
        template, test_file=F.col("test_file"), test_code=F.col("test_code"), files=F.coalesce("context", F.lit(""))
    )
    full = asked.join(both, by, "left").withColumn("prompt", prompt)
    none = F.array().cast("array<string>")
    return full.select(*by, F.coalesce("files_in_prompt", none).alias("files_in_prompt"), "prompt")


def completions(prompts: DataFrame, call: Callable[[str], str], prompt_col: str = "prompt") -> DataFrame:
    """``response`` and ``finish_reason`` of each prompt; an exception becomes an ``error`` row."""
    kept = [c for c in prompts.columns if c not in ("response", "finish_reason")]
    kinds = dict(prompts.dtypes)

    def one(prompt: str) -> tuple[str, str]:
        try:
            return call(prompt) or "", "stop"
        except Exception as e:  # noqa: BLE001
            return f"ERROR: {type(e).__name__} - {e}", "error"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            answers = [one(p) for p in pdf[prompt_col]]
            yield pdf.assign(response=[a for a, _ in answers], finish_reason=[r for _, r in answers])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in kept) + ", response string, finish_reason string"
    return prompts.select(*kept).mapInPandas(run, schema)
