"""Prompt context under a token budget.

Exact packing recounts every part with the tokenizer, because token counts of joined
texts are not sums; it folds a task's files in one Arrow batch. Where costs do add up,
``additive_fold`` stays in the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probelake.functions.python_values import SpaceTokenizer, truncate_text

NO_BUDGET = "# No token budget is left for related files.\n"
NOTHING_FITS = "# No related file fits into the token limit.\n"


def pack_files(
    files: Iterable[tuple[str, str | None]], budget: int, tokenizer, skip: bool = False
) -> tuple[str, list[str], int]:
    """(context, included paths, tokens) of files in order.

    A file that does not fit whole is cut to what is left. Stop mode ends at the first
    file that cannot be added; skip mode passes over it, and over unreadable ones.
    """
    if budget <= 0 and not skip:
        return NO_BUDGET, [], 0
    size = lambda text: len(tokenizer.encode(text))
    parts: list[str] = []
    paths: list[str] = []
    used = 0
    for path, content in files:
        if used >= budget:
            break
        if content is None:
            if skip:
                continue
            content = f"# file {path} was not found"
        head, foot = f"### file: {path}\n```python\n", "\n```\n"
        room = budget - used - size(head) - size(foot)
        part = None
        if room > 0:
            tokens = tokenizer.encode(content)
            part = head + (tokenizer.decode(tokens[:room]) if len(tokens) > room or skip else content) + foot
            cost = size(part)
            if used + cost > budget:
                part = None
        if part is None:
            if skip:
                continue
            break
        parts.append(part)
        paths.append(path)
        used += cost
    if not parts and not skip:
        return NOTHING_FITS, [], 0
    return "".join(parts), paths, used


def packed_contexts(
    files: DataFrame, by: list[str], skip: bool = False, tokenizer_of: Callable[[], object] = SpaceTokenizer
) -> DataFrame:
    """One context for each group: ``by``, position, path, content, budget -> context, files, tokens."""
    kinds = dict(files.dtypes)
    # contents of one task's files are few (top ranks), so a group is small by construction
    grouped = files.groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct("position", "path", "content"))).alias("files"), F.max("budget").alias("budget")
    )

    def run(batches):
        tokenizer = tokenizer_of()
        for pdf in batches:
            made = [
                pack_files([(f["path"], f["content"]) for f in fs], int(b), tokenizer, skip) for fs,
                b in zip(pdf["files"], pdf["budget"], strict=True)
            ]
            yield pdf[by].assign(context=[m[0] for m in made], files=[m[1] for m in made], tokens=[m[2] for m in made])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in by) + ", context string, files array<string>, tokens int"
    return grouped.mapInPandas(run, schema)


def additive_fold(costs: Column, budget: Column, skip: bool = False) -> Column:
    """Positions (from 0) of the costs that are taken in order under a budget."""
    zero = F.struct(F.lit(0.0).alias("used"), F.lit(False).alias("over"), F.array().cast("array<int>").alias("taken"))

    def step(acc: Column, x: Column) -> Column:
        fits = (acc["used"] + x["cost"] <= budget) & (F.lit(skip) | ~acc["over"])
        return F.struct(
            F.when(fits, acc["used"] + x["cost"]).otherwise(acc["used"]).alias("used"),
            (acc["over"] | ~fits).alias("over"),
            F.when(fits, F.concat(acc["taken"], F.array(x["i"]))).otherwise(acc["taken"]).alias("taken"),
        )

    placed = F.transform(costs, lambda c, i: F.struct(c.cast("double").alias("cost"), i.alias("i")))
    return F.aggregate(placed, zero, step, lambda acc: acc["taken"])


def two_sided_context(
    positive: DataFrame, negative: DataFrame, by: list[str], seed: int = 42, tokenizer_of: Callable[[], object] = SpaceTokenizer
) -> DataFrame:
    """Positive and negative blocks of each task, skip-packed, joined in seeded order."""
    pos = packed_contexts(positive, by, True, tokenizer_of).select(
        *by, F.col("context").alias("p"), F.col("files").alias("positive_files")
    )
    neg = packed_contexts(negative, by, True, tokenizer_of).select(
        *by, F.col("context").alias("n"), F.col("files").alias("negative_files")
    )
    both = pos.join(neg, by, "full")
    p, n = F.coalesce("p", F.lit("")), F.coalesce("n", F.lit(""))
    first = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in by])) < F.lit("8")
    none = F.array().cast("array<string>")
    files = F.concat(F.coalesce("positive_files", none), F.coalesce("negative_files", none))
    return both.select(
        *by, F.when(first, F.concat(p, n)).otherwise(F.concat(n, p)).alias("context"), files.alias("files_in_prompt")
    )


def chat_window(messages: DataFrame, by: list[str], order: str, last: int = 2) -> DataFrame:
    """The first and the last messages of each conversation; each part is a bounded rank, so a long one is cut before it is sorted."""
    ranked = lambda column, n: messages.withColumn(
        "__r", F.row_number().over(Window.partitionBy(*by).orderBy(column))
    ).where(F.col("__r") <= n).drop("__r")
    ends = ranked(F.desc(order), last)
    first = ranked(F.asc(order), 1).join(ends.select(*by, order), [*by, order], "left_anti")
    return first.select(*messages.columns).unionByName(ends)


# Names and patterns that a project drawing leaves out.
TREE_EXCLUDED = (
    ".git", ".svn", ".hg", ".DS_Store", "Thumbs.db", ".*~", "*.tmp", "*.temp",
    "__pycache__", ".pytest_cache", "*.egg-info",
    "node_modules", ".npm", ".yarn",
    "*.class", "target",
    "*.o", "*.obj", "*.exe", "*.dll", "*.so", "*.dylib",
    "obj", "*.pdb",
    "build", "dist", "out",
    ".vscode", ".idea", "*.swp", "*.swo",
)


def project_trees(
    paths: DataFrame, max_depth: int = 3, max_files: int = 5, excluded: tuple[str, ...] = TREE_EXCLUDED, limit: int = 4000,
    tokenizer_of: Callable[[], object] = SpaceTokenizer
) -> DataFrame:
    """A drawing of each repository's folders and files, cut to ``limit`` tokens: reponame, path -> reponame, tree.

    Folders come before files, by name without regard to case (ties by name); files beyond
    ``max_files`` are noted, not left out. Siblings are ranked folder by folder, and only as
    many lines of a repository as the limit has tokens are put together.
    """
    pattern = "|".join("(?:" + re.escape(p).replace(r"\*", ".*") + ")" for p in excluded)
    parts = F.split("path", "/")
    clean = paths.select("reponame", parts.alias("parts")).where(
        ~F.exists("parts", lambda p: F.regexp_like(p, F.lit(f"^(?:{pattern})$")))
    )
    upto = F.sequence(F.lit(1), F.least(F.size("parts"), F.lit(max_depth + 1)))
    nodes = clean.select("reponame", "parts", F.explode(upto).alias("depth"))
    nodes = nodes.select(
        "reponame", "depth", F.slice("parts", 1, F.col("depth") - 1).alias("folder"),
        F.get("parts", F.col("depth") - 1).alias("name"), (F.col("depth") == F.size("parts")).alias("is_file")
    ).distinct()
    siblings = Window.partitionBy("reponame", "folder")
    order = siblings.orderBy("is_file", F.lower("name"), "name")
    nodes = nodes.withColumns(
        {
            "rank": F.row_number().over(order), "n": F.count(F.lit(1)).over(siblings),
            "files": F.count_if("is_file").over(siblings)
        }
    )
    drawn, above = None, None
    for depth in range(1, max_depth + 2):
        here = nodes.where(F.col("depth") == depth)
        if above is None:
            here = here.withColumns({"before": F.lit(""), "place": F.array().cast("array<int>")})
        else:
            here = here.join(above, ["reponame", "folder"])
        last = F.col("rank") == F.col("n")
        place = F.concat("place", F.array("rank"))
        line = F.concat("before", F.when(last, "└── ").otherwise("├── "), "name", F.when(F.col("is_file"), "").otherwise("/"))
        more = here.where((F.col("files") > max_files) & last)
        note = F.concat("before", F.lit("    └── ... ("), (F.col("files") - max_files).cast("string"), F.lit(" more files)"))
        part = here.select("reponame", place.alias("place"), line.alias("line")).unionByName(
            more.select(
                "reponame", F.concat("place", F.array(F.col("n") + 1).cast("array<int>")).alias("place"), note.alias("line")
            )
        )
        drawn = part if drawn is None else drawn.unionByName(part)
        within = F.concat("folder", F.array("name"))
        above = here.where(~F.col("is_file")).select(
            "reponame", within.alias("folder"), F.concat("before", F.when(last, "    ").otherwise("│   ")).alias("before"),
            place.alias("place")
        )
    # every line has a token at least, so later ones cannot show
    rank = F.row_number().over(Window.partitionBy("reponame").orderBy("place"))
    shown = drawn.withColumn("__r", rank).where(F.col("__r") <= limit).groupBy("reponame").agg(
        F.array_sort(F.collect_list(F.struct("place", "line"))).alias("lines")
    )
    counted = drawn.groupBy("reponame").agg(F.count(F.lit(1)).alias("n"))
    text = F.concat("reponame", F.lit("/"), F.array_join(F.transform("lines", lambda x: F.concat(F.lit("\n"), x["line"])), ""))
    return shown.join(counted, "reponame").select(
        "reponame", _cut_lines(limit, tokenizer_of)(text, (F.col("n") + 1).cast("int")).alias("tree")
    )


def _cut_lines(limit: int, tokenizer_of: Callable[[], object]):
    @F.pandas_udf("string")
    def cut(texts: pd.Series, lines: pd.Series) -> pd.Series:
        tokenizer = tokenizer_of()
        return pd.Series([truncate_text(t, limit, tokenizer, int(n)) for t, n in zip(texts, lines, strict=True)])

    return cut
