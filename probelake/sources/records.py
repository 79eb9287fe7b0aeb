"""Scans and sinks of records, sources and logs.

Partition values that live in paths (repository, ratio, condition, mode) become
columns; where line order matters it becomes the columns ``path`` and ``line_no``.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from probelake.functions import text as T

# Directories and names that a retrieval corpus leaves out (case ignored).
CORPUS_DIRECTORIES = [
    "venv", "node_modules", "build", "dist", "site-packages", "tests", "test", "testing", ".venv", ".git", ".hg", "docs",
    "examples", "samples", "scripts"
]
CORPUS_FILES = ["__init__.py", "setup.py", "conftest.py"]
# The same for a candidate pool (case kept; any hidden directory goes too).
POOL_DIRECTORIES = [".venv", ".git", "docs", "examples", "__pycache__", "tests", "test"]
POOL_FILES = ["__init__.py"]
# Directories that a search for tests does not enter.
TEST_PRUNED = [".venv", "venv", ".git", "node_modules", "build", "dist", "__pycache__"]


def path_of_row() -> Column:
    return F.col("_metadata.file_path")


def with_path_columns(df: DataFrame, *levels: str, path_col: str = "path") -> DataFrame:
    """``reponame`` from the file's stem and one column for each directory level, innermost last."""
    parts = F.split(F.col(path_col), "/")
    out = df.withColumn("reponame", T.stem(F.col(path_col)))
    for i, name in enumerate(levels):
        out = out.withColumn(name, F.element_at(parts, -(len(levels) - i) - 1))
    return out


def _present(spark: SparkSession, paths: list[str]) -> list[str]:
    """Paths (or globs) that match something."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(conf).globStatus(path):
            found.append(p)
    return found


def read_records(
    spark: SparkSession, paths: str | list[str], schema: str, bad_lines: str = "skip", recursive: bool = False
) -> DataFrame:
    """JSON lines under an explicit schema, with their ``path``.

    ``bad_lines``: ``skip`` drops malformed lines, ``keep`` leaves them as rows whose
    ``_corrupt_record`` holds the line (to count and warn), ``fail`` raises. A path
    that does not exist gives no rows, unless lines must not be bad.
    """
    paths = [paths] if isinstance(paths, str) else paths
    mode = {"skip": "DROPMALFORMED", "keep": "PERMISSIVE", "fail": "FAILFAST"}[bad_lines]
    full = schema + ", _corrupt_record string" if bad_lines == "keep" else schema
    there = paths if bad_lines == "fail" else _present(spark, paths)
    if not there:
        return spark.createDataFrame([], full).withColumn("path", F.lit(None).cast("string"))
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower())
    if recursive:
        reader = reader.option("pathGlobFilter", "*.jsonl")
    if bad_lines == "keep":  # a plain scan refuses to read nothing but the malformed lines
        options = {"mode": mode, "columnNameOfCorruptRecord": "_corrupt_record"}
        lines = reader.text(there).where("trim(value) <> ''").select(
            F.from_json("value", full, options).alias("r"), path_of_row().alias("path")
        )
        return lines.select("r.*", "path")
    return reader.schema(full).option("mode", mode).json(there).select("*", path_of_row().alias("path"))


def bad_line_counts(records: DataFrame) -> DataFrame:
    """Malformed lines of each file of a scan that kept them."""
    return records.groupBy("path").agg(F.count_if(F.col("_corrupt_record").isNotNull()).alias("bad_lines"))


def read_ordered_records(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """JSON lines with ``path`` and ``line_no``; blank and malformed lines keep their number but give no row."""
    paths = _present(spark, [paths] if isinstance(paths, str) else paths)
    if not paths:
        return spark.createDataFrame([], schema + ", path string, line_no int")
    lines = spark.read.text(paths, wholetext=True).select(
        path_of_row().alias("path"), F.posexplode(F.split("value", "\n")).alias("line_no", "line")
    )
    parsed = lines.select(
        "path", "line_no", F.from_json("line", schema + ", _corrupt_record string", {"mode": "PERMISSIVE"}).alias("r")
    ).where("r IS NOT NULL AND r._corrupt_record IS NULL")
    names = [f.name for f in spark.createDataFrame([], schema).schema]
    some = F.lit(False)
    for n in names:
        some = some | F.col(f"r.{n}").isNotNull()
    return parsed.where(some).select(*[F.col(f"r.{n}").alias(n) for n in names], "path", "line_no")


def read_json_arrays(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """Files that hold one JSON array each."""
    return spark.read.schema(schema).option("multiLine", "true").json(paths).select("*", path_of_row().alias("path"))


def read_sources(spark: SparkSession, root: str, name_glob: str = "*.py") -> DataFrame:
    """Whole source files below a folder: relative ``path`` and ``content``.

    Spark's listings leave out names that start with an underscore or a dot; trees in
    which those matter come as a table of ``path`` and ``content`` instead.
    """
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", name_glob).text(root, wholetext=True)
    full = F.regexp_replace(path_of_row(), r"^file:/+", "/")
    return files.select(
        F.regexp_replace(full, "^.*?" + _regex_quote(root.rstrip("/")) + "/", "").alias("path"), F.col("value").alias("content")
    )


def _regex_quote(text: str) -> str:
    return r"\Q" + text + r"\E"


def directory_of(path: Column) -> Column:
    return F.regexp_replace(path, r"[^/]*$", "")


def test_sources(files: DataFrame) -> DataFrame:
    """Files named ``test_*.py`` outside pruned directories."""
    return files.where(
        F.regexp_like(T.base_name(F.col("path")), F.lit(r"^test_.*\.py$")) & ~T.excluded_path(
            directory_of(F.col("path")), TEST_PRUNED, lower=False
        )
    )


def rewritten_sources(files: DataFrame) -> DataFrame:
    """Files ending in the rewrite suffix, with the original's path."""
    return files.where(F.col("path").endswith("_agent_rewrite.py")).withColumn("original_path", T.original_path(F.col("path")))


def corpus_sources(files: DataFrame) -> DataFrame:
    """Retrieval corpus: no excluded directory or file name, not blank."""
    keep = ~T.excluded_path(F.col("path"), CORPUS_DIRECTORIES) & ~T.base_name(F.col("path")).isin(CORPUS_FILES)
    return files.where(keep & (F.size(T.space_tokens(F.col("content"))) > 0))


def pool_sources(files: DataFrame) -> DataFrame:
    """Candidate pool: case-sensitive directories, any hidden one, and package files excluded."""
    where = directory_of(F.col("path"))
    hidden = F.exists(F.split(where, "/"), lambda p: p.startswith("."))
    return files.where(
        ~T.excluded_path(where, POOL_DIRECTORIES, lower=False) & ~hidden & ~T.base_name(F.col("path")).isin(POOL_FILES)
    )


def repos_with_reports(reports: DataFrame, sources: DataFrame) -> DataFrame:
    """Repositories that have a report and sources."""
    return reports.select("reponame").distinct().join(sources.select("reponame").distinct(), "reponame", "left_semi")


def write_records(
    df: DataFrame, path: str, by: tuple[str, ...] = ("reponame",), fmt: str = "json", mode: str = "overwrite"
) -> None:
    """One folder for each value of ``by``; rerunning overwrites."""
    df.write.mode(mode).partitionBy(*by).format(fmt).save(path)


def append_missing(spark: SparkSession, new: DataFrame, path: str, keys: tuple[str, ...], retry_errors: bool = False) -> None:
    """Append the rows whose keys are not there yet (with ``retry_errors``, nor recorded as errors)."""
    if _present(spark, [path]):
        done = spark.read.parquet(path)
        if retry_errors:
            done = done.where("finish_reason IS NULL OR finish_reason NOT IN ('error', 'api_error')")
        new = new.join(done.select(*keys).distinct(), list(keys), "left_anti")
    new.write.mode("append").parquet(path)


def write_report(spark: SparkSession, report: dict, path: str) -> None:
    """One indented JSON object, written by the driver; for a few aggregated values only."""
    text = json.dumps(report, ensure_ascii=False, indent=2)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def console_table(df: DataFrame, digits: int = 4, rows: int = 200) -> str:
    """A small result as text, doubles with four decimals."""
    shown = df.select(*[F.format_number(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
    return shown._show_string(rows, False)


def repo_catalog(
    spark: SparkSession, repos: dict[str, dict[str, str]], present: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(catalog, counts): name, url and category; per category how many and how many are present."""
    rows = [(c, n, u) for c, of in repos.items() for n, u in of.items()]
    catalog = spark.createDataFrame(rows, "category string, reponame string, url string")
    here = present.select("reponame").distinct().withColumn("here", F.lit(True)) if present is not None else spark.createDataFrame([], "reponame string, here boolean")
    counts = catalog.join(here, "reponame", "left").groupBy("category").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.coalesce("here", F.lit(False))).alias("present")
    )
    return catalog, counts
