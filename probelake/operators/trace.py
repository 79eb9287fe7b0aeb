"""Call traces folded into dependency reports."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probelake.functions import text as T
from probelake.operators.keys import min_hop_rollup


class TraceFold:
    """Stack of source files and least hops of one test.

    A call into a file other than the stack's top is pushed; a return from the top pops.
    By default a nested call inside one file is not pushed although its return pops, as
    in the recorded reports; ``balanced`` counts such calls, so returns pair up.
    """

    def __init__(
        self, prefixes: tuple[str, ...] = ("",), balanced: bool = False, strict_prefix: bool = False, stack: list | None = None,
        hops: dict | None = None
    ):
        self.prefixes = tuple(p.rstrip("/") + "/" for p in prefixes) if strict_prefix else prefixes
        self.balanced = balanced
        self.stack: list[list] = stack or []  # [file, open calls]
        self.hops: dict[str, int] = hops or {}

    def add(self, kind: str | None, filename: str | None) -> None:
        if kind not in ("call", "return") or not filename or not filename.startswith(self.prefixes):
            return
        top = self.stack[-1] if self.stack else None
        same = top is not None and top[0] == filename
        if kind == "call":
            if same:
                top[1] += 1
            else:
                self.stack.append([filename, 1])
                depth = len(self.stack)
                self.hops[filename] = min(depth, self.hops.get(filename, depth))
        elif same:
            top[1] -= 1
            if not self.balanced or top[1] <= 0:
                self.stack.pop()

    def add_all(self, events: Iterable[tuple[str | None, str | None]]) -> TraceFold:
        for kind, filename in events:
            self.add(kind, filename)
        return self


def fold_traces(
    events: DataFrame, prefixes: tuple[str, ...] = ("",), balanced: bool = False, strict_prefix: bool = False
) -> DataFrame:
    """test_nodeid, file, hops from test_nodeid, seq, kind, filename.

    Tests are sorted in their partitions and folded as they stream by: a task holds one
    stack and its files' hops, however long a trace is.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        test, fold = None, None

        def found() -> pd.DataFrame:
            return pd.DataFrame([(test, f, h) for f, h in fold.hops.items()], columns=["test_nodeid", "file", "hops"])

        for pdf in batches:
            for name, kind, filename in zip(pdf["test_nodeid"], pdf["kind"], pdf["filename"], strict=True):
                if fold is None or name != test:
                    if fold is not None:
                        yield found()
                    test, fold = name, TraceFold(prefixes, balanced, strict_prefix)
                fold.add(kind, filename)
        if fold is not None:
            yield found()

    used = events.where(
        "kind IN ('call', 'return') AND filename IS NOT NULL AND filename <> ''"
    ).select("test_nodeid", "seq", "kind", "filename")
    ordered = used.repartition("test_nodeid").sortWithinPartitions("test_nodeid", "seq")
    return ordered.mapInPandas(run, "test_nodeid string, file string, hops int")


def function_report(folded: DataFrame) -> DataFrame:
    """test_file, test_function, dependencies, one row for each test."""
    parts = T.node_id_parts(F.col("test_nodeid"))
    return min_hop_rollup(folded, ["test_nodeid"]).select(
        parts["test_file"].alias("test_file"), parts["test_function"].alias("test_function"), "dependencies"
    )


def file_report(folded: DataFrame) -> DataFrame:
    """test_file, dependencies with the least hops over the file's tests."""
    return min_hop_rollup(folded.withColumn("test_file", F.split("test_nodeid", "::")[0]), ["test_file"])


def phases(logs: DataFrame, by: list[str], order: str) -> DataFrame:
    """Phase of each logged command: TRACING after the first one that completes the setup."""
    from pyspark.sql import Window

    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    done = T.setup_complete(F.col("command"), F.col("stdout"), F.col("stderr"))
    seen = F.max(done.cast("int")).over(before)
    return logs.withColumn("phase", F.when(seen == 1, "TRACING").otherwise("SETUP"))
