"""The trace fold over a stream of events, and a resumable sink.

State of a test is its stack and least hops; every micro-batch emits the hops that
improved. Events of one test must arrive in order, as a tracer writes them.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from probelake.operators.trace import TraceFold


def fold_stream(events: DataFrame, prefixes: tuple[str, ...] = ("",), balanced: bool = False) -> DataFrame:
    """Improved (test_nodeid, file, hops) of each micro-batch."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        stack, hops = (json.loads(x) for x in state.get) if state.exists else ([], {})
        fold, before = TraceFold(prefixes, balanced, stack=stack, hops=hops), dict(hops)
        pdf = pd.concat(list(batches)).sort_values("seq", kind="stable")
        fold.add_all(zip(pdf["kind"], pdf["filename"], strict=True))
        state.update((json.dumps(fold.stack), json.dumps(fold.hops)))
        new = [(key[0], f, h) for f, h in fold.hops.items() if before.get(f) != h]
        yield pd.DataFrame(new, columns=["test_nodeid", "file", "hops"])

    grouped = events.select("test_nodeid", "seq", "kind", "filename").groupBy("test_nodeid")
    return grouped.applyInPandasWithState(
        run, "test_nodeid string, file string, hops int", "stack string, hops string", "update", GroupStateTimeout.NoTimeout
    )


def append_new(spark: SparkSession, path: str, keys: tuple[str, ...]):
    """A ``foreachBatch`` function that appends rows whose keys are not in ``path`` yet."""
    from probelake.sources.records import append_missing

    def write(batch: DataFrame, _: int) -> None:
        append_missing(spark, batch.dropDuplicates(list(keys)), path, keys)

    return write


def least_hops(updates: DataFrame) -> DataFrame:
    """The final hops of all emitted updates."""
    return updates.groupBy("test_nodeid", "file").agg(F.min("hops").alias("hops"))
