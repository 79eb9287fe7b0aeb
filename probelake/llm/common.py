"""Shared helpers: scratch tables, worker objects, native word splitting, components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from weakref import WeakKeyDictionary

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F

#: White space of the word class ``[^\x20\x09-\x0D]+`` other than the space itself.
OTHER_SPACE = "\t\n\x0b\x0c\r"
_OWN_ROOT: list[str] = []
_RUN = uuid.uuid4().hex
#: The folder behind each frame of :func:`store`.
_WRITTEN: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``.

    Where it is unset, a session on this machine alone gets a folder of its own; a
    cluster has no folder that all machines see, so the setting is asked for.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _OWN_ROOT:
            _OWN_ROOT.append(tempfile.mkdtemp(prefix="probelake-"))
        root = _OWN_ROOT[0]
    return f"{root.rstrip('/')}/probelake-{_RUN}"


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends at replicated files.

    The tables go with :func:`clear_scratch`, at the latest when the process ends.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[back] = path
    return back


def drop_stored(df: DataFrame) -> None:
    """Delete the table behind a frame of :func:`store` that no later plan reads."""
    path = _WRITTEN.pop(df, None)
    if path:
        _delete(df.sparkSession.sparkContext, path)


def clear_scratch(spark: SparkSession) -> None:
    """Delete every table that :func:`store` has written in this process."""
    _delete(spark.sparkContext, scratch_root(spark))
    _WRITTEN.clear()
    if _OWN_ROOT:
        shutil.rmtree(_OWN_ROOT[0], ignore_errors=True)


def _delete(sc: SparkContext, folder: str) -> None:
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def _clear_at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        clear_scratch(spark)
    elif _OWN_ROOT:
        shutil.rmtree(_OWN_ROOT[0], ignore_errors=True)


atexit.register(_clear_at_exit)
_IN_WORKER: dict[str, object] = {}


def once_in_worker(name: str, make: Callable[[], object]):
    """An object that a Python worker keeps from task to task.

    Only the latest one stays: readers, tokenizers and models of earlier stages are let
    go, and their memory returned, before the next one is made.
    """
    if name not in _IN_WORKER:
        _IN_WORKER.clear()
        pa.default_memory_pool().release_unused()
        _IN_WORKER[name] = make()
    return _IN_WORKER[name]


def text_slices(batch: pa.RecordBatch, at: int, size: int) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts) of consecutive runs of about so many bytes of a batch's text column."""
    column = batch.column(at)
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(sizes.tolist()):
        total += n
        if total >= size:
            yield start, column.slice(start, i + 1 - start)
            start, total = i + 1, 0
    if start < len(sizes):
        yield start, column.slice(start)


def text_runs(batch: pa.RecordBatch, at: int, chars: int = 1_000_000) -> Iterator[tuple[int, list[str | None]]]:
    """Runs of :func:`text_slices` as Python strings, of which only one run at a time exists."""
    for start, texts in text_slices(batch, at, chars):
        yield start, texts.to_pylist()


class Memo(dict):
    """A memo bounded in bytes: a full young generation becomes the old one.

    Keys of more than ``longest`` characters are worked out anew in each batch, so
    neither many nor long keys outgrow the bound.
    """

    def __init__(self, limit: int = 8_000_000, longest: int = 64, entry: int = 160):
        super().__init__()
        self.old: dict = {}
        self.limit, self.longest, self.entry = limit, longest, entry
        self.held = 0

    def reader(self, keys: set, make: Callable[[list], list]) -> Callable:
        """A lookup that knows all of ``keys``; ``make`` gives the values of those not remembered."""
        if self.held > self.limit:
            self.old = dict(self)
            self.clear()
            self.held = 0
        old, once, held, entry = self.old, {}, 0, self.entry
        todo = keys.difference(self)
        new = list(todo.difference(old))
        for k in todo.intersection(old) if new else todo:
            self[k] = v = old[k]
            held += entry + len(k) + (len(v) if isinstance(v, bytes) else 0)
        for k, v in zip(new, make(new) if new else (), strict=True):
            if len(k) <= self.longest:
                self[k] = v
                held += entry + len(k) + (len(v) if isinstance(v, bytes) else 0)
            else:
                once[k] = v
        self.held += held
        return (lambda k: once[k] if k in once else self[k]) if once else self.__getitem__


def dealt_blocks(rows: DataFrame, keys: list[str]) -> GroupedData:
    """Blocks as groups, over all shuffle partitions: a block's work is far larger than its bytes, by which Spark would join partitions."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, *keys).groupBy(*keys)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once: a lambda variable stands for it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    r"""The words ``[^\x20\x09-\x0D]+`` of a text, null counting as empty."""
    flat = F.translate(F.coalesce(text, F.lit("")), OTHER_SPACE, " " * len(OTHER_SPACE))
    return F.array_remove(F.split(flat, " "), "")


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


#: Sub-keys that the neighbours of one node are dealt to.
_SPLIT = 64


def _with_least(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with m, the least neighbour of u.

    A hub's edges and its one least value are dealt to sub-keys of the node by a hash of
    the neighbour, so that no task gets all edges of one node.
    """
    part = F.pmod(F.xxhash64("v"), F.lit(_SPLIT)).cast("int").alias("s")
    # one exchange serves the minimum and the join
    dealt = edges.select("u", "v", part).repartition("u", "s")
    least = dealt.groupBy("u", "s").agg(F.min("v").alias("m")).groupBy("u").agg(
        F.min("m").alias("m"), F.collect_set("s").alias("parts")
    )
    return dealt.join(least.select("u", "m", F.explode("parts").alias("s")), ["u", "s"])


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = _with_least(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    hung = F.explode(
        F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))
    )
    return down.select(hung.alias("e")).select("e.*").where("u <> v").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph: columns u, v (long) -> node, component.

    Alternating large-star and small-star rounds; each is a partial minimum and a join
    whose hubs are dealt out, so no neighbourhood is ever gathered in one task, and each
    round is written out, so a lost executor costs one round. Nodes without an edge to
    another node are absent from the result; ``component`` is the smallest node.
    """
    edges = store(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    before = _signature(edges)
    for _ in range(max_rounds):
        if not before[0]:
            break
        last, edges = edges, store(_small_star(_large_star(edges)), "edges")
        drop_stored(last)
        after = _signature(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    # every edge now leads to a root, which is its own component
    pairs = F.explode(
        F.array(
            F.struct(F.col("u").alias("node"), F.col("v").alias("component")),
            F.struct(F.col("v").alias("node"), F.col("v").alias("component"))
        )
    )
    return edges.select(pairs.alias("p")).select("p.*").distinct()


def labelled_sample(
    docs: DataFrame, labels: DataFrame, target: str, train_docs: int, may_learn: Column, id_col: str = "doc_id",
    text_col: str = "text"
) -> DataFrame:
    """A bounded sample of labelled rows, stored: id, text, label, weight.

    About ``train_docs / 2`` rows of each class at most, chosen by a hash of the id;
    the weight undoes the sampling rate. Several labels of one id count as the largest,
    several texts of one id as the least. Only sampled ids (a bounded number) are
    broadcast to the texts.
    """
    known = labels.select(
        F.col(id_col).alias("id"), F.col(target).cast("int").alias("label")
    ).where("id IS NOT NULL AND label IN (0, 1)")
    known = known.where(may_learn).groupBy("id").agg(F.max("label").alias("label"))
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    rates = {k: min(1.0, train_docs / 2 / n) for k, n in sizes.items()}
    rate = F.when(F.col("label") == 1, F.lit(rates.get(1, 0.0))).otherwise(F.lit(rates.get(0, 0.0)))
    chosen = known.where(
        F.xxhash64(F.col("id").cast("string"), F.lit(11)) / F.lit(2.0**64) + 0.5 < rate
    ).withColumn("weight", F.try_divide(F.lit(1.0), rate))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = texts.join(F.broadcast(chosen), "id").groupBy("id", "label", "weight").agg(F.min("text").alias("text"))
    return store(found.select("id", "text", "label", "weight"), "labelled")
