"""What the operators share: shared-folder tables, joins that survive hot keys,
gapless ranks without a global sort, and connected components.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: The tables that ``written`` makes in a ``scratch`` go here; another thread has its own.
_tables: ContextVar[list[tuple[SparkSession, str]] | None] = ContextVar("tables", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one is set only where
    that is unset and everything runs in one local JVM."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="kestrova-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


@contextmanager
def thrifty(spark: SparkSession) -> Iterator[None]:
    """For writing a table: its shuffle files go when it is written, not when the driver's garbage
    does, and rows go to Python in batches of 8 MB, whatever a row holds."""
    settings = {_CLEANUP: "true", _BATCH: str(1 << 23)}
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: cuts the lineage
    and survives the loss of any executor. It is deleted when its ``scratch`` is released, or when the
    driver ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/kestrova/{name}-{uuid.uuid4().hex}"
    with thrifty(spark):
        df.write.option("compression", compression).parquet(path)
    delete_on_exit(spark, path)
    made = _tables.get()
    if made is not None:
        made.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def gathered(df: DataFrame, each: int = 4, again: bool = False) -> DataFrame:
    """``df`` in at most ``each`` partitions a core, or in ``each`` for 32 of a shuffle's if that is more. A table of a few
    rows in each of many partitions is as many files, and in a local folder Hadoop starts three processes (chmod) to
    make one, each of which shares the executor's whole memory until it runs. One task does the work of several partitions,
    unless the rows are shuffled ``again``."""
    spark = df.sparkSession
    most = each * max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 32)
    return df.repartition(most) if again else df.coalesce(most)


def small(df: DataFrame, most: int = 1 << 20) -> DataFrame:
    """``df`` written, and marked for broadcast if it has at most ``most`` rows;
    beyond, joins with it shuffle."""
    df = written(df, "small")
    return F.broadcast(df) if df.count() <= most else df


def _place(spark: SparkSession, path: str) -> tuple:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def exists(spark: SparkSession, path: str) -> bool:
    files, hadoop = _place(spark, path)
    return files.exists(hadoop)


def delete(spark: SparkSession, path: str) -> None:
    files, hadoop = _place(spark, path)
    files.delete(hadoop, True)


def delete_on_exit(spark: SparkSession, path: str) -> None:
    files, hadoop = _place(spark, path)
    files.deleteOnExit(hadoop)


@contextmanager
def scratch() -> Iterator[list]:
    """Collects the tables that ``written`` makes meanwhile, for ``release``."""
    made: list = []
    token = _tables.set(made)
    try:
        yield made
    finally:
        _tables.reset(token)


def release(made: list) -> None:
    """Delete the tables of a ``scratch``. Call it only when no result that still
    reads them is needed."""
    while made:
        delete(*made.pop())


_kept: dict[str, object] = {}


def keep(name: str, make: Callable[[], object]) -> object:
    """What ``make`` gives, kept in a worker for the next tasks; and no other operator's
    state with it: a worker serves many, and their states would add up."""
    if name not in _kept:
        lean()
        _kept[name] = make()
    return _kept[name]


def lean() -> None:
    """Lets go of what ``keep`` holds, and gives freed memory back to the system."""
    if _kept:
        _kept.clear()
        gc.collect()
    trim()


def trim() -> None:
    """Gives freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # glibc alone has it
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over a task's batches; then its worker, which waits for others, gives back what it freed."""

    def tidied(batches: Iterator) -> Iterator:
        yield from run(batches)
        trim()

    return tidied


def join_groups(rows: DataFrame, groups: DataFrame, key: list[str], count: str, total: int) -> DataFrame:
    """Inner join of rows with one row a group. Groups that hold over a thousandth
    of the rows number under 1000, so they are broadcast and their rows stay where
    they are; the others are shuffled. ``count`` is the group's number of rows."""
    limit = max(total // 1000, 1000)
    if total <= limit:
        return rows.join(groups, key)
    hot = F.broadcast(groups.filter(F.col(count) > limit))
    cold = groups.filter(F.col(count) <= limit)
    return rows.join(hot, key).unionByName(rows.join(hot.select(*key), key, "left_anti").join(cold, key))


def with_ranks(df: DataFrame, group: str, ties: list[str], name: str) -> DataFrame:
    """Adds ``rank``: 0, 1, 2 ... within each value of the integer column ``group``, by two
    hashes of the columns ``ties`` (96 bits), however the rows lie; rows equal in these have any order. No group is brought into one task: rows are sorted into ranges, each
    task numbers its own while they are written, and a table of a row for each group and one more for each range holds the
    offsets."""
    if {"_tie", "_also", "_row", "_part", "_local", "_before", "rank"} & set(df.columns):
        raise ValueError("a column is named like one that ranks need")
    with scratch() as made:
        rows = written(df, name)
        order = [group, "_tie", "_also", "_row"]
        dealt = rows.withColumn("_tie", F.xxhash64(*ties)).withColumn("_also", F.hash(*ties)).withColumn("_row", F.monotonically_increasing_id())
        dealt = dealt.repartitionByRange(*order).sortWithinPartitions(*order).select(*df.columns)
    schema = T.StructType([*df.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_local", T.LongType())])

    def number(batches):
        part, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, code = np.unique(batch.column(group).to_numpy(zero_copy_only=False), return_inverse=True)
            order = np.argsort(code, kind="stable")
            sizes = np.bincount(code, minlength=len(keys))
            first = np.cumsum(sizes) - sizes
            local = np.empty(len(code), dtype=np.int64)
            local[order] = np.arange(len(code)) - np.repeat(first, sizes)
            base = np.array([seen.get(k, 0) for k in keys.tolist()], dtype=np.int64)
            seen.update(zip(keys.tolist(), (base + sizes).tolist()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(code), part, dtype=np.int32)), pa.array(local + base[code])], names=[f.name for f in schema])

    rows = written(dealt.mapInArrow(number, schema), name)
    release(made)
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("_part", group).count().withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    return rows.join(small(offsets), ["_part", group]).withColumn("rank", F.col("_before") + F.col("_local")).select(*df.columns, "rank")


def spanning(batches_of_pairs) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (member, smallest member) for the components of some pairs."""
    parent: dict[int, int] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in batches_of_pairs:
        for x, y in zip(a.tolist(), b.tolist()):
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
    ends = [(x, root(x)) for x in parent]
    ends = [(x, r) for x, r in ends if x != r]
    return np.array([x for x, _ in ends], dtype=np.int64), np.array([r for _, r in ends], dtype=np.int64)


def forest(pairs: DataFrame) -> DataFrame:
    """Each task's pairs (a, b) replaced by a spanning star forest of the same components."""

    def run(batches):
        a, b = spanning((x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return pairs.select("a", "b").mapInArrow(run, "a long, b long")


def components(pairs: DataFrame, most: int = 1 << 20) -> DataFrame:
    """(id, component): for every id in pairs (a, b) the smallest id it reaches.

    Each task first replaces its pairs by a spanning forest. If at most ``most`` edges
    are left, one task joins the forests. Beyond, large-star and small-star steps
    alternate, each a partial aggregation and a join, until no edge changes; every
    round is a written table, and no component is brought to one task. Nothing goes to
    the driver. Pairs must not be null; a pair of an id with itself is ignored."""
    edges = written(forest(pairs.filter("a <> b")), "edges")
    if edges.count() <= most:
        edges = written(forest(edges.coalesce(1)), "edges")
        return _named(edges)
    while True:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionByName(least.select("a", F.col("m").alias("b")))
        after = written(small.distinct(), "edges")
        # a star forest: no id has two parents, and no parent has a parent
        same = after.agg(F.count("*").alias("n"), F.sum(F.hash("a", "b").cast("long")).alias("h")).first()
        was = edges.agg(F.count("*").alias("n"), F.sum(F.hash("a", "b").cast("long")).alias("h")).first()
        edges = after
        if (same.n, same.h) == (was.n, was.h):
            break
    return _named(edges)


def _named(stars: DataFrame) -> DataFrame:
    roots = stars.select(F.col("b").alias("id")).distinct()
    return stars.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots.select("id", F.col("id").alias("component")))
