"""Places that every executor can reach, and the few DataFrame helpers that the operators share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from threading import Lock

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset a new local one is set, on one machine only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


#: Set to true, Spark removes the shuffle files of an execution when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of the Arrow batches that Python workers are sent while a copy is written, where the session has more.
ARROW_BYTES, MOST_ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20
#: Copies made by the calls of settled under way in this thread.
_made: ContextVar[list[list[str]]] = ContextVar("made")
#: Saves under way in a session share its setting: the first one sets it, the last one puts it back.
_saving: dict[int, tuple[int, dict[str, str | None]]] = {}
_lock = Lock()


@contextmanager
def _for_copies(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go with their job, and Arrow batches are small."""
    key = id(spark._jsparkSession)
    with _lock:
        n, before = _saving.get(key, (0, {}))
        if not n:
            before = {SHUFFLE_CLEANUP: spark.conf.get(SHUFFLE_CLEANUP, None), ARROW_BYTES: spark.conf.get(ARROW_BYTES)}
            spark.conf.set(SHUFFLE_CLEANUP, "true")
            given = int(before[ARROW_BYTES].removesuffix("b")) if before[ARROW_BYTES].removesuffix("b").lstrip("-").isdigit() else 0
            if given > MOST_ARROW_BYTES or given < 0:
                spark.conf.set(ARROW_BYTES, MOST_ARROW_BYTES)
        _saving[key] = (n + 1, before)
    try:
        yield
    finally:
        with _lock:
            n, before = _saving.pop(key)
            if n > 1:
                _saving[key] = (n - 1, before)
            else:
                for name, value in before.items():
                    spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, after which the worker, which goes on to other tasks, gives its unused memory back."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc alone has it
            trim(0)

    return wrapped


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: cuts the lineage, and survives lost executors. The application owns
    the copy: it goes when the application ends, since results read it lazily until then. The shuffle files behind it go at
    once, as later jobs read the copy."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with _for_copies(spark):
        df.write.parquet(path)
    place, files = _place(spark, path)
    files.deleteOnExit(place)
    if made := _made.get([]):
        made[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What make gives, saved. Copies that make saved on its way, in this thread, are deleted then: nothing else may read them."""
    outer = _made.get([])
    own: list[str] = []
    token = _made.set([*outer, own])
    try:
        out = saved(make(), name)
    finally:
        _made.reset(token)
    for path in own[:-1]:
        place, files = _place(spark, path)
        files.delete(place, True)
    if outer:
        outer[-1].append(own[-1])
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unused(df: DataFrame, name: str) -> str:
    """name, with underscores in front until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def hot_size(rows: int, most: int = 10_000) -> int:
    """From this many rows on a key is hot: at most `most` keys of a table of so many rows are."""
    return max(64, -(-rows // most))


def looked_up(rows: DataFrame, found: DataFrame, keys: list[str], n: str, total: int) -> DataFrame:
    """rows left-joined with found, which has one row for each value of keys that is hot in rows, and for any others, with
    the number of rows in column n (dropped); total is the number of all rows.

    Hot keys are found by a broadcast of at most 10,000 rows (hot_size), so that none lands whole in one task; the others by a shuffle.
    """
    least = hot_size(total)
    mark = unused(rows, "_hot")
    hot = found.where(F.col(n) >= least).drop(n).withColumn(mark, F.lit(True))
    both = rows.join(F.broadcast(hot), keys, "left")
    rest = both.where(F.col(mark).isNull()).select(*rows.columns).join(found.where(F.col(n) < least).drop(n), keys, "left")
    return both.where(F.col(mark).isNotNull()).drop(mark).unionByName(rest)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components by alternating large-star and small-star rounds.

    Returns (node, component) for every node of an edge; component is the smallest node reachable.
    Each round is written to the shared folder, so that lineage doesn't grow; a hub's edges are joined,
    never collected. Rounds go on until nothing changes. No edges: an empty table. Loops and repeated edges change nothing.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = saved(e, "edges")
    seen = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            break
        seen = now
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        e = saved(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots).distinct()
