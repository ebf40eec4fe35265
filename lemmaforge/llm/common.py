"""Shared pieces of the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import functools
import inspect
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session. Where a
    local session has none (as in tests) a temporary folder is set; on a cluster that
    is an error, since executors would not find a folder of the driver's machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="lemmaforge-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(found)
    return found


# Where the shared folder is a local one and Hadoop lacks its native library, it spawns a
# chmod for each file it makes, four with the checksum twin of the file. Until it runs,
# a spawned process maps all memory of its JVM, and what sums up processes counts it again.
_PLAIN = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true", "mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}


def stored(df: DataFrame, label: str, plain: bool = False) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts the lineage,
    fixes the rows, and survives the loss of any executor. plain: without checksum files
    in a local folder and without a mark of success, so with fewer spawned processes;
    the checksums that Parquet keeps of its pages are verified instead."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/lemmaforge-{label}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.options(**(_PLAIN if plain else {})).parquet(path)
    verify = {"parquet.page.verify-checksum.enabled": "true"} if plain else {}
    return spark.read.options(**verify).schema(schema).parquet(path)


def small(df: DataFrame, row_bytes: int, limit: int = 32 << 20) -> DataFrame:
    """df with a broadcast hint if its counted rows fit the limit, else unchanged so
    that the planner shuffles. df should be cheap to count (a stored table)."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores added until no column of df has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def tasks_for(df: DataFrame, target_bytes: int, least: int = 1, factor: float = 1.0) -> int:
    """A number of partitions that follows the size the optimizer knows for df, or the
    number of its rows where it knows none (rows that came from Python)."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 60:
        size = df.count() * 4096
    return max(least, min(1 << 20, int(size * factor / target_bytes) + 1))


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch of texts holds, where the session sets no bound. The
    setting stays, as plans made here run after the call that made them."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(str(spark.conf.get(name)).rstrip("bB") or 0) > 8 << 20:
        spark.conf.set(name, str(8 << 20))


@functools.lru_cache(1)
def _trim_call():
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # no GNU C library: nothing to give back
        return lambda _: 0


def give_back() -> None:
    """Return freed memory of this worker to the system: workers live on between
    stages, and what the allocators keep counts against the executor."""
    pa.default_memory_pool().release_unused()
    _trim_call()(0)


def lean(run):
    """run, a function over Arrow data, that gives memory back after each result."""
    if inspect.isgeneratorfunction(run):

        def each(batches):
            for out in run(batches):
                yield out
                del out
                give_back()

        return each

    def once(*tables):
        out = run(*tables)
        give_back()
        return out

    # the number of arguments tells Spark what to pass
    return (lambda t: once(t)) if len(inspect.signature(run).parameters) == 1 else (lambda a, b: once(a, b))


def components(edges: DataFrame, label: str = "cc", plain: bool = False) -> DataFrame:
    """Connected components by alternating large-star and small-star steps.

    edges: (a, b) of one orderable type. Returns (node, root), root being the
    smallest node of the component; nodes that occur only in loops or beside a null
    are their own root or absent. Each round is written to the shared folder (plain: as
    in stored), and the number of rounds grows with the logarithm of the longest path.
    """
    edges = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull()).select("a", "b")
    now = stored(edges.where("a <> b").distinct(), label, plain)
    before = None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: neighbours above a node hang on the least of its neighbourhood
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: a node and its smaller neighbours hang on the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        step = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        now = stored(step.where("a <> b").distinct(), label, plain)
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


# vectorised hashing of words and character windows

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
MULT = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: a bijection that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE ** i and its inverse modulo 2 ** 64, for i < n at least."""
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, 1 << 16)
        for key, base in (("up", _BASE), ("down", _BASE_INV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[key] = np.multiply.accumulate(p)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def word_hashes(data: bytes, piece: int = 4 << 20) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash, end offset) of each word of data, in which one space (byte 32)
    follows every word. Worked off in pieces that end at a space, so that the
    temporary arrays stay small however long data is."""
    if len(data) > piece:
        hashes, ends, at = [], [], 0
        while at < len(data):
            to = len(data) if at + piece >= len(data) else data.rfind(b" ", at, at + piece) + 1
            if to <= at:
                to = data.index(b" ", at) + 1
            h, e = _word_hashes(data[at:to])
            hashes.append(h)
            ends.append(e + at)
            at = to
        return np.concatenate(hashes), np.concatenate(ends)
    return _word_hashes(data)


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    b = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(b == 32)
    up, down = powers(len(b) + 1)
    total = np.empty(len(b) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[b] * up[: len(b)], out=total[1:])
    starts = np.empty_like(ends)
    if len(ends):
        starts[0] = 0
        starts[1:] = ends[:-1] + 1
    return mix((total[ends] - total[starts]) * down[starts]), ends


def texts_to_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all texts, and how many each text has."""
    words = [t.lower().split() for t in texts]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    data = b" ".join(" ".join(w).encode("utf-8", "replace") for w in words if w)
    return word_hashes(data + b" " if data else b"")[0], counts


def chunks(texts: list[str], most: int, rows: int = 1 << 30):
    """(first, last) of runs of texts with about `most` characters and at most `rows`
    texts each; a longer text is a run of its own, whole."""
    at = size = 0
    for i, t in enumerate(texts):
        if i > at and (size + len(t) > most or i - at >= rows):
            yield at, i
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)
