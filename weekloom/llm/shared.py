"""What several operators of this package share: written intermediate tables,
word and shingle hashing, connected components, and pivot pairs."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import suppress
from itertools import chain, pairwise
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but these six; ``bytes.split()`` cuts at the same ones.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of an Arrow batch under ``bound_batches``.
BATCH_BYTES = 2 << 20

#: Seconds between two looks for shuffle files that nothing needs.
RELEASE_S = 4.0

_last: dict[str, float] = {}
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_own_dirs: dict[str, str] = {}
_kept: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (``spark.checkpoint.dir``).

    Only a local master may run without the setting; it then gets a folder of its own."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not (spark.sparkContext.master or "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="weekloom-")
    return _own_dirs[app]


def bound_batches(spark: SparkSession) -> None:
    """Jobs of this session send at most BATCH_BYTES to Python at a time, unless the session asks for less: texts and sets may be long,
    and the JVM and the worker each hold a batch more than once."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    found = re.fullmatch(r"(\d+)b?", spark.conf.get(key).strip().lower())
    if not found or not 0 < int(found[1]) <= BATCH_BYTES:
        spark.conf.set(key, BATCH_BYTES)


def _trim() -> None:
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # glibc alone has it
        ctypes.CDLL(None).malloc_trim(0)


def tidy(task: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``task``, giving its memory back at its end: workers outlive tasks, and idle ones would keep what the last task took."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from task(batches)
        finally:
            _trim()

    return run


def _release(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished jobs: Spark removes them when the driver's JVM finds their plans unreachable, which
    it may not look for in a long time."""
    now = time.monotonic()
    if now - _last.get("gc", 0.0) >= RELEASE_S:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        _last["gc"] = time.monotonic()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    It cuts the lineage: a lost executor costs no recomputation of what stands before. The application's
    folder goes when its driver ends."""
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/weekloom-{spark.sparkContext.applicationId}"
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    if folder not in _kept:
        _kept.add(folder)
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    bound_batches(spark)
    df.write.parquet(path)
    _release(spark)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing reads any more."""
    for df in tables:
        path = _paths.pop(df)
        spark = df.sparkSession
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class WordHashes(dict):
    """64-bit hash of each word seen so far; forgets all when it holds ``most``."""

    def __init__(self, most: int = 150_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values: the multiply-xorshift rounds of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hashes_of(words: Iterable[list[bytes]], cache: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word, list after list, and where each list begins, with the end of the last."""
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in words])]).astype(np.int64)
    return np.fromiter(map(cache.__getitem__, chain.from_iterable(words)), dtype=np.uint64, count=int(bounds[-1])), bounds


def ngram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of k words, in order; of the whole sequence if it is shorter."""
    n = len(words)
    if n == 0:
        return words
    width = min(k, n)
    h = np.zeros(n - width + 1, dtype=np.uint64)
    for i in range(width):
        h = mix(h + words[i : n - width + 1 + i])
    return h


def shingle_sets(texts: list[bytes | None], k: int, cache: WordHashes) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles, words lower-cased (A-Z)."""
    words, bounds = hashes_of([t.lower().split() if t else [] for t in texts], cache)
    grams = ngram_hashes(words, k)  # those that reach into the next text are not used
    return [np.unique(grams[a : b - k + 1] if b - a >= k else ngram_hashes(words[a:b], k)) for a, b in pairwise(bounds.tolist())]


def connected_components(edges: DataFrame, name: str, most_rounds: int = 60) -> DataFrame:
    """Components of the undirected ``edges(a, b)`` as ``(id, component)``, component the smallest id.

    Alternates large-star and small-star steps until the edges are stars, each round written to the
    shared folder. One number a round reaches the driver."""

    def linked(df: DataFrame) -> DataFrame:
        return df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")

    def settled(df: DataFrame) -> bool:
        """Each larger end has one edge, and is the smaller end of none."""
        ends = df.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(df.select("b", F.lit(0), F.lit(1)))
        return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").isEmpty()

    now = materialize(linked(edges).distinct(), f"{name}-edges")
    for i in range(most_rounds):
        if settled(now):
            break
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = linked(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b")))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(low.select("a", F.col("m").alias("b")))
        now = materialize(linked(small).distinct(), f"{name}-star{i}")
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    found = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return found.unionAll(found.select(F.col("component").alias("id"), "component").distinct())
