"""What several of these operators share: whole-text batches, hashing, and files in the shared folder."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import os
import tempfile
import time
import uuid
import weakref
from collections.abc import Callable, Iterable, Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import xxhash
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: White space of the word definition `[^\x20\x09-\x0D]+`; `bytes.split()` splits on exactly these.
WHITE = r"[\x20\x09-\x0D]+"

M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit words that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= M1
    x ^= x >> np.uint64(27)
    x *= M2
    x ^= x >> np.uint64(31)
    return x


class WordHashes(dict):
    """Word bytes to a 64-bit hash, remembered for up to `bound` distinct words of a task."""

    every: weakref.WeakValueDictionary[int, WordHashes] = weakref.WeakValueDictionary()

    def __init__(self, bound: int = 400_000):
        super().__init__()
        self.bound = bound
        self.every[id(self)] = self

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.bound:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """Whole values of a string column as UTF-8 bytes."""
    return column.cast(pa.large_binary()).to_pylist()


def release() -> None:
    """Give memory back to the system. A worker lives on after its task, idle or for another stage, and what it keeps is lost to the
    executor meanwhile: hashes are forgotten (they cost less than their memory), and free memory of Arrow and the C library is returned."""
    for hashes in list(WordHashes.every.values()):
        hashes.clear()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def releasing(work: Callable[[Iterator[pa.RecordBatch]], Iterable]) -> Callable[[Iterator[pa.RecordBatch]], Iterator]:
    """`work` on the batches of a task, with `release` at its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator:
        try:
            yield from work(batches)
        finally:
            release()

    return run


def map_batches(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterable[dict | pa.RecordBatch]], schema: str) -> DataFrame:
    """`mapInArrow` where `work` may yield dicts of columns in the order of `schema`."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in work(batches):
            if isinstance(out, dict):
                out = pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type, from_pandas=False) for f in target], schema=target)
            if out.num_rows:
                yield out

    return df.mapInArrow(releasing(run), schema)


def shared_path(spark: SparkSession, prefix: str) -> str:
    """A new folder below `spark.checkpoint.dir`, as a path that driver and executors can open and map.

    Where the setting is absent (tests, local mode) a temporary folder is set as checkpoint directory.
    Memory mapping needs a mounted file system, so another scheme than `file` is an error and not a silent local copy.
    """
    url = urlparse(scratch(spark, prefix))
    if url.scheme not in ("", "file"):
        raise ValueError(f"memory-mapped files need a mounted shared folder in spark.checkpoint.dir, not {url.geturl()}")
    os.makedirs(url.path)
    return url.path


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; set to a temporary one only where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        jsc = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jsc.isDefined():
            return jsc.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(base)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return base


#: Rows whose aggregate is one task's work.
ROWS_A_TASK = 25_000


def few(aggregate: DataFrame, rows: int | None) -> DataFrame:
    """An aggregate of so many rows in no more tasks than they are worth, however many partitions a shuffle has (as it is, if their number
    is not known). Every task and file costs the driver memory, whatever there is in it."""
    return aggregate if rows is None else aggregate.coalesce(1 + rows // ROWS_A_TASK)


#: Seconds between two times that the driver gives memory back.
PAUSE = 5.0
_GIVEN_BACK = [0.0]


def give_back(spark: SparkSession) -> None:
    """Give the driver's memory back to the system, at most every PAUSE seconds. A chain of many small queries leaves little that lives, but the
    heap grows by what each one drops, and the C library keeps what compilers and threads freed. Where a Java machine cannot trim, it only collects."""
    if time.monotonic() - _GIVEN_BACK[0] < PAUSE:
        return
    jvm, array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    jvm.System.gc()
    with contextlib.suppress(Py4JError):
        beans = jvm.java.lang.Class.forName("javax.management.MBeanServer")  # the server's own class is not open to reflection
        invoke = next(m for m in beans.getMethods() if m.getName() == "invoke")
        given = array(jvm.Object, 4)
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        given[2], given[3] = array(jvm.Object, 0), array(jvm.String, 0)
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    _GIVEN_BACK[0] = time.monotonic()


def cut(df: DataFrame, **sums: Column) -> DataFrame:
    """Cut the lineage: write the rows as a table in the shared folder and read it from there. Its rows are counted on the way, and further
    aggregates of them are kept in `seen` by name. Without a mark of success, which a local folder lets the driver start processes for."""
    path, seen = scratch(df.sparkSession, "rows"), Observation()
    marked = df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(name) for name, c in sums.items()])
    marked.write.option("compression", "zstd").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    give_back(df.sparkSession)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.seen = seen.get
    table.written_rows = table.seen["rows"]
    return table


def renamed(table: DataFrame, *columns: str | Column) -> DataFrame:
    """Columns of a written table; its number of rows stays known."""
    out = table.select(*columns)
    out.written_rows = rows_of(table)
    return out


def rows_of(table: DataFrame) -> int:
    """Number of rows; known for a table as `cut` returns it, else counted."""
    return table.written_rows if hasattr(table, "written_rows") else table.count()


def small(table: DataFrame, most: int) -> DataFrame:
    """A table that is written first, and marked for sending to all tasks if it has at most `most` rows; beyond, it is joined by shuffle."""
    table = table if hasattr(table, "written_rows") else cut(table)
    return F.broadcast(table) if rows_of(table) <= most else table


def attach(rows: DataFrame, table: DataFrame, key: str, most: int, how: str = "inner", parts: int = 32) -> DataFrame:
    """`rows` with the columns of a written table by `key`, a column of both (null keys never match).

    With at most `most` rows the table is sent to all tasks. Beyond, both sides are shuffled by the key and a part: each row falls to one
    of `parts` parts in turn and the table is repeated for each, so no key brings more than a part of its rows to one task.
    """
    if rows_of(table) <= most:
        return rows.join(F.broadcast(table), key, how)
    part = private(rows, "__part")
    repeated = table.withColumn(part, F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    dealt = rows.withColumn(part, F.pmod(F.monotonically_increasing_id(), F.lit(parts)).cast("int"))
    return dealt.join(repeated, [key, part], how).drop(part)


#: A key is hot if more than one in so many rows have it, so there are at most as many hot keys.
HOT = 10_000


def join_weighted(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """Inner join of two written tables. `table` has each key once, with the number of `rows` that have it in `weight`, `total` in all.

    Rows with a hot key stay where they are and meet the few hot keys, which are sent to all tasks; the others are shuffled by key.
    """
    hot = table.where(F.col(weight) > total / HOT)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(table.where(F.col(weight) <= total / HOT), keys)
    return rows.join(F.broadcast(hot), keys).unionByName(rest)


_PATHS: list[str] = []


def scratch(spark: SparkSession, prefix: str) -> str:
    """A new path in the shared folder. Results are lazy, so what is written there stays for the life of the driver and goes at its end."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{prefix}-{uuid.uuid4().hex}"
    if not _PATHS:
        atexit.register(_drop)
    _PATHS.append(path)
    return path


def _drop() -> None:
    spark = SparkSession.getActiveSession()
    if spark is None or spark.sparkContext._jsc is None:
        return
    for path in _PATHS:
        try:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session is gone; files in a scratch folder are not worth failing an exit for
            return


def write_whole(path: str, data: bytes | np.ndarray) -> None:
    """Write a file that appears whole or not at all, so that a task that runs twice does no harm."""
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as out:
        out.write(memoryview(np.ascontiguousarray(data)).cast("B") if isinstance(data, np.ndarray) and data.size else bytes(data))
    os.replace(part, path)


def mapped(path: str, dtype: str) -> np.ndarray:
    """A memory-mapped array; an empty file gives an empty array."""
    return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.empty(0, dtype)


def private(df: DataFrame, name: str) -> str:
    """A column name that `df` does not have."""
    while name in df.columns:
        name += "_"
    return name


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Deal rows out evenly by content; equal rows may meet, a hot key does not."""
    return df.repartition(F.xxhash64(*columns))


def slices(lengths: np.ndarray) -> np.ndarray:
    """Start of each slice and the end of the last."""
    return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated aranges: start, start + 1, ... for every slice."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    at = slices(lengths)[:-1]
    return np.arange(total, dtype=np.int64) + np.repeat(starts - at, lengths)
