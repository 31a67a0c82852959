"""Helpers that several training-data operators share.

Intermediate tables are written as Parquet below the folder that the session
names in ``spark.checkpoint.dir``, so every executor sees them and a lost
executor costs only a re-read. Where the setting is absent a local session (tests)
gets a folder of our own, and a cluster an error: its executors share no local folder.

Results are read from such tables as they are used, so the tables stay until ``release`` deletes them.
"""

from __future__ import annotations

import ctypes
import json
import tempfile
import uuid
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words: space and the five ASCII controls 9 to 13.
SPACES = " \t\n\x0b\x0c\r"
#: The same as a Java regular expression.
SPACES_RE = r"[\x20\x09-\x0D]+"

#: Bytes of text that a kernel treats at a time (one longer text is treated alone).
JOINED = 1 << 18
U = np.uint64

#: Spark's setting for the bytes of an Arrow batch, which else holds up to 10,000 texts, and what load() makes of its default.
BATCH, BATCH_DEFAULT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", str(4 << 20)
#: Spark's setting for removing an execution's shuffle files at its end.
FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own_dir: str | None = None
_roots: list[str] = []
#: What kernels of a worker process remember between tasks.
_remembered: list = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    global _own_dir
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if _own_dir is None:
        _own_dir = "file://" + tempfile.mkdtemp(prefix="weftcode-shared-")
    return _own_dir


class Workspace:
    """Written tables of one run of an operator."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        small_batches(spark)
        self.root = f"{shared_dir(spark)}/weft-{uuid.uuid4().hex}"
        self._made = 0
        _roots.append(self.root)

    def path(self, name: str) -> str:
        self._made += 1
        return f"{self.root}/{self._made:03d}-{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return the frame that reads it back; files of its exchanges are freed once it is written."""
        where = self.path(name)
        before = self.spark.conf.get(FREE)
        self.spark.conf.set(FREE, "true")
        try:
            df.write.parquet(where)
        finally:
            self.spark.conf.set(FREE, before)
        out = self.spark.read.schema(df.schema).parquet(where)
        out._weft_path = where
        return out

    def part(self, what: DataFrame, name: str) -> DataFrame:
        """Write a small part of a table just written, in no more files than there are cores."""
        return self.table(what.coalesce(self.spark.sparkContext.defaultParallelism), name)

    def drop(self, *tables: DataFrame) -> None:
        """Delete written tables that no later step reads."""
        for t in tables:
            self.delete(t._weft_path)

    def keep_only(self, *tables: DataFrame) -> None:
        """Delete all tables but these."""
        kept = {t._weft_path for t in tables}
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        for f in path.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(path):
            if not any(f.getPath().toString().endswith(k.rpartition("/")[2]) for k in kept):
                self.delete(f.getPath().toString())

    def delete(self, where: str) -> None:
        delete(self.spark, where)


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of a few rows, as a literal of the plan: no Python worker makes it."""
    fields = [x.split() for x in schema.split(", ")]
    data = json.dumps([{name: v for (name, _), v in zip(fields, row)} for row in rows])
    struct = ", ".join(f"{name}: {kind}" for name, kind in fields)
    return spark.range(0, 1, 1, 1).select(F.inline(F.from_json(F.lit(data), f"array<struct<{struct}>>")))


def empty_table(spark: SparkSession, schema: str) -> DataFrame:
    """A table without rows; no Python worker makes it."""
    return spark.range(0).select(F.from_json(F.lit("{}"), schema).alias("row")).select("row.*")


def release(spark: SparkSession) -> None:
    """Delete all tables that operators have written so far; results that read them are gone after that."""
    while _roots:
        delete(spark, _roots.pop())


def delete(spark: SparkSession, where: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Let workers get texts in batches of a few megabytes, unless the session says otherwise."""
    if spark.conf.get(BATCH) == BATCH_DEFAULT:
        spark.conf.set(BATCH, BATCH_BYTES)


def trim() -> None:
    """Give a worker's freed memory back to the system: it is kept for other tasks."""
    pa.default_memory_pool().release_unused()
    if hasattr(ctypes.CDLL(None), "malloc_trim"):
        ctypes.CDLL(None).malloc_trim(0)


def remembered(make):
    """A function whose values a worker process keeps for its next tasks, until a frugal kernel starts there."""
    _remembered.append(cache(make))
    return _remembered[-1]


def forget() -> None:
    for make in _remembered:
        make.cache_clear()


def frugal(kernel):
    """A kernel that drops what others remember in its worker, and trims the worker's memory at its end."""

    def run(batches):
        forget()
        yield from kernel(batches)
        trim()

    return run


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as it lies; one of no more bytes than a single split may have is dealt over all cores."""
    small_batches(spark)
    where = f"{sf_dir}/{name}.parquet"
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    size = path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    split = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    df = spark.read.parquet(where)
    return df.repartition(spark.sparkContext.defaultParallelism) if size <= split else df


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def joined(batch, text_at: int):
    """Slices of an Arrow batch with about JOINED bytes of text each, and their texts as bytes."""
    texts = batch.column(text_at)
    begin, size, some = 0, 0, []
    for i in range(batch.num_rows):
        t = (texts[i].as_py() or "").encode()
        some.append(t)
        size += len(t)
        if size >= JOINED or i + 1 == batch.num_rows:
            yield batch.slice(begin, len(some)), some
            begin, size, some = i + 1, 0, []


def words_of(text):
    """Array of the words of a text column; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES_RE), lambda w: w != "")
