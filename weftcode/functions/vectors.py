"""Fixed-length vectors in DataFrames: array columns, long form, numpy kernels.

A vector is an ``array<double>``; the long form has one row (id, i, x) per component.
Kernels see whole Arrow batches as matrices, a row per vector. A null vector, a null
component or a wrong length is an error, not a guess.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def vectors(df: DataFrame, id_col: str, vector_col: str, scale: float = 1.0) -> DataFrame:
    """(id, x array<double>), optionally scaled."""
    x = F.transform(F.col(vector_col), lambda v: v.cast("double") * F.lit(scale) if scale != 1.0 else v.cast("double"))
    return df.select(F.col(id_col).alias("id"), x.alias("x"))


def to_long(df: DataFrame, vector_col: str = "x") -> DataFrame:
    """(id, i, x): one row per component."""
    return df.select("id", F.posexplode(vector_col).alias("i", "x"))


def from_long(df: DataFrame) -> DataFrame:
    """Inverse of to_long."""
    return df.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("x"))


def literal(values) -> F.Column:
    """A driver-side vector as one array literal (an expression a component would make plans of its length)."""
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


def batch_matrix(column) -> np.ndarray:
    """An Arrow list column as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        raise ValueError("a vector is null")
    flat = column.flatten()
    if flat.null_count:
        raise ValueError("a component is null")
    sizes = np.diff(np.asarray(column.offsets))
    if len(sizes) and (sizes != sizes[0]).any():
        raise ValueError("vectors differ in length")
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(sizes), -1)


def matrix_batch(m: np.ndarray, item=None) -> pa.Array:
    """A matrix as an Arrow list column."""
    m = np.asarray(m, np.float64)
    offsets = np.arange(0, m.size + 1, m.shape[1] or 1, dtype=np.int32) if m.shape[1] else np.zeros(len(m) + 1, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(m.ravel()))


def sliced(batches, at: list[int], most: int = 1 << 22):
    """Slices of Arrow batches with at most so many components, so that what a kernel makes of one stays small."""
    for b in batches:
        size = max([1, *(len(b.column(i).flatten()) // max(1, b.num_rows) for i in at)])
        step = max(1, most // size)
        for k in range(0, b.num_rows, step):
            yield b.slice(k, step)


def apply_rows(df: DataFrame, ins: list[str], outs: list[str], fn: Callable[..., tuple]) -> DataFrame:
    """Add array columns ``outs``: fn gets a matrix per input column and returns a matrix per output."""
    at = [df.columns.index(c) for c in ins]
    kept = [i for i, c in enumerate(df.columns) if c not in outs]
    names = [df.columns[i] for i in kept] + outs
    fields = [df.schema.fields[i] for i in kept] + [T.StructField(c, T.ArrayType(T.DoubleType())) for c in outs]

    def kernel(batches):
        for b in sliced(batches, at):
            if b.num_rows:
                got = fn(*(batch_matrix(b.column(i)) for i in at))
                got = got if isinstance(got, tuple) else (got,)
                yield pa.record_batch([*(b.column(i) for i in kept), *map(matrix_batch, got)], names=names)

    return df.mapInArrow(kernel, T.StructType(fields))


#: Blocks that are left after each round of adding up tasks' matrices.
ROUNDS = (256, 16)
BLOCK = "name string, height long, data binary, slot long"


def sum_matrices(df: DataFrame, ins: list[str], fn: Callable[..., dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """Sums over all rows of what fn returns for a batch: {name: matrix}.

    Each task adds up its batches and emits one block of bytes for each matrix; blocks are added up in rounds of
    tasks, so the driver gets 16 of a name at most, however many rows or tasks there are.
    """

    def added(total: dict, name: str, m: np.ndarray) -> None:
        total[name] = total[name] + m if name in total else m

    def blocks(total: dict[str, np.ndarray]):
        slot = TaskContext.get().partitionId()
        for k, m in total.items():
            yield pa.record_batch([pa.array([k]), pa.array([len(m)]), pa.array([m.tobytes()], pa.binary()), pa.array([slot])], names=["name", "height", "data", "slot"])

    def first(batches):
        total: dict[str, np.ndarray] = {}
        for b in sliced(batches, list(range(len(ins)))):
            if b.num_rows:
                for k, m in fn(*(batch_matrix(b.column(i)) for i in range(len(ins)))).items():
                    added(total, k, np.atleast_2d(np.asarray(m, np.float64)))
        yield from blocks(total)

    def again(batches):
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for k, height, data in zip(*(b.column(i).to_pylist() for i in range(3))):
                added(total, k, np.frombuffer(data).reshape(height, -1))
        yield from blocks(total)

    parts = df.select(*ins).mapInArrow(first, BLOCK)
    for most in ROUNDS:
        parts = parts.repartition(F.pmod("slot", F.lit(most))).mapInArrow(again, BLOCK)
    out: dict[str, np.ndarray] = {}
    for r in parts.collect():
        added(out, r.name, np.frombuffer(r.data).reshape(r.height, -1))
    return out


def matrix_table(spark, m: np.ndarray, row: str = "i", column: str = "j", value: str = "v", digits: int | None = None) -> DataFrame:
    """A driver-side matrix as a small table."""
    m = np.atleast_2d(m)
    rows = [(int(a), int(b), float(m[a, b])) for a in range(m.shape[0]) for b in range(m.shape[1])]
    out = spark.createDataFrame(rows, f"{row} int, {column} int, {value} double")
    return out if digits is None else out.withColumn(value, F.round(value, digits))
