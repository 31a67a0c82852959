"""Sources and sinks: a table registry, image files, patch datasets, dictionary checkpoints, run records.

Everything is read and written by Spark, so any file system that Spark knows will do.
"""

from __future__ import annotations

import io
import json
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, or, in a local session that names none, below one of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    base = base or "file://" + tempfile.mkdtemp(prefix="weftcode-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


IMAGES = "path string, id long, height int, width int, channels int, x array<double>"


class Registry:
    """Names of datasets and how they are read; an unknown or unsupported name is an error."""

    def __init__(self):
        self._readers: dict[str, Callable[[SparkSession], DataFrame]] = {}

    def add(self, name: str, reader: Callable[[SparkSession], DataFrame]) -> None:
        self._readers[name] = reader

    def add_table(self, name: str, path: str) -> None:
        self.add(name, lambda spark: spark.read.parquet(path))

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        if name not in self._readers:
            raise KeyError(f"no dataset {name}; there are {sorted(self._readers)}")
        return self._readers[name](spark)


def npy_arrays(data: bytes) -> list[np.ndarray]:
    """Images of one .npy file: (h, w), (h, w, c) or (images, h, w, c), as float."""
    a = np.load(io.BytesIO(data), allow_pickle=False).astype(np.float64)
    if a.ndim not in (2, 3, 4):
        raise ValueError(f"an array of shape {a.shape} is no image")
    return list(a) if a.ndim == 4 else [a]


def pgm_arrays(data: bytes) -> list[np.ndarray]:
    """The image of one binary PGM or PPM file."""
    parts, at = [], 0
    while len(parts) < 4:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        end = at
        while not data[end : end + 1].isspace():
            end += 1
        parts.append(data[at:end])
        at = end
    kind, w, h, top = parts[0], *map(int, parts[1:])
    if kind not in (b"P5", b"P6"):
        raise ValueError(f"{kind!r} is not supported")
    shape = (h, w) if kind == b"P5" else (h, w, 3)
    return [np.frombuffer(data, ">u2" if top > 255 else np.uint8, int(np.prod(shape)), at + 1).reshape(shape).astype(np.float64)]


#: Kinds of image files; each function takes a file's bytes and returns its images, (h, w) or (h, w, c).
FORMATS = {"npy": npy_arrays, "pgm": pgm_arrays, "ppm": pgm_arrays}


def read_images(spark: SparkSession, path: str, kind: str, parse: Callable[[bytes], list[np.ndarray]] | None = None) -> DataFrame:
    """One row per image in files of a kind; sizes may differ. id numbers the images of a file.

    parse reads files of a kind that isn't in FORMATS (MATLAB's, HDF5, a pickle that the caller trusts).
    """
    parse = parse or FORMATS.get(kind)
    if parse is None:
        raise NotImplementedError(f"images of kind {kind}")

    def kernel(batches):
        for b in batches:
            for where, data in zip(b.column(0).to_pylist(), b.column(1)):
                arrays = parse(data.as_py())
                yield pa.record_batch(
                    [
                        pa.array([where] * len(arrays)), pa.array(range(len(arrays)), pa.int64()), pa.array([a.shape[0] for a in arrays], pa.int32()),
                        pa.array([a.shape[1] for a in arrays], pa.int32()), pa.array([a.shape[2] if a.ndim == 3 else 1 for a in arrays], pa.int32()),
                        pa.array([a.ravel() for a in arrays], pa.list_(pa.float64())),
                    ],
                    names=["path", "id", "height", "width", "channels", "x"],
                )

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(kernel, IMAGES)


def save_patches(training: DataFrame, validation: DataFrame, path: str) -> None:
    """A patch dataset: two splits of one table."""
    both = training.withColumn("split", F.lit("training")).unionByName(validation.withColumn("split", F.lit("validation")))
    both.write.partitionBy("split").parquet(path)


def load_patches(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    both = spark.read.parquet(path)
    return tuple(both.filter(F.col("split") == s).drop("split") for s in ("training", "validation"))


def save_checkpoint(spark: SparkSession, path: str, iteration: int, dictionary: np.ndarray) -> None:
    """A dictionary as (s, phi), below its iteration; writing an iteration again replaces it."""
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(np.asarray(dictionary).reshape(len(dictionary), -1))]
    spark.createDataFrame(rows, "s int, phi array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/iteration={iteration}")


def newest_checkpoint(spark: SparkSession, path: str) -> tuple[int, np.ndarray]:
    """The last iteration and its dictionary; other iterations' files aren't read for the rows."""
    saved = spark.read.parquet(path)
    last = saved.agg(F.max("iteration")).first()[0]
    if last is None:
        raise FileNotFoundError(f"no checkpoint in {path}")
    rows = saved.filter(F.col("iteration") == last).select("s", "phi").collect()
    return int(last), np.array([r.phi for r in sorted(rows)])


def save_params(spark: SparkSession, path: str, params: dict) -> None:
    """Run parameters as one JSON document; what JSON has no form for is written as text."""
    spark.createDataFrame([(json.dumps(params, default=str, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_params(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def log_metrics(spark: SparkSession, path: str, iteration: int, metrics: dict[str, float]) -> None:
    """Append (iteration, metric, value) rows."""
    rows = [(iteration, k, float(v)) for k, v in metrics.items()]
    spark.createDataFrame(rows, "iteration long, metric string, value double").coalesce(1).write.mode("append").parquet(path)
