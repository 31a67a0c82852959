"""Online dictionary learning over a stream: an extension of the batch trainer.

Each micro-batch is coded with the dictionary of the batch before, its sufficient
statistics are added up, and the new dictionary is saved under the batch's id. A batch that is
replayed after a failure starts from the same predecessor and overwrites its own result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..operators import inference, learning
from ..sources import datasets


class OnlineLearner:
    def __init__(self, spark: SparkSession, path: str, start: np.ndarray, weight: float, step: float, code_iterations: int = 20):
        self.spark, self.path, self.start = spark, path, np.asarray(start, np.float64)
        self.weight, self.step, self.code_iterations = weight, step, code_iterations

    def before(self, batch_id: int) -> np.ndarray:
        """The dictionary that the batch starts from."""
        if batch_id == 0:
            return self.start
        saved = self.spark.read.parquet(self.path)
        last = saved.filter(saved.iteration < batch_id).agg({"iteration": "max"}).first()[0]
        if last is None:
            return self.start
        rows = saved.filter(saved.iteration == last).select("s", "phi").collect()
        return np.array([r.phi for r in sorted(rows)])

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        d = self.before(batch_id)
        if not batch.isEmpty():
            stats = learning.code_stats(inference.infer(batch, d, self.weight, self.code_iterations))
            d = learning.steepest(d, stats, self.step)
        datasets.save_checkpoint(self.spark, self.path, batch_id, d)

    def start_query(self, stream: DataFrame, checkpoint: str, **trigger):
        """Run over a stream of (id, x)."""
        writer: Callable = stream.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint)
        return (writer.trigger(**trigger) if trigger else writer).start()
