"""State between micro-batches, kept as a table in the shared folder."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class BatchState:
    """What batch n leaves for batch n + 1.

    Two folders take turns.  A batch reads its predecessor's and writes its own,
    so running a batch again after a failure finds the same state and gives the
    same result.
    """

    path: str

    def before(self, spark: SparkSession, batch: int) -> DataFrame | None:
        return spark.read.parquet(self._slot(batch - 1)) if batch > 0 else None

    def save(self, state: DataFrame, batch: int) -> None:
        state.write.mode("overwrite").parquet(self._slot(batch))

    def _slot(self, batch: int) -> str:
        return f"{self.path}/slot{batch % 2}"
