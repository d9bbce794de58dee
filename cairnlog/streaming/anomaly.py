"""Anomaly scores on a stream: per key, the statistics of all earlier batches are state."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame

from ..operators.anomaly import MIN_SAMPLES, THRESHOLD, score_anomalies, totals_of
from ..session import temporary_tables
from .state import BatchState

Sink = Callable[[DataFrame, int], None]


def anomaly_writer(
    name: str,
    sink: Sink,
    state_path: str,
    order_by: Sequence[str] | str | None = None,
    partition_by: Sequence[str] = (),
    threshold: float = THRESHOLD,
    min_samples: int = MIN_SAMPLES,
) -> Sink:
    """A ``foreachBatch`` function that scores each entry against all earlier ones.

    Inside a micro-batch entries are taken in their order, between batches as
    they arrive.  It is the batch operator with the earlier totals in front, so
    a key that fills the batch is spread over tasks as it is there.  ``sink``
    gets the scored batch and its number, which makes a repeated write safe.
    """
    state = BatchState(state_path)

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            with temporary_tables(batch.sparkSession):
                prior = state.before(batch.sparkSession, number)
                scored = score_anomalies(batch, name, threshold, min_samples, order_by, partition_by, prior=prior)
                sink(scored, number)
                state.save(totals_of(batch, name, partition_by, prior), number)
        finally:
            batch.unpersist()

    return write
