"""Alert delivery: to every registered channel of the rule, best effort."""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Send = Callable[[DataFrame], None]

logger = logging.getLogger(__name__)

LOG_SCHEMA = "batch long, channel string, delivered boolean, error string, at timestamp"


def route(alerts: DataFrame, registered: list[str]) -> DataFrame:
    """One row per alert and channel; channels nobody registered are skipped."""
    return alerts.withColumn("channel", F.explode("channels")).where(
        F.col("channel").isin(*registered) if registered else F.lit(False)
    )


def deliver(
    alerts: DataFrame, channels: Mapping[str, Send], log_path: str | None = None, batch: int = 0
) -> None:
    """Hand each channel its alerts; a channel that fails is logged and passed over.

    ``Send`` gets a DataFrame and decides how to write it, for instance with
    ``foreachPartition``.  Outcomes are appended to ``log_path``.
    """
    routed = route(alerts, list(channels)).persist()
    outcomes = []
    try:
        for name, send in channels.items():
            error = None
            try:
                send(routed.where(F.col("channel") == name))
            except Exception as failure:  # best effort: no channel may stop the pipeline
                error = f"{type(failure).__name__}: {failure}"
                logger.warning("channel %s failed: %s", name, error)
            outcomes.append((batch, name, error is None, error, datetime.now(timezone.utc)))
    finally:
        routed.unpersist()
    if log_path is not None and outcomes:
        log = alerts.sparkSession.createDataFrame(outcomes, LOG_SCHEMA)
        log.coalesce(1).write.mode("append").parquet(log_path)


def batch_writer(channels: Mapping[str, Send], log_path: str | None = None) -> Callable[[DataFrame, int], None]:
    """The same as a ``foreachBatch`` function for a stream of alerts."""
    return lambda alerts, batch: deliver(alerts, channels, log_path, batch)
