"""Alert rules on a stream: per rule, the time it may fire again is state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timestamps import micros
from ..operators.alerts import Rule, evaluate_rules
from ..session import temporary_tables
from .anomaly import Sink
from .state import BatchState


def alert_writer(
    rules: Sequence[Rule],
    sink: Sink,
    state_path: str,
    timestamp: str = "timestamp",
    order_by: Sequence[str] | str | None = None,
) -> Sink:
    """A ``foreachBatch`` function that evaluates the rules and hands on the alerts.

    Entries older than a rule's last fire are suppressed with those inside its
    cooldown.  ``sink`` gets the alerts of a batch and its number; for channels
    use :func:`cairnlog.sinks.delivery.batch_writer`.
    """
    state = BatchState(state_path)

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            with temporary_tables(batch.sparkSession):
                before = state.before(batch.sparkSession, number)
                # One row per rule that ever fired.
                ready = {} if before is None else {r.rule_no: r.ready for r in before.collect()}
                alerts = evaluate_rules(batch, rules, timestamp, order_by, ready=ready).persist()
                sink(alerts, number)
                state.save(_ready_after(alerts, rules, ready), number)
                alerts.unpersist()
        finally:
            batch.unpersist()

    return write


def _ready_after(alerts: DataFrame, rules: Sequence[Rule], ready: dict[int, int]) -> DataFrame:
    cooldowns = F.array(*[F.lit(rule.cooldown_micros) for rule in rules])
    fired = alerts.where("fired_at IS NOT NULL").groupBy("rule_no").agg(F.max(micros(F.col("fired_at"))).alias("last"))
    new = fired.select("rule_no", (F.col("last") + F.get(cooldowns, F.col("rule_no"))).alias("ready"))
    old = alerts.sparkSession.createDataFrame(list(ready.items()), "rule_no int, ready long")
    return old.unionByName(new).groupBy("rule_no").agg(F.max("ready").alias("ready"))
