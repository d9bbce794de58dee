"""Custom aggregators and outputs supplied by the caller."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Any, Protocol

import pandas as pd
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fields import field, is_log_frame
from ..session import ship_package


# States of a key merge into this many slots, round after round.
MERGE_SLOTS = (4096, 64, 1)
#: Keys whose states a task holds before it passes them on and starts anew.
HELD_KEYS = 10_000

_STATES = "slot long, state binary"


class Aggregator(Protocol):
    """``add`` takes one entry, ``merge`` another aggregator's state, ``result`` ends it.

    An aggregator may have ``add_batch`` as well, which takes a pandas DataFrame of
    entries (the columns of a table; the column ``fields`` of a log frame) and is
    then called in place of ``add``.
    """

    def add(self, entry: dict[str, Any]) -> None: ...

    def merge(self, other: Any) -> None: ...

    def result(self) -> dict[str, Any]: ...


def aggregate(df: DataFrame, make: Callable[[], Aggregator], schema: str, by: Sequence[str] = ()) -> DataFrame:
    """Run a Python aggregator over all entries; one row of its result for each value of ``by``.

    Keys are texts of fields, named like them and put before the columns of
    ``schema``; without ``by`` there is one row, also of no entries.  Every task
    folds its own entries, key by key, and the states of a key merge in rounds by
    the tasks they come from: no task has to read all entries of a key, or of
    all.  An aggregator that is a function of DataFrames needs none of this: call
    it.
    """
    ship_package(df.sparkSession)
    keys = [f"_key{i}" for i in range(len(by))]
    named = [field(df, name).alias(key) for name, key in zip(by, keys, strict=True)]
    held = ["fields"] if is_log_frame(df) else df.columns
    kinds = "".join(f"{key} string, " for key in keys)
    states = df.select(*named, *held).mapInPandas(_fold(make, keys, is_log_frame(df)), kinds + _STATES)
    if not by:
        # A fresh state, so that there is one where no task had an entry.
        fresh = [(0, bytearray(cloudpickle.dumps(make())))]
        states = states.unionByName(df.sparkSession.createDataFrame(fresh, _STATES))
    for slots in MERGE_SLOTS:
        slot = F.pmod(F.col("slot"), F.lit(slots)).cast("long")
        states = states.withColumn("slot", slot).groupBy(*keys, "slot").applyInPandas(_merge, kinds + _STATES)
    ended = states.select(*keys, "state").mapInPandas(_finish(keys), kinds + schema)
    return ended.withColumnsRenamed(dict(zip(keys, by, strict=True)))


def _fold(
    make: Callable[[], Aggregator], keys: list[str], log_frame: bool
) -> Callable[[Iterable[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, Aggregator] = {}
        for batch in batches:
            for key, rows in _groups(batch, keys):
                aggregator = held.get(key)
                if aggregator is None:
                    aggregator = held[key] = make()
                if hasattr(aggregator, "add_batch"):
                    aggregator.add_batch(rows)
                else:
                    for entry in rows["fields"] if log_frame else rows.astype(object).where(rows.notna(), None).to_dict("records"):
                        aggregator.add(dict(entry))
            if len(held) > HELD_KEYS:
                yield _states(held, keys)
                held = {}
        yield _states(held, keys)

    return run


def _groups(batch: pd.DataFrame, keys: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    if not keys:
        yield (), batch
        return
    for key, rows in batch.groupby(keys, sort=False):
        yield key, rows.drop(columns=keys)


def _states(held: dict[tuple, Aggregator], keys: list[str]) -> pd.DataFrame:
    task = TaskContext.get().partitionId()
    rows = [(*key, task, cloudpickle.dumps(aggregator)) for key, aggregator in held.items()]
    return pd.DataFrame(rows, columns=[*keys, "slot", "state"])


def _merge(group: pd.DataFrame) -> pd.DataFrame:
    first, *others = (pickle.loads(state) for state in group["state"])
    for other in others:
        first.merge(other)
    return group.iloc[:1].assign(state=[cloudpickle.dumps(first)])


def _finish(keys: list[str]) -> Callable[[Iterable[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [pickle.loads(state).result() for state in batch["state"]]
            yield pd.concat([batch[keys].reset_index(drop=True), pd.DataFrame(rows)], axis=1)

    return run


def write_custom(df: DataFrame, render: Callable[[list[dict[str, Any]]], str], path: str) -> None:
    """Write text rendered by the caller from batches of entries, in parallel."""
    ship_package(df.sparkSession)
    whole_entry = F.col("fields") if is_log_frame(df) else F.struct(*df.columns)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            text = render([dict(e) for e in batch["entry"]])
            yield pd.DataFrame({"value": [text]})

    df.select(whole_entry.alias("entry")).mapInPandas(run, "value string").write.text(path)
