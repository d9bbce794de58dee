"""Alert rules: which entries match, and which matches fire given a cooldown.

A rule fires on a match at least ``cooldown`` seconds of event time after its
last fire.  Whether a match fires depends on the one before, so the decision is
a chain along time.  It is made on distinct match times only, and where a rule
has more of them than one task should hold, the time axis is cut: see
:func:`fire_times`.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fields import LINE_ORDER, order_columns, row_hash
from ..functions.text import pinned
from ..functions.timestamps import micros
from ..session import broadcast_if_small, settle, ship_package
from .blocks import earliest
from .predicates import Predicate, condition, entry_time


@dataclass(frozen=True)
class Rule:
    """A named condition, its cooldown in seconds (0: every match) and its channels."""

    name: str
    when: Predicate
    cooldown: float = 60.0
    channels: tuple[str, ...] = ()

    @property
    def cooldown_micros(self) -> int:
        return round(self.cooldown * 1_000_000)


def match_rules(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One row per entry and rule it matches, with the rule's number and name."""
    hits = [
        F.when(condition(df, rule.when), F.struct(F.lit(i).alias("rule_no"), F.lit(rule.name).alias("rule")))
        for i, rule in enumerate(rules)
    ]
    matched = F.filter(F.array(*hits), lambda hit: hit.isNotNull())
    return df.select("*", F.explode(matched).alias("_hit")).select(*df.columns, "_hit.rule_no", "_hit.rule")


def evaluate_rules(
    df: DataFrame,
    rules: Sequence[Rule],
    timestamp: str = "timestamp",
    order_by: Sequence[str] | str | None = None,
    blocks: int | None = None,
    ready: Mapping[int, int] | None = None,
) -> DataFrame:
    """The alerts: entries that fire a rule, with rule_no, rule, fired_at, channels.

    Entries of equal time count in their order.  An entry without a time cannot
    be inside a cooldown, so it fires.  ``ready`` tells, by rule number, from
    which time (in microseconds) on a rule that fired earlier may fire again.
    The order need not be unique and may hold NULLs: of entries equal in time and
    order one fires (by a hash of its columns); only entries equal in every
    column count as one and fire together.

    The entries are read twice, whatever the rules: once for the match times, and
    once to pick those that fire.
    """
    order = order_columns(df, order_by)
    hits = match_rules(df, rules)
    cooldowns = F.array(*[F.lit(rule.cooldown_micros) for rule in rules])
    # Pinned, or each mention below would parse the time again.
    stamped = hits.withColumn("fired_at", pinned(entry_time(hits, timestamp)))
    stamped = stamped.withColumn("_t", micros(F.col("fired_at"))).withColumn("_cooldown", F.get(cooldowns, F.col("rule_no")))
    keys = list(order)
    if tuple(order) != LINE_ORDER:
        stamped, keys = stamped.withColumn("_tie", row_hash(df)), [*order, "_tie"]
    always = (F.col("_cooldown") == 0) | F.col("_t").isNull()
    fired = stamped
    if any(rule.cooldown_micros for rule in rules):
        # The first entry of every distinct match time; partial aggregation
        # folds a crowded instant before anything is shuffled.
        held = stamped.where(~always).select("rule_no", "_t", "_cooldown", *keys)
        ticks = settle(earliest(held, ["rule_no", "_t", "_cooldown"], keys, "_first"))
        known = ticks
        if ready:
            cooling = [(F.col("rule_no") == no) & (F.col("_t") < at) for no, at in ready.items()]
            known = known.where(~reduce(or_, cooling))
        fires = settle(fire_times(known.select("rule_no", "_t", "_cooldown"), blocks))
        firing = known.join(fires, ["rule_no", "_t"])
        firing = firing.select(*[F.col(c).alias(f"_f_{c}") for c in ("rule_no", "_t")], *[F.col(f"_first.{c}").alias(f"_f_{c}") for c in keys])
        firing = broadcast_if_small(firing, fires.count(), row_bytes=64 + 256 * len(keys))
        same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_f_{c}")) for c in ("rule_no", "_t", *keys)])
        fired = stamped.join(firing, same, "left").where(always | F.col("_f_rule_no").isNotNull())
    channels = F.array(*[_names(rule.channels) for rule in rules])
    fired = fired.select(*df.columns, "rule_no", "rule", "fired_at")
    return fired.withColumn("channels", F.get(channels, F.col("rule_no")))


def _names(names: Sequence[str]) -> Column:
    return F.array(*[F.lit(n) for n in names]).cast("array<string>")


def fired_rules(alerts: DataFrame, order_by: Sequence[str] | str | None = None) -> DataFrame:
    """Per entry that fired anything, the names of its rules in the rules' order."""
    order = order_columns(alerts, order_by)
    # At most one row per rule in a group.
    pairs = F.array_sort(F.collect_list(F.struct("rule_no", "rule")))
    return alerts.groupBy(*order).agg(F.transform(pairs, lambda p: p["rule"]).alias("rules"))


def fire_times(ticks: DataFrame, blocks: int | None = None) -> DataFrame:
    """Which of the match times (rule_no, _t, _cooldown; distinct) fire: (rule_no, _t).

    Every time points to the next one at least a cooldown later; the fires are the
    times that a rule's first one leads to.  Times are dealt in blocks of their
    order.  Inside a block pointers are followed at once, so a block is left with
    the times at which an earlier block can enter it, those of its first cooldown,
    each with the time from which on the rule may fire again.  The entries of all
    blocks are linked, and the links are doubled by joins until they lead nowhere:
    a number of rounds logarithmic in the blocks, for all rules together.  However
    the times lie, a task holds one block.  ``blocks`` defaults to the session's
    shuffle partitions.
    """
    ship_package(ticks.sparkSession)
    order = ["rule_no", "_t"]
    spread = ticks.repartitionByRange(blocks, *order) if blocks else ticks.repartitionByRange(*order)
    dealt = settle(spread.withColumn("block", F.spark_partition_id()))
    inside = dealt.groupBy("rule_no", "block")
    entries = settle(inside.applyInPandas(_entries, "rule_no int, block int, _t long, ready long"))
    marked = settle(entries.groupBy("rule_no").agg(F.min("_t").alias("_t")))
    links = settle(_linked(entries, blocks))
    while not links.isEmpty():
        # the fires known so far lead to as many more; at most one entry a rule and block is ever marked
        ahead = links.join(F.broadcast(marked), order).select("rule_no", F.col("then").alias("_t"))
        marked = settle(marked.unionByName(ahead))
        further = links.select("rule_no", F.col("_t").alias("then"), F.col("then").alias("after"))
        links = settle(links.join(further, ["rule_no", "then"]).select("rule_no", "_t", F.col("after").alias("then")))
    entered = entries.join(F.broadcast(marked), order, "left_semi").select("rule_no", "block", F.col("_t").alias("entry"))
    return dealt.join(F.broadcast(entered), ["rule_no", "block"]).groupBy("rule_no", "block").applyInPandas(_fires, "rule_no int, _t long")


def _linked(entries: DataFrame, blocks: int | None) -> DataFrame:
    """(rule_no, _t, then): for each entry the first entry of any block at which its rule may fire again.

    Entries and the times they wait for are dealt together in ranges; what a range
    does not answer is answered by the first entry of the ranges after it.
    """
    kinds = [("_t", 1), ("ready", 0)]
    both = reduce(DataFrame.unionByName, [entries.select("rule_no", F.col(c).alias("at"), F.lit(k).alias("kind")) for c, k in kinds]).distinct()
    order = ["rule_no", "at", "kind"]
    spread = both.repartitionByRange(blocks, *order) if blocks else both.repartitionByRange(*order)
    dealt = settle(spread.withColumn("part", F.spark_partition_id()))
    entry = F.when(F.col("kind") == 1, F.col("at"))
    firsts = dealt.groupBy("rule_no", "part").agg(F.min(entry).alias("first"))
    later = Window.partitionBy("rule_no").orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    firsts = settle(firsts.withColumn("first", F.min("first").over(later)))
    own = Window.partitionBy("rule_no", "part").orderBy(F.desc("at"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    found = dealt.withColumn("own", F.min(entry).over(own)).where("kind = 0").join(F.broadcast(firsts), ["rule_no", "part"])
    found = found.select("rule_no", F.col("at").alias("ready"), F.coalesce("own", "first").alias("then")).where("then IS NOT NULL")
    return entries.join(found, ["rule_no", "ready"]).select("rule_no", "_t", "then")


def following(times: np.ndarray, cooldown: int) -> np.ndarray:
    """The position each ascending time points to; the number of times where none is late enough."""
    return np.searchsorted(times, times + cooldown)


def _entries(group: pd.DataFrame) -> pd.DataFrame:
    """The times of a block's first cooldown and the next one, each with the time its last fire in the block waits for."""
    times, cooldown = np.sort(group["_t"].to_numpy()), int(group["_cooldown"].iloc[0])
    n = len(times)
    last, leads = np.arange(n + 1), np.append(following(times, cooldown), n)
    while (leads[:n] < n).any():  # as many steps at once as were made before
        last = np.where(leads < n, last[leads], last)
        leads = leads[leads]
    first = min(int(np.searchsorted(times, times[0] + cooldown)) + 1, n)
    return pd.DataFrame(
        {"rule_no": group["rule_no"].iloc[0], "block": group["block"].iloc[0], "_t": times[:first], "ready": times[last[:first]] + cooldown}
    )


def _fires(group: pd.DataFrame) -> pd.DataFrame:
    """The fires of a block that is entered at a known time."""
    times = np.sort(group["_t"].to_numpy())
    leads = following(times, int(group["_cooldown"].iloc[0])).tolist()
    at, fired = int(np.searchsorted(times, group["entry"].iloc[0])), []
    while at < len(times):
        fired.append(at)
        at = leads[at]
    return pd.DataFrame({"rule_no": group["rule_no"].iloc[0], "_t": times[fired]})
