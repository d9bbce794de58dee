"""Packing of token sequences: shortest-pack-first over the histogram of lengths.

Documents become pieces of at most ``capacity`` ids.  Only the histogram of the
pieces' lengths (``capacity`` numbers, whatever the corpus) goes to the driver.
There lengths are placed longest first, each into the packs that are shortest so
far, as counts of patterns and not piece by piece.  A piece then finds its place
from its length and its rank among the pieces of that length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import settle
from .common import HIDDEN, fresh_names, lean, partitions, slices, text_or_empty, with_fields
from .tokens import word_bpe

PIECE = "start bigint, length bigint, doc_tokens bigint, ids binary"


def pieces(
    df: DataFrame, file: str, text: str = "text", end_id: int = 2, capacity: int = 4096, batch_chars: int = 1_000_000
) -> DataFrame:
    """Cut each document's ids, ``end_id`` appended, into pieces of ``capacity`` ids and one shorter rest.

    Gives the columns of ``df`` but the text, and ``start``, ``length``,
    ``doc_tokens`` and ``ids`` (binary: little-endian unsigned 32-bit numbers).
    Null and empty texts are the end id alone; repeated rows stay; input columns
    with these names are replaced.
    """
    names = [n for n in fresh_names(df, ["start", "length", "doc_tokens", "ids"]) if n != text]
    source = df.select(*[F.col(f"`{n}`") for n in names], text_or_empty(text).alias(HIDDEN + "text"))
    end = np.array([end_id], "<u4").tobytes()
    step = 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(file)
        for batch in batches:
            texts = batch.column(len(names))
            for first, last in slices(texts, batch_chars):
                packed = bpe.packed(texts.slice(first, last - first))
                rows, starts, totals, ids = [], [], [], []
                for i, data in enumerate(packed, first):
                    data += end
                    for at in range(0, len(data), step):
                        rows.append(i)
                        starts.append(at // 4)
                        totals.append(len(data) // 4)
                        ids.append(data[at : at + step])
                kept = [batch.column(c).take(pa.array(rows, pa.int64())) for c in range(len(names))]
                lengths = [len(x) // 4 for x in ids]
                made = [pa.array(x, pa.int64()) for x in (starts, lengths, totals)] + [pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(kept + made, names=[*names, "start", "length", "doc_tokens", "ids"])
        bpe.forget()  # the worker waits for its next task without

    return source.mapInArrow(lean(run), with_fields(df, names, PIECE))


@dataclass(frozen=True)
class Plan:
    """Where the pieces of each length go: per length the slots, as running counts."""

    lengths: np.ndarray  # of each slot, ascending
    before: np.ndarray  # pieces of this length in earlier slots
    first: np.ndarray  # sequence of the slot's first piece
    offset: np.ndarray  # place in the sequence
    sequences: int


def plan(histogram: dict[int, int], capacity: int) -> Plan:
    """Shortest-pack-first: lengths longest first, each into the packs with the largest gap."""
    gaps: list[list[tuple[int, tuple[int, ...]]]] = [[] for _ in range(capacity + 1)]
    widest = 0
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            while widest and not gaps[widest]:
                widest -= 1
            if widest >= length:
                gap, (count, pattern) = widest, gaps[widest].pop()
                each = min(max(left // count, 1), gap // length)
                used = min(count, left)
                if count > used:
                    gaps[gap].append((count - used, pattern))
            else:  # no pack has room: open new ones, each with as many pieces of this length as fit
                gap, pattern, each = capacity, (), min(capacity // length, left)
                used = left // each
            gaps[gap - each * length].append((used, pattern + (length,) * each))
            widest = max(widest, gap)
            left -= used * each
    slots: list[tuple[int, int, int, int]] = []
    base = 0
    for packs in gaps:
        for count, pattern in packs:
            at = 0
            for length in pattern:
                slots.append((length, base, at, count))
                at += length
            base += count
    slots.sort()
    table = np.array(slots, np.int64).reshape(-1, 4)
    total = np.cumsum(table[:, 3]) - table[:, 3]
    lengths, starts = np.unique(table[:, 0], return_index=True)
    own = np.repeat(total[starts], np.diff(np.append(starts, len(table)))) if len(table) else total
    return Plan(table[:, 0], total - own, table[:, 1], table[:, 2], base)


def pack(cut: DataFrame, capacity: int = 4096, order: tuple[str, ...] = ("doc_id", "start")) -> DataFrame:
    """``cut`` (with a ``length`` of 1 to ``capacity`` a row) plus ``sequence_id`` and ``offset``.

    ``cut`` is written once to the shared folder, since the histogram and the
    ranks must see the same rows.  The counts are taken from it anew where they are
    needed: to write them would be a small file for each shuffle partition.  Ranks
    are counted in buckets of each length, so that a length which many pieces have
    is no single task; ties are ranked in any order.  An empty table gives an empty
    table.
    """
    spark = cut.sparkSession
    cut = settle(cut.select(*[F.col(f"`{n}`") for n in fresh_names(cut, ["sequence_id", "offset"])]))
    bucket = F.pmod(F.xxhash64(*[F.col(f"`{n}`") for n in order]), F.lit(partitions(spark))).cast("int")
    marked = cut.withColumn(HIDDEN + "b", bucket)
    sizes = marked.groupBy("length", HIDDEN + "b").agg(F.count(F.lit(1)).alias(HIDDEN + "n"))
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    if any(not 1 <= k <= capacity for k in histogram):
        raise ValueError(f"lengths must be 1 to {capacity}")
    places = plan(histogram, capacity)
    running = Window.partitionBy("length").orderBy(HIDDEN + "b").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("length", HIDDEN + "b", F.coalesce(F.sum(HIDDEN + "n").over(running), F.lit(0)).alias(HIDDEN + "k"))
    within = Window.partitionBy("length", HIDDEN + "b").orderBy(*[F.col(f"`{n}`") for n in order])
    ranked = marked.withColumn(HIDDEN + "r", F.row_number().over(within)).join(before, ["length", HIDDEN + "b"])
    names = cut.columns
    source = ranked.select(*[F.col(f"`{n}`") for n in names], (F.col(HIDDEN + "k") + F.col(HIDDEN + "r") - 1).alias(HIDDEN + "rank"))
    at = names.index("length")

    # slots ordered by (length, before): the slot of (length, rank) is the last one not beyond it
    span = max(histogram.values(), default=0) + 1
    if span * (capacity + 1) >= 2**63:
        raise OverflowError("too many pieces of one length for 64-bit keys")
    keys = places.lengths * span + places.before

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(at).to_numpy()
            ranks = batch.column(len(names)).to_numpy().astype(np.int64)
            slot = np.searchsorted(keys, lengths * span + ranks, side="right") - 1
            made = [pa.array(places.first[slot] + ranks - places.before[slot]), pa.array(places.offset[slot])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=[*names, "sequence_id", "offset"])

    return source.mapInArrow(run, with_fields(cut, names, "sequence_id bigint, offset bigint"))
