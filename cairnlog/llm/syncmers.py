"""Fingerprints from closed syncmers.

A k-mer of code points is chosen if the least of its inner s-mers stands first or
last in it.  That depends on the k-mer alone, so a choice is the same wherever
the k-mer occurs: shared passages keep their anchors, whatever stands around.
The fingerprint is the list of all chosen k-mers with their positions, and two
texts are compared over all of them.  The bottom sketch of their hashes, of the
same size for any text, is a short form that only estimates the likeness.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import partitions, text_or_empty
from .suffixes import Rolling, mix, sliding_least

K, S, SLOTS = 20, 10, 128
#: Characters of text whose results are handed on together; their lists are some nine times as long.
BATCH = 2_000_000
_ODD = np.uint64(0x9FB21C651E98DF25)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def syncmers(points: np.ndarray, k: int = K, s: int = S, block: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of the closed syncmers of a text, in blocks so that memory is bounded.

    A tie for the least s-mer counts for the edges.  A text shorter than ``k``, or
    without a syncmer, is anchored as a whole at 0; an empty text has no anchor.
    """
    places, hashes = [], []
    for start in range(0, len(points) - k + 1, block):
        symbols = mix((points[start : start + block + k - 1].astype(np.uint64) + np.uint64(1)) * _ODD)
        rolling = Rolling(symbols)
        inner, whole = rolling.windows(s), rolling.windows(k)
        least = sliding_least(inner, k - s + 1)
        chosen = np.flatnonzero((inner[: len(whole)] == least) | (inner[k - s :] == least))
        places.append(chosen + start)
        hashes.append(whole[chosen])
    if not places or not sum(map(len, places)):
        if not len(points):
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        symbols = mix((points.astype(np.uint64) + np.uint64(1)) * _ODD)
        return np.zeros(1, np.int64), Rolling(symbols).slices(np.array([0]), np.array([len(points)]))
    return np.concatenate(places), np.concatenate(hashes)


def sketch(hashes: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """The ``slots`` least distinct hashes (32 bits), ascending."""
    values = (hashes >> np.uint64(32)).astype(np.uint32)
    if len(values) > 8 * slots:  # most values can't be among the least
        low = values[values < np.uint32(2**32 * 4 * slots / len(values))]
        found = np.unique(low)
        if len(found) >= slots:
            return found[:slots]
    return np.unique(values)[:slots]


def likeness(a: np.ndarray, b: np.ndarray, slots: int | None = SLOTS) -> float:
    """Share of common syncmers of two sets, 0 to 1; two empty texts are alike.

    Of sketches it is an estimate (exact while both have at most ``slots``), of
    whole sets, with ``slots`` None, it is exact.
    """
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.union1d(a, b)[:slots]
    return len(np.intersect1d(both, np.intersect1d(a, b, assume_unique=True), assume_unique=True)) / len(both)


def shown(values: np.ndarray) -> str:
    """A sketch as text: 8 hexadecimal digits a slot; empty for an empty text."""
    return values.astype(">u4").tobytes().hex()


def listed(places: np.ndarray, hashes: np.ndarray) -> str:
    """All anchors in order as text: 24 hexadecimal digits each, 8 of the position and 16 of the hash."""
    rows = np.empty(len(places), [("position", ">u4"), ("hash", ">u8")])
    rows["position"], rows["hash"] = places, hashes
    return rows.tobytes().hex()


def unlisted(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    """The (position, hash) that ``listed`` wrote."""
    rows = np.frombuffer(bytes.fromhex(fingerprint), [("position", ">u4"), ("hash", ">u8")])
    return rows["position"].astype(np.int64), rows["hash"].astype(np.uint64)


def anchors(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, s: int = S) -> DataFrame:
    """(doc_id, position, hash) of every closed syncmer: for matching passages by position.

    Null and empty texts have none; repeated rows give theirs again.
    """
    source = df.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), text_or_empty(text).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch["t"].to_pylist()):
                at, hashes = syncmers(code_points(text), k, s)
                own = batch["doc_id"].take(pa.array(np.full(len(at), i)))
                yield pa.RecordBatch.from_arrays([own, pa.array(at), pa.array(hashes.view("i8"))], names=["doc_id", "position", "hash"])

    return source.mapInArrow(run, "doc_id bigint, position bigint, hash bigint")


def with_neighbours(df: DataFrame, key: str = "doc_id", text: str = "text", blocks_per_partition: int = 4, whole: bool = False) -> DataFrame:
    """Fingerprint each text, its edited text, and compare with the next document's.

    The edited text has its last floor(n/2) code points replaced by the first as
    many (or all) of the next document in ascending key order; after the last
    comes the first.  Gives doc_id, n_chars, edited_text, fingerprint,
    edited_fingerprint, near_edited, near_next: with ``whole`` the list of all
    anchors and the likeness of the whole sets, else sketches and estimates.
    Null texts are empty; null keys come last; rows with equal keys follow each
    other by text; other columns are not read; an empty table gives an empty table.

    Documents are dealt once, in ranges of keys.  Range limits are keys that
    exist, so the row after a range is the row at the next limit, and only those
    rows are copied to the range before.
    """
    spark = df.sparkSession
    rank = F.coalesce(F.col(f"`{key}`").cast("bigint"), F.lit(2**63 - 1))
    docs = df.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), rank.alias("rank"), text_or_empty(text).alias("t"))
    blocks = blocks_per_partition * partitions(spark)
    shares = [i / blocks for i in range(1, blocks)]
    row = docs.agg(F.min("rank").alias("a"), F.percentile_approx("rank", shares, 10_000).alias("p")).first()
    limits = np.array(sorted({row["a"], *(row["p"] or [])} - {None}), np.int64)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def place(ranks: pd.Series) -> pd.Series:
        block = np.searchsorted(limits, ranks.to_numpy(), side="right") - 1
        first = limits[block] == ranks.to_numpy()
        return pd.Series([[b, -1 - (b - 1) % len(limits)] if f else [b] for b, f in zip(block.tolist(), first.tolist(), strict=True)])

    # a negative number is a copy for the block before
    dealt = docs.withColumn("b", F.explode(place("rank")))
    dealt = dealt.withColumn("copy", F.col("b") < 0).withColumn("block", F.when(F.col("b") < 0, -1 - F.col("b")).otherwise(F.col("b")))
    ordered = dealt.repartition("block").sortWithinPartitions("block", "copy", "rank", "t").select("block", "copy", "doc_id", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # the document whose next one is to come
        names = ["doc_id", "n_chars", "edited_text", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

        def table(rows: list[tuple]) -> pa.RecordBatch:
            made = list(zip(*rows, strict=True)) or [[] for _ in names]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(made, kinds, strict=True)], names=names)

        for batch in batches:
            rows, held = [], 0
            for copy, doc_id, text in zip(*(batch[c] for c in ("copy", "doc_id", "t")), strict=True):
                copy, doc_id, text = copy.as_py(), doc_id.as_py(), text.as_py()
                if last is None and copy:
                    continue  # further rows with the key of the first one
                points = code_points(text)
                own = _fingerprint(points, whole)
                if last is not None:
                    rows.append(_compared(last, text, points, own, whole))
                    held += len(last[2])
                    if held > BATCH:
                        yield table(rows)
                        rows, held = [], 0
                last = None if copy else (doc_id, text, points, own)
            yield table(rows)

    return ordered.mapInArrow(
        run,
        "doc_id bigint, n_chars bigint, edited_text string, fingerprint string, edited_fingerprint string,"
        " near_edited double, near_next double",
    )


def _fingerprint(points: np.ndarray, whole: bool) -> tuple[str, np.ndarray]:
    """A text's fingerprint as shown, and the set of hashes it is compared by."""
    places, hashes = syncmers(points)
    if whole:
        return listed(places, hashes), np.unique(hashes)
    own = sketch(hashes)
    return shown(own), own


def _compared(last: tuple, text: str, points: np.ndarray, following: tuple, whole: bool) -> tuple:
    doc_id, own_text, own_points, own = last
    half = len(own_points) // 2
    edited = own_text[: len(own_points) - half] + text[:half]
    edited_points = np.concatenate((own_points[: len(own_points) - half], points[:half]))
    changed = _fingerprint(edited_points, whole)
    slots = None if whole else SLOTS
    return (
        doc_id, len(own_points), edited, own[0], changed[0], likeness(own[1], changed[1], slots), likeness(own[1], following[1], slots),
    )
