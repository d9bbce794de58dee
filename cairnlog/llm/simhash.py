"""SimHash fingerprints, and their links within a Hamming distance by vantage-point trees.

The upper levels of the tree are built on the driver from a bounded sample of
fingerprints and only decide how the work is cut: a point lies in one shard, and
is copied into each other shard whose inner side it may reach (triangle bound).
Every pair within the radius meets in a shard; there the same recursion goes on
until a block is small, and pairs are compared by XOR and bit count.  A shard
gives a star per connected set instead of its pairs; stars of all shards are
merged by min-label propagation.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import broadcast_if_small, settle
from .common import arrow_map, partitions, refuse_hidden

SEED = 42
_LOW = np.uint64(0x0101010101010101)


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """(doc_id, fingerprint bigint) per row: the SimHash of the shingles of the whole text.

    A to Z are lower-cased, words are runs without ASCII white space, shingles
    are ``words`` words joined by a space, repeats included; fewer words are one
    shingle, none give 0.  Null texts count as empty.
    """
    source = df.withColumn("__llm_key", F.col(f"`{key}`").cast("bigint"))

    def work(texts: list[str]) -> dict[str, pa.Array]:
        return {"fingerprint": pa.array(simhashes(texts, words).view(np.int64))}

    return arrow_map(source, ["__llm_key"], text, "fingerprint bigint", work).withColumnRenamed("__llm_key", "doc_id")


def simhashes(texts: list[str], words: int = 3) -> np.ndarray:
    """The fingerprints of texts: a bit is 1 where over half of the shingles' hashes have it."""
    hashes, counts = [], np.zeros(len(texts), np.int64)
    digest = xxhash.xxh64_intdigest
    for i, text in enumerate(texts):
        found = text.encode("utf-8", "surrogatepass").lower().split()
        if not found:
            continue
        if len(found) < words:
            shingles = [b" ".join(found)]
        else:
            shingles = list(map(b" ".join, zip(*(found[k:] for k in range(words)), strict=False)))
        counts[i] = len(shingles)
        hashes.append(np.fromiter(map(digest, shingles, repeat(SEED)), np.uint64, len(shingles)))
    out = np.zeros(len(texts), np.uint64)
    if not hashes:
        return out
    values, used = np.concatenate(hashes), np.flatnonzero(counts)
    # eight bytes in a word count eight bits at once; blocks of 255 rows keep each below 256
    blocks = [np.arange(0, n, 255) for n in counts[used]]
    first = np.cumsum(counts[used]) - counts[used]
    cuts = np.concatenate([b + s for b, s in zip(blocks, first, strict=True)])
    owner = np.cumsum([0] + [len(b) for b in blocks[:-1]])
    for shift in range(8):
        sums = np.add.reduceat((values >> np.uint64(shift)) & _LOW, cuts)
        bits = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), owner, axis=0)
        over = bits * 2 > counts[used][:, None]
        for byte in range(8):
            out[used] |= over[:, byte].astype(np.uint64) << np.uint64(8 * byte + shift)
    return out


@dataclass(frozen=True)
class Node:
    """Inside are fingerprints within ``radius`` of the vantage point; shards are numbered leaves."""

    vantage: int
    radius: int
    inside: Node | int
    outside: Node | int


def build(sample: np.ndarray, leaf: float, distance: int) -> tuple[Node | int, int]:
    """A tree over a sample whose leaves hold about ``leaf`` of its points; the number of leaves."""
    counter = 0

    def grow(points: np.ndarray, depth: int) -> Node | int:
        nonlocal counter
        if len(points) > max(leaf, 2) and depth < 40:
            split = _split(points, distance)
            if split is not None:
                vantage, radius, near = split
                far = np.bitwise_count(points ^ vantage) > radius
                return Node(int(vantage), radius, grow(points[near], depth + 1), grow(points[far], depth + 1))
        counter += 1
        return counter - 1

    return grow(np.unique(sample), 0), counter


def _split(points: np.ndarray, distance: int) -> tuple[np.uint64, int, np.ndarray] | None:
    """Vantage point, radius and the inside (with its margin); None where no cut makes both sides clearly smaller."""
    best = None
    for at in np.linspace(0, len(points) - 1, 8).astype(int):
        far = np.bitwise_count(points ^ points[at]).astype(np.int64)
        below = np.cumsum(np.bincount(far, minlength=65 + distance))
        for radius in range(0, 64):
            inside, outside = below[radius + distance], len(points) - below[radius]
            larger = max(inside, outside)
            if best is None or larger < best[0]:
                best = (larger, points[at], radius, far)
    larger, vantage, radius, far = best
    if larger > 0.9 * len(points):
        return None
    return vantage, radius, far <= radius + distance


def assign(tree: Node | int, values: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """(index, shard): each value in its own shard and, as a guest, in the inner shards it may reach."""
    rows: list[np.ndarray] = []
    shards: list[np.ndarray] = []

    def walk(node: Node | int, index: np.ndarray) -> None:
        if not len(index):
            return
        if isinstance(node, int):
            rows.append(index)
            shards.append(np.full(len(index), node, np.int32))
            return
        far = np.bitwise_count(values[index] ^ np.uint64(node.vantage))
        walk(node.inside, index[far <= node.radius + distance])
        walk(node.outside, index[far > node.radius])

    walk(tree, np.arange(len(values)))
    if not rows:
        return np.empty(0, np.int64), np.empty(0, np.int32)
    return np.concatenate(rows), np.concatenate(shards)


def pairs(values: np.ndarray, distance: int, block: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of values within the distance (some more than once), by a vantage-point tree."""

    def walk(index: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if len(index) > block:
            split = _split(values[index], distance)
            if split is not None:
                vantage, radius, near = split
                far = np.bitwise_count(values[index] ^ vantage) > radius
                yield from walk(index[near])
                yield from walk(index[far])
                return
        own = values[index]
        for start in range(0, len(own), 512):
            for other in range(start, len(own), 4096):
                close = np.bitwise_count(own[start : start + 512, None] ^ own[None, other : other + 4096]) <= distance
                a, b = np.nonzero(close)
                a, b = a + start, b + other
                yield index[a[a < b]], index[b[a < b]]

    yield from walk(np.arange(len(values)))


def stars(values: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """(value, least value connected with it) for values that have a neighbour."""
    label = np.arange(len(values))
    for a, b in pairs(values, distance):
        while len(a):
            ra, rb = _roots(label, a), _roots(label, b)
            open_ = ra != rb
            a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
            np.minimum.at(label, np.maximum(ra, rb), np.minimum(ra, rb))
    root = _roots(label, np.arange(len(values)))
    linked = root != np.arange(len(values))
    return values[linked], values[root[linked]]


def _roots(label: np.ndarray, index: np.ndarray) -> np.ndarray:
    while True:
        up = label[index]
        if (up == index).all():
            return index
        label[index] = label[up]
        index = label[up]


def links(
    points: DataFrame, distance: int = 2, shard_size: int = 20_000, sample_size: int = 20_000, shard_limit: int = 60_000
) -> DataFrame:
    """(a, b) bigint: for distinct fingerprints (column ``fingerprint``), stars that connect what lies within ``distance``.

    The sample for the upper tree is bounded by ``sample_size``; it sets where
    shards are cut, never what is found.  A shard beyond ``shard_limit`` (many
    points in one small ball, where no vantage point helps) is cut by the values
    of ``distance + 1`` groups of bits: two points within the distance agree on
    at least one group.
    """
    spark = points.sparkSession
    count = points.count()
    share = min(1.0, 0.9 * sample_size / max(count, 1))
    picked = points.where(F.pmod(F.xxhash64("fingerprint"), F.lit(1 << 30)) < int(share * (1 << 30)))
    sample = picked.limit(sample_size).toPandas()["fingerprint"].to_numpy(np.int64).view(np.uint64)
    tree, _ = build(sample, shard_size * max(len(sample), 1) / max(count, 1), distance)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy().view(np.uint64)
            rows, shards = assign(tree, values, distance)
            yield pa.RecordBatch.from_arrays(
                [pa.array(values[rows].view(np.int64)), pa.array(shards)], names=["fingerprint", "shard"]
            )

    placed = points.select("fingerprint").mapInArrow(spread, "fingerprint bigint, shard int")
    sizes = placed.groupBy("shard").count().where(F.col("count") > shard_limit).collect()
    crowded = [r["shard"] for r in sizes]
    edges = np.linspace(0, 64, distance + 2).astype(int)
    parts = [
        F.struct(F.lit(i).alias("part"), F.shiftrightunsigned(F.shiftleft("fingerprint", int(64 - hi)), int(64 - hi + lo)).alias("bits"))
        for i, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False))
    ]
    whole = F.array(F.struct(F.lit(-1).alias("part"), F.lit(0).cast("bigint").alias("bits")))
    if crowded:
        whole = F.when(F.col("shard").isin(crowded), F.array(*parts)).otherwise(whole)
    cut = placed.select("fingerprint", "shard", F.explode(whole).alias("k")).select("fingerprint", "shard", "k.part", "k.bits")

    def find(group: pd.DataFrame) -> pd.DataFrame:
        values = np.unique(group["fingerprint"].to_numpy(np.int64).view(np.uint64))
        a, b = stars(values, distance)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return cut.groupBy("shard", "part", "bits").applyInPandas(find, "a bigint, b bigint")


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): its component's least node.

    Alternates large-star and small-star steps, each written to the shared
    folder, until nothing changes; only counts come to the driver.
    """
    edges = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = settle(small.select("e.a", "e.b").where("a <> b").distinct())
        row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if row["n"] == 0 or (row["n"], row["s"]) == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = (row["n"], row["s"])


def components(df: DataFrame, key: str = "doc_id", text: str = "text", distance: int = 2, **limits: int) -> DataFrame:
    """(doc_id, fingerprint, component_id) per row of ``df``.

    ``component_id`` is the least key reachable over links, the row's own
    included (null keys are not counted; null where a component has no other).
    Repeated rows stay, other columns are not read, an empty table gives an
    empty table.
    """
    spark: SparkSession = df.sparkSession
    docs = settle(fingerprints(df, key, text))
    points = settle(docs.groupBy("fingerprint").agg(F.min("doc_id").alias("least")))
    found = connected(links(points, distance, **limits))
    named = points.join(found, points["fingerprint"] == found["node"]).select("fingerprint", "least", "root")
    top = points.join(found.select("root").distinct(), points["fingerprint"] == F.col("root"), "left_semi")
    members = settle(named.unionByName(top.select("fingerprint", "least", F.col("fingerprint").alias("root"))))
    lowest = members.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = members.join(lowest, "root").select("fingerprint", "component_id")
    ids = settle(
        points.join(linked, "fingerprint", "left").select("fingerprint", F.coalesce("component_id", "least").alias("component_id"))
    )
    small = broadcast_if_small(ids, ids.count(), 64)
    return docs.join(small, "fingerprint").select("doc_id", "fingerprint", "component_id").repartition(partitions(spark))


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with one row of each component: the one with its least key; all columns stay.

    Rows that share that key are not told apart and stay together; rows without a
    key stay, since nothing names them.
    """
    refuse_hidden(df)
    found = components(df, key, text).where("doc_id = component_id").select(F.col("doc_id").alias("__llm_k")).distinct()
    keep = settle(found)
    own = F.col(f"`{key}`").cast("bigint") == F.col("__llm_k")
    kept = df.join(broadcast_if_small(keep, keep.count(), 32), own, "left_semi")
    return kept.unionByName(df.where(F.col(f"`{key}`").isNull()))
