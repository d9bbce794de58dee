"""Removal of bytes that repeated substrings cover, over all documents (see ``suffixes``)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, settle
from .common import fresh_names, text_or_empty, with_fields
from .suffixes import cover, repeated_windows, text_anchors, word_places, words

ADDED = ["n_bytes", "n_removed", "n_spans", "n_repeated_grams", "kept"]
_KEY = ["k_id", "k_text"]
#: Spread of the text's part of a row's key, so that it is no hash used elsewhere.
_SALT = "substrings"


@dataclass(frozen=True)
class Strings:
    """Strings of ``length`` bytes that start elsewhere too, or words that other documents have too.

    They are anchored at a gram of half of them; a string's two grams cover it.
    """

    length: int
    by_words: bool = False

    @property
    def gram(self) -> int:
        return (self.length + 1) // 2

    @property
    def symbol(self) -> type:
        return np.uint64 if self.by_words else np.uint8

    @property
    def least_bytes(self) -> int:
        """No shorter text holds such a string."""
        return 2 * self.length - 1 if self.by_words else self.length

    def symbols(self, text: pa.Buffer) -> np.ndarray:
        data = np.frombuffer(text, np.uint8)
        return words(data) if self.by_words else data


def remove_repeats(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    length: int = 400,
    group_limit: int = 32_768,
    n_words: int | None = None,
) -> DataFrame:
    """``df`` without ``text``, plus n_bytes, n_removed, n_spans, n_repeated_grams and kept (binary).

    Each byte of a text (UTF-8; null is empty) goes that a ``length``-byte string
    covers which starts at another place too, in this or any other row; strings
    are judged on the input.  Repeated rows repeat each other's strings, whether
    or not their keys are equal or null.  Texts shorter than ``length`` keep all.
    ``n_repeated_grams`` counts the text's anchors whose ``length`` / 2 bytes start
    elsewhere, too: it tells of shared passages that are too short to be removed.
    With ``n_words`` a column ``n_shared_words`` follows: the words (runs without
    ASCII white space) that ``n_words`` words in a row cover which another document
    has, too, however few bytes they have; found the same way.  Rows of equal key
    and text are one document here.
    ``group_limit`` bounds the distinct surroundings one task compares at once;
    larger buckets are cut, and their windows compared across the parts.
    """
    shared, merged = _repeated(df, key, text, Strings(length), group_limit)
    counts = shared.groupBy(*_KEY).agg(F.count_distinct("position").alias("n_repeated_grams"))
    found = counts.join(merged, _KEY, "left")
    if n_words is None:
        return _apply(df, key, text, settle(found), [])
    _, by_words = _repeated(df, key, text, Strings(n_words, by_words=True), group_limit)
    found = found.join(by_words.withColumnRenamed("runs", "word_runs"), _KEY, "full")
    return _apply(df, key, text, settle(found), ["n_shared_words"])


def _repeated(df: DataFrame, key: str, text: str, strings: Strings, group_limit: int) -> tuple[DataFrame, DataFrame]:
    """Anchors whose gram starts elsewhere too, and per text the runs (k_id, k_text, runs) that repeated strings cover."""
    reach = strings.length - strings.gram
    found = settle(_anchors(df, key, text, strings))
    buckets = found.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.min("span").alias("low"), F.max("span").alias("high"), _several(strings).alias("several")
    )
    buckets = settle(buckets.where("several").select("bucket", (F.col("low") != F.col("high")).alias("mixed")))
    shared = settle(found.join(broadcast_if_small(buckets, buckets.count(), 64), "bucket"))
    agreed = shared.where("not mixed").select(
        *_KEY, (F.col("position") - reach).alias("start"), (F.col("position") + strings.length).alias("end")
    )
    refined = _refine(df, key, text, shared.where("mixed"), strings, group_limit)
    intervals = agreed.unionByName(refined).groupBy(*_KEY).agg(F.collect_set(F.struct("start", "end")).alias("runs"))
    return shared, intervals.mapInArrow(_merged, intervals.schema)


def _several(strings: Strings) -> F.Column:
    """Whether a group's anchors are more than one, or by words: of more than one document."""
    own = F.struct(*_KEY)
    return F.min(own) != F.max(own) if strings.by_words else F.count(F.lit(1)) > 1


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Overlapping and touching runs of a text as one: few are left, so few are sent to the texts."""
    for batch in batches:
        lists = batch["runs"]
        sizes = pa.compute.list_value_length(lists).to_numpy()
        flat = lists.flatten()
        both = np.stack([flat.field("start").to_numpy(), flat.field("end").to_numpy()], axis=1)
        parts = [cover(x, 2**62) for x in np.split(both, np.cumsum(sizes)[:-1])] if len(sizes) else []
        ends = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype("i4")
        values = np.concatenate(parts) if parts else np.empty((0, 2), np.int64)
        runs = pa.StructArray.from_arrays([pa.array(values[:, 0]), pa.array(values[:, 1])], names=["start", "end"])
        yield pa.RecordBatch.from_arrays([batch["k_id"], batch["k_text"], pa.ListArray.from_arrays(pa.array(ends), runs)], names=[*_KEY, "runs"])


def _keyed(df: DataFrame, key: str, text: str) -> DataFrame:
    """``df`` with the parts of a row's key; rows equal in key and text may share one."""
    own = F.xxhash64(F.lit(_SALT), text_or_empty(text))
    return df.withColumn("k_id", F.coalesce(F.xxhash64(F.col(f"`{key}`")), F.lit(0))).withColumn("k_text", own)


def _anchors(df: DataFrame, key: str, text: str, strings: Strings) -> DataFrame:
    """(bucket, span, k_id, k_text, position) of every anchor of every text."""
    source = _keyed(df.select(F.col(f"`{key}`"), F.col(f"`{text}`")), key, text)
    source = source.select(*_KEY, text_or_empty(text).alias("t")).where(F.octet_length("t") >= strings.least_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, parts = [], []
            for row, text in enumerate(batch["t"]):
                parts.append(text_anchors(strings.symbols(text.as_buffer()), strings.length, strings.gram))
                rows.append(np.full(len(parts[-1][0]), row))
            if not parts:
                continue
            position, bucket, span = (np.concatenate(x) for x in zip(*parts, strict=True))
            own = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket.view("i8")), pa.array(span.view("i8")), batch["k_id"].take(own), batch["k_text"].take(own), pa.array(position)],
                names=["bucket", "span", *_KEY, "position"],
            )

    return source.mapInArrow(run, "bucket bigint, span bigint, k_id bigint, k_text bigint, position bigint")


def _refine(df: DataFrame, key: str, text: str, mixed: DataFrame, strings: Strings, limit: int) -> DataFrame:
    """(k_id, k_text, start, end) of the repeated windows around anchors of mixed buckets.

    Anchors with the same surroundings are one class with a count.  All windows
    of an anchor hold its gram, so what they cover is one run: from the farthest
    repeated window before the anchor to the nearest.
    """
    classes = mixed.groupBy("bucket", "span").agg(
        F.when(_several(strings), 2).otherwise(1).cast("bigint").alias("copies"), F.min(F.struct(*_KEY, "position")).alias("at")
    )
    classes = settle(classes.select("bucket", "span", "copies", "at.*"))
    sizes = settle(classes.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit))
    contexts = _contexts(df, key, text, classes, strings)
    salted = contexts.join(broadcast_if_small(sizes, sizes.count(), 32), "bucket", "left")
    part = F.when(F.col("n").isNull(), -1).otherwise(F.pmod(F.xxhash64("span"), F.ceil(F.col("n") / limit)).cast("int"))
    salted = salted.withColumn("part", part).drop("n")
    placed = salted.repartition("bucket", "part").sortWithinPartitions("bucket", "part")
    checked = settle(placed.mapInArrow(_checker(strings), "bucket bigint, span bigint, back int, window bigint, owner bigint"))
    # rows with a window are from cut buckets: they repeat if another part has the window as well,
    # and by words not all of them are of one document (no owner: several)
    open_ = checked.where("window is not null")
    again = open_.groupBy("bucket", "back", "window").agg(
        F.count(F.lit(1)).alias("n"), (F.min("owner") != F.max("owner")).alias("differ"), F.bool_or(F.col("owner").isNull()).alias("many")
    )
    again = again.where("n > 1 and (many or differ)").select("bucket", "back", "window")
    across = open_.join(again, ["bucket", "back", "window"], "left_semi").select("bucket", "span", "back")
    runs = checked.where("window is null").select("bucket", "span", "back").unionByName(across)
    runs = settle(runs.groupBy("bucket", "span").agg(F.min("back").alias("near"), F.max("back").alias("far")))
    named = mixed.join(broadcast_if_small(runs, runs.count(), 64), ["bucket", "span"])
    return named.select(*_KEY, (F.col("position") - F.col("far")).alias("start"), (F.col("position") + strings.length - F.col("near")).alias("end"))


def _contexts(df: DataFrame, key: str, text: str, classes: DataFrame, strings: Strings) -> DataFrame:
    """(bucket, span, copies, owner, before, context) of each class, cut from one text that has it."""
    length, reach = strings.length, strings.length - strings.gram
    wanted = classes.groupBy(*_KEY).agg(F.collect_list(F.struct("bucket", "span", "copies", "position")).alias("wanted"))
    wanted = settle(wanted)
    size = wanted.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("wanted")).alias("m")).first()
    small = broadcast_if_small(wanted, size["n"] + (size["m"] or 0), 40)
    source = _keyed(df.select(F.col(f"`{key}`"), F.col(f"`{text}`")), key, text).join(small, _KEY)
    source = source.select(text_or_empty(text).alias("t"), "wanted", F.xxhash64(*_KEY).alias("owner"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch["wanted"].flatten()
            owner = np.repeat(np.arange(batch.num_rows), pa.compute.list_value_length(batch["wanted"]).to_numpy())
            places = flat.field("position").to_numpy()
            pieces, at, own = [], -1, None
            for o, p in zip(owner.tolist(), places.tolist(), strict=True):
                if o != at:
                    at, own = o, strings.symbols(batch["t"][o].as_buffer())
                pieces.append(own[max(p - reach, 0) : p + length].tobytes())
            yield pa.RecordBatch.from_arrays(
                [flat.field("bucket"), flat.field("span"), flat.field("copies"), batch["owner"].take(pa.array(owner)), pa.array(np.minimum(places, reach).astype("i4")), pa.array(pieces, pa.binary())],
                names=["bucket", "span", "copies", "owner", "before", "context"],
            )

    cut = source.mapInArrow(run, "bucket bigint, span bigint, copies bigint, owner bigint, before int, context binary")
    return cut.dropDuplicates(["bucket", "span"])  # repeated rows give the same text twice


def _checker(strings: Strings):
    """Rows (bucket, span, back): the nearest and the farthest repeated window; with ``window`` in cut buckets: one to compare across parts."""

    def check(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        if not rows.num_rows:
            return
        bucket, span = rows["bucket"].to_numpy(), rows["span"].to_numpy()
        owner = rows["owner"].to_numpy()
        exists, repeats, ids = repeated_windows(
            bucket.view("u8"), rows["before"].to_numpy().astype(np.int64), rows["context"].to_pylist(), rows["copies"].to_numpy(), strings.length, strings.gram, strings.symbol,
            owner if strings.by_words else None,
        )
        row = np.flatnonzero(repeats.any(axis=1))
        near = repeats[row].argmax(axis=1)
        far = repeats.shape[1] - 1 - repeats[row][:, ::-1].argmax(axis=1)
        row, back = np.concatenate((row, row)), np.concatenate((near, far))
        yield pa.RecordBatch.from_arrays(
            [pa.array(bucket[row]), pa.array(span[row]), pa.array(back.astype("i4")), pa.nulls(len(row), pa.int64()), pa.nulls(len(row), pa.int64())],
            names=["bucket", "span", "back", "window", "owner"],
        )
        cut = rows["part"].to_numpy() >= 0
        if cut.any():
            # once a window and part: a witness for the others, and its own question
            row, back = np.nonzero(exists & cut[:, None])
            window = ids[row, back]
            part = mix_parts(bucket[row], rows["part"].to_numpy()[row], back, window)
            _, first = np.unique(part, return_index=True)
            if strings.by_words:  # each class of a document alone with a window asks for itself
                first = np.union1d(first, np.flatnonzero(~repeats[row, back]))
            row, back, window = row[first], back[first], window[first]
            several = repeats[row, back] | (not strings.by_words)
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket[row]), pa.array(span[row]), pa.array(back.astype("i4")), pa.array(window.view("i8")), pa.array(owner[row], mask=several)],
                names=["bucket", "span", "back", "window", "owner"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            while batch.num_rows:
                keys = np.stack([batch["bucket"].to_numpy(), batch["part"].to_numpy().astype("i8")])
                end = min(batch.num_rows, 2000)
                if held and sum(b.num_rows for b in held) >= 2000:
                    # take the rest of the group that is open, then work
                    same = (keys == np.array(last)[:, None]).all(axis=0)
                    more = batch.num_rows if same.all() else int(same.argmin())
                    held.append(batch.slice(0, more))
                    batch = batch.slice(more)
                    if batch.num_rows:
                        yield from check(pa.Table.from_batches(held))
                        held = []
                    continue
                held.append(batch.slice(0, end))
                last = keys[:, end - 1].tolist()
                batch = batch.slice(end)
        if held:
            yield from check(pa.Table.from_batches(held))

    return run


def mix_parts(bucket: np.ndarray, part: np.ndarray, back: np.ndarray, window: np.ndarray) -> np.ndarray:
    from .suffixes import mix

    low = part.astype(np.uint64) * np.uint64(1 << 16) + back.astype(np.uint64)
    return mix(mix(window ^ mix(bucket.view("u8"))) ^ mix(low + np.uint64(1)))


def _apply(df: DataFrame, key: str, text: str, intervals: DataFrame, more: list[str]) -> DataFrame:
    names = [n for n in fresh_names(df, ADDED + more) if n != text]
    if not more:
        intervals = intervals.withColumn("word_runs", F.lit(None).cast(intervals.schema["runs"].dataType))
    size = intervals.agg(F.count(F.lit(1)).alias("n"), F.sum(sum(F.coalesce(F.size(c), F.lit(0)) for c in ("runs", "word_runs"))).alias("m")).first()
    small = broadcast_if_small(intervals, 2 * size["n"] + (size["m"] or 0), 24)
    # names of the input stay apart from the key's, whatever they are called
    source = df.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("r"), F.col(f"`{key}`").alias("id"), text_or_empty(text).alias("t"))
    source = _keyed(source, "id", "t").join(small, _KEY, "left").select("r.*", "t", "runs", "word_runs", F.coalesce("n_repeated_grams", F.lit(0)).alias("met"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, spans, shared, kept = [], [], [], [], []
            for text, runs, word_runs in zip(*batch.columns[len(names) : len(names) + 3], strict=True):
                data = text.as_buffer()
                sizes.append(data.size)
                found = cover(_limits(runs), data.size)
                n_words = len(word_places(np.frombuffer(data, np.uint8))[0]) if word_runs.is_valid else 0
                by_words = cover(_limits(word_runs), n_words)
                shared.append(int((by_words[:, 1] - by_words[:, 0]).sum()))
                removed.append(int((found[:, 1] - found[:, 0]).sum()))
                spans.append(len(found))
                edges = [0, *found.ravel().tolist(), data.size]
                kept.append(b"".join(data[a:b].to_pybytes() for a, b in zip(edges[::2], edges[1::2], strict=True)))
            made = [pa.array(x, pa.int64()) for x in (sizes, removed, spans)]
            made += [batch.column(len(names) + 3), pa.array(kept, pa.binary())] + [pa.array(shared, pa.int64())] * len(more)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *made], names=[*names, *ADDED, *more])

    made = "n_bytes bigint, n_removed bigint, n_spans bigint, n_repeated_grams bigint, kept binary"
    return source.mapInArrow(run, with_fields(df, names, ", ".join([made, *[f"{n} bigint" for n in more]])))


def _limits(runs: pa.Scalar) -> np.ndarray:
    """Runs as rows (start, end)."""
    if not runs.is_valid:
        return np.empty((0, 2), np.int64)
    return np.stack([runs.values.field(c).to_numpy() for c in ("start", "end")], axis=1)
