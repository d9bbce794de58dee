"""Cross-entropy difference between matched bigram models of a target and of all documents.

Both models have one vocabulary (all subwords), one order and one smoothing.  A
document's score is the mean over its tokens of target loss minus background
loss: the lower, the more it reads like the target.

Bigram counts are a table that grows with the corpus.  Documents are dealt in
blocks of some megabytes as they are encoded; the counts of a block's bigrams
are summed over all blocks, and the sums joined with the bigrams of each block
and brought to its documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .common import HIDDEN, fresh_names, slices, text_or_empty, with_fields
from .tokens import byte_bpe

#: Classes of the vocabulary: 0 stands before a text; where the vocabulary is limited, 1 is all subwords but the most frequent ones.
BEFORE, OTHER = 0, 1
#: Bytes of text after which a block of documents is full (a longer text makes its own block longer).
BLOCK = 8_000_000


def vocabulary(target: DataFrame, file: str, ranks: str, text: str = "text", size: int | None = None) -> tuple[np.ndarray, int]:
    """The class of each subword, and the number of classes.

    Every subword has its own class; with a ``size`` only the ``size`` - 2 most
    frequent ones of all target texts.
    """
    known = byte_bpe(file, ranks).size
    if size is None:
        return np.arange(1, known + 1), known + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(file, ranks)
        total = np.zeros(bpe.size, np.int64)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                total += np.bincount(bpe.ids(t), minlength=bpe.size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["token", "n"])

    counted = target.select(text_or_empty(text)).mapInArrow(count, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    first = counted.orderBy(F.desc("n"), "token").limit(size - 2).collect()
    classes = np.full(known, OTHER, np.int64)
    classes[[r["token"] for r in first]] = np.arange(2, 2 + len(first))
    return classes, size


def encoded(docs: DataFrame, names: list[str], flag: str, classes: np.ndarray, kind: str, file: str, ranks: str, text: str) -> DataFrame:
    """``names`` of ``docs``, whether a row is target, its block and the classes of its tokens (bytes of ``kind``)."""
    source = docs.select(*[F.col(f"`{n}`") for n in names], F.coalesce(F.col(f"`{flag}`"), F.lit(False)).alias(HIDDEN + "target"), text_or_empty(text).alias(HIDDEN + "text"))
    kept = [*names, HIDDEN + "target"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, own = byte_bpe(file, ranks), classes.astype(kind)
        block, filled = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            texts = batch.column(len(kept))
            for start, end in slices(texts, BLOCK // 2):
                part = batch.slice(start, end - start)
                packed = pa.array([own[bpe.ids(t)].tobytes() for t in part.column(len(kept)).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], pa.array(np.full(len(packed), block)), packed], names=[*kept, HIDDEN + "block", HIDDEN + "classes"])
                filled += pa.compute.sum(pa.compute.binary_length(part.column(len(kept)))).as_py() or 0
                if filled >= BLOCK:
                    block, filled = block + 1, 0

    return source.mapInArrow(run, with_fields(source, kept, f"{HIDDEN}block bigint, {HIDDEN}classes binary"))


def pairs(packed: list[bytes], kind: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Each token of the texts as class before it * ``size`` + its class, and the number of tokens of each text."""
    own = np.frombuffer(b"".join(packed), kind).astype(np.int64)
    n = np.array([len(x) for x in packed], np.int64) // np.dtype(kind).itemsize
    before = np.concatenate(([BEFORE], own[:-1])) if len(own) else own
    before[(np.cumsum(n) - n)[n > 0]] = BEFORE
    return before * size + own, n


def block_counts(coded: DataFrame, kind: str, size: int) -> DataFrame:
    """(block, previous, current, target, every): bigrams of each block, how often in target rows and in all rows.

    A block that two tasks read has rows of both.
    """
    schema = "block bigint, previous int, current int, target bigint, every bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, kept, held = None, ([], []), 0

        def flush() -> pa.RecordBatch:
            (target, a), (other, b) = (np.unique(np.concatenate([np.empty(0, np.int64), *x]), return_counts=True) for x in kept)
            every = np.union1d(target, other)
            n = np.zeros((2, len(every)), np.int64)
            n[0, np.searchsorted(every, target)] = a
            n[1, np.searchsorted(every, other)] = b
            columns = [np.full(len(every), block), (every // size).astype("i4"), (every % size).astype("i4"), n[0], n[0] + n[1]]
            return pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["block", "previous", "current", "target", "every"])

        for batch in batches:
            for number, is_target, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (number != block or held > BLOCK):
                    yield flush()
                    kept, held = ([], []), 0
                block = number
                kept[0 if is_target else 1].append(pairs([packed], kind, size)[0])
                held += len(packed)
        if held:
            yield flush()

    return coded.select(HIDDEN + "block", HIDDEN + "target", HIDDEN + "classes").mapInArrow(run, schema)


def counts(found: DataFrame) -> DataFrame:
    """(previous, current, target, every): the bigrams of all blocks."""
    return found.groupBy("previous", "current").agg(F.sum("target").alias("target"), F.sum("every").alias("every"))


def singles(table: DataFrame, column: str, size: int) -> np.ndarray:
    """Two rows of ``size`` counts, of target and of all rows: how often each class is in ``column``."""
    got = table.groupBy(column).agg(F.sum("target").alias("target"), F.sum("every").alias("every")).toArrow()
    out = np.zeros((2, size), np.int64)
    for row, name in enumerate(("target", "every")):
        out[row, got[column].to_numpy()] = got[name].to_numpy()
    return out


def losses(n: np.ndarray, previous: np.ndarray, current: np.ndarray, before: np.ndarray, single: np.ndarray, weight: float) -> np.ndarray:
    """-log p(class | class before): bigram counts ``n`` smoothed by ``weight`` times the unigram, that by one of each class."""
    share = (single + 1.0) / (single + 1.0).sum()
    return -np.log((n + weight * share[current]) / (before[previous] + weight))


def score(
    docs: DataFrame, target: DataFrame, file: str, ranks: str, text: str = "text", flag: str = "is_target", size: int | None = None, weight: float = 50.0
) -> DataFrame:
    """``docs`` without ``text`` and ``flag``, plus n_tokens, target_loss, background_loss and score.

    ``flag`` (boolean; null is false) marks the rows that are the target; the
    background is all rows.  Every subword counts; with a ``size`` only the most
    frequent ones of ``target`` (the same rows again) are told apart.  Losses are
    means per token; an empty or null text has 0 tokens and 0.0 everywhere.
    Repeated rows count as often as they occur.  Without any target the target
    model is the smoothing alone.
    """
    classes, size = vocabulary(target, file, ranks, text, size)
    kind = "<u2" if size <= 1 << 16 else "<u4"
    added = ["n_tokens", "target_loss", "background_loss", "score"]
    names = [n for n in fresh_names(docs, added) if n not in (text, flag)]
    coded = settle(encoded(docs, names, flag, classes, kind, file, ranks, text))
    found = settle(block_counts(coded, kind, size))
    table = settle(counts(found))
    # two numbers a subword and side, whatever the corpus
    model = docs.sparkSession.sparkContext.broadcast((singles(table, "previous", size), singles(table, "current", size)))
    known = found.select("block", "previous", "current").join(table, ["previous", "current"])
    sides = coded.groupBy(HIDDEN + "block").cogroup(known.groupBy("block"))

    def run(rows: pa.Table, bigrams: pa.Table) -> pa.Table:
        before, single = model.value
        previous, current = (bigrams[c].to_numpy().astype(np.int64) for c in ("previous", "current"))
        cells, first = np.unique(previous * size + current, return_index=True)
        flat, n = pairs(rows[HIDDEN + "classes"].to_pylist(), kind, size)
        at = np.searchsorted(cells, flat)
        means = []
        for row, name in enumerate(("target", "every")):
            loss = losses(bigrams[name].to_numpy()[first], previous[first], current[first], before[row], single[row], weight)
            means.append(np.add.reduceat(np.append(loss[at], 0.0), np.cumsum(n) - n) * (n > 0) / np.maximum(n, 1))
        t, b = means
        return pa.table([*(rows[c] for c in names), pa.array(n), pa.array(t), pa.array(b), pa.array(t - b)], names=[*names, *added])

    return sides.applyInArrow(run, with_fields(docs, names, "n_tokens bigint, target_loss double, background_loss double, score double"))
