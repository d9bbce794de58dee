"""BPE encoding and decoding of whole texts, long ones by tree concatenation.

A text longer than a leaf is cut into halves, again and again, until the pieces
are leaves; these are encoded in parallel as rows of their own.  Neighbours are
then joined pair by pair: the text around a join is encoded anew in a window that
grows on both sides until the first and the last id of the window are ids that
the sides already had.  In a BPE encoding every two neighbouring ids are
compatible, and a sequence of which this holds is the encoding, so agreement at
both edges makes the joined ids exact.  How a text is split before its bytes are
merged depends on what follows in runs of white space only, so neither a piece
nor a window ends in one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HIDDEN, arrow_map, fresh_names, lean, ranges, slices, text_or_empty
from .tokens import END_OF_TEXT, ByteBpe, byte_bpe

#: Ids decoded, or bytes of leaves encoded, at a time.
BLOCK = 1_000_000
#: Where a split is sure, after one character: white space between a letter, number or mark and a letter.
_SURE = regex.compile(r"[\p{L}\p{N}.,;:!?](?=[ \n]\p{L})")


def encode(
    df: DataFrame, file: str, ranks: str, text: str = "text", ids: str = "ids", leaf_chars: int = 8192
) -> DataFrame:
    """``df`` with the column ``ids`` (array<int>): the ids of the whole text, no special tokens added.

    Null and empty texts have no ids.  ``<|endoftext|>`` in a text is that token,
    as in the library.  Repeated rows stay.  An input column named like ``ids``
    is replaced.  ``leaf_chars`` bounds a leaf, not the text.
    """
    names = fresh_names(df, [ids])
    is_long = F.char_length(text_or_empty(text)) > leaf_chars
    short = arrow_map(
        df.where(~is_long), names, text, f"`{ids}` array<int>", _encoder(file, ranks, ids), BLOCK
    )
    long = df.where(is_long).select(*[F.col(f"`{n}`") for n in names], text_or_empty(text).alias(HIDDEN + "t"))
    long = long.withColumn(HIDDEN + "d", F.sha2(HIDDEN + "t", 256)).drop(HIDDEN + "t")
    texts = df.where(is_long).select(text_or_empty(text).alias("t"))
    made = _encode_long(texts, file, ranks, leaf_chars)
    joined = long.join(made, long[HIDDEN + "d"] == made["digest"])

    # An expression, unlike a mapped partition, lets columns that nobody asks for be left out before the join.
    @F.arrow_udf("array<int>")
    def unpacked(packed: pa.Array) -> pa.Array:
        kind = _packed(byte_bpe(file, ranks))
        return _lists([np.frombuffer(x.as_buffer(), kind) for x in packed])

    return short.unionByName(joined.select(*[long[n] for n in names], unpacked(made["packed"]).alias(ids)))


def decode(df: DataFrame, file: str, ranks: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with the column ``text``: what ``ids`` say, special tokens kept; null ids give the empty text."""
    names = fresh_names(df, [text])
    schema = df.select(*[F.col(f"`{n}`") for n in names]).withColumn(text, F.lit("")).schema
    at = names.index(ids)
    source = df.select(*[F.col(f"`{n}`") for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(file, ranks)
        for batch in batches:
            for first, last in ranges(pa.compute.list_value_length(batch.column(at)).to_pylist(), BLOCK):
                part = batch.slice(first, last - first)
                made = [bpe.text(_numbers(x)) for x in part.column(at)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(made, pa.string())], names=[*names, text])

    return source.mapInArrow(lean(run), schema)


def _numbers(ids: pa.Scalar) -> np.ndarray:
    return ids.values.to_numpy(zero_copy_only=False) if ids.is_valid else np.empty(0, "i4")


def _encoder(file: str, ranks: str, ids: str) -> Callable[[list[str]], dict[str, pa.Array]]:
    def work(texts: list[str]) -> dict[str, pa.Array]:
        bpe = byte_bpe(file, ranks)
        return {ids: _lists([bpe.ids(t) for t in texts])}

    return work


def _lists(ids: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype("i4")
    values = np.concatenate(ids).astype("i4", copy=False) if ids else np.empty(0, "i4")
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))


def _encode_long(texts: DataFrame, file: str, ranks: str, leaf_chars: int) -> DataFrame:
    """(digest, packed) of each distinct text: leaves encoded as rows, then joined per text.

    Leaves of copies are folded on their way to the tasks that encode them, and
    ids travel as bytes (see :func:`_packed`).
    """
    cut_schema = pa.schema([("digest", "string"), ("leaf", pa.int32()), ("piece", "string")])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for digest, text in zip(batch["digest"], batch["t"], strict=True):
                digest, pieces = digest.as_py(), leaves(text.as_py(), leaf_chars)
                rows = {"digest": [digest] * len(pieces), "leaf": list(range(len(pieces))), "piece": pieces}
                yield pa.RecordBatch.from_pydict(rows, schema=cut_schema)

    def leaf_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(file, ranks)
        for batch in batches:
            for first, last in slices(batch["piece"], BLOCK):
                part = batch.slice(first, last - first)
                made = [bpe.ids(p).astype(_packed(bpe)).tobytes() for p in part["piece"].to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part["digest"], part["leaf"], pa.array(made, pa.binary())], names=["digest", "leaf", "packed"]
                )

    def tree(group: pd.DataFrame) -> pd.DataFrame:
        bpe = byte_bpe(file, ranks)
        parts = [np.frombuffer(x, _packed(bpe)) for x in group.sort_values("leaf")["packed"]]
        return pd.DataFrame({"digest": [group["digest"].iloc[0]], "packed": [concatenate(bpe, parts).astype(_packed(bpe)).tobytes()]})

    pieces = texts.withColumn("digest", F.sha2("t", 256)).mapInArrow(lean(cut), "digest string, leaf int, piece string")
    encoded = pieces.dropDuplicates(["digest", "leaf"]).mapInArrow(lean(leaf_ids), "digest string, leaf int, packed binary")
    return encoded.groupBy("digest").applyInPandas(tree, "digest string, packed binary")


def _packed(bpe: ByteBpe) -> str:
    """The number type that holds any id: two bytes where the vocabulary allows it."""
    return "<u2" if bpe.size <= 1 << 16 else "<u4"


def leaves(text: str, size: int) -> list[str]:
    """The text in pieces of at most some ``size`` characters, halved where a split is sure, else after any character.

    No piece but the last ends in white space, and special tokens stay whole: a
    run of white space beyond ``size`` is not cut.
    """
    pieces: list[str] = []
    left = [(0, len(text))]
    while left:
        start, end = left.pop()
        at = _place(text, start, end) if end - start > size else None
        if at is None:
            pieces.append(text[start:end])
        else:
            left += [(at, end), (start, at)]
    return pieces


def _place(text: str, start: int, end: int) -> int | None:
    """Where to cut, near the middle; None if all is white space or one special token."""
    middle = (start + end) // 2
    found = _SURE.search(text, middle, min(end, middle + 1000))
    at = found.end() if found else middle
    # First onwards, then backwards, past white space and out of a special token.
    for step in (1, -1):
        while start < at < end:
            mark = text.find(END_OF_TEXT, max(start, at - len(END_OF_TEXT) + 1), min(end, at + len(END_OF_TEXT) - 1))
            if 0 <= mark < at:
                at = mark + len(END_OF_TEXT) if step > 0 else mark
            elif text[at - 1].isspace():
                at += step
            else:
                return at
        at = middle
    return None


def concatenate(bpe: ByteBpe, ids: list[np.ndarray]) -> np.ndarray:
    """Join encoded neighbours pair by pair until one is left."""
    while len(ids) > 1:
        pairs = [join(bpe, a, b) for a, b in zip(ids[::2], ids[1::2], strict=False)]
        ids = pairs + ids[2 * len(pairs) :]
    return ids[0] if ids else np.empty(0, "u4")


def join(bpe: ByteBpe, left: np.ndarray, right: np.ndarray, start: int = 4) -> np.ndarray:
    """The ids of two neighbouring pieces as one, from windows around the join that double until both sides agree."""
    if not len(left) or not len(right):
        return np.concatenate((left, right))
    width = start
    while True:
        a, b = min(width, len(left)), min(width, len(right))
        while a < len(left) and _cut_character(bpe, left[-a]):
            a += 1
        while b < len(right) and (_cut_character(bpe, right[b]) or _ends_in_space(bpe, right[:b])):
            b += 1
        new = bpe.ids((bpe.raw(left[len(left) - a :]) + bpe.raw(right[:b])).decode("utf-8"))
        if (a == len(left) or new[0] == left[-a]) and (b == len(right) or new[-1] == right[b - 1]):
            return np.concatenate((left[: len(left) - a], new, right[b:]))
        width *= 2


def _cut_character(bpe: ByteBpe, number: int) -> bool:
    """Whether a token begins inside a character."""
    return 0x80 <= bpe.bytes_of[number][0] < 0xC0


def _ends_in_space(bpe: ByteBpe, ids: np.ndarray) -> bool:
    """Whether the text of ids ends in white space; a character has four ids at most."""
    return bpe.raw(ids[-4:]).decode("utf-8", "ignore")[-1:].isspace()
