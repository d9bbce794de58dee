"""Ids of the public BPE vocabularies, exactly as the tokenizers library gives them.

Plain texts (ASCII and the letters of Latin-1) take a fast route with the same
merges; all others, on which two libraries might disagree about letters or
white space, go to the tokenizers library as they are.
"""

from __future__ import annotations

import base64
import functools
import json
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
import tiktoken
from tokenizers import Tokenizer

#: Pieces remembered by a worker before it starts anew; bounds its memory.
REMEMBERED = 100_000
#: Characters for which cutting, lower-casing and normalising are known to agree between libraries.
PLAIN = "\t\n\r\x20-\x7eÀ-ÖØ-öø-ÿ"
_NOT_PLAIN = re.compile(f"[^{PLAIN}]")
END_OF_TEXT = "<|endoftext|>"


def is_plain(text: str) -> bool:
    return _NOT_PLAIN.search(text) is None


class ByteBpe:
    """The byte-level vocabulary: ids of any text, and the text of ids."""

    def __init__(self, file: str, ranks: str) -> None:
        self.library = _library(file)
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.words = tiktoken.Encoding(
            "words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}
        )
        self.special = self.library.token_to_id(END_OF_TEXT)
        self.size = max(max(table.values()), self.special) + 1
        self.bytes_of: list[bytes] = [b""] * self.size
        for token, number in table.items():
            self.bytes_of[number] = token
        self.bytes_of[self.special] = END_OF_TEXT.encode()

    def ids(self, text: str) -> np.ndarray:
        """The ids of a whole text."""
        if END_OF_TEXT not in text:
            return self._segment(text)
        mark, parts = np.array([self.special], "u4"), []
        for part in text.split(END_OF_TEXT):
            parts += [self._segment(part), mark]
        return np.concatenate(parts[:-1])

    def _segment(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, "u4")
        if is_plain(text):
            return self.words.encode_to_numpy(text, disallowed_special=()).astype("u4", copy=False)
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "u4")

    def raw(self, ids: np.ndarray) -> bytes:
        """The bytes that ids stand for."""
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))

    def text(self, ids: np.ndarray) -> str:
        """The text of ids, special tokens kept; bytes that are no UTF-8 become U+FFFD."""
        return self.raw(ids).decode("utf-8", "replace")


class WordBpe:
    """The vocabulary with word ends: lower case, white space dropped.

    Plain texts are cut at white space a block at a time, as Arrow columns, and
    each distinct piece of a block is looked up once.  The ids of pieces are
    remembered in two generations.  New pieces are merged in bulk: a mark after
    each word stands for the word end, and joining it to the last byte comes
    before all other merges, which is what a vocabulary with word ends does.
    """

    _WORD = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^ \t\n\ra-z0-9ß-öø-ÿ]+|\n")
    _END = "\0"

    def __init__(self, file: str) -> None:
        self.library = _library(file)
        with open(file, encoding="utf-8") as model:
            model = json.load(model)["model"]
        vocabulary, suffix = model["vocab"], model["end_of_word_suffix"]
        real: list[int] = []
        ranks: dict[bytes, int] = {}

        def put(token: bytes, number: int) -> None:
            ranks[token] = len(real)
            real.append(number)

        letters = {shown: bytes([byte]) for byte, shown in _shown_bytes().items()}
        put(self._END.encode(), 0)
        for shown, byte in letters.items():
            if byte != self._END.encode():
                put(byte + self._END.encode(), vocabulary[shown + suffix])
        for shown, byte in letters.items():
            if byte != self._END.encode():
                put(byte, vocabulary[shown])
        for left, right in model["merges"]:
            token = left + right
            whole = b"".join(map(letters.__getitem__, token.removesuffix(suffix)))
            put(whole + self._END.encode() * token.endswith(suffix), vocabulary[token])
        self._real = np.array(real, "<u4")
        self._break = list(ranks).index(f"\n{self._END}".encode())
        # with no special token at all, tiktoken looks for one at every character
        self._bulk = tiktoken.Encoding(
            "word ends", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={END_OF_TEXT: len(real)}
        )
        self._young: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}

    def packed(self, texts: list[str] | pa.Array) -> list[bytes]:
        """The ids of whole texts as bytes (little-endian unsigned 32-bit numbers)."""
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.large_string())
        other = pa.compute.match_substring_regex(texts, _NOT_PLAIN.pattern + r"|<\|")
        cut = pa.compute.ascii_split_whitespace(pa.compute.utf8_lower(texts.filter(pa.compute.invert(other))))
        pieces = cut.flatten().dictionary_encode()
        ids = self._of(pieces.dictionary.to_numpy(zero_copy_only=False).tolist())
        # where the ids of each distinct piece begin, then those of each piece of the texts
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        numbers = pieces.indices.to_numpy()
        starts, sizes = (np.cumsum(sizes) - sizes)[numbers], sizes[numbers]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        places = np.repeat(starts - ends[:-1], sizes) + np.arange(ends[-1])
        data = np.frombuffer(b"".join(ids), "<u4")[places].tobytes()
        edges = [0, *(4 * ends[np.cumsum(pa.compute.list_value_length(cut).to_numpy(), dtype=np.int64)]).tolist()]
        plain = (data[a:b] for a, b in zip(edges, edges[1:], strict=False))
        rest = (self.library.encode(t, add_special_tokens=False).ids for t in texts.filter(other).to_pylist())
        return [np.array(next(rest), "<u4").tobytes() if x else next(plain) for x in other.to_numpy(zero_copy_only=False)]

    def forget(self) -> None:
        """Drop what is remembered."""
        self._young, self._old = {}, {}

    def _of(self, pieces: list[str]) -> list[bytes]:
        """The ids of distinct pieces in lower case."""
        ids = list(map(self._young.get, pieces))
        made = {p: self._old.get(p) for p, x in zip(pieces, ids, strict=True) if x is None}
        new = [p for p, x in made.items() if x is None]
        if new:
            made.update(zip(new, self._merged(new), strict=True))
        if len(self._young) + len(made) > REMEMBERED:
            self._old, self._young = self._young, {}
        self._young.update(made)
        return [made[p] if x is None else x for p, x in zip(pieces, ids, strict=True)]

    def _merged(self, pieces: list[str]) -> list[bytes]:
        """The ids of pieces that are not remembered; line feeds, which no piece has, tell where one ends."""
        words = self._WORD.findall("\n".join(pieces) + "\n")
        ids = self._bulk.encode_to_numpy(self._END.join(words) + self._END, disallowed_special=())
        data, ends = self._real[ids].tobytes(), (4 * np.flatnonzero(ids == self._break)).tolist()
        return [data[a + 4 : b] for a, b in zip([-4, *ends], ends, strict=False)]


def _library(file: str) -> Tokenizer:
    library = Tokenizer.from_file(file)
    library.no_truncation()
    library.no_padding()
    return library


def _shown_bytes() -> dict[int, str]:
    """The character that byte-level vocabularies write for each byte."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    unseen = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(unseen)}


@functools.lru_cache(maxsize=2)
def byte_bpe(file: str, ranks: str) -> ByteBpe:
    """The worker's encoder, loaded once."""
    return ByteBpe(file, ranks)


@functools.lru_cache(maxsize=2)
def word_bpe(file: str) -> WordBpe:
    """The worker's encoder, loaded once."""
    return WordBpe(file)
