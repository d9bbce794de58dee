from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from cairnlog.llm import bpe, packing, queries, tokens
from cairnlog.llm.tokens import byte_bpe, word_bpe

TEXTS = [
    "", " ", "\n\n", "a  b\n\n c\t d", "it's 'TIS don't I'LL x'sy", "日本語 テスト é É", "İstanbul ΣΑΣ \x1cx", "...'s 3.14 a_b__c",
    "<|endoftext|>x<|endoftext|> <|endoftext|>", "a" * 3000, "ab" * 900 + " ab", "<|startoftext|> A <|", "x y z", "ﬁ µ ª ²",
]


@pytest.fixture(scope="module")
def both():
    return byte_bpe(queries.BYTE_FILE, queries.BYTE_RANKS), word_bpe(queries.WORD_FILE)


@pytest.fixture(scope="module")
def libraries():
    return Tokenizer.from_file(queries.BYTE_FILE), Tokenizer.from_file(queries.WORD_FILE)


def test_ids_are_the_librarys(both, libraries, docs):
    own_byte, own_word = both
    byte, word = libraries
    texts = TEXTS + [r.text for r in docs.collect()]
    packed = own_word.packed(texts)
    for text, data in zip(texts, packed, strict=True):
        ids = byte.encode(text, add_special_tokens=False).ids
        assert own_byte.ids(text).tolist() == ids
        assert own_byte.text(np.array(ids)) == byte.decode(ids, skip_special_tokens=False)
        assert np.frombuffer(data, "<u4").tolist() == word.encode(text, add_special_tokens=False).ids


def test_distinct_pieces_of_a_block_are_merged_once(both, libraries, monkeypatch):
    """Pieces that differ in case only are one; special tokens are not looked for at every character."""
    own, word = both[1], libraries[1]
    own.forget()
    merged = []
    monkeypatch.setattr(own, "_merged", lambda pieces, merge=own._merged: merged.extend(pieces) or merge(pieces))
    for kind in (pa.string(), pa.large_string()):
        texts = pa.array(["skipped", "The THE the", " the,\tÄHNLICH ähnlich\r\n", "", "日本 the", "don't THE, x'll", " "], kind).slice(1)
        for data, text in zip(own.packed(texts), texts.to_pylist(), strict=True):
            assert np.frombuffer(data, "<u4").tolist() == word.encode(text, add_special_tokens=False).ids
    assert sorted(merged) == ["", "don't", "the", "the,", "x'll", "ähnlich"]
    assert own._bulk.special_tokens_set
    assert own.packed([]) == [] and own.packed(["日"])[0] == np.array(word.encode("日", add_special_tokens=False).ids, "<u4").tobytes()


def test_remembered_pieces_of_both_generations_have_the_librarys_ids(libraries, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 30)
    own, rng = tokens.WordBpe(queries.WORD_FILE), random.Random(7)
    kinds = ["the", "Ändern", "'s", "3", "...", "é", "don't", "zyx", "<", "|>"]
    words = ["".join(rng.choices(kinds, k=rng.randint(1, 4))) for _ in range(90)]
    words = [w for w in words if "<|" not in w]
    for _ in range(40):
        texts = [" ".join(rng.choices(words, k=rng.randint(0, 12))) for _ in range(4)]
        for data, text in zip(own.packed(texts), texts, strict=True):
            assert np.frombuffer(data, "<u4").tolist() == libraries[1].encode(text, add_special_tokens=False).ids
        assert len(own._young) <= 48 and len(own._old) <= 48


def test_joined_halves_are_the_whole(both, libraries):
    own, byte = both[0], libraries[0]
    rng = random.Random(3)
    kinds = ["aab", "abcdefgh", "é日a😀", "0123456789", "-=*", "the ing tion and", "x\n y"]
    for _ in range(150):
        text = "".join(rng.choice(rng.choice(kinds)) for _ in range(rng.randint(2, 300)))
        pieces = bpe.leaves(text, rng.randint(1, 40))
        assert "".join(pieces) == text
        assert bpe.concatenate(own, [own.ids(p) for p in pieces]).tolist() == byte.encode(text, add_special_tokens=False).ids
    run = "".join(rng.choice("ab") for _ in range(5000))
    assert bpe.concatenate(own, [own.ids(p) for p in bpe.leaves(run, 64)]).tolist() == byte.encode(run, add_special_tokens=False).ids


def test_long_texts_of_any_script_are_cut(both, libraries):
    """Ids of the whole from leaves of few characters: words, marks, contractions, white space and special tokens."""
    own, byte = both[0], libraries[0]
    rng = random.Random(5)
    words = {
        "Cyrillic": ["съешь", "же", "ещё", "этих", "булок", "да", "№7", "—"], "Greek": ["ξεσκεπάζω", "την", "ψυχή", "ΣΑΣ", "ό,τι"],
        "Arabic": ["نصٌّ", "حكيمٌ", "له", "سرٌّ", "١٢٣", "،"], "Hindi": ["हिन्दी", "में", "लेख", "।"], "marks": ["don't", "x'", "'s", "…", "\u00a0", "\u3000", "😀"],
    }
    solid = ["日本語の文章です。", "二つ目、", "가나다", "「引用」", "１２３", "é", "'s", "<|endoftext|>", "😀", "\u3000", "𠀀", "a"]
    texts = [rng.choice([" ", "\n", "  "]).join(rng.choices(w, k=120)) for w in words.values()]
    texts += [" ".join(rng.choices(sum(words.values(), []) + solid, k=200)) for _ in range(10)]
    texts += ["".join(rng.choices(solid, k=120)) for _ in range(10)] + ["語" * 700, "ё" * 700, "😀" * 300, "<|endoftext|>" * 40]
    texts += ["".join(rng.choices("!'’\"stvelmdr x\u3000\n ", k=300)) for _ in range(60)]
    for text in texts:
        for size in (1, 7, 50):
            pieces = bpe.leaves(text, size)
            assert "".join(pieces) == text
            assert max(len(p) for p in pieces) <= size + 26
            assert bpe.concatenate(own, [own.ids(p) for p in pieces]).tolist() == byte.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("leaf", [65_536, 300])
def test_round_trip(spark, odd, nothing, libraries, leaf):
    encoded = bpe.encode(odd, queries.BYTE_FILE, queries.BYTE_RANKS, leaf_chars=leaf)
    rows = bpe.decode(encoded, queries.BYTE_FILE, queries.BYTE_RANKS, text="score").collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert r["ids"] == libraries[0].encode(r["text"] or "", add_special_tokens=False).ids
        assert r["score"] == (r["text"] or "")
    assert bpe.encode(nothing, queries.BYTE_FILE, queries.BYTE_RANKS).collect() == []


def test_decoded_batches_are_small(spark, monkeypatch):
    """A worker holds the decoded texts of some ids at a time, and words only while it has a task."""
    import pyarrow as pa

    runs = []
    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", lambda self, run, schema: runs.append(run) or self)
    monkeypatch.setattr(bpe, "BLOCK", 10)
    bpe.decode(spark.createDataFrame([], "doc_id long, ids array<int>"), queries.BYTE_FILE, queries.BYTE_RANKS)
    ids = [[1, 2, 3], None, [4] * 25, [], [5] * 6, [6] * 6]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])
    out = list(runs[0](iter([batch])))
    assert [b.num_rows for b in out] == [2, 1, 2, 1]
    own = byte_bpe(queries.BYTE_FILE, queries.BYTE_RANKS)
    assert [t for b in out for t in b["decoded"].to_pylist()] == [own.text(np.array(x or [], "i4")) for x in ids]
    packing.pieces(spark.createDataFrame([(1, "a")], "doc_id long, text string"), queries.WORD_FILE)
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["some words to keep"])], names=["doc_id", "text"])
    assert sum(b.num_rows for b in runs[1](iter([batch]))) == 1
    assert not word_bpe(queries.WORD_FILE)._young


def test_sequences_hold_every_id_once(spark, docs, odd, nothing, libraries):
    for table in (docs.select("doc_id", "text"), odd.where("doc_id is not null").dropDuplicates(["doc_id"])):
        cut = packing.pieces(table, queries.WORD_FILE)
        own = {r.doc_id: libraries[1].encode(r.text or "", add_special_tokens=False).ids + [2] for r in table.collect()}
        rows = packing.pack(cut).collect()
        assert sum(r.length for r in rows) == sum(map(len, own.values()))
        for r in rows:
            ids = own[r.doc_id]
            assert r.doc_tokens == len(ids)
            assert bytes(r.ids) == np.array(ids[r.start : r.start + r.length], "<u4").tobytes()
        _gapless(rows)
    assert packing.pack(packing.pieces(nothing, queries.WORD_FILE)).collect() == []


def test_query_packs_whole_documents(spark, docs):
    rows = queries.packed(docs).collect()
    _gapless(rows)
    row = max(rows, key=lambda r: r.doc_tokens)
    ids = word_bpe(queries.WORD_FILE).packed([docs.where(f"doc_id = {row.doc_id}").first().text])[0] + b"\2\0\0\0"
    assert row.ids_crc32 == zlib.crc32(ids[4 * row.start : 4 * (row.start + row.length)])


def test_ties_and_repeated_rows_have_places_of_their_own(spark):
    rows = [(1, 0, 10)] * 500 + [(i, 0, 1 + i % 30) for i in range(500)]
    _gapless(packing.pack(spark.createDataFrame(rows, "doc_id long, start long, length long"), capacity=64).collect(), 64)


def test_packing_writes_the_pieces_and_no_more(spark, monkeypatch):
    """The counts of lengths would be a file for each shuffle partition, and a few processes for each file."""
    written = []
    monkeypatch.setattr(packing, "settle", lambda df, settle=packing.settle: written.append(df.columns) or settle(df))
    cut = spark.createDataFrame([(i, 0, 1 + i % 7) for i in range(200)], "doc_id long, start long, length long")
    rows = packing.pack(cut, capacity=16).collect()
    _gapless(rows, 16)
    assert len(rows) == 200 and written == [["doc_id", "start", "length"]]


def test_plan_leaves_little_padding():
    rng = random.Random(1)
    histogram: dict[int, int] = {}
    for _ in range(20_000):
        n = min(4096, 1 + int(rng.expovariate(1 / 700)))
        histogram[n] = histogram.get(n, 0) + 1
    made = packing.plan(histogram, 4096)
    used = sum(k * n for k, n in histogram.items())
    assert made.sequences * 4096 < 1.02 * used + 4096
    assert packing.plan({}, 4096).sequences == 0


def _gapless(rows, capacity: int = 4096) -> None:
    sequences: dict[int, list] = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
