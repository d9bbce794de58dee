from __future__ import annotations

import collections
import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cairnlog.llm import exact, simhash, substrings


def _groups(rows):
    by = collections.defaultdict(list)
    for key, text in rows:
        by[text or ""].append(key)
    out = []
    for text, keys in by.items():
        known = [k for k in keys if k is not None]
        keep = max(known) if known else None
        left = 1
        for k in keys:
            kept = k == keep and left > 0
            left -= kept
            out.append((k, keep, len(keys), kept, hashlib.sha256(text.encode()).hexdigest()))
    return collections.Counter(out)


@pytest.mark.parametrize("bits", [256, 8])
def test_exact(spark, odd, docs, bits):
    for table in (odd, docs):
        got = exact.deduplicate(table, digest_bits=bits)
        assert collections.Counter(map(tuple, got.collect())) == _groups((r.doc_id, r.text) for r in table.select("doc_id", "text").collect())


def test_exact_state_grows_over_batches(spark, docs):
    copies = docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 10_000)).repartition(8)
    got = exact.deduplicate(copies, batches=4)
    assert got.where("kept").count() == docs.select("text").distinct().count()
    assert got.where("kept").agg(F.min("doc_id")).first()[0] >= 10_000


def test_keep_one_keeps_columns(spark, odd, nothing):
    kept = exact.keep_one(odd)
    assert kept.columns == odd.columns
    texts = [r.text or "" for r in kept.collect()]
    assert sorted(texts) == sorted({r.text or "" for r in odd.collect()})
    assert exact.keep_one(nothing).collect() == [] and exact.deduplicate(nothing).collect() == []


def _simhash(text: str) -> int:
    words = (text or "").encode().lower().split()
    parts = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def _components(values: list[int], distance: int) -> list[int]:
    parent = list(range(len(values)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= distance:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(values))]


def test_fingerprints(spark, odd, docs):
    for table in (odd, docs):
        rows = simhash.fingerprints(table).collect()
        own = collections.Counter((r.doc_id, _simhash(r.text)) for r in table.collect())
        assert collections.Counter((r.doc_id, r.fingerprint % 2**64) for r in rows) == own


def test_components_are_the_brute_force_ones(spark, docs, odd, nothing):
    for table in (docs, odd):
        rows = table.select("doc_id", "text").collect()
        roots = _components([_simhash(r.text) for r in rows], 2)
        least = {}
        for r, c in zip(rows, roots, strict=True):
            if r.doc_id is not None:
                least[c] = min(least.get(c, r.doc_id), r.doc_id)
        want = collections.Counter((r.doc_id, least.get(c)) for r, c in zip(rows, roots, strict=True))
        assert collections.Counter((r.doc_id, r.component_id) for r in simhash.components(table).collect()) == want
    assert simhash.components(nothing).collect() == []


@pytest.mark.parametrize("limits", [{"shard_size": 40}, {"shard_size": 40, "shard_limit": 10}, {"sample_size": 64, "shard_size": 30}])
def test_no_link_is_lost_in_small_shards(spark, limits):
    rng = random.Random(9)
    values = []
    for _ in range(60):
        value = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            values.append(value)
            for _ in range(rng.randint(0, 3)):
                value ^= 1 << rng.randrange(64)
    values += [rng.getrandbits(8) for _ in range(40)]
    values = sorted({v - 2**64 if v >= 2**63 else v for v in values})
    points = spark.createDataFrame([(v,) for v in values], "fingerprint long")
    found = {r.node: r.root for r in simhash.connected(simhash.links(points, 2, **limits)).collect()}
    roots = _components([v % 2**64 for v in values], 2)
    groups, own = collections.defaultdict(set), collections.defaultdict(set)
    for v, r in zip(values, roots, strict=True):
        groups[r].add(v)
        own[found.get(v, v)].add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, own.values()))


def test_long_chains_connect(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "a long, b long")
    found = {r.node: r.root for r in simhash.connected(edges).collect()}
    assert found == {i: 0 for i in range(1, 201)} | {501: 500}


def test_near_keep_one(spark, odd):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    keys = [r.doc_id for r in kept.select("doc_id").collect()]
    assert sorted(k for k in keys if k)[0] == 1 and keys.count(None) == 2


def _remove(rows, length):
    texts = [(k, (t or "").encode()) for k, t in rows]
    starts = collections.Counter(b[i : i + length] for _, b in texts for i in range(len(b) - length + 1))
    out = []
    for key, b in texts:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if starts[b[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((key, len(b), int(gone.sum()), runs, np.frombuffer(b, np.uint8)[~gone].tobytes()))
    return collections.Counter(out)


@pytest.mark.parametrize("limit", [4000, 3])
def test_repeats_are_removed_exactly(spark, limit):
    rng = random.Random(5)

    def words(n):
        return "".join(rng.choice("abcdé ") for _ in range(n))

    shared = [words(60) for _ in range(4)]
    rows = [
        (i, "".join(rng.choice([*shared, words(rng.randint(0, 50))])[rng.randint(0, 10) :] for _ in range(rng.randint(0, 6))))
        for i in range(60)
    ]
    rows += [(3, rows[3][1]), (None, rows[4][1]), (None, None), (70, "ab" * 100), (71, "a" * 90), (72, ""), (73, "a" * 39)]
    table = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, kept string, span long")
    got = substrings.remove_repeats(table, length=40, group_limit=limit)
    assert set(got.columns) == {"doc_id", "span", "n_bytes", "n_removed", "n_spans", "n_repeated_grams", "kept"}
    found = collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got.collect())
    assert found == _remove(rows, 40)
    # anchors whose 20 bytes repeat: some where bytes were removed, none where no 20 bytes repeat
    texts = [(t or "").encode() for _, t in rows]
    grams = collections.Counter(t[i : i + 20] for t in texts for i in range(len(t) - 19))
    for r in got.collect():
        assert r.n_repeated_grams > 0 if r.n_removed else r.n_repeated_grams >= 0
    counted = {(r.doc_id, r.n_bytes): r.n_repeated_grams for r in got.collect()}
    for (key, _), t in zip(rows, texts, strict=True):
        if all(grams[t[i : i + 20]] < 2 for i in range(len(t) - 19)):
            assert counted[key, len(t)] == 0


@pytest.mark.parametrize(("limit", "n"), [(4000, 12), (3, 11)])
def test_shared_words_are_counted_exactly(spark, limit, n):
    rng = random.Random(11)

    def words(n):
        return [rng.choice(["a", "b", "é", "日本", "x" * 30]) for _ in range(n)]

    shared = [words(14) for _ in range(3)]
    made = [sum((rng.choice([*shared, words(rng.randint(0, 9))])[rng.randint(0, 5) :] for _ in range(rng.randint(0, 5))), []) for _ in range(50)]
    texts = [rng.choice(["", " "]) + "".join(w + rng.choice([" ", "\n", " \t "]) for w in own) for own in made]
    rows = [*enumerate(texts), (3, texts[3]), (None, texts[4]), (None, None), (70, "a b " * 40), (71, ""), (72, "q " * 11)]
    # a passage of twelve words and few bytes in two texts: nothing of 400 bytes repeats
    rows += [(80, "one two three four five six seven eight nine ten eleven twelve"), (81, "0 one two three four five six seven eight nine ten eleven twelve 13")]
    table = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, n_shared_words long")
    got = substrings.remove_repeats(table, n_words=n, group_limit=limit).collect()
    split = [(k, (t or "").split()) for k, t in rows]
    owners = collections.defaultdict(set)
    for row, (_, w) in zip(rows, split, strict=True):
        for i in range(len(w) - n + 1):
            owners[tuple(w[i : i + n])].add((row[0], row[1] or ""))
    expected = collections.Counter()
    for (key, w), (_, t) in zip(split, rows, strict=True):
        gone = {i + j for i in range(len(w) - n + 1) if len(owners[tuple(w[i : i + n])]) > 1 for j in range(n)}
        expected[key, len((t or "").encode()), len(gone)] += 1
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_shared_words) for r in got) == expected
    by = {r.doc_id: r for r in got}
    assert by[80].n_shared_words == by[81].n_shared_words == 12 and by[80].n_removed == 0


def test_words_are_numbered_in_blocks():
    from cairnlog.llm.suffixes import words

    data = np.frombuffer(("  ab  cd\n" + "e" * 50 + " ab\t日本 cd").encode(), np.uint8)
    whole = words(data)
    assert len(whole) == 6 and whole[0] == whole[3] and whole[1] == whole[5] and len(set(whole.tolist())) == 4
    for block in (1, 7, 30):
        assert (words(data, block) == whole).all()
    assert len(words(np.empty(0, np.uint8))) == 0


def test_repeats_in_the_tables(spark, docs, odd, nothing):
    small = docs.select("doc_id", "text").limit(120)
    rows = [(r.doc_id, r.text) for r in small.collect()]
    got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got.collect()) == _remove(rows, 400)
    by = {r.doc_id: r for r in substrings.remove_repeats(odd).collect()}
    assert by[8].n_removed == 70_000 and by[9].n_removed == 0 and by[5].n_bytes == 0
    assert substrings.remove_repeats(nothing).collect() == []


def test_blocks_of_a_long_text_change_nothing():
    from cairnlog.llm.suffixes import text_anchors

    data = np.random.default_rng(2).integers(97, 101, 5000).astype(np.uint8)
    whole, cut = text_anchors(data, 100, 50), text_anchors(data, 100, 50, block=333)
    for a, b in zip(whole, cut, strict=True):
        assert (a == b).all()
