from __future__ import annotations

import collections
import hashlib
import random
import zlib

import pytest

from cairnlog.llm import queries, trie

from .conftest import SF


def _sequences(df):
    rows = collections.defaultdict(list)
    for r in df.select("conv_id", "turn", "role", "text").collect():
        if r.conv_id is not None:
            rows[r.conv_id].append(((r.turn is not None, r.turn or 0), r.role or "", r.text or ""))
    return {c: [turn[1:] for turn in sorted(v, key=lambda t: t[0])] for c, v in rows.items()}


def _rebuilt(sequences):
    out = {}
    for c, own in sequences.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = sequences.get(c - c % 100, [])[:h] + own[h:]
    return out


def _nodes(sequences):
    members, ends = collections.defaultdict(set), collections.defaultdict(list)
    for c, path in sequences.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].add(c)
        ends[tuple(path)].append(c)
    kids = collections.Counter(k[:-1] for k in members if k)
    leaves, saved = collections.Counter(), collections.Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(m) - 1) * (len(k[-1][1]) if k else 0)
            leaves[k[:d]] += kids[k] == 0
    digest = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return collections.Counter(
        (min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k], digest(ends.get(k, [])))
        for k, m in members.items()
    )


def _found(df):
    return collections.Counter(map(tuple, df.select(*trie.COLUMNS).collect()))


def _plain(df, **limits):
    turns = trie.numbered(df)
    return trie.prefix_trie(turns, turns.select("conv").distinct(), **limits)


@pytest.fixture(scope="module")
def branching(spark):
    """Few texts, so that sequences part late; three long copies, two of which part at the end; ids of many ranges."""
    rng = random.Random(3)
    rows = []
    for c in [*range(40), 100, 101, 205, 300, 9000, 9001]:
        n = 11 if c in (7, 8, 9) else rng.choice([1, 2, 3, 5, 9])
        for t in range(n):
            text = f"long {t + (c == 9 and t == 10)}" if c in (7, 8, 9) else rng.choice(["a", "bb", "ccc"][: 2 if t < 3 else 3])
            rows.append((c, t, "user" if t % 2 else None, text))
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


@pytest.mark.parametrize("limits", [{"width": 4, "ranges": 5}, {"width": 512, "ranges": 7}, {"ranges": 1}])
def test_nodes_equal_brute_force(branching, limits):
    assert _found(_plain(branching, **limits)) == _nodes(_sequences(branching))


def test_rebuilt_conversations(branching):
    turns, members = trie.rebuilt(trie.numbered(branching))
    assert _found(trie.prefix_trie(turns, members)) == _nodes(_rebuilt(_sequences(branching)))


def test_query_over_the_table(spark):
    got = queries.QUERIES["op11_prefix_trie"](spark, SF)
    assert [c for c, _ in got.dtypes] == trie.COLUMNS
    assert _found(got) == _nodes(_rebuilt(_sequences(spark.read.parquet(f"{SF}/conversations.parquet"))))


def test_odd_rows(spark):
    schema = "conv_id long, turn long, role string, text string, depth string, a int"
    rows = [
        (1, None, None, None, "x", 1), (1, 0, "user", "naïve 😀", "x", 1), (2, 0, "user", "naïve 😀", None, 2),
        (None, 0, "user", "no conversation", None, None), (3, 0, "user", "t" * 50_000, "y", 3), (3, 0, "user", "t" * 50_000, "y", 3),
        (-5, 2, "", "", None, None), (1, 5, "user", "", "x", 1),
    ]
    odd = spark.createDataFrame(rows, schema)
    assert _found(_plain(odd, ranges=3)) == _nodes(_sequences(odd))
    # turns that tie are in the order of their digests, whatever the order of the rows
    ties = [(c, 0, "user", t) for c in (1, 2) for t in (("x", "y", "z") if c == 1 else ("z", "x", "y"))]
    tied = spark.createDataFrame(ties, "conv_id long, turn long, role string, text string")
    assert sorted((r.depth, r.n_convs) for r in _plain(tied).collect()) == [(0, 2), (1, 2), (2, 2), (3, 2)]
    none = spark.createDataFrame([], schema)
    assert _plain(none).collect() == []


def test_splitters_are_short_and_in_order():
    rng = random.Random(5)
    sample = []
    for _ in range(400):
        path = tuple(rng.randrange(3) for _ in range(rng.choice([0, 1, 3, 6])))
        sample.append(((0, 0, *[x for p in path for x in (p, p)]), path))
    skeleton = trie.Skeleton(sample, 16)
    assert skeleton.splitters == sorted(set(skeleton.splitters)) and len(skeleton.splitters) > 4
    paths = {elements for elements, _ in sample}
    for prefix in {p[:d] for p in paths for d in range(2, len(p) + 1, 2)}:
        ranges = {skeleton.range_of(p) for p in paths if p[: len(prefix)] == prefix}
        assert len(ranges) == 1 or skeleton.number(prefix) >= 0
