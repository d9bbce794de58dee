from __future__ import annotations

import collections

import numpy as np
import pytest

from cairnlog.llm import queries
from cairnlog.llm import syncmers as S

from .conftest import SF


def _plain(text: str, k: int, s: int) -> list[int]:
    """Closed syncmers by the definition, with the module's own hash of s-mers."""
    points = S.code_points(text)
    symbols = S.mix((points.astype(np.uint64) + np.uint64(1)) * S._ODD)
    inner = S.Rolling(symbols).windows(s).tolist()
    out = []
    for i in range(len(points) - k + 1):
        window = inner[i : i + k - s + 1]
        if min(window) in (window[0], window[-1]):
            out.append(i)
    return out


@pytest.mark.parametrize("block", [1 << 20, 37])
def test_syncmers_follow_the_definition(block):
    rng = np.random.default_rng(4)
    for n in (20, 21, 60, 700):
        text = "".join(rng.choice(list("abcdé日 ")) for _ in range(n))
        at, hashes = S.syncmers(S.code_points(text), block=block)
        want = _plain(text, S.K, S.S)
        assert at.tolist() == (want or [0]) and len(hashes) == len(at)


def test_anchors_need_no_context():
    rng = np.random.default_rng(4)
    word = lambda n: "".join(rng.choice(list("abcdefgh ")) for _ in range(n))
    shared = word(300)
    inside = dict(zip(*map(np.ndarray.tolist, S.syncmers(S.code_points(shared))), strict=True))
    before = word(77)
    at, hashes = S.syncmers(S.code_points(before + shared + word(50)))
    found = {p - 77: h for p, h in zip(at.tolist(), hashes.tolist(), strict=True) if 0 <= p - 77 <= 300 - S.K}
    assert found == inside


def test_sketch_and_likeness():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 5000).astype(np.uint64) * np.uint64(2)
    assert (S.sketch(a) == np.unique((a >> np.uint64(32)).astype(np.uint32))[: S.SLOTS]).all()
    b = np.concatenate((a[:2500], rng.integers(0, 2**63, 2500).astype(np.uint64) * np.uint64(2)))
    assert abs(S.likeness(S.sketch(a), S.sketch(b)) - 1 / 3) < 0.13
    none = np.empty(0, np.uint64)
    assert S.likeness(S.sketch(none), S.sketch(none)) == 1.0 and S.likeness(S.sketch(a), S.sketch(none)) == 0.0


def _edited(rows):
    out = []
    for i, (key, text) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        own, changed, after = (S.sketch(S.syncmers(S.code_points(t))[1]) for t in (text, edited, following))
        out.append((key, len(text), edited, S.shown(own), S.shown(changed), S.likeness(own, changed), S.likeness(own, after)))
    return collections.Counter(out)


def test_neighbours(spark, docs, odd, nothing):
    for table in (docs, odd):
        rows = sorted(((r.doc_id, r.text or "") for r in table.collect()), key=lambda r: (r[0] is None, r[0], r[1].encode()))
        got = S.with_neighbours(table)
        assert collections.Counter(map(tuple, got.collect())) == _edited(rows)
    one = spark.createDataFrame([(5, "alone with itself, and long enough")], "doc_id long, text string")
    assert S.with_neighbours(one).first().near_next == 1.0
    assert S.with_neighbours(nothing).collect() == []


def test_whole_fingerprints(spark, nothing):
    rng = np.random.default_rng(9)
    word = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    shared, long = word(1000), word(200_000)
    texts = [long, long[:100_000] + shared + long[101_000:], word(80_000) + shared + word(80_000), "", "naïve 日本語 😀 and so on"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in S.with_neighbours(table, whole=True).collect()}
    found = [S.syncmers(S.code_points(t)) for t in texts]
    for i, (at, hashes) in enumerate(found):
        places, kept = S.unlisted(got[i].fingerprint)
        assert places.tolist() == at.tolist() and kept.tolist() == hashes.tolist()
        a, b = set(hashes.tolist()), set(found[(i + 1) % len(texts)][1].tolist())
        assert got[i].near_next == (len(a & b) / len(a | b) if a and b else float(a == b))
        places, kept = S.unlisted(got[i].edited_fingerprint)
        at, hashes = S.syncmers(S.code_points(got[i].edited_text))
        assert places.tolist() == at.tolist() and kept.tolist() == hashes.tolist()
        assert got[i].near_edited == S.likeness(np.unique(found[i][1]), np.unique(hashes), None)
    assert got[0].fingerprint != got[1].fingerprint and got[0].near_next < 1.0
    assert got[1].near_next > 0.0
    # the passage is found by position: anchors in common lie the same distance apart
    (p, a), (q, b) = (S.unlisted(got[i].fingerprint) for i in (1, 2))
    where = dict(zip(a.tolist(), p.tolist(), strict=True))
    assert {where[h] - at for h, at in zip(b.tolist(), q.tolist(), strict=True) if h in where} == {100_000 - 80_000}
    assert S.with_neighbours(nothing, whole=True).collect() == []


def test_the_query_keeps_every_anchor(spark, docs):
    rows = {r.doc_id: r for r in queries.op1_syncmer_fingerprints(spark, SF).collect()}
    for r in docs.limit(40).collect():
        at, hashes = S.syncmers(S.code_points(r.text or ""))
        places, kept = S.unlisted(rows[r.doc_id].fingerprint)
        assert places.tolist() == at.tolist() and kept.tolist() == hashes.tolist()


def test_anchor_table(spark, odd, nothing):
    rows = S.anchors(odd).where("doc_id = 1").collect()
    at, _ = S.syncmers(S.code_points("the same text, again and again"))
    assert sorted(r.position for r in rows) == at.tolist()
    assert S.anchors(odd).where("doc_id in (4, 5)").count() == 0 == S.anchors(nothing).count()
