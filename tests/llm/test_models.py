from __future__ import annotations

import collections
import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnlog.llm import chain, html, lm, pii, queries, recurrent, toxicity, trees
from cairnlog.llm.tokens import byte_bpe

from .conftest import SF


def _all_labelings(gain, start, step):
    total, one = 0.0, np.zeros(len(gain))
    for y in itertools.product((0, 1), repeat=len(gain)):
        score = start[y[0]] + sum(g for g, v in zip(gain, y, strict=True) if v) + sum(step[a, b] for a, b in zip(y, y[1:], strict=False))
        total += np.exp(score)
        one += np.exp(score) * np.array(y)
    return one / total


def test_marginals_are_sums_over_labelings():
    rng = np.random.default_rng(0)
    start, step = rng.normal(size=2), rng.normal(size=(2, 2))
    parts = [rng.normal(size=n) * 2 for n in (1, 5, 9, 3)]
    starts = np.concatenate([[True] + [False] * (len(p) - 1) for p in parts])
    got = chain.marginals(np.concatenate(parts), starts, start, step)
    assert np.allclose(got, np.concatenate([_all_labelings(p, start, step) for p in parts]))


def test_blocks_of_the_chain_agree_with_single_sequences():
    rng = np.random.default_rng(1)
    start, step = rng.normal(size=2), rng.normal(size=(2, 2))
    sizes = [1, 700, 3, 2500, 64]
    gain = rng.normal(size=sum(sizes)) * 4
    starts = np.zeros(len(gain), bool)
    starts[np.cumsum([0, *sizes[:-1]])] = True
    got = np.split(chain.marginals(gain, starts, start, step), np.cumsum(sizes)[:-1])
    for own, part in zip(np.split(gain, np.cumsum(sizes)[:-1]), got, strict=True):
        first = np.zeros(len(own), bool)
        first[0] = True
        assert np.allclose(chain.marginals(own, first, start, step), part)
    assert len(chain.marginals(np.empty(0), np.empty(0, bool), start, step)) == 0


def test_toxic_documents_are_found(spark):
    rng = np.random.default_rng(2)
    plain = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(600):
        words = list(rng.choice(plain, 40))
        if i % 6 == 0:
            words[int(rng.integers(40))] = str(rng.choice(["grumbix", "snarfel" + str(rng.choice(["a", "os", "en", "ik"]))]))
        rows.append((i, " ".join(words), "c", 1))
        labels.append((i, int(i % 6 == 0)))
    rows += [(None, None, None, None), (1000, "", "c", 2), (1001, "x " * 50_000 + "Grumbix!", "c", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, extra long")
    known = spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.train(docs, known))
    assert got.columns == ["doc_id", "text", "extra", "score", "spans"] and got.count() == len(rows)
    found = {r.doc_id: r for r in got.collect()}
    held = [i for i in range(600) if found[i].doc_id is not None and _crc(i) % 5 == 0]
    hits = [(found[i].score >= 0.5) == (i % 6 == 0) for i in held]
    assert np.mean(hits) > 0.97
    assert found[None].score < 0.5 and found[1000].score < 0.5 and found[1000].spans == []
    last = found[1001]
    assert last.score >= 0.5 and [(s.start, s.end) for s in last.spans] == [(100_000, 100_007)]


def _crc(i: int) -> int:
    import zlib

    return zlib.crc32(str(i).encode())


def test_toxicity_without_labels(spark, odd, nothing):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(odd, toxicity.train(odd, none)).agg(F.max("score")).first()[0] < 0.5
    one = spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int")
    assert toxicity.score(odd, toxicity.train(odd, one)).agg(F.max("score")).first()[0] < 0.5
    assert toxicity.score(nothing, toxicity.train(nothing, none)).collect() == []


def test_workers_keep_nothing_between_tasks(spark, monkeypatch):
    import pyarrow as pa

    model = toxicity.Model({"w bad": 3.0}, np.zeros(2), np.zeros((2, 2)), np.zeros(3))
    runs = []
    frame = spark.createDataFrame([(1, "a bad word")], "doc_id long, text string")
    shared = type("Shared", (), {"value": model})()
    monkeypatch.setattr(type(frame), "mapInArrow", lambda self, run, schema: runs.append(run) or self)
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: shared)
    toxicity.score(frame, model)
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["a bad word"]), pa.array(["a bad word"])], names=["doc_id", "text", "__llm_text"])
    known = []
    for _ in runs[0](iter([batch])):
        known.append(len(model._known))
    assert known == [3] and not model._known


def test_held_out_labels_are_not_used(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.score(docs, toxicity.train(docs, x)).select("doc_id", "score") for x in (labels, turned))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_a_repeated_key_gives_few_texts_to_training(spark, monkeypatch):
    rows = [(1, f"text number {i}") for i in range(300)] + [(1, "text number 1")] * 50 + [(2, "another one"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, toxic int")
    got = []
    monkeypatch.setattr(toxicity, "fit", lambda sample, shares: got.append((len(sample.texts), sample.y)))
    monkeypatch.setattr(toxicity, "held_out", lambda key: F.lit(False))
    toxicity.train(docs, labels)
    assert got == [(6, [1] * 4 + [0] * 2)]


def test_loss_difference_by_hand(spark, docs, nothing):
    marked = docs.select("doc_id", "text", (F.col("doc_id") % 3 == 0).alias("is_target")).unionByName(
        spark.createDataFrame([(None, None, None), (10**6, "", True)], "doc_id long, text string, is_target boolean")
    )
    size, weight = 64, 5.0
    got = {r.doc_id: r for r in lm.score(marked, marked.where("is_target"), queries.BYTE_FILE, queries.BYTE_RANKS, size=size, weight=weight).collect()}
    rows = [(r.doc_id, byte_bpe(queries.BYTE_FILE, queries.BYTE_RANKS).ids(r.text or "").tolist(), bool(r.is_target)) for r in marked.collect()]
    counts: dict[int, int] = {}
    for _, ids, t in rows:
        for i in ids if t else []:
            counts[i] = counts.get(i, 0) + 1
    first = sorted(counts, key=lambda i: (-counts[i], i))[: size - 2]
    of = {i: n + 2 for n, i in enumerate(first)}
    tables = {True: np.zeros((size, size)), False: np.zeros((size, size))}
    pairs = {}
    for key, ids, t in rows:
        own = [of.get(i, 1) for i in ids]
        pairs[key] = list(zip([0, *own], own, strict=False))
        for h, w in pairs[key]:
            tables[False][h, w] += 1
            tables[True][h, w] += t
    def loss(table, h, w):
        single = (table[:, w].sum() + 1) / (table.sum() + size)
        return -np.log((table[h, w] + weight * single) / (table[h].sum() + weight))
    for key in [None, 10**6, *list(pairs)[:12]]:
        mean = {t: np.mean([loss(tables[t], h, w) for h, w in pairs[key]]) if pairs[key] else 0.0 for t in (True, False)}
        assert got[key].n_tokens == len(pairs[key])
        assert got[key].score == pytest.approx(mean[True] - mean[False], abs=1e-4)
    empty = nothing.withColumn("is_target", F.lit(True))
    assert lm.score(empty, empty, queries.BYTE_FILE, queries.BYTE_RANKS).collect() == []


def test_every_subword_and_its_bigrams_count(spark):
    rare = [f"zq{a}{b}vx" for a in "abcdefghij" for b in "klmnopqrst"]
    common = "the quick brown fox jumps over the lazy dog and runs away from it again "
    rows = [(i, common * 20 + f" {w} Ж{chr(0x410 + i % 32)} 日本 {w[::-1]}", i % 2 == 0) for i, w in enumerate(rare)]
    rows += [(1000, " ".join(rare[0::2]), False), (1001, " ".join(rare[1::2]), False), (None, None, None)]
    marked = spark.createDataFrame(rows, "doc_id long, text string, is_target boolean")
    got = {r.doc_id: r for r in lm.score(marked, marked.where("is_target"), queries.BYTE_FILE, queries.BYTE_RANKS).collect()}
    bpe = byte_bpe(queries.BYTE_FILE, queries.BYTE_RANKS)
    pairs = {key: list(itertools.pairwise([-1, *bpe.ids(text or "").tolist()])) for key, text, _ in rows}
    both = {side: collections.Counter(p for key, _, t in rows if t or not side for p in pairs[key]) for side in (True, False)}
    before, single = ({s: collections.Counter() for s in both} for _ in range(2))
    for side, table in both.items():
        for (h, w), n in table.items():
            before[side][h] += n
            single[side][w] += n

    def loss(side, h, w):
        share = (single[side][w] + 1) / (single[side].total() + bpe.size + 1)
        return -np.log((both[side][h, w] + 50 * share) / (before[side][h] + 50))

    for key in pairs:
        t, b = (np.mean([loss(s, *p) for p in pairs[key]]) if pairs[key] else 0.0 for s in (True, False))
        assert got[key].n_tokens == len(pairs[key])
        assert got[key].target_loss == pytest.approx(t) and got[key].background_loss == pytest.approx(b)
    assert got[1000].score < got[1001].score
    table = lm.counts(lm.block_counts(lm.encoded(marked, ["doc_id"], "is_target", *_all_classes(bpe), queries.BYTE_FILE, queries.BYTE_RANKS, "text"), "<u2", bpe.size + 1))
    assert {(r.previous - 1, r.current - 1): (r.target, r.every) for r in table.collect()} == {p: (both[True][p], n) for p, n in both[False].items()}


def _all_classes(bpe):
    return np.arange(1, bpe.size + 1), "<u2"


PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def _base(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": lambda m=m: True,
                "ip": lambda m=m: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda d=digits: 14 <= len(d) <= 19 and _luhn(d),
                "phone": lambda d=digits: 10 <= len(d) <= 15,
            }[kind]()
            if ok:
                out.append((m.start(), m.end(), k))
    return sorted(out, key=lambda s: (s[0], s[2]))


def _luhn(digits):
    values = [int(d) * (2 if i % 2 else 1) for i, d in enumerate(reversed(digits))]
    return sum(v - 9 if v > 9 else v for v in values) % 10 == 0


def test_base_spans_are_the_patterns(docs):
    rng = np.random.default_rng(3)
    pieces = ["a.b@c.de", "@", "x@y", "1.2.3.4", "256.1.1.1", "007.1.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (415) 555-2671", "+1", " ", ".", "é", "-", "_", "b@c.d.e@f.gh", "12"]
    texts = ["".join(rng.choice(pieces, int(rng.integers(1, 12)))) for _ in range(3000)]
    for text in texts + [r.text for r in docs.collect()]:
        assert pii.base_spans(text) == _base(text), text
    assert pii.base_spans("1" * 300_000 + "a" * 300_000 + "@") == []


def test_lanes_and_windows_change_nothing():
    net = recurrent.Network.random(5, 6, 4, np.random.default_rng(0))
    a, b = (np.random.default_rng(s).integers(1, recurrent.CHARACTERS, n).astype(np.uint8) for s, n in ((1, 40), (2, 25)))
    lane = np.concatenate(([0], a, [0], b, [0]))[:, None]
    e = net.emissions(lane)[:, :, 0]
    for own, at in ((a, 1), (b, 42)):
        alone = net.emissions(own[:, None])[:, :, 0]
        assert np.allclose(e[at : at + len(own)], alone, atol=1e-5)
    slow, _ = recurrent._forward(net, a[:, None].astype(int))
    assert np.allclose(net.emissions(a[:, None])[:, :, 0], slow[:, 0], atol=1e-4)


def test_gates_take_one_exponential_and_keep_their_values(monkeypatch):
    """No tanh, which took over half of the time; shut gates and large cells stay finite."""
    rng = np.random.default_rng(4)
    net = recurrent.Network.random(5, 8, 8, rng)
    net.gates *= 4
    lanes = rng.integers(1, recurrent.CHARACTERS, (300, 3)).astype(np.uint8)
    slow = recurrent._forward(net, lanes)[0]

    def refused(*args, **more):
        raise AssertionError("tanh")

    monkeypatch.setattr(recurrent.np, "tanh", refused)
    fast = net.emissions(lanes).transpose(0, 2, 1)
    assert np.allclose(fast, slow, atol=2e-3)
    lanes[0] = lanes[150] = recurrent.RESET
    whole = net.emissions(lanes)
    assert np.isfinite(whole).all() and np.allclose(whole[151:], net.emissions(lanes[151:]), atol=1e-5)


def test_slopes_are_those_of_the_loss():
    rng = np.random.default_rng(5)
    net = recurrent.Network.random(3, 4, 3, rng)
    net.move[:], net.first[:] = rng.normal(size=(3, 3)), rng.normal(size=3)
    x, y = rng.integers(1, 20, (7, 4)), rng.integers(0, 3, (7, 4))

    def loss():
        return recurrent.crf_loss(recurrent._forward(net, x)[0], net.move, net.first, y)[0]

    e, kept = recurrent._forward(net, x)
    _, slope, move, first = recurrent.crf_loss(e, net.move, net.first, y)
    for p, g in zip(net.parameters(), [*recurrent._backward(net, x, kept, slope), move, first], strict=True):
        for _ in range(4):
            at = tuple(int(rng.integers(n)) for n in p.shape)
            old = p[at]
            p[at] = old + 1e-5
            up = loss()
            p[at] = old - 1e-5
            down = loss()
            p[at] = old
            assert g[at] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-5)


@pytest.fixture(scope="module")
def network():
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("aeiourstln"), int(rng.integers(2, 8))))
    texts = []
    for _ in range(260):
        words = [word() for _ in range(40)]
        digits = "".join(map(str, rng.integers(0, 10, 10)))
        card = next(c for c in (f"4{digits}1234{i}" for i in range(10)) if _luhn(c))
        extra = [f"{word()}.{word()}@{word()}.example.com", "10.%d.2.%d" % tuple(rng.integers(0, 255, 2)), card, f"+1 ({digits[:3]}) {digits[3:6]}-{digits[6:]}"]
        words[int(rng.integers(40))] = extra[int(rng.integers(4))]
        texts.append(" ".join(words))
    return pii.fit(texts, ["".join(word() + " " for _ in range(40)) for _ in range(60)], most=300)


def test_network_finds_what_patterns_label(network):
    text = "some words here " * 150 + "write to ana.lore@tin.example.com now, " + "more words there " * 150 + "or call +1 (212) 555-0199 today"
    own = pii.base_spans(text)
    found = pii.network_spans(network, [text, "", "plain words"])
    assert any(a < own[0][1] and own[0][0] < b for a, b, _ in found[0]) and found[1] == []
    base, both = pii.all_spans([text], network)
    assert base[0] == own and set(own) <= set(both[0])


def test_spans_at_the_edges_of_a_text_are_not_pruned():
    rng = np.random.default_rng(11)
    edges = 0
    for _ in range(150):
        net = recurrent.Network.random(len(pii.KINDS) + 1, 6, 4, rng)
        net.bias[0] = 0.2
        net.move[0, 1:] = net.move[1:, 0] = -2.0
        net.move[1:, 1:] -= 3.0 * (1 - np.eye(len(pii.KINDS)))
        net.first[1:] = rng.normal(size=len(pii.KINDS))
        text = "".join(rng.choice(list("ab1@ .-+"), 30))
        tags = recurrent.decode(net.emissions(_codes(text)[:, None])[:, :, 0], net.move, net.first)
        cuts = [0, *(np.flatnonzero(np.diff(tags)) + 1).tolist(), len(tags)]
        want = [(a, b, int(tags[a]) - 1) for a, b in itertools.pairwise(cuts) if tags[a]]
        edges += any(a == 0 or b == len(text) for a, b, _ in want)
        assert pii.network_spans(net, [text])[0] == want
    assert edges > 20


def _codes(text):
    return pii.codes(pii.code_points(text))


def test_find_and_mask(spark, odd, nothing, network):
    rows = {r.doc_id: r for r in pii.find(odd, network).collect() if r.doc_id}
    assert [(s.kind, s.start) for s in rows[9].base_spans] == [("phone", 26), ("email", 44)]
    assert rows[5].spans == [] == rows[4].spans
    masked = {r.doc_id: r.text for r in pii.mask(odd, network).collect() if r.doc_id}
    assert masked[9].endswith("<phone> <email>") and masked[4] is None and masked[8] == "a" * 70_000
    assert pii.find(nothing, pii.learn(nothing)).collect() == []
    assert pii._masked("abcdef", [(1, 4, 0), (2, 5, 1)]) == "a<email>f"


def test_trees_learn_a_rule():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    model = trees.boost(x[:2000], y[:2000])
    assert ((model.log_odds(x[2000:]) > 0) == y[2000:]).mean() > 0.95


def test_kept_nodes_are_the_best_closed_set():
    rng = np.random.default_rng(8)
    for _ in range(60):
        n = int(rng.integers(1, 9))
        page = html.Page(["div"] * n, [-1] + [int(rng.integers(0, i)) for i in range(1, n)], [""] * n, [0] * n, [0] * n)
        odds = rng.normal(size=n)
        best = max(
            sum(o for o, k in zip(odds, keep, strict=True) if k)
            for keep in itertools.product((0, 1), repeat=n)
            if all(not keep[i] or keep[page.parents[i]] for i in range(1, n))
        )
        keep = html.kept(page, odds)
        assert all(not keep[i] or keep[page.parents[i]] for i in range(1, n))
        assert odds[keep].sum() == pytest.approx(best)


@pytest.fixture(scope="module")
def reader(spark):
    return html.learn(spark.read.parquet(f"{SF}/pages.parquet").unionByName(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")))


def _article(page: str) -> str:
    from html import unescape

    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    lines = [" ".join(unescape(re.sub("<[^>]+>", "", b.replace("<br>", " "))).split()) for b in re.split("</?(?:p|h1)>", inner)]
    return "\n".join(x for x in lines if x)


def test_articles_of_the_tables(spark, reader):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r.text for r in html.extract(pages, reader).collect()}
    right = [got[r.page_id] == _article(r.html) for r in pages.collect()]
    assert np.mean(right) > 0.95


def test_pages_of_other_sites(reader):
    page = """<body><div class="masthead"><a href=/>Site</a></div><div id=menu><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></div>
    <div class="layout"><div class="story-body"><h1>A storm &amp; its name</h1><p>First   paragraph, long enough to be
    <b>real</b> text, with commas.<div class="ad-slot">Buy shoes</div><p>Second paragraph, also long enough to be one.</p>
    <script>if (a<b) { x("<p>no</p>") }</script></div><div class="sidebar"><h3>Popular</h3><ul><li><a href=1>Three</a></ul></div></div>
    <div class="comments"><div class="comment"><p>I liked this story, thanks for it.</p></div></div>
    <form><p>Subscribe to our letter</p></form><div class=footer>&copy; Site</div>"""
    text = html.extracted([page], reader)[0]
    assert "First paragraph, long enough to be real text, with commas.\nSecond paragraph, also long enough to be one." in text
    for noise in ("Site", "One", "shoes", "no", "Three", "liked", "Subscribe"):
        assert noise not in re.findall("[A-Za-z]+", text)


def test_odd_pages(spark, reader):
    pages = ["", None, "<", "<<<<" * 1000, "<p", '<a href="x' * 2000, "<!-- never closed", "</p></div>", "<div>" * 3000 + "deep", "<script>x", "&amp;&#x41;&nbsp;&bogus;"]
    rows = [(i, p, "t", "u") for i, p in enumerate(pages)] + [(None, None, None, None), (0, "", "t", "u")]
    table = spark.createDataFrame(rows, "page_id long, html string, text string, url string")
    got = html.extract(table, reader)
    assert got.columns == ["page_id", "url", "text"] and got.count() == len(rows)
    assert all(r.text is not None for r in got.collect())
    assert html.extract(table.limit(0), reader).collect() == []
