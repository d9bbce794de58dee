from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest

from cairnlog.llm import licenses, queries, runs

from .conftest import SF

_SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def _runs(words):
    """By comparing all words that are q apart, for every q."""
    n, out = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(24, 3 * q):
                out.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((s, e - s, q) for (s, e), q in out.items()), key=lambda r: (r[0], r[2]))


def test_runs_equal_brute_force():
    rng = random.Random(1)
    some = lambda n, k: [str(rng.randrange(k)).encode() for _ in range(n)]
    cases = [[], [b"a"], [b"a"] * 23, [b"a"] * 24, [b"a"] * 200, [b"a", b"b"] * 40, some(300, 2), some(2000, 1000)]
    for _ in range(300):
        case = []
        for _ in range(rng.randrange(1, 5)):
            block = some(rng.randrange(1, 12), rng.choice([1, 2, 3, 50]))
            case += (block * rng.randrange(1, 14))[: rng.randrange(1, 80)] + some(rng.randrange(6), 3)
        cases.append(case)
    words = ["a", "ab"]
    while len(words[-1]) < 500:
        words.append(words[-1] + words[-2])
    cases.append([c.encode() for c in words[-1]])
    assert runs.runs_of(cases) == [_runs(c) for c in cases]


def test_small_blocks_test_all_suffixes(monkeypatch):
    monkeypatch.setattr(runs, "TESTED", 5)
    case = [b"x", b"y", b"z"] * 30 + [b"a"] * 40 + [b"x", b"y"] * 15
    assert runs.runs_of([case]) == [_runs(case)]


def test_suffixes_and_prefixes_in_order():
    rng = random.Random(2)
    import numpy as np

    for n in (1, 2, 50, 300):
        word = np.array([rng.randrange(2) for _ in range(n)])
        sa, levels, tied = runs.doubled(word, np.full(n, n))
        want = sorted(range(n), key=lambda i: word[i:].tolist())
        assert sa.tolist() == want and not len(tied)
        lcp = runs.common_prefixes(sa, levels).tolist()
        for k in range(1, n):
            a, b = word[want[k - 1] :].tolist(), word[want[k] :].tolist()
            assert lcp[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def _expected(key, text):
    words = _SPACE.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(key).encode()) if key is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    found = _runs(words)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else (None, None, None)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (
        key, len(found), *best, 1000 * best[1] // best[2] if found else None, digest("".join(f"{s},{n},{q}\n" for s, n, q in found)),
        digest(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def test_runs_query_over_the_table(spark):
    got = queries.QUERIES["op12_periodic_runs"](spark, SF)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = collections.Counter(_expected(r.doc_id, r.text) for r in docs)
    assert collections.Counter(map(tuple, got.collect())) == want


def test_runs_of_odd_rows(spark, odd, nothing):
    clashing = odd.withColumnsRenamed({"score": "runs", "fingerprint": "best"})
    found = runs.periodic_runs(clashing).collect()
    assert len(found) == odd.count() and set(found[0].asDict()) == {"doc_id", "text", "sequence_id", "n_words", "runs", "best", "collapsed"}
    for r in found:
        if r.doc_id != 7:
            assert [tuple(x) for x in r.runs] == _runs(_SPACE.findall(r.text or ""))
    long = next(r for r in found if r.doc_id == 7)
    assert tuple(long.best) == (0, 36_000, 4) and long.collapsed == "long words and letters;"
    assert runs.periodic_runs(nothing).collect() == [] and runs.planted(nothing).collect() == []
    planted = {(r.doc_id, r.text) for r in runs.planted(odd).collect()}
    assert (None, None) in planted and (4, None) in planted and runs.planted(odd).columns == odd.columns


def _pattern(template):
    """The template as a regular expression over words that each end in a space."""
    out = []
    for part in re.findall(r"\[\[|\]\]|\{\{[^}]*\}\}|[^\s\[\]{}]+", template):
        if part == "[[":
            out.append("(?:")
        elif part == "]]":
            out.append(")?")
        elif part.startswith("{{*"):
            out.append(r"(?:\S+ ){0,%s}" % part[3:-2])
        elif part.startswith("{{"):
            out.append("(?:" + "|".join("".join(w + " " for w in x.split()) for x in part[2:-2].split("|")) + ")")
        else:
            out.append(part + " ")
    return re.compile("".join(out))


def _written(template, rng):
    """A text that the template accepts."""
    out, skip = [], 0
    for part in re.findall(r"\[\[|\]\]|\{\{[^}]*\}\}|[^\s\[\]{}]+", template):
        if part == "[[":
            skip += skip > 0 or rng.random() < 0.5
        elif part == "]]":
            skip = max(skip - 1, 0)
        elif not skip and part.startswith("{{*"):
            out += ["name"] * rng.randrange(int(part[3:-2]) + 1)
        elif not skip and part.startswith("{{"):
            out += rng.choice(part[2:-2].split("|")).split()
        elif not skip:
            out.append(part)
    return out


@pytest.mark.parametrize("label", licenses.TEMPLATES)
def test_automata_accept_what_their_template_says(label):
    rng = random.Random(label)
    template = licenses.TEMPLATES[label]
    pattern, automaton = _pattern(template), licenses.Automaton.compile(label, template)
    scanner = licenses.Scanner({}, {label: template})
    for _ in range(30):
        words = _written(template, rng)
        text = ["before", *words, "after"]
        if rng.random() < 0.5:
            at = rng.randrange(len(text))
            text[at : at + 1] = rng.choice([[], ["other"], [text[at]] * 2])
        for at in range(min(len(text), 12)):
            ends = [e for e in range(at + 1, len(text) + 1) if pattern.fullmatch("".join(w + " " for w in text[at:e]))]
            assert automaton.read([w.encode() for w in text], at)[0] == max(ends, default=-1)
        written = " ".join(w.upper() if rng.random() < 0.2 else w for w in words).replace(" ", rng.choice([" ", "\n", ", ", " -- "]))
        n, _, stretches, share = scanner.scan("Then: " + written)
        assert n == len(words) + 1 and stretches[0][2] == label and share == 1.0 and stretches[0][1] <= n


def test_wrong_templates_are_refused():
    for wrong in ("[[a", "a]]", "[[a]]", "{{*3}} a"):
        with pytest.raises(ValueError):
            licenses.Scanner({}, {"x": wrong})


def _license_row(key, text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    found = [
        (i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()
    ]
    starts = [i for i, _ in found]
    return key, len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def test_license_query_over_the_table(spark):
    got = queries.QUERIES["op13_license_wording"](spark, SF)
    assert got.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    rows = got.collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert collections.Counter(tuple(r)[:6] for r in rows) == collections.Counter(_license_row(r.doc_id, r.text) for r in docs)
    patterns = {label: _pattern(t) for label, t in licenses.TEMPLATES.items()}
    joined = {r.doc_id: "".join(w.decode() + " " for w in licenses.words_of(r.text or "")) for r in docs}
    for r in rows:
        extra = {label for label, p in patterns.items() if re.search(r"(?:^|(?<= ))" + p.pattern, joined[r.doc_id])}
        assert set(filter(None, r.labels.split(","))) == set(filter(None, r.base_labels.split(","))) | extra
        assert 0 <= r.score <= 1 and (r.score == 1) == bool(extra)


def test_licenses_of_odd_rows(spark, odd, nothing):
    clashing = odd.withColumnRenamed("fingerprint", "places")
    rows = licenses.scan(clashing).collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert (r.n_words, len(r.places)) == _license_row(0, r.text)[1:3]
    assert licenses.scan(nothing).collect() == []
    text = "MIT-LICENSE mit license\u00a0 Mit, License; permission to the GNU general  public\x7flicense"
    found = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [tuple(p) for p in found.places] == [(0, "mit"), (4, "mit"), (10, "gpl")] and found.score == 0.5
