"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Labels are per document, so tokens are labelled first: features of words (the
word, its beginnings) that explain toxic documents and hardly occur in others are
picked greedily, each for documents that no earlier one explains; tokens with a
picked feature in a toxic document are its spans.  The field learns from these,
tags every text by forward-backward, and a logistic curve over the marginals
gives the document's score.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle
from .chain import marginals, pair_counts
from .common import fresh_names, lean, least_hashes, slices, text_or_empty, with_fields

_TOKEN = re.compile(r"[^\W_]+")
#: Words whose scores a worker remembers before it starts anew.
REMEMBERED = 300_000


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def features(word: str) -> list[str]:
    """The word, its beginnings and end, and its kind."""
    out = ["w " + word, "s " + word[-3:]]
    out += ["p " + word[:k] for k in range(3, 8) if len(word) > k]
    if not word.isalpha():
        out.append("digits")
    return out


@dataclass
class Model:
    weights: dict[str, float]
    start: np.ndarray
    step: np.ndarray
    curve: np.ndarray
    _known: dict[str, float] = field(default_factory=dict, repr=False)

    def gains(self, words: list[str]) -> list[float]:
        known = self._known
        out = list(map(known.get, words))
        if None in out:
            if len(known) > REMEMBERED:
                known.clear()
            for i, gain in enumerate(out):
                if gain is None:
                    out[i] = known[words[i]] = self.gain(words[i])
        return out

    def forget(self) -> None:
        """Drop the scores that are remembered."""
        self._known.clear()

    def gain(self, word: str) -> float:
        weight = self.weights.get
        return weight("bias", 0.0) + sum(weight(f, 0.0) for f in features(word))

    def tag(self, texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
        """Marginals of each text's tokens, and each text's score."""
        found = [self.gains(tokens(t)) for t in texts]
        sizes = np.array([len(x) for x in found], np.int64)
        gain = np.concatenate([np.array(x, float) for x in found]) if found else np.empty(0)
        starts = np.zeros(len(gain), bool)
        first = np.cumsum(sizes) - sizes
        starts[first[sizes > 0]] = True
        p = marginals(gain, starts, self.start, self.step)
        x = summary(p, first, sizes)
        return np.split(p, first[1:]) if len(first) else [], 1 / (1 + np.exp(-x @ self.curve))


def summary(p: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Per text: 1, the greatest marginal, and the expected number of toxic tokens (log)."""
    used = sizes > 0
    top, total = np.zeros(len(sizes)), np.zeros(len(sizes))
    if used.any():
        top[used] = np.maximum.reduceat(p, first[used])
        total[used] = np.add.reduceat(p, first[used])
    return np.stack([np.ones(len(sizes)), top, np.log1p(total)], axis=1)


def held_out(key: Column) -> Column:
    """Rows never learned from: crc32 of the key as text is divisible by 5."""
    return F.crc32(key.cast("string").cast("binary")) % 5 == 0


def train(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", per_class: int = 2000, per_key: int = 4
) -> Model:
    """Fit on labelled rows that are not held out: at most ``per_class`` documents of each label.

    Which ones is decided by a hash of the key, the same at every size.  Rows
    without key or label are not used; equal texts are used once.  Of a key that
    repeats, the ``per_key`` texts with the least hashes are used.
    """
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(key)))
    known = known.select(F.col(key).cast("bigint").alias("k"), F.col(label).cast("int").alias("y")).distinct()
    shares = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    known = known.withColumn("h", F.xxhash64("k"))
    picked = [
        (r["k"], r["y"])
        for y in (0, 1)
        for r in least_hashes(known.where(F.col("y") == y), "h", F.col("k"), per_class, shares.get(y, 0))
    ]
    if not picked:
        return Model({}, np.zeros(2), np.zeros((2, 2)), np.array([-20.0, 0.0, 0.0]))
    ids = docs.sparkSession.createDataFrame(picked, "k bigint, y int")  # at most 2 x per_class rows
    texts = docs.select(F.col(f"`{key}`").cast("bigint").alias("k"), text_or_empty(text).alias("t"))
    # a key may have any number of rows: each task keeps its first few of a key before they meet
    own = Window.partitionBy("k", "y").orderBy(F.xxhash64("t"), "t")
    rows = texts.join(F.broadcast(ids), "k").dropDuplicates(["k", "y", "t"]).withColumn("r", F.row_number().over(own))
    rows = settle(rows.where(F.col("r") <= per_key).select("k", "y", "t"))
    return fit(Sample.read(rows.orderBy("k", "t")), shares)


class Sample:
    """Documents as arrays of word numbers; every word, and what it is made of, is kept once."""

    def __init__(self) -> None:
        self.words: dict[str, int] = {}
        self.texts: list[np.ndarray] = []
        self.y: list[int] = []

    @classmethod
    def read(cls, rows: DataFrame) -> Sample:
        """The rows (t, y) in order, a partition at a time; of equal texts the first."""
        made, seen = cls(), set()
        for r in rows.select("t", "y").toLocalIterator():
            digest = hashlib.md5(r["t"].encode(), usedforsecurity=False).digest()
            if digest not in seen:
                seen.add(digest)
                made.add(r["t"], r["y"])
        return made

    def add(self, text: str, y: int) -> None:
        number = self.words.setdefault
        self.texts.append(np.fromiter((number(w, len(self.words)) for w in tokens(text)), np.int32))
        self.y.append(y)


def fit(sample: Sample, shares: dict[int, int], rounds: int = 60) -> Model:
    """Label tokens, train the field on sentences, then the curve on documents."""
    y = np.array(sample.y)
    share = (shares.get(1, 0) + 0.5) / (sum(shares.values()) + 1.0)
    prior = float(np.log(share / (1 - share)))
    if y.all() or not y.any() or not sample.words:
        return Model({}, np.zeros(2), np.zeros((2, 2)), np.array([prior, 0.0, 0.0]))
    words = list(sample.words)
    marks = explain(words, [np.unique(t) for t in sample.texts], y)
    marked = np.array([any(f in marks for f in features(w)) for w in words], bool)
    sequences, targets = _sentences(sample.texts, y, marked)
    weights, start, step = _train_field(words, sequences, targets, rounds)
    model = Model(weights, start, step, np.zeros(3))
    x = _summaries(np.array([model.gain(w) for w in words]), sample.texts, start, step)
    counts = np.bincount(y, minlength=2)
    weight = np.array([shares.get(0, 1) / max(counts[0], 1), shares.get(1, 1) / max(counts[1], 1)])[y]
    model.curve = _logistic(x, y, weight / weight.mean())
    return model


def _summaries(gain: np.ndarray, texts: list[np.ndarray], start: np.ndarray, step: np.ndarray, block: int = 100_000) -> np.ndarray:
    """``summary`` of every text, a block of texts of some ``block`` tokens at a time."""
    out, some, total = [], [], 0
    for text in [*texts, None]:
        if some and (text is None or total + len(text) > block):
            sizes = np.array([len(t) for t in some])
            first = np.cumsum(sizes) - sizes
            starts = np.zeros(total, bool)
            starts[first[sizes > 0]] = True
            out.append(summary(marginals(gain[np.concatenate(some)], starts, start, step), first, sizes))
            some, total = [], 0
        if text is not None:
            some.append(text)
            total += len(text)
    return np.concatenate(out)


def explain(words: list[str], documents: list[np.ndarray], y: np.ndarray, least: int = 3, precision: float = 0.97) -> set[str]:
    """Features that explain toxic documents, best first, each for documents not yet explained.

    ``documents`` are the distinct word numbers of each document.  Features for
    which no document is left are kept where chance would not give a single one
    of all features as many toxic documents among those that have it.
    """
    index: dict[str, int] = {}
    made = [[index.setdefault(f, len(index)) for f in features(w) if f[0] in "wp"] for w in words]
    ends = np.cumsum([0] + [len(m) for m in made])
    flat = np.fromiter((f for m in made for f in m), np.int32, int(ends[-1]))
    del made

    def marks_of(own: np.ndarray) -> np.ndarray:
        sizes = ends[own + 1] - ends[own]
        return np.unique(flat[np.arange(sizes.sum()) + np.repeat(ends[own] - (np.cumsum(sizes) - sizes), sizes)])

    counts = np.zeros((2, len(index)), np.int32)
    for own, label in zip(documents, y.tolist(), strict=True):
        counts[label, marks_of(own)] += 1
    toxic = [own for own, label in zip(documents, y.tolist(), strict=True) if label]
    scale = len(toxic) / (len(documents) - len(toxic))
    pure = (counts[1] >= least) & (counts[1] >= precision * (counts[1] + scale * counts[0]))
    hits: dict[int, list[int]] = {f: [] for f in np.flatnonzero(pure).tolist()}
    for i, own in enumerate(toxic):
        here = marks_of(own)
        for f in here[pure[here]].tolist():
            hits[f].append(i)
    names = list(index)
    share = len(toxic) / len(documents)
    sure = [f for f in hits if _tail(int(counts[1, f]), int(counts[:, f].sum()), share) * len(index) < 1]
    left, marks = np.ones(len(toxic), bool), {names[f] for f in sure}
    # greedy cover with stale bounds: a feature's gain only falls
    heap = [(-len(i), -len(names[f]), names[f], f) for f, i in hits.items()]
    heapq.heapify(heap)
    while heap:
        bound, size, name, f = heapq.heappop(heap)
        gain = int(left[hits[f]].sum())
        if gain < least:
            continue
        if gain < -bound:
            heapq.heappush(heap, (-gain, size, name, f))
            continue
        marks.add(name)
        left[hits[f]] = False
    return marks


def _tail(hits: int, n: int, share: float) -> float:
    """Probability of ``hits`` or more in ``n`` draws that hit with probability ``share``."""
    return sum(math.comb(n, i) * share**i * (1 - share) ** (n - i) for i in range(hits, n + 1))


def _sentences(texts: list[np.ndarray], y: np.ndarray, marked: np.ndarray, width: int = 16) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Stretches of ``width`` tokens: all with a marked token, and twice as many without, clean documents first."""
    with_marks, plain = [], []
    for i in np.argsort(y, kind="stable").tolist():
        text = texts[i]
        tags = (marked[text] & bool(y[i])).astype(float)
        for at in range(0, len(text), width):
            part = (text[at : at + width], tags[at : at + width])
            (with_marks if part[1].any() else plain).append(part)
    step = max(1, len(plain) // (2 * len(with_marks) + 2000))
    chosen = with_marks + plain[::step]
    return [c[0] for c in chosen], [c[1] for c in chosen]


def _train_field(
    words: list[str], sequences: list[np.ndarray], targets: list[np.ndarray], rounds: int, decay: float = 1e-4
) -> tuple[dict[str, float], np.ndarray, np.ndarray]:
    """Maximum likelihood by Adam over all sequences at once; features seen in fewer than three sequences have no weight."""
    used, own = np.unique(np.concatenate(sequences), return_inverse=True)
    types = [words[i] for i in used.tolist()]
    counts: dict[str, int] = {}
    for w, n in zip(types, np.bincount(own).tolist(), strict=True):
        for f in features(w):
            counts[f] = counts.get(f, 0) + n
    index = {f: i + 1 for i, f in enumerate(f for f, n in counts.items() if n >= 3)}
    rows, columns = [], []
    for i, w in enumerate(types):
        hit = [0] + [index[f] for f in features(w) if f in index]
        rows += [i] * len(hit)
        columns += hit
    rows, columns = np.array(rows), np.array(columns)
    y = np.concatenate(targets)
    starts = np.zeros(len(y), bool)
    starts[np.cumsum([0] + [len(s) for s in sequences[:-1]])] = True
    size = len(index) + 1
    value = np.zeros(size + 6)
    moment, square = np.zeros_like(value), np.zeros_like(value)
    inner = np.flatnonzero(~starts)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[inner - 1].astype(int), y[inner].astype(int)), 1)
    seen_first = np.array([(1 - y[starts]).sum(), y[starts].sum()])
    for t in range(1, rounds + 1):
        gain = np.bincount(rows, value[columns], len(types))[own]
        start, step = value[size : size + 2], value[size + 2 :].reshape(2, 2)
        p = marginals(gain, starts, start, step)
        first, pairs = pair_counts(p, gain, starts, start, step)
        slope = np.empty_like(value)
        slope[:size] = np.bincount(columns, np.bincount(own, p - y, len(types))[rows], size)
        slope[size : size + 2] = first - seen_first
        slope[size + 2 :] = (pairs - seen).ravel()
        slope = slope / len(sequences) + decay * value
        moment = 0.9 * moment + 0.1 * slope
        square = 0.99 * square + 0.01 * slope**2
        value -= 0.2 * (moment / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-8)
    weights = {"bias": float(value[0])} | {f: float(value[i]) for f, i in index.items()}
    return weights, value[size : size + 2].copy(), value[size + 2 :].reshape(2, 2).copy()


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, decay: float = 1e-3) -> np.ndarray:
    """Newton's method with a small penalty, so that separable rows keep finite weights."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ w))
        slope = x.T @ (weight * (p - y)) / len(y) + decay * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x / len(y) + decay * np.eye(len(w))
        w -= np.linalg.solve(curve, slope)
    return w


def score(df: DataFrame, model: Model, text: str = "text", least: float = 0.5) -> DataFrame:
    """``df`` plus ``score`` (0 to 1) and ``spans`` (array of start, end, probability; code points).

    Whole texts are tagged; null and empty texts have no tokens and the score the
    curve gives to that.  Spans are runs of neighbouring tokens with a marginal
    of ``least`` or more.  Input columns of these names are replaced.
    """
    names = fresh_names(df, ["score", "spans"])
    source = df.select(*[F.col(f"`{n}`") for n in names], text_or_empty(text).alias("__llm_text"))
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(names))
            for first, last in slices(texts, 1_000_000):
                part = batch.slice(first, last - first)
                own = texts.slice(first, last - first).to_pylist()
                p, scores = shared.value.tag(own)
                spans = [_spans(t, q, least) if len(q) and q.max() >= least else [] for t, q in zip(own, p, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pa.array(scores), pa.array(spans, kind)], names=[*names, "score", "spans"])
        shared.value.forget()  # the worker waits for its next task without

    return source.mapInArrow(lean(run), with_fields(df, names, "score double, spans array<struct<start:bigint,end:bigint,probability:double>>"))


def _spans(text: str, p: np.ndarray, least: float) -> list[dict]:
    lower = text.lower()
    if len(lower) != len(text):  # a letter that grows in lower case: places are those of single letters
        lower = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    places = [m.span() for m in _TOKEN.finditer(lower)]
    out: list[dict] = []
    before = -2
    for i in np.flatnonzero(p >= least).tolist():
        if i >= len(places):
            break
        if i == before + 1:
            out[-1]["end"] = places[i][1]
            out[-1]["probability"] = max(out[-1]["probability"], float(p[i]))
        else:
            out.append({"start": places[i][0], "end": places[i][1], "probability": float(p[i])})
        before = i
    return out
