"""Periodic runs of words, by the branching-tandem test on enhanced suffix arrays.

A run of period q ends where two suffixes q words apart agree in exactly q words:
the square that starts 2 q words before the run's end branches there, so the two
suffixes lie in different children of the LCP interval of depth q.  The suffix
array, its inverse and the LCP values of a text are enough to find these squares;
the intervals come off a stack and no tree is kept.  Of each interval all children
but the largest are walked: for each of their suffixes i the inverse array says
whether i + q or i - q lies in the interval, too.  A square found is rotated to the
left as far as it goes, which gives the whole run; squares of the same run merge.

Suffix arrays are made for many texts at once, side by side, by doubling.  A run of
24 words and three periods makes two suffixes agree in 16 words, so a text in which
no 16 words repeat is done after four rounds.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, fresh_names, text_or_empty

#: Least words and least periods of a run.
LEAST, PERIODS = 24, 3
#: Words on which two suffixes of a text with a run agree at least: LEAST less a third, a power of two.
SHARED = 16
#: Suffixes of smaller children that are tested at once.
TESTED = 1 << 21
ADDED = ["n_words", "runs", "best", "collapsed"]
_RUN = [("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]


def doubled(key: np.ndarray, ends: np.ndarray, until: int | None = None) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Suffixes in order, ranks by their first 1, 2, 4, ... symbols, and the slots that are still tied.

    ``key`` sorts the symbols, of an earlier text before those of a later one;
    ``ends`` is where each position's text ends, and a suffix that ends goes first.
    Stops where no suffixes are tied, or with ranks by ``until`` symbols.
    """
    n = len(key)
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    slots = np.arange(n)
    sorted_key = key[order]
    levels: list[np.ndarray] = []
    sa = order.copy()
    width = 1
    while True:
        first = np.ones(len(slots), bool)
        first[1:] = sorted_key[1:] != sorted_key[:-1]
        heads = np.flatnonzero(first)
        sizes = np.diff(np.append(heads, len(slots)))
        rank[sa[slots]] = np.repeat(slots[heads], sizes)
        levels.append(rank.astype(np.int32 if n < 2**31 else np.int64))
        slots = slots[np.repeat(sizes > 1, sizes)]
        if not len(slots) or width == until:
            return sa, levels, slots
        at = sa[slots]
        later = at + width
        second = np.where(later < ends[at], rank[np.minimum(later, n - 1)], -1)
        sorted_key = rank[at] * (n + 1) + second + 1
        order = np.argsort(sorted_key, kind="stable")
        sa[slots] = at[order]
        sorted_key = sorted_key[order]
        width *= 2


def common_prefixes(sa: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """LCP of each suffix with the one before it in order (0 for the first), from the ranks, longest first."""
    a, b = sa[:-1].copy(), sa[1:].copy()
    out = np.zeros(len(sa), np.int64)
    padded = -1
    for k in range(len(levels) - 1, -1, -1):
        rank = np.append(levels[k], padded)
        same = rank[a] == rank[b]
        step = same.astype(np.int64) << k
        a += step
        b += step
        out[1:] += step
    return out


def branching_squares(sa: np.ndarray, lcp: np.ndarray, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, period) of the squares of one text (positions and slots ``start`` to ``end``) that no next word continues."""
    depths = lcp[start + 1 : end].tolist()
    longest = (end - start) // PERIODS
    children: list[tuple[int, int, int, int, int]] = []  # from, to, interval from, to, depth
    stack: list[tuple[int, int, list[int]]] = []
    for k, depth in enumerate([*depths, 0], 1):
        low = k - 1
        while stack and stack[-1][0] > depth:
            inner, low, cuts = stack.pop()
            if inner <= longest:
                bounds = [low, *cuts, k]
                sizes = [y - x for x, y in zip(bounds, bounds[1:], strict=False)]
                largest = sizes.index(max(sizes))
                children += [(bounds[i], bounds[i + 1], low, k, inner) for i in range(len(sizes)) if i != largest]
        if depth:
            if stack and stack[-1][0] == depth:
                stack[-1][2].append(k)
            else:
                stack.append((depth, low, [k]))
    if not children:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    table = np.array(children, np.int64)
    own = sa[start:end] - start
    inverse = np.empty(end - start, np.int64)
    inverse[own] = np.arange(end - start)
    found_at, found_period = [], []
    upto = np.cumsum(table[:, 1] - table[:, 0])
    first = 0
    while first < len(table):
        past = upto[first - 1] if first else 0
        last = max(int(np.searchsorted(upto, past + TESTED, "right")), first + 1)
        some = table[first:last]
        first = last
        sizes = some[:, 1] - some[:, 0]
        row = np.repeat(np.arange(len(some)), sizes)
        slot = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + some[row, 0]
        at, period = own[slot], some[row, 4]
        for other in (at + period, at - period):
            inside = np.flatnonzero((other >= 0) & (other < end - start))
            r, c = inverse[other[inside]], some[row[inside]]
            hit = inside[(r >= c[:, 2]) & (r < c[:, 3]) & ((r < c[:, 0]) | (r >= c[:, 1]))]
            found_at.append(np.minimum(at[hit], other[hit]))
            found_period.append(period[hit])
    return np.concatenate(found_at) + start, np.concatenate(found_period)


def merged(word: np.ndarray, start: int, at: np.ndarray, period: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs that end with the squares ``at``, those that are long enough; places count from ``start``."""
    # a long enough run goes on to the left for this many words, the nearest of which are looked at for all squares at once
    need = np.maximum(LEAST - 2 * period, (PERIODS - 2) * period)
    likely = at - need >= start
    for step in (1, 2, 3):
        likely &= (need < step) | (word[np.maximum(at - step, 0)] == word[np.maximum(at - step + period, 0)])
    at, period = at[likely], period[likely]
    order = np.lexsort((period, at + 2 * period))
    runs: list[tuple[int, int, int]] = []
    end_before, starts_there = -1, []
    for i, q in zip(at[order].tolist(), period[order].tolist(), strict=True):
        end = i + 2 * q
        if end != end_before:
            end_before, starts_there = end, []
        if any(s <= i for s in starts_there):
            continue  # a square of a multiple of a smaller period, or the same square again
        low, chunk = i, 32
        while low > start:
            size = min(chunk, low - start)
            differ = np.flatnonzero(word[low - size : low] != word[low - size + q : low + q])
            if len(differ):
                low += int(differ[-1]) + 1 - size
                break
            low -= size
            chunk *= 2
        if end - low >= max(LEAST, PERIODS * q):
            starts_there.append(low)
            runs.append((low - start, end - low, q))
    return sorted(runs, key=lambda r: (r[0], r[2]))


def runs_of(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each text's words, by start, then period."""
    sizes = np.array([len(t) for t in texts], np.int64)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    some = np.flatnonzero(sizes >= LEAST)
    if not len(some):
        return out
    word = pd.factorize(np.array([w for i in some.tolist() for w in texts[i]], object))[0].astype(np.int64)
    sizes = sizes[some]
    key, ends = _side_by_side(word, sizes)
    tied = doubled(key, ends, SHARED)
    repeating = np.zeros(len(some), bool)
    repeating[np.searchsorted(np.cumsum(sizes), tied[0][tied[2]], "right")] = True
    del tied
    if not repeating.any():
        return out
    word = word[np.repeat(repeating, sizes)]
    some, sizes = some[repeating], sizes[repeating]
    key, ends = _side_by_side(word, sizes)
    sa, levels, _ = doubled(key, ends)
    lcp = common_prefixes(sa, levels)
    stops = np.cumsum(sizes)
    lcp[stops[:-1]] = 0
    for i, start, stop in zip(some.tolist(), (stops - sizes).tolist(), stops.tolist(), strict=True):
        out[i] = merged(word, start, *branching_squares(sa, lcp, start, stop))
    return out


def _side_by_side(word: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(np.arange(len(sizes)), sizes) * (word.max() + 1) + word, np.repeat(np.cumsum(sizes), sizes)


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """The words that stay: those that no run contains after its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) == 0


def periodic_runs(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` plus n_words, runs (array of start, length, period), best (the greatest exponent) and collapsed.

    Words are what space, tab, line feed, vertical tab, form feed and carriage
    return separate.  A run has 24 words and three periods at least, and does not
    go on at either side; ``runs`` are by start, then period.  ``best`` has the
    greatest length / period (ties: smallest start, then period), null without
    runs.  ``collapsed`` has the words that no run contains after its first
    period, joined by one space.  Null and empty texts have no words.  Input
    columns of these names are replaced; a text is one task's work, in memory
    that is proportional to its longest one (and its logarithm).
    """
    names = fresh_names(df, ADDED)

    def work(texts: list[str]) -> dict[str, pa.Array]:
        words = [t.encode().split() for t in texts]
        found = runs_of(words)
        best = [min(r, key=lambda x: (_less(x), x[0], x[2])) if r else None for r in found]
        collapsed = [
            b" ".join(w if not r else [w[i] for i in np.flatnonzero(kept_words(len(w), r)).tolist()]) for w, r in zip(words, found, strict=True)
        ]
        return {
            "n_words": pa.array([len(w) for w in words], pa.int64()),
            "runs": pa.array([[_named(x) for x in r] for r in found], pa.list_(pa.struct(_RUN))),
            "best": pa.array([x and _named(x) for x in best], pa.struct(_RUN)),
            "collapsed": pa.array(collapsed, pa.binary()).cast(pa.string()),
        }

    run = "struct<start:bigint,length:bigint,period:bigint>"
    return arrow_map(df, names, text, f"n_words bigint, runs array<{run}>, best {run}, collapsed string", work)


def _named(run: tuple[int, int, int]) -> dict[str, int]:
    return {"start": run[0], "length": run[1], "period": run[2]}


def _less(run: tuple[int, int, int]) -> Fraction:
    return -Fraction(run[1], run[2])


def planted(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` whose texts repeat their ends where crc32 of the key is divisible by 10: from word a on with period p.

    h = crc32 of the key as decimal text, g = h div 10, a = g mod n, and
    p = 1 + (n - a) div (3 + g mod 8) for n words; other texts, and those without
    words or key, stay as they are.
    """
    words = F.filter(F.split(text_or_empty(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    out = df.withColumn("__llm_h", F.crc32(F.col(f"`{key}`").cast("string").cast("binary")))
    out = out.withColumns({"__llm_words": F.when(F.col("__llm_h") % 10 == 0, words), "__llm_g": F.expr("__llm_h div 10")})
    out = out.withColumn("__llm_n", F.size("__llm_words").cast("bigint"))
    made = F.expr(
        "array_join(slice(concat(slice(__llm_words, 1, int(__llm_a)), flatten(array_repeat(slice(__llm_words, int(__llm_a) + 1, int(__llm_p)),"
        " int(ceil((__llm_n - __llm_a) / __llm_p))))), 1, int(__llm_n)), ' ')"
    )
    out = out.withColumn("__llm_a", F.expr("CASE WHEN __llm_n > 0 THEN __llm_g % __llm_n END"))
    out = out.withColumn("__llm_p", F.expr("1 + (__llm_n - __llm_a) div (3 + __llm_g % 8)"))
    out = out.withColumn(text, F.when(F.col("__llm_p").isNotNull(), made).otherwise(F.col(f"`{text}`")))
    return out.select(*[F.col(f"`{c}`") for c in df.columns])
