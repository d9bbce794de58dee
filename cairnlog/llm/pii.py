"""Personal data: patterns, and a character BiLSTM-CRF that learns from what the patterns label.

The network reads whole texts, long ones as overlapping windows; scores of the
windows' middles are laid side by side and decoded as one sequence, so that a
span across a window's edge is found once and whole.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_names, lean, least_hashes, refuse_hidden, slices, text_or_empty, with_fields
from .recurrent import REST, Network, codes, decode, train
from .syncmers import code_points

KINDS = ("email", "ip", "card", "phone")
# fixed values: the base patterns; the look-behind only keeps long runs of digits linear
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_SIGN = re.compile(r"[0-9@\[(]")

#: Characters of a window, and of the margin on each side that only gives context.
WINDOW, MARGIN = 2048, 64
LANES = 512


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the patterns' matches by start, then kind; each kind leftmost and not overlapping."""
    out = [(a, b, 0) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(part.lstrip("0")) <= 3 and int(part) <= 255 for part in m[0].split(".")):
                out.append((m.start(), m.end(), 1))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), m.end(), 2))
        for m in _PHONE.finditer(text):
            if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append((m.start(), m.end(), 3))
    return sorted(out, key=lambda s: (s[0], s[2]))


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches from each @ outwards: a run without @ is looked at once."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            free = found.end()
        at = text.find("@", max(at + 1, free))


def _luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2]) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def learn(df: DataFrame, key: str = "doc_id", text: str = "text", sample: int = 1500) -> Network | None:
    """Train on windows around the base spans of at most ``sample`` documents with a digit or @ and a third as many without, picked by a hash of the key.

    None where these have no span.  The bound concerns the training only.
    """
    texts = df.select(F.xxhash64(F.col(f"`{key}`")).alias("h"), text_or_empty(text).alias("t"))
    marked = F.col("t").rlike("[0-9@]")
    counts = texts.agg(F.count_if(marked).alias("marked"), F.count_if(~marked).alias("plain")).first()
    picked = [
        least_hashes(texts.where(which), "h", F.xxhash64("t"), n, rows)
        for which, n, rows in ((marked, sample, counts["marked"]), (~marked, sample // 3, counts["plain"]))
    ]
    return fit(*(list(dict.fromkeys(r["t"] for r in rows)) for rows in picked))


def fit(texts: list[str], plain: list[str] = (), steps: int = 96, most: int = 1600) -> Network | None:
    """Windows with spans, some of them rewritten as people write them to escape patterns, and as many without."""
    rng = np.random.default_rng(11)
    lanes: list[np.ndarray] = []
    tags: list[np.ndarray] = []

    def put(text: str, spans: list[tuple[int, int, int]], start: int) -> None:
        lane = np.full(steps, REST, np.uint8)
        part = codes(code_points(text[start : start + steps]))
        lane[: len(part)] = part
        tag = np.zeros(steps, np.int64)
        for a, b, kind in spans:
            tag[max(a - start, 0) : max(b - start, 0)] = kind + 1
        lanes.append(lane)
        tags.append(tag)

    found = [(t, base_spans(t)) for t in texts]
    places = [(i, s) for i, (_, spans) in enumerate(found) for s in spans]
    if not places:
        return None
    for p in rng.permutation(len(places))[:most].tolist():
        i, (a, b, kind) = places[p]
        text, spans = found[i]
        low = max(0, a - int(rng.integers(4, max(5, steps - min(b - a, steps - 8) - 2))))
        put(text, spans, low)
        if rng.random() < 0.5:
            new = _disguised(text[a:b], kind, rng)
            before, after = text[max(0, a - 60) : a], text[b : b + 60]
            put(before + new + after, [(len(before), len(before) + len(new), kind)], max(0, len(before) - int(rng.integers(0, 50))))
    others = found + [(t, []) for t in plain if t]
    for _ in range(len(lanes)):
        text, spans = others[int(rng.integers(len(others)))]
        put(text, spans, int(rng.integers(max(1, len(text) - steps + 1))))
    digits = [(t, s, m.start()) for t, s in found for m in _DIGIT.finditer(t) if not any(a <= m.start() < b for a, b, _ in s)]
    for p in rng.permutation(len(digits))[: most // 3].tolist():
        text, spans, at = digits[p]
        put(text, spans, max(0, at - int(rng.integers(0, steps - 8))))
    return train(np.array(lanes), np.array(tags), len(KINDS) + 1)


def _disguised(value: str, kind: int, rng: np.random.Generator) -> str:
    """A labelled span in another spelling."""
    pick = int(rng.integers(3))
    if kind == 0:
        return value.replace("@", (" (at) ", "(at)", " [at] ")[pick]).replace(".", (".", " (dot) ", " [dot] ")[pick])
    if kind == 3:
        digits = re.sub("[^0-9]", "", value)
        return (f"({digits[-10:-7]}) {digits[-7:-4]}-{digits[-4:]}", f"{digits[-10:-7]}-{digits[-7:-4]}-{digits[-4:]}", "00" + digits)[pick]
    if kind == 2:
        digits = re.sub("[^0-9]", "", value)
        return (".", " ", "-")[pick].join(digits[i : i + 4] for i in range(0, len(digits), 4))
    return value.replace(".", ("[.]", "(.)", "[dot]")[pick])


def network_spans(net: Network, texts: list[str], lanes: int = LANES) -> list[list[tuple[int, int, int]]]:
    """(start, end, kind) of the network's spans in each text."""
    pieces: list[tuple[int, int, int]] = []  # text, first character read, characters read
    data = [codes(code_points(t)) for t in texts]
    for i, own in enumerate(data):
        for start in range(0, len(own), WINDOW):
            low = max(start - MARGIN, 0)
            pieces.append((i, low, min(start + WINDOW + MARGIN, len(own)) - low))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not pieces:
        return out
    # longest pieces first onto the shortest lane: steps are the longest lane's
    total = sum(n + 1 for _, _, n in pieces)
    width = max(1, min(lanes, total // (WINDOW + 2 * MARGIN) + 1))
    fill, place = [0] * width, {}
    heap = [(0, lane) for lane in range(width)]
    for p in sorted(range(len(pieces)), key=lambda p: -pieces[p][2]):
        used, lane = heapq.heappop(heap)
        place[p] = (lane, used + 1)
        fill[lane] = used + 1 + pieces[p][2]
        heapq.heappush(heap, (fill[lane], lane))
    table = np.zeros((max(fill) + 1, width), np.uint8)
    for p, (lane, at) in place.items():
        i, low, n = pieces[p]
        table[at : at + n, lane] = data[i][low : low + n]
    e = net.emissions(table)
    gain, cost = _bound(net, e)
    enter, leave = _edges(net)
    own_pieces: dict[int, list[int]] = {}
    for p, (i, _, _) in enumerate(pieces):
        own_pieces.setdefault(i, []).append(p)
    for i, found in own_pieces.items():
        sums = np.empty(len(data[i]))
        for p in found:
            lane, at = place[p]
            _, low, n = pieces[p]
            first = 0 if low == 0 else MARGIN  # the margin's scores come from the window before
            sums[low + first : low + n] = gain[lane, at + first : at + n]
        sums[0] += enter
        sums[-1] += leave
        np.cumsum(sums, out=sums)
        least = np.minimum.accumulate(np.minimum(sums, 0.0))
        live = np.flatnonzero(sums - least > cost)
        if not len(live):
            continue
        scores = np.empty((len(data[i]), e.shape[1]))
        for p in found:
            lane, at = place[p]
            _, low, n = pieces[p]
            first = 0 if low == 0 else MARGIN
            scores[low + first : low + n] = e[at + first : at + n, :, lane]
        out[i] = _spans(net, scores, live, np.searchsorted(-least, -least[live], side="left"))
    return out


def _bound(net: Network, e: np.ndarray) -> tuple[np.ndarray, float]:
    """What a character can at most add to a span over being outside (lanes x steps), and what a span costs at least."""
    inner = net.move[1:, 1:].max(axis=0)
    outside = net.move[0, 0]
    gain = (e[:, 1:] + inner.astype("f4")[None, :, None]).max(axis=1)
    gain -= e[:, 0] + np.float32(outside)
    cost = -((net.move[0, 1:] - inner).max() + net.move[1:, 0].max() - outside)
    return np.ascontiguousarray(gain.T), float(cost)


def _edges(net: Network) -> tuple[float, float]:
    """What ``_bound`` asks too much of a span that begins at a text's first character, and of one that ends at its last.

    The first has the scores of a beginning in place of a move from outside, the
    second no move to outside.
    """
    inner, outside = net.move[1:, 1:].max(axis=0), net.move[0, 0]
    enter = (net.first[1:] - net.first[0] - inner).max() - (net.move[0, 1:] - inner).max() + outside
    return max(float(enter), 0.0), max(float(outside - net.move[1:, 0].max()), 0.0)


def _spans(net: Network, scores: np.ndarray, live: np.ndarray, since: np.ndarray, around: int = 64) -> list[tuple[int, int, int]]:
    """Decode only where spans can be: from where their sum began to rise to where it is high, and ``around`` it."""
    out = []
    low = np.maximum(np.minimum(since, live) - around, 0)
    high = np.minimum(live + around + 1, len(scores))
    cuts = np.flatnonzero(low[1:] > np.maximum.accumulate(high)[:-1])
    for a, b in zip(np.append(0, cuts + 1).tolist(), np.append(cuts, len(live) - 1).tolist(), strict=True):
        start, end = int(low[a : b + 1].min()), int(high[b])
        tags = decode(scores[start:end], net.move, net.first)
        edges = np.flatnonzero(np.diff(np.concatenate(([0], tags, [0]))))
        for x, y in zip(edges.tolist(), edges[1:].tolist(), strict=False):
            if tags[x]:
                out.append((start + x, start + y, int(tags[x]) - 1))
    return out


def all_spans(texts: list[str], net: Network | None, least: int = 7) -> tuple[list[list[tuple[int, int, int]]], list[list[tuple[int, int, int]]]]:
    """Per text: base spans, and all spans: base ones and those of the network that touch none of them.

    Of the network's spans outer white space is left off; shorter ones than
    ``least`` characters, or without any digit, @ or bracket, are noise and not taken.
    """
    base = [base_spans(t) for t in texts]
    if net is None:
        return base, base
    both = []
    for text, own, new in zip(texts, base, network_spans(net, texts), strict=True):
        spans = list(own)
        for a, b, kind in new:
            part = text[a:b]
            a, b = a + len(part) - len(part.lstrip()), b - (len(part) - len(part.rstrip()))
            if b - a >= least and _SIGN.search(text, a, b) and not any(a < y and x < b for x, y, _ in own):
                spans.append((a, b, kind))
        both.append(sorted(spans, key=lambda s: (s[0], s[2])))
    return base, both


_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
_SPAN_SQL = "array<struct<kind:string,start:bigint,end:bigint>>"


def find(df: DataFrame, net: Network | None, text: str = "text") -> DataFrame:
    """``df`` plus ``base_spans`` and ``spans`` (arrays of kind, start, end in code points), by start and kind.

    Null and empty texts have none; input columns of these names are replaced.
    """
    return _mapped(df, net, text, ["base_spans", "spans"], f"base_spans {_SPAN_SQL}, spans {_SPAN_SQL}", _found)


def _found(texts: list[str], net: Network | None) -> list[pa.Array]:
    def rows(spans: list[list[tuple[int, int, int]]]) -> pa.Array:
        return pa.array([[{"kind": KINDS[k], "start": a, "end": b} for a, b, k in own] for own in spans], _SPAN)

    base, both = all_spans(texts, net)
    return [rows(base), rows(both)]


def mask(df: DataFrame, net: Network | None, text: str = "text") -> DataFrame:
    """``df`` with each span of personal data in ``text`` replaced by its kind in angle brackets (``<email>``).

    Overlapping spans become one mark, of the first one's kind.  A null text
    stays null.
    """
    refuse_hidden(df)

    def work(texts: list[str], net: Network | None) -> list[pa.Array]:
        return [pa.array([_masked(t, s) for t, s in zip(texts, all_spans(texts, net)[1], strict=True)], pa.string())]

    masked = _mapped(df, net, text, ["__llm_masked"], "__llm_masked string", work)
    new = F.when(F.col(f"`{text}`").isNull(), F.lit(None).cast("string")).otherwise(F.col("__llm_masked"))
    return masked.select(*[(new.alias(n) if n == text else F.col(f"`{n}`")) for n in df.columns])


def _masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    parts, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            parts += [text[at:a], f"<{KINDS[kind]}>"]
        at = max(at, b)
    return "".join([*parts, text[at:]])


def _mapped(df: DataFrame, net: Network | None, text: str, added: list[str], ddl: str, work) -> DataFrame:
    names = fresh_names(df, added)
    source = df.select(*[F.col(f"`{n}`") for n in names], text_or_empty(text).alias("__llm_text"))
    shared = df.sparkSession.sparkContext.broadcast(net)  # a few thousand numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(names))
            for first, last in slices(texts, 1_000_000):
                part = batch.slice(first, last - first)
                made = work(texts.slice(first, last - first).to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], *made], names=[*names, *added])

    return source.mapInArrow(lean(run), with_fields(df, names, ddl))
