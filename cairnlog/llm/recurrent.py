"""A character BiLSTM with CRF transitions, trained and run in numpy.

Texts run in lanes, one after the other; a reset character between two of them
closes the gates, so that a text starts from the zero state wherever it stands.
Both directions are one batch.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Characters: 0 resets, 1 to 95 are ASCII from space on, then line breaks and tabs, other letters, all others.
RESET, BREAK, LETTER, REST = 0, 96, 97, 98
CHARACTERS = 99
_TABLE = np.full(0x250, REST, np.uint8)
_TABLE[0x20:0x7F] = np.arange(1, 96)
_TABLE[[9, 10, 13]] = BREAK
_TABLE[[c for c in range(0xAA, 0x250) if chr(c).isalpha()]] = LETTER


def codes(points: np.ndarray) -> np.ndarray:
    """The character class of each code point."""
    return np.where(points < 0x250, _TABLE[np.minimum(points, 0x24F)], np.uint8(REST)).astype(np.uint8)


@dataclass
class Network:
    """Per direction: embedding (characters x inputs), gates (4 hidden x (hidden + inputs + 1)), tags; CRF scores."""

    embed: np.ndarray
    gates: np.ndarray  # 2, 4H, H + D + 1; order of the gates: input, forget, output, new
    tags: np.ndarray  # 2, K, H
    bias: np.ndarray  # K
    move: np.ndarray  # K, K
    first: np.ndarray  # K

    @classmethod
    def random(cls, kinds: int, hidden: int, inputs: int, rng: np.random.Generator) -> Network:
        gates = rng.normal(0, 1 / np.sqrt(hidden + inputs), (2, 4 * hidden, hidden + inputs + 1))
        gates[:, :, -1] = 0.0
        gates[:, hidden : 2 * hidden, -1] = 1.0
        return cls(
            rng.normal(0, 0.5, (CHARACTERS, inputs)), gates, rng.normal(0, 0.3, (2, kinds, hidden)),
            np.zeros(kinds), np.zeros((kinds, kinds)), np.zeros(kinds),
        )

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, self.gates, self.tags, self.bias, self.move, self.first]

    def emissions(self, lanes: np.ndarray) -> np.ndarray:
        """Scores (steps, kinds, lanes) for lanes (steps, lanes) of character classes."""
        steps, width = lanes.shape
        hidden, kinds = self.tags.shape[2], self.tags.shape[1]
        size = self.embed.shape[1]
        # one exponential for all gates: sigmoid(x) = 1 / (1 + exp(-x)), tanh(x) = 2 sigmoid(2 x) - 1, which
        # takes less time than tanh; a column of its own closes them on a reset
        scale = np.full((1, 4 * hidden, 1), -1.0)
        scale[:, 3 * hidden :] = -2.0
        shut = np.zeros((2, 4 * hidden, 1))
        shut[:, : 3 * hidden] = 1e4
        weights = np.concatenate((self.gates[:, :, : hidden + size] * scale, self.gates[:, :, -1:] * scale, shut), axis=2).astype("f4")
        table = np.zeros((size + 2, CHARACTERS), "f4")
        table[:size], table[size], table[size + 1, RESET] = self.embed.T, 1.0, 1.0
        tags = self.tags.astype("f4")
        out = np.empty((2, steps, kinds, width), "f4")
        state = np.zeros((2, hidden + size + 2, width), "f4")
        h, x = state[:, :hidden], state[:, hidden:]
        cell, fresh = np.zeros((2, hidden, width), "f4"), np.empty((2, hidden, width), "f4")
        gates = np.empty((2, 4 * hidden, width), "f4")
        sigmoid, new = gates[:, : 3 * hidden], gates[:, 3 * hidden :]
        enter, keep, give = sigmoid[:, :hidden], sigmoid[:, hidden : 2 * hidden], sigmoid[:, 2 * hidden :]
        with np.errstate(over="ignore"):  # a gate that is shut: 1 / (1 + infinity)
            for t in range(steps):
                np.take(table, lanes[t].astype(np.intp), axis=1, out=x[0], mode="clip")
                np.take(table, lanes[steps - 1 - t].astype(np.intp), axis=1, out=x[1], mode="clip")
                np.matmul(weights, state, out=gates)
                np.exp(gates, out=gates)
                gates += 1
                np.reciprocal(gates, out=gates)
                new *= 2
                new -= 1
                cell *= keep
                np.multiply(enter, new, out=fresh)
                cell += fresh
                np.multiply(cell, -2, out=fresh)
                np.exp(fresh, out=fresh)
                fresh += 1
                np.divide(2, fresh, out=fresh)
                fresh -= 1
                np.multiply(give, fresh, out=h)
                np.matmul(tags[0], h[0], out=out[0, t])
                np.matmul(tags[1], h[1], out=out[1, steps - 1 - t])
        total = out[0]
        total += out[1]
        total += self.bias.astype("f4")[None, :, None]
        return total


def _forward(net: Network, lanes: np.ndarray) -> tuple[np.ndarray, list]:
    """Emissions (steps, lanes, kinds) and what the backward pass needs; for training, without resets."""
    steps, width = lanes.shape
    hidden = net.tags.shape[2]
    total = np.tile(net.bias, (steps, width, 1))
    kept = []
    for d in range(2):
        order = range(steps) if d == 0 else range(steps - 1, -1, -1)
        h, c = np.zeros((width, hidden)), np.zeros((width, hidden))
        trace = []
        for t in order:
            x = np.concatenate((h, net.embed[lanes[t]], np.ones((width, 1))), axis=1)
            g = x @ net.gates[d].T
            s = 1 / (1 + np.exp(-g[:, : 3 * hidden]))
            z = np.tanh(g[:, 3 * hidden :])
            before = c
            c = s[:, hidden : 2 * hidden] * c + s[:, :hidden] * z
            q = np.tanh(c)
            h = s[:, 2 * hidden :] * q
            trace.append((t, x, s, z, before, q, h))
            total[t] += h @ net.tags[d].T
        kept.append(trace)
    return total, kept


def _backward(net: Network, lanes: np.ndarray, kept: list, slope: np.ndarray) -> list[np.ndarray]:
    """Gradients of embedding, gates, tags and bias for d loss / d emissions (steps, lanes, kinds)."""
    hidden, size = net.tags.shape[2], net.embed.shape[1]
    embed, gates, tags = (np.zeros_like(p) for p in (net.embed, net.gates, net.tags))
    for d in range(2):
        dh, dc = np.zeros((lanes.shape[1], hidden)), np.zeros((lanes.shape[1], hidden))
        for t, x, s, z, before, q, h in reversed(kept[d]):
            tags[d] += slope[t].T @ h
            dh = dh + slope[t] @ net.tags[d]
            enter, keep, give = s[:, :hidden], s[:, hidden : 2 * hidden], s[:, 2 * hidden :]
            dc = dc + dh * give * (1 - q**2)
            ds = np.concatenate((dc * z, dc * before, dh * q), axis=1) * s * (1 - s)
            dg = np.concatenate((ds, dc * enter * (1 - z**2)), axis=1)
            gates[d] += dg.T @ x
            dx = dg @ net.gates[d]
            np.add.at(embed, lanes[t], dx[:, hidden : hidden + size])
            dh, dc = dx[:, :hidden], dc * keep
    return [embed, gates, tags, slope.sum(axis=(0, 1))]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)


def crf_loss(e: np.ndarray, move: np.ndarray, first: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Negative log-likelihood of tags ``y`` (steps, lanes), and its slopes by emissions, moves and first tags."""
    steps, width, kinds = e.shape
    ahead, behind = np.empty_like(e), np.zeros_like(e)
    ahead[0] = e[0] + first
    for t in range(1, steps):
        ahead[t] = e[t] + _log_sum(ahead[t - 1][:, :, None] + move, 1)
    for t in range(steps - 2, -1, -1):
        behind[t] = _log_sum(move + (e[t + 1] + behind[t + 1])[:, None, :], 2)
    norm = _log_sum(ahead[-1], 1)
    p = np.exp(ahead + behind - norm[None, :, None])
    pairs = np.exp(ahead[:-1, :, :, None] + move + (e[1:] + behind[1:])[:, :, None, :] - norm[None, :, None, None]).sum(axis=(0, 1))
    own = np.eye(kinds)[y]
    seen = np.zeros_like(move)
    np.add.at(seen, (y[:-1].ravel(), y[1:].ravel()), 1)
    score = (e * own).sum() + (seen * move).sum() + first[y[0]].sum()
    return float(norm.sum() - score), p - own, pairs - seen, (p[0] - own[0]).sum(axis=0)


def train(lanes: np.ndarray, tags: np.ndarray, kinds: int, hidden: int = 8, inputs: int = 8, rounds: int = 16, batch: int = 192, seed: int = 7) -> Network:
    """Fit to windows (windows, steps) of character classes and their tags, by Adam on the CRF's likelihood."""
    rng = np.random.default_rng(seed)
    net = Network.random(kinds, hidden, inputs, rng)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters()]
    step, total = 0, rounds * -(-len(lanes) // batch)
    for _ in range(rounds):
        order = rng.permutation(len(lanes))
        for start in range(0, len(lanes), batch):
            index = order[start : start + batch]
            x, y = lanes[index].T, tags[index].T
            e, kept = _forward(net, x)
            _, slope, move, first = crf_loss(e, net.move, net.first, y)
            slopes = [*_backward(net, x, kept, slope), move, first]
            step += 1
            rate = 0.02 * (1 - 0.95 * step / total)
            norm = np.sqrt(sum((s**2).sum() for s in slopes)) / len(index)
            for p, s, (m, v) in zip(net.parameters(), slopes, moments, strict=True):
                s = s / len(index) / max(1.0, norm / 5)
                m += 0.1 * (s - m)
                v += 0.01 * (s**2 - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def decode(e: np.ndarray, move: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The best tags for emissions (steps, kinds)."""
    back = np.empty((len(e), e.shape[1]), np.int64)
    best = e[0] + first
    for t in range(1, len(e)):
        path = best[:, None] + move
        back[t] = path.argmax(axis=0)
        best = path.max(axis=0) + e[t]
    tags = np.empty(len(e), np.int64)
    tags[-1] = best.argmax()
    for t in range(len(e) - 1, 0, -1):
        tags[t - 1] = back[t, tags[t]]
    return tags
