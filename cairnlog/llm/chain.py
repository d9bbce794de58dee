"""Linear-chain conditional random fields: sums over many sequences laid end to end."""

from __future__ import annotations

import numpy as np

_BLOCK = 64


def marginals(gain: np.ndarray, starts: np.ndarray, start: np.ndarray, step: np.ndarray) -> np.ndarray:
    """p(label 1) of each token by forward-backward.

    ``gain`` is the score of label 1 over label 0 per token, ``starts`` marks
    first tokens, ``start`` and ``step`` are scores of first labels and of label
    pairs.  The sequences are one chain in which first tokens forget what came
    before, and the chain is summed in blocks, all blocks at once.
    """
    if not len(gain):
        return np.empty(0)
    scale = np.maximum(gain, 0.0)
    emit = np.stack([np.exp(-scale), np.exp(gain - scale)], axis=1)
    first, pair = np.exp(start - start.max()), np.exp(step - step.max())
    move = np.broadcast_to(pair, (len(gain), 2, 2)).copy()
    move[starts] = first[None, None, :]
    ahead = _sweep(move * emit[:, None, :], np.array([1.0, 0.0]))
    # backwards: what a token passes to the one before it; ends pass on ones
    back = np.empty_like(move)
    back[:-1] = (move[1:] * emit[1:, None, :]).transpose(0, 2, 1)
    back[-1] = 1.0
    behind = _sweep(back[::-1], np.ones(2))[::-1]
    joint = ahead * behind
    return joint[:, 1] / joint.sum(axis=1)


def _sweep(moves: np.ndarray, state: np.ndarray) -> np.ndarray:
    """The row vector after each of the products state m0, state m0 m1, ... (each scaled to a sum of 1)."""
    n = len(moves)
    if n <= 4 * _BLOCK:
        out = np.empty((n, 2))
        for i in range(n):
            state = state @ moves[i]
            state = state / state.sum()
            out[i] = state
        return out
    blocks = -(-n // _BLOCK)
    padded = np.empty((blocks * _BLOCK, 2, 2))
    padded[:n] = moves
    padded[n:] = np.eye(2)
    padded = padded.reshape(blocks, _BLOCK, 2, 2)
    whole = padded[:, 0].copy()
    for i in range(1, _BLOCK):
        whole = whole @ padded[:, i]
        whole /= whole.sum(axis=(1, 2), keepdims=True)
    entry = np.concatenate((state[None], _sweep(whole, state)[:-1]))
    out = np.empty((blocks, _BLOCK, 2))
    for i in range(_BLOCK):
        entry = (entry[:, :, None] * padded[:, i]).sum(axis=1)
        entry /= entry.sum(axis=1, keepdims=True)
        out[:, i] = entry
    return out.reshape(-1, 2)[:n]


def pair_counts(p: np.ndarray, gain: np.ndarray, starts: np.ndarray, start: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expected first labels and label pairs, from exact marginals of neighbours."""
    first = np.array([(1 - p[starts]).sum(), p[starts].sum()])
    inner = np.flatnonzero(~starts)
    # p(a, b) of neighbours: forward message without the move, times the move, times what lies behind
    scale = np.maximum(gain, 0.0)
    emit = np.stack([np.exp(-scale), np.exp(gain - scale)], axis=1)
    pair = np.exp(step - step.max())
    move = np.broadcast_to(pair, (len(gain), 2, 2)).copy()
    move[starts] = np.exp(start - start.max())[None, None, :]
    ahead = _sweep(move * emit[:, None, :], np.array([1.0, 0.0]))
    both = np.stack([1 - p, p], axis=1)
    behind = both / np.maximum(ahead, 1e-300)
    joint = ahead[inner - 1][:, :, None] * pair[None] * (emit[inner] * behind[inner])[:, None, :]
    total = joint.sum(axis=(1, 2), keepdims=True)
    return first, (joint / np.maximum(total, 1e-300)).sum(axis=0)
