"""Forward-backward for many linear chains at once, in blocks: chains of any length cost a few array passes."""

from __future__ import annotations

import numpy as np

BLOCK = 64
#: Steps between two rescalings of the running products.
RESCALE = 4


def _reduced(potential: np.ndarray, step: np.ndarray, start: np.ndarray, running: np.ndarray) -> np.ndarray:
    """The transfer matrices of blocks: start, of which the first running[t] have a step t."""
    k = len(step)
    out = np.tile(np.eye(k), (len(start), 1, 1))
    for t in range(BLOCK):
        a = running[t]
        new = (out[:a].reshape(-1, k) @ step).reshape(a, k, k)
        new *= potential[start[:a] + t][:, None, :]
        if t % RESCALE == RESCALE - 1:
            new /= (new.reshape(a, k * k) @ np.ones(k * k))[:, None, None]
        out[:a] = new
    return out


def transfer(emissions: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """The k x k matrix, up to a factor, that takes the state before a part of a chain to the state after it."""
    n, k = emissions.shape
    if not n:
        return np.eye(k)
    start = np.arange(0, n, BLOCK)
    # only the last block may be shorter
    running = np.where(np.arange(BLOCK) < (n - 1) % BLOCK + 1, len(start), len(start) - 1)
    parts = _reduced(np.exp(emissions - emissions.max(1, keepdims=True)), np.exp(transitions), start, running)
    out = np.eye(k)
    for m in parts:
        out = out @ m
        out /= out.sum()
    return out


def posteriors(emissions: np.ndarray, bounds: np.ndarray, transitions: np.ndarray, counts: bool = True, enter: np.ndarray | None = None, leave: np.ndarray | None = None):
    """Marginals of each step and, with counts, the expected transition counts.

    enter, leave: for parts of longer chains, the distribution before and the message from behind each (chains x k).

    emissions: n x k log potentials; bounds: where chains start in them (m + 1 values); transitions: k x k log
    potentials, applied before each step, the first one too (from a uniform state). Chains are cut into blocks of
    BLOCK steps. Blocks are first reduced to k x k transfer matrices, all at once; a scan over each chain's blocks
    gives what enters and leaves them; then the steps inside all blocks are filled in together. Blocks stand longest
    first, so that at each step those still running are a leading slice.
    """
    n, k = emissions.shape
    step = np.exp(transitions)
    lengths = np.diff(bounds)
    blocks = -(-lengths // BLOCK)
    chain = np.repeat(np.arange(len(lengths)), blocks)
    if not len(chain):
        return np.zeros((0, k)), np.zeros((k, k))
    first = np.r_[0, np.cumsum(blocks)]
    start = bounds[chain] + BLOCK * (np.arange(len(chain)) - first[chain])
    size = np.minimum(BLOCK, bounds[chain + 1] - start)
    order = np.argsort(-size, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    start, size = start[order], size[order]
    running = np.searchsorted(-size, -np.arange(BLOCK), "left")
    potential = np.exp(emissions - emissions.max(1, keepdims=True))
    ones, m = np.ones(k), len(chain)

    transfers = _reduced(potential, step, start, running)

    forward = np.full((len(lengths), k), 1 / k) if enter is None else enter.copy()
    backward = np.ones((len(lengths), k)) if leave is None else leave.copy()
    enter, leave = np.empty((m, k)), np.empty((m, k))
    by_length = np.argsort(-blocks, kind="stable")
    live = np.searchsorted(-blocks[by_length], -np.arange(int(blocks.max())), "left")
    for b in range(len(live)):
        c = by_length[: live[b]]
        i = place[first[c] + b]
        enter[i] = forward[c]
        new = (forward[c][:, None, :] @ transfers[i])[:, 0]
        forward[c] = new / (new @ ones)[:, None]
    for b in range(len(live) - 1, -1, -1):
        c = by_length[: live[b]]
        i = place[first[c] + b]
        leave[i] = backward[c]
        new = (transfers[i] @ backward[c][:, :, None])[:, :, 0]
        backward[c] = new / (new @ ones)[:, None]

    alpha = np.empty((n, k))
    pairs = np.zeros((k, k))
    for t in range(BLOCK):
        a = running[t]
        at = start[:a] + t
        new = (enter[:a] @ step) * potential[at]
        new /= (new @ ones)[:, None]
        alpha[at] = enter[:a] = new
    gamma = np.empty((n, k))
    for t in range(BLOCK - 1, -1, -1):
        a = running[t]
        at = start[:a] + t
        gamma[at] = alpha[at] * leave[:a]
        new = leave[:a] * potential[at]
        if counts:
            before = np.full((a, k), 1 / k)
            inner = np.flatnonzero(~np.isin(at, bounds))
            before[inner] = alpha[at[inner] - 1]
            norm = ((before @ step) * new) @ ones
            pairs += step * (before.T @ (new / norm[:, None]))
        new = new @ step.T
        leave[:a] = new / (new @ ones)[:, None]
    gamma /= (gamma @ ones)[:, None]
    return gamma, pairs
