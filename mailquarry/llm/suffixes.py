"""Runs of suffixes in order: front coding and a merge that never compares known prefixes again."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix of two strings that are known to share ``known`` bytes."""
    most = min(len(a), len(b))
    while known < most:
        n = min(64, most - known)
        x = int.from_bytes(a[known:known + n]) ^ int.from_bytes(b[known:known + n])
        if x:
            return known + n - (x.bit_length() + 7) // 8
        known += n
    return most


def prefixes(run: list[bytes]) -> np.ndarray:
    """Common prefix of each string of a run with the one before."""
    return np.array([0, *(common(a, b) for a, b in zip(run[:-1], run[1:], strict=True))] if run else [], np.int64)


def front_coded(run: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Common prefixes, rest lengths and rests of a sorted run."""
    shared = prefixes(run)
    rests = [x[k:] for x, k in zip(run, shared.tolist(), strict=True)]
    return shared, np.array([len(r) for r in rests], np.int64), b"".join(rests)


def decoded(shared: np.ndarray, sizes: np.ndarray, rests: bytes) -> Iterator[tuple[bytes, int]]:
    """Strings of a front-coded run, each with its common prefix."""
    last, at = b"", 0
    for k, n in zip(shared.tolist(), sizes.tolist(), strict=True):
        last = last[:k] + rests[at:at + n]
        at += n
        yield last, k


def merged(runs: list[Iterator[tuple[bytes, int]]]) -> Iterator[tuple[int, bytes, int]]:
    """(run, string, common prefix with the string before) in order, by a loser tree.

    Every head knows how much it shares with the last string given out. Of two heads the one that shares more is the
    smaller one, without a comparison; only if they share equally much are they compared, from there on. The loser of a
    match keeps what it shares with the winner.
    """
    size = 1
    while size < len(runs):
        size *= 2
    heads: list[bytes | None] = [None] * size
    shared = [0] * size

    def advance(r: int) -> None:
        heads[r], shared[r] = next(runs[r], (None, 0)) if r < len(runs) else (None, 0)

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser."""
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if shared[a] != shared[b]:
            return (a, b) if shared[a] > shared[b] else (b, a)
        k = common(x, y, shared[a])
        first = k == len(x) or k < len(y) and x[k] < y[k]
        if first and k == len(x) == len(y):
            first = a < b
        winner, loser = (a, b) if first else (b, a)
        shared[loser] = k
        return winner, loser

    losers = [0] * size
    winners = [0] * (2 * size)
    for r in range(size):
        advance(r)
        shared[r] = 0
        winners[size + r] = r
    for node in range(size - 1, 0, -1):
        winners[node], losers[node] = play(winners[2 * node], winners[2 * node + 1])
    top = winners[1]
    while heads[top] is not None:
        yield top, heads[top], shared[top]
        advance(top)
        node, best = (top + size) // 2, top
        while node:
            best, losers[node] = play(best, losers[node])
            node //= 2
        top = best
