"""Linear-chain conditional random field with two states, for many chains at once.

State 0 has score 0 everywhere; ``emission`` is the score of state 1 at each place, ``trans`` the 2 x 2 scores of
neighbouring states. Forward and backward quantities are kept as odds of state 1 against 0, so nothing under- or
overflows along a chain of any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_AREA = 2_000_000
_CLIP = 25.0


def _groups(cut: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """Chains of falling length, so many that the padded table stays small."""
    size = np.diff(cut)
    order = np.argsort(-size, kind="stable")
    order = order[size[order] > 0]
    lo = 0
    while lo < len(order):
        longest = int(size[order[lo]])
        hi = min(len(order), lo + max(1, _AREA // longest))
        # a chain of less than half the length waits for the next table
        short = np.flatnonzero(size[order[lo:hi]] < longest // 2)
        if len(short) and short[0] >= 64:
            hi = lo + int(short[0])
        yield order[lo:hi], longest
        lo = hi


def odds(emission: np.ndarray, cut: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward odds at each place; chain k is cut[k]:cut[k + 1]. Their product is the odds of the marginal."""
    e_all = np.exp(np.clip(emission, -_CLIP, _CLIP))
    a = np.exp(trans)
    fwd, back = np.empty(len(emission)), np.empty(len(emission))
    size = np.diff(cut)
    for chains, longest in _groups(cut):
        n = size[chains]
        live = len(chains) - np.searchsorted(n[::-1], np.arange(longest), side="right")  # chains longer than t
        at = cut[chains]
        r = e_all[at]
        fwd[at] = r
        for t in range(1, longest):
            k = live[t]
            here = at[:k] + t
            r = r[:k]
            r = e_all[here] * (a[0, 1] + r * a[1, 1]) / (a[0, 0] + r * a[1, 0])
            fwd[here] = r
        b = np.ones(len(chains))
        back[at + n - 1] = 1.0
        for t in range(longest - 1, 0, -1):
            k = live[t]
            x = e_all[at[:k] + t] * b[:k]
            b[:k] = (a[1, 0] + a[1, 1] * x) / (a[0, 0] + a[0, 1] * x)
            back[at[:k] + t - 1] = b[:k]
    return fwd, back


def marginals(emission: np.ndarray, cut: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Probability of state 1 at each place."""
    fwd, back = odds(emission, cut, trans)
    x = fwd * back
    return x / (1 + x)


def expected(emission: np.ndarray, cut: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals, and the expected number of each pair of neighbouring states."""
    fwd, back = odds(emission, cut, trans)
    inner = np.ones(len(emission), bool)
    inner[cut[:-1][np.diff(cut) > 0]] = False
    t = np.flatnonzero(inner)
    left = fwd[t - 1]
    right = np.exp(np.clip(emission[t], -_CLIP, _CLIP)) * back[t]
    a = np.exp(trans)
    pair = np.stack([a[0, 0] * np.ones(len(t)), a[0, 1] * right, a[1, 0] * left, a[1, 1] * left * right])
    pair /= pair.sum(0)
    x = fwd * back
    return x / (1 + x), pair.sum(1).reshape(2, 2)


def observed_pairs(labels: np.ndarray, cut: np.ndarray) -> np.ndarray:
    inner = np.ones(len(labels), bool)
    inner[cut[:-1][np.diff(cut) > 0]] = False
    t = np.flatnonzero(inner)
    return np.bincount(2 * labels[t - 1] + labels[t], minlength=4).reshape(2, 2).astype(float)
