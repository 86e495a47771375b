"""Difference-cover blockwise suffix sort of short-range matches, in numpy.

:func:`window_classes` groups window starts of a byte buffer by their first
``length`` bytes.  A difference cover modulo ``PERIOD`` is sorted first
(:class:`CoverRanks`): for any two positions some shift below ``PERIOD`` puts
both on cover positions.  The windows are then sorted one leading-byte bucket
at a time by their first ``PERIOD`` bytes only; longer ties are resolved by
the ranks of the cover positions behind them.  So working memory is one
bucket plus the cover, never all windows at full depth.
"""

from __future__ import annotations

import numpy as np

#: A perfect difference set: every residue modulo 21 is a difference of two members.
PERIOD = 21
COVER = (3, 6, 7, 12, 14)
BUCKET = 1 << 18


def _shifts() -> np.ndarray:
    """shift[a, b]: the least d with (a + d) and (b + d) modulo PERIOD in COVER."""
    inside = np.zeros(PERIOD, bool)
    inside[list(COVER)] = True
    r = np.arange(PERIOD)
    out = np.full((PERIOD, PERIOD), -1, np.int64)
    for d in range(PERIOD - 1, -1, -1):
        m = inside[(r + d) % PERIOD]
        out[m[:, None] & m[None, :]] = d
    assert (out >= 0).all()
    return out


SHIFT = _shifts()


def words8(buf: np.ndarray) -> np.ndarray:
    """The 8 bytes from every position as a big-endian number (zeros past the end)."""
    n = len(buf)
    padded = np.zeros(n + 72, np.uint64)
    padded[:n] = buf
    w = padded
    for k in (1, 2, 4):
        nxt = np.zeros_like(w)
        nxt[:-k] = w[k:]
        w = (w << np.uint64(8 * k)) | nxt
    return w


def _depth_words(w: np.ndarray, at: np.ndarray, depth: int) -> list[np.ndarray]:
    """The first ``depth`` bytes from ``at`` as big-endian words, the first word first."""
    out = []
    for k in range(0, depth, 8):
        x = w[at + k]
        rest = depth - k
        out.append(x if rest >= 8 else x >> np.uint64(64 - 8 * rest))
    return out


class CoverRanks:
    """Ranks of the cover positions by their next ``length`` bytes, and their classes at any smaller depth."""

    def __init__(self, w: np.ndarray, n: int, length: int):
        r = np.arange(n) % PERIOD
        inside = np.zeros(PERIOD, bool)
        inside[list(COVER)] = True
        at = np.flatnonzero(inside[r])
        keys = _depth_words(w, at, length)
        order = np.lexsort(keys[::-1])
        self.length = length
        self.rank = np.zeros(n, np.int64)
        self.rank[at[order]] = np.arange(len(at))
        # common bytes of neighbours in rank order
        lcp = np.zeros(max(len(at) - 1, 0), np.int64)
        going = np.ones(len(lcp), bool)
        for k, key in enumerate(keys):
            width = min(8, length - 8 * k)
            x = key[order[1:]] ^ key[order[:-1]]
            same = np.full(len(lcp), 0, np.int64)
            for b in range(1, width + 1):
                same += x < np.uint64(1 << (8 * (width - b))) if width - b < 8 else 1
            lcp += np.where(going, same, 0)
            going &= same == width
        self.lcp = lcp
        self._classes: dict[int, np.ndarray] = {}

    def classes(self, at: np.ndarray, depth: int) -> np.ndarray:
        """Equal for cover positions that agree in ``depth`` bytes."""
        if depth not in self._classes:
            c = np.zeros(len(self.lcp) + 1, np.int64)
            np.cumsum(self.lcp < depth, out=c[1:])
            self._classes[depth] = c
        return self._classes[depth][self.rank[at]]


def _agree(cover: CoverRanks, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether windows at a and b, equal in the first PERIOD bytes, are equal throughout."""
    d = SHIFT[a % PERIOD, b % PERIOD]
    out = np.zeros(len(a), bool)
    for k in np.unique(d).tolist():
        m = d == k
        out[m] = cover.classes(a[m] + k, cover.length - k) == cover.classes(b[m] + k, cover.length - k)
    return out


def _bucket_classes(w: np.ndarray, cover: CoverRanks, at: np.ndarray, first: int, rounds: int = 6) -> tuple[np.ndarray, int]:
    """Class ids from ``first`` on for the windows of one bucket, and the next free id."""
    keys = _depth_words(w, at, PERIOD)
    order = np.lexsort(keys[::-1])
    new = np.ones(len(at), bool)
    new[1:] = np.any([k[order[1:]] != k[order[:-1]] for k in keys], axis=0)
    group = np.cumsum(new) - 1
    out = np.full(len(at), -1, np.int64)
    rest, group = order, group
    for _ in range(rounds):
        if not len(rest):
            return out, first
        head = np.ones(len(rest), bool)
        head[1:] = group[1:] != group[:-1]
        lead_at = np.flatnonzero(head)
        nth = np.cumsum(head) - 1
        lead = at[rest[lead_at]][nth]
        same = head.copy()
        other = np.flatnonzero(~head)
        same[other] = _agree(cover, lead[other], at[rest[other]])
        out[rest[same]] = first + nth[same]
        first += len(lead_at)
        rest, group = rest[~same], group[~same]
    if len(rest):  # prefixes that go on in very many ways: sort what is left to full depth
        keys = _depth_words(w, at[rest], cover.length)
        order = np.lexsort(keys[::-1])
        new = np.ones(len(rest), bool)
        new[1:] = np.any([k[order[1:]] != k[order[:-1]] for k in keys], axis=0)
        out[rest[order]] = first + np.cumsum(new) - 1
        first += int(new.sum())
    return out, first


def window_classes(buf: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """An id for every start, equal for starts whose ``length`` bytes are equal."""
    if not len(starts):
        return np.zeros(0, np.int64)
    w = words8(buf)
    cover = CoverRanks(w, len(buf), length)
    lead = (w[starts] >> np.uint64(40)).astype(np.int64)
    by = np.argsort(lead, kind="stable")
    edges = np.flatnonzero(np.diff(lead[by], prepend=-1))
    out = np.empty(len(starts), np.int64)
    first = lo = 0
    # buckets: runs of whole leading-byte groups of about BUCKET windows
    ends = np.append(edges[1:], len(by))
    while lo < len(by):
        hi = int(ends[min(np.searchsorted(ends, lo + BUCKET), len(ends) - 1)])
        own = by[lo:hi]
        out[own], first = _bucket_classes(w, cover, starts[own], first)
        lo = hi
    return out
