"""Tandem repeats of a sequence of integers: Lempel-Ziv blocks, suffix-link walks, located runs.

After Gusfield and Stoye (2004), with NumPy over whole arrays in place of pointers: the suffix tree is
the suffix array with its longest common prefixes, a node an interval of that array. A square
is a word followed by itself. Only squares whose half isn't itself a repetition are kept;
each run (a stretch with smallest period p and at least 2p long) is the union of its squares.
"""

from __future__ import annotations

import numpy as np

#: Values of a block of ``Least``.
BLOCK = 16
#: Occurrences of squares that are located at once, whole periods at least.
AT_ONCE = 2_000_000


class Least:
    """Minima of any stretches of an array, in a few bytes a value."""

    def __init__(self, values: np.ndarray):
        n = -(-max(len(values), 1) // BLOCK)
        self.v = np.full(n * BLOCK, np.iinfo(np.int32).max, np.int32)
        self.v[: len(values)] = values
        m = self.v.reshape(n, BLOCK)
        self.first = np.minimum.accumulate(m, 1).ravel()
        self.last = np.minimum.accumulate(m[:, ::-1], 1)[:, ::-1].ravel()
        levels = [m.min(1)]
        while 2 << (len(levels) - 1) <= n:
            w = 1 << (len(levels) - 1)
            up = levels[-1].copy()
            up[:-w] = np.minimum(up[:-w], levels[-1][w:])
            levels.append(up)
        self.table = np.stack(levels)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Least value from place a to place b, both inside, a <= b."""
        i, j = a // BLOCK, b // BLOCK
        out = np.minimum(self.last[a], self.first[b])
        far = np.flatnonzero(j > i + 1)
        if far.size:
            gap = j[far] - i[far] - 1
            k = np.frexp(gap.astype(np.float64))[1] - 1
            out[far] = np.minimum(out[far], np.minimum(self.table[k, i[far] + 1], self.table[k, j[far] - (1 << k)]))
        if (near := np.flatnonzero(i == j)).size:
            x, y = a[near], b[near]
            least = self.v[x]
            for _ in range(int((y - x).max())):
                x = np.minimum(x + 1, y)
                least = np.minimum(least, self.v[x])
            out[near] = least
        return out


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Start places of all suffixes in order, by doubling; only groups of equals are sorted again."""
    n = len(t)
    sa = np.argsort(t, kind="stable")
    rank = np.zeros(n, np.int64)
    slots = np.arange(n)
    key, width = t[sa], 1
    while True:
        head = np.ones(len(slots), bool)
        head[1:] = (key[1:] != key[:-1]) if key.ndim == 1 else (key[1:] != key[:-1]).any(1)
        start = np.maximum.accumulate(np.where(head, slots, 0))
        rank[sa[slots]] = start
        single = head.copy()
        single[:-1] &= head[1:]
        slots = slots[~single]
        if not len(slots):
            return sa
        at = sa[slots]
        after = np.where(at + width < n, rank[np.minimum(at + width, n - 1)] + 1, 0)
        key = rank[at] * (n + 1) + after
        order = np.argsort(key, kind="stable")
        sa[slots], key = at[order], key[order]
        width *= 2


def _common(t: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of suffixes a and b, by comparing."""
    n = len(t)
    out = np.zeros(len(a), np.int64)
    go = np.arange(len(a))
    for step in range(64):
        x, y = a[go] + step, b[go] + step
        ok = (x < n) & (y < n)
        ok[ok] = t[x[ok]] == t[y[ok]]
        go = go[ok]
        out[go] = step + 1
        if not go.size:
            return out
    for i in go.tolist():
        x, y, length, piece = int(a[i]), int(b[i]), 64, 256
        while True:
            m = min(piece, n - max(x, y) - length)
            unlike = np.flatnonzero(t[x + length : x + length + m] != t[y + length : y + length + m])
            if unlike.size or m < piece:
                out[i] = length + (int(unlike[0]) if unlike.size else m)
                break
            length, piece = length + m, piece * 2
    return out


class Suffixes:
    """Suffix array, ranks, and the common prefix length of any two suffixes."""

    def __init__(self, t: np.ndarray):
        n = self.n = len(t)
        self.t, self.sa = t, suffix_array(t)
        self.rank = np.empty(n, np.int64)
        self.rank[self.sa] = np.arange(n)
        before = np.full(n, -1, np.int64)
        before[self.sa[1:]] = self.sa[:-1]
        # prefix lengths that don't follow from the suffix one place earlier are compared, the others follow
        at = np.arange(n)
        own = (before < 0) | (at == 0) | (before == 0)
        rest = np.flatnonzero(~own)
        own[rest] = t[rest - 1] != t[before[rest] - 1]
        places = np.flatnonzero(own & (before >= 0))
        reach = np.where(own, at, 0)
        reach[places] += _common(t, places, before[places])
        self.lcp = (np.maximum.accumulate(reach) - at)[self.sa].astype(np.int32)  # of a suffix and the one before it in order
        self.least = Least(self.lcp)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefix lengths of suffixes a and b; a place beyond either end has none."""
        out = np.zeros(len(a), np.int64)
        use = np.flatnonzero((a >= 0) & (b >= 0) & (a < self.n) & (b < self.n) & (a != b))
        x, y = self.rank[a[use]], self.rank[b[use]]
        out[use] = self.least(np.minimum(x, y) + 1, np.maximum(x, y))
        return out

    def _alike(self, at: np.ndarray, edge: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether all suffixes from place ``at`` to ``edge`` of the order share ``length`` values."""
        out = (edge >= 0) & (edge < self.n)
        a, b = np.minimum(at[out], edge[out]), np.maximum(at[out], edge[out])
        out[out] = self.least(a + 1, b) >= length[out]
        return out

    def _edge(self, at: np.ndarray, length: np.ndarray, side: int) -> np.ndarray:
        """The last place to one side whose suffix shares ``length`` values: steps double, then halve."""
        out, step, go = at.copy(), np.full(len(at), side), np.arange(len(at))
        while go.size:
            go = go[self._alike(out[go], out[go] + step[go], length[go])]
            out[go] += step[go]
            step[go] *= 2
        size = np.abs(step) // 2
        while (go := np.flatnonzero(size)).size:
            edge = out[go] + side * size[go]
            fits = self._alike(out[go], edge, length[go])
            out[go[fits]] = edge[fits]
            size[go] //= 2
        return out

    def node(self, at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last place in the suffix array of the suffixes that share ``length`` values with those at ``at``."""
        r = self.rank[at]
        return self._edge(r, length, -1), self._edge(r, length, 1)


def _nearest_smaller(v: np.ndarray) -> np.ndarray:
    """For each place the nearest earlier one with a smaller value, else -1."""
    out = np.arange(len(v)) - 1
    go = np.arange(1, len(v))
    while go.size:
        to = out[go]
        more = (to >= 0) & (v[np.maximum(to, 0)] > v[go])
        go, to = go[more], to[more]
        out[go] = out[to]
    return out


def block_starts(s: Suffixes) -> np.ndarray:
    """Starts of the Lempel-Ziv blocks: each the longest stretch that also starts earlier, at least one value."""
    n = s.n
    before = _nearest_smaller(s.sa)
    after = n - 1 - _nearest_smaller(s.sa[::-1])[::-1]
    seen = np.zeros(n, np.int64)
    for other in (before, np.where(after < n, after, -1)):
        use = np.flatnonzero(other >= 0)
        seen[use] = np.maximum(seen[use], s.common(s.sa[use], s.sa[other[use]]))
    step = np.empty(n, np.int64)
    step[s.sa] = np.maximum(seen, 1)
    step, at, out = step.tolist(), 0, []
    while at < n:
        out.append(at)
        at += step[at]
    return np.array(out, np.int64)


def _ranges(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and number from 0 of each of ``count`` things."""
    owner = np.repeat(np.arange(len(count)), count)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)


def covering_squares(s: Suffixes, back: Suffixes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squares (start, period) so that every square first occurs in the same run as one of them, not before it.

    Where a square first occurs it isn't inside a block. With its middle in a block, its right
    half ends in the next one at the latest. So it either starts in the block and contains
    the block's end, or starts before the block and contains its start in its left half.
    """
    n = s.n
    ends = np.append(starts[1:], n)
    nexts = np.append(ends[1:], n)
    shared = lambda a, b: (s.common(a, b), back.common(n - a, n - b))  # noqa: E731  after, and before, places a and b
    owner, k = _ranges(ends - starts)
    k, h, mid = k + 1, ends[owner], ends[owner] - k - 1
    right, left = shared(h, mid)
    first = np.maximum(mid - left, mid - k + 1)
    ok = (first <= np.minimum(mid + right - k, mid - 1)) & (first >= 0)
    found = [(first[ok], k[ok])]
    owner, k = _ranges(nexts - starts)
    k, h = k + 1, starts[owner]
    right, left = shared(h, h + k)
    first = np.maximum(h - left, h - k)
    ok = (first <= np.minimum(np.minimum(h + right - k, h - 1), ends[owner] - 1 - k)) & (first >= 0)
    found.append((first[ok], k[ok]))
    at, period = (np.concatenate(x) for x in zip(*found, strict=True))
    at, period = np.unique(np.stack([at, period], 1), axis=0).T if len(at) else (at, period)
    return _primitive(s, at, period)


def _primitive(s: Suffixes, at: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squares whose half isn't itself repeated: no prime part of the period is a period."""
    if not len(at):
        return at, period
    factor = np.zeros(int(period.max()) + 1, np.int64)
    for p in range(2, len(factor)):
        if p * p >= len(factor):
            break
        if not factor[p]:
            part = factor[p * p :: p]
            part[part == 0] = p
    factor = np.where(factor == 0, np.arange(len(factor)), factor)
    good, rest = np.ones(len(at), bool), period.copy()
    while (go := np.flatnonzero(good & (rest > 1))).size:
        p = factor[rest[go]]
        shift = period[go] // p
        good[go] = s.common(at[go], at[go] + shift) < 2 * period[go] - shift
        rest[go] //= p
    return at[good], period[good]


def vocabulary(s: Suffixes, at: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All distinct squares: their nodes (first and last place in the suffix array) and periods.

    From each covering square a walk goes on by suffix links: without its first value, and
    on along the edge that has that value, there is the next rotation. As long as the text itself goes on so, its places
    give the steps; where it doesn't, the link's node is searched for that edge. A walk ends
    at a square that is known.
    """
    known = np.zeros(0, np.int64)
    out = []
    while len(at):
        more = np.minimum(period, s.common(at, at + period) - period + 1)
        owner, turn = _ranges(more)
        i, k = at[owner] + turn, period[owner]
        low, high = s.node(i, 2 * k)
        name = low * (s.n + 1) + k
        name, first = np.unique(name, return_index=True)
        new = ~np.isin(name, known, assume_unique=True)
        name, first = name[new], first[new]
        known = np.concatenate([known, name])
        out.append((low[first], high[first], k[first]))
        # walks whose text breaks off after a new square, before all rotations are seen
        ends = (np.cumsum(more) - 1)[more < period]
        ends = ends[np.isin(ends, first)]
        i, k = i[ends], k[ends]
        use = i + 1 < s.n
        i, k = i[use], k[use]
        low, high = s.node(i + 1, 2 * k - 1)
        wanted = s.t[i]
        a, b = low, high + 1
        while (go := np.flatnonzero(a < b)).size:  # first suffix of the node whose next value isn't smaller
            m = (a[go] + b[go]) // 2
            place = s.sa[m] + 2 * k[go] - 1
            less = (place >= s.n) | (s.t[np.minimum(place, s.n - 1)] < wanted[go])
            a, b = a.copy(), b.copy()
            a[go[less]], b[go[~less]] = m[less] + 1, m[~less]
        place = s.sa[np.minimum(a, s.n - 1)] + 2 * k - 1
        there = (a <= high) & (place < s.n)
        there[there] = s.t[place[there]] == wanted[there]
        at, period = s.sa[a[there]], k[there]
        fresh = ~np.isin(a[there] * (s.n + 1) + period, known)
        at, period = np.unique(np.stack([at[fresh], period[fresh]], 1), axis=0).T if fresh.any() else (at[:0], period[:0])
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (known, known, known)


def located_runs(s: Suffixes, low: np.ndarray, high: np.ndarray, period: np.ndarray, exponent: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs (start, end, period): squares of a period at neighbouring places are one."""
    order = np.argsort(period, kind="stable")
    low, high, period = low[order], high[order], period[order]
    total = np.cumsum(high - low + 1)
    out, at = [], 0
    while at < len(low):
        done = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, done + AT_ONCE, "right")))
        end = int(np.searchsorted(period, period[end - 1], "right"))  # a period's squares are together
        owner, turn = _ranges((high - low + 1)[at:end])
        place, k = s.sa[low[at:end][owner] + turn], period[at:end][owner]
        where = np.lexsort((place, k))
        place, k = place[where], k[where]
        head = np.ones(len(place), bool)
        head[1:] = (k[1:] != k[:-1]) | (place[1:] != place[:-1] + 1)
        first = np.flatnonzero(head)
        last = np.append(first[1:], len(place)) - 1
        a, b, p = place[first], place[last] + 2 * k[first], k[first]
        some = b - a >= exponent * p
        out.append((a[some], b[some], p[some]))
        at = end
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (low, low, low)


def tandem_runs(t: np.ndarray, exponent: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All maximal stretches of ``t`` with smallest period p and at least ``exponent`` p long: start, end, p."""
    if len(t) < 2:
        return (np.zeros(0, np.int64),) * 3
    t = np.unique(t, return_inverse=True)[1].astype(np.int64)
    s, back = Suffixes(t), Suffixes(t[::-1])
    at, period = covering_squares(s, back, block_starts(s))
    del back
    return located_runs(s, *vocabulary(s, at, period), exponent)
