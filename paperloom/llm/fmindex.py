"""A compressed full-text index: BWT in a wavelet matrix, searched backwards for many patterns at once."""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector with rank: packed in words of 64, and the ones before each word."""

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        ones = np.bitwise_count(self.words).astype(np.int32)
        self.before = np.cumsum(ones, dtype=np.int32) - ones

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low).astype(np.int64)


class Wavelet:
    """A wavelet matrix: how often a symbol occurs before a place, in a step for each bit of a symbol."""

    def __init__(self, symbols: np.ndarray, size: int) -> None:
        self.depth = max(1, int(size - 1).bit_length())
        self.levels: list[tuple[int, Bits, int]] = []
        for shift in range(self.depth - 1, -1, -1):
            bit = (symbols >> shift & 1).astype(bool)
            self.levels.append((shift, Bits(bit), int(len(bit) - bit.sum())))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])
        #: Where each symbol's places begin below the last level.
        self.start = self._down(np.arange(size), np.zeros(size, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for shift, bits, zeros in self.levels:
            ones = bits.rank(at)
            at = np.where(symbol >> shift & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self._down(symbol, at) - self.start[symbol]


class Minima:
    """Minimum of any range, and the nearest smaller value on either side, by doubling."""

    def __init__(self, values: np.ndarray) -> None:
        self.levels = [values]
        span = 1
        while 2 * span <= len(values):
            self.levels.append(np.minimum(self.levels[-1][:-span], self.levels[-1][span:]))
            span *= 2
        self.flat, self.offset = np.concatenate(self.levels), np.cumsum([0, *map(len, self.levels[:-1])])

    def range(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Minimum of [lo, hi), which is not empty."""
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        base = self.offset[level]
        return np.minimum(self.flat[base + lo], self.flat[base + hi - (1 << level)])

    def before(self, at: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The last place <= at whose value is below the bound; there is one."""
        at = at.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            lo = at - (1 << k) + 1
            go = np.flatnonzero(lo > 0)
            go = go[self.levels[k][lo[go]] >= bound[go]]
            at[go] -= 1 << k
        return at

    def after(self, at: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The first place >= at whose value is below the bound; there is one."""
        at, n = at.copy(), len(self.levels[0])
        for k in range(len(self.levels) - 1, -1, -1):
            go = np.flatnonzero(at + (1 << k) < n)
            go = go[self.levels[k][at[go]] >= bound[go]]
            at[go] += 1 << k
        return at


class Index:
    """FM-index of texts (arrays of symbols 1, 2, ...), each with an owner; matches are those in texts of a smaller owner."""

    def __init__(self, texts: list[np.ndarray], owner: np.ndarray) -> None:
        count, size = len(texts), np.array([len(t) for t in texts])
        self.symbols = 1 + max((int(t.max(initial=0)) for t in texts), default=0)
        self.end = np.cumsum(size + 1) - 1
        body = np.zeros(int(size.sum()) + count, np.int64)
        inside = np.ones(len(body), bool)
        inside[self.end] = False
        body[inside] = np.concatenate(texts)
        order, common = _sorted_suffixes(body, self.end, int(size.max(initial=0)))
        # What stands before each suffix; an end mark counts as symbol 0.
        bwt = body[order - 1]
        self.first = np.r_[0, np.cumsum(np.bincount(body, minlength=self.symbols))]
        self.wavelet = Wavelet(bwt, self.symbols)
        self.common = Minima(common)
        self.owner, rank = np.unique(owner, return_inverse=True)
        self.rank = rank
        of = np.repeat(np.arange(count), size + 1)
        self.least = Minima(rank[of[order]].astype(np.int32))
        self.body, self.size = body, size

    def statistics(self, need: int) -> "list[tuple[np.ndarray, np.ndarray, np.ndarray]]":
        """Matching statistics of all texts against those of smaller owners, from their ends backwards.

        Yields for each step: texts still on their way, the place in each, and how
        many words match from there. A text leaves once no stretch of ``need`` words
        from its first ``len - need + 1`` places can match any more.
        """
        n = len(self.body)
        text = np.arange(len(self.size))
        at = self.size.copy()
        lo, hi, m = np.zeros(len(text), np.int64), np.full(len(text), n), np.zeros(len(text), np.int64)
        begin = self.end - self.size
        while True:
            going = (at > 0) & ((at > need) | (at + m >= need))
            if not going.all():
                text, at, lo, hi, m = (a[going] for a in (text, at, lo, hi, m))
            if not len(text):
                return
            at = at - 1
            symbol, owner = self.body[begin[text] + at], self.rank[text]
            open_ = np.arange(len(text))
            while len(open_):
                s = np.tile(symbol[open_], 2)
                both = self.first[s] + self.wavelet.rank(s, np.concatenate([lo[open_], hi[open_]]))
                a, b = both[: len(open_)], both[len(open_) :]
                good = np.flatnonzero(a < b)
                good = good[self.least.range(a[good], b[good]) < owner[open_[good]]]
                done = open_[good]
                lo[done], hi[done] = a[good], b[good]
                m[done] += 1
                rest = np.ones(len(open_), bool)
                rest[good] = False
                open_ = open_[rest]
                open_ = open_[m[open_] > 0]
                if len(open_):  # a word less from the right: the parent interval
                    x, y = lo[open_], hi[open_]
                    depth = np.maximum(self.common.levels[0][x], self.common.levels[0][y])
                    flat = depth <= 0
                    bound = np.maximum(depth, 1)
                    lo[open_] = np.where(flat, 0, self.common.before(x, bound))
                    hi[open_] = np.where(flat, n, self.common.after(y, bound))
                    m[open_] = np.maximum(depth, 0)
            yield text, at, m


def _sorted_suffixes(body: np.ndarray, end: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, end marks in order of place, and how many symbols each shares with the one before (-1 at both edges)."""
    n = len(body)
    rank = body + len(end)
    rank[end] = np.arange(len(end))
    ranks, span = [], 1
    order = np.argsort(rank, kind="stable")
    while True:
        value = rank[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.r_[0, value[1:] != value[:-1]])
        ranks.append(rank.astype(np.int32))
        if span > longest or rank[order[-1]] == n - 1:
            break
        nxt = np.zeros(n, np.int64)
        nxt[: n - span] = rank[span:] + 1 if span < n else 0
        rank = rank * (n + 1) + nxt
        order = np.argsort(rank, kind="stable")
        span *= 2
    common = np.zeros(n + 1, np.int16)
    a, b = order[:-1].copy(), order[1:].copy()
    for k in range(len(ranks) - 1, -1, -1):
        ok = (a < n) & (b < n)
        same = np.zeros(len(a), bool)
        same[ok] = ranks[k][a[ok]] == ranks[k][b[ok]]
        # Ranks of a level say whether 2**k symbols agree; end marks never agree with anything.
        common[1:n][same] += 1 << k
        a[same] += 1 << k
        b[same] += 1 << k
    common[0] = common[n] = -1
    return order, common
