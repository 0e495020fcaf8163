"""Self-indexes over a shard of sequences, and matching statistics against them.

``FMIndex`` keeps the Burrows-Wheeler transform of the shard in a wavelet matrix of packed bits. ``RunIndex`` keeps it
as runs (head, length) with the suffix-array samples at run ends. Both answer ``step``: the backward-search step that
maps a border of the interval of a match to its border after one more symbol on the left.

Suffixes are ordered by their first ``depth`` symbols (prefix doubling). For matches of at most ``depth`` symbols this
gives the same intervals and counts as the full order.

``matching_statistics`` streams sequences from right to left, all of them in lockstep: for each position, the length
(up to ``cap``) of the longest match that starts there and occurs at least ``least`` times in the shard. A match that
can't be extended is shortened to its parent interval, which the LCP array gives.
"""

from __future__ import annotations

import numpy as np

SEPARATOR = 0  # between the sequences; sequences hold symbols from 1 on


def joined(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The shard's text (a separator behind each sequence) and the offset of each sequence."""
    sizes = np.array([len(s) for s in sequences], np.int64)
    begin = np.cumsum(sizes + 1) - sizes - 1
    text = np.zeros(int(sizes.sum()) + len(sequences), np.int64)
    for s, at in zip(sequences, begin, strict=True):
        text[at : at + len(s)] = s
    return text, begin


def _ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """Order of the keys, dense ranks, and whether all differ."""
    order = np.argsort(key)
    new = np.empty(len(key), np.int64)
    new[:1] = 0
    s = key[order]
    np.cumsum(s[1:] != s[:-1], out=new[1:])
    rank = np.empty(len(key), np.int64)
    rank[order] = new
    return order, rank, bool(len(key) == 0 or new[-1] == len(key) - 1)


class Suffixes:
    """Suffix order and LCP (up to depth) of a text."""

    def __init__(self, text: np.ndarray, depth: int) -> None:
        n = len(text)
        self.text, self.n = text, n
        bits = max(1, int(text.max(initial=0)).bit_length())
        pack = max(1, 62 // bits)
        pack = 1 << (min(pack, depth).bit_length() - 1)
        key = text.copy()
        h = 1
        while h < pack:  # first ranks straight from packed symbols
            nxt = np.zeros(n, np.int64)
            nxt[: n - h] = key[h:] if h < n else 0
            key = key << (bits * h) | nxt
            h *= 2
        order, rank, done = _ranked(key)
        levels = [(h, rank.astype(np.int32))]
        while h < depth and not done:
            nxt = np.zeros(n, np.int64)
            if h < n:
                nxt[: n - h] = rank[h:] + 1
            order, rank, done = _ranked(rank * (n + 1) + nxt)
            h *= 2
            levels.append((h, rank.astype(np.int32)))
        self.sa, self.depth = order, h
        self.lcp = self._lcp(levels, bits, pack, key)

    def _lcp(self, levels, bits: int, pack: int, key: np.ndarray) -> np.ndarray:
        """lcp[r]: common symbols of the suffixes at r - 1 and r, up to depth; -1 at both ends."""
        n = self.n
        a, b = self.sa[:-1].copy(), self.sa[1:].copy()
        got = np.zeros(max(0, n - 1), np.int64)
        for h, rank in reversed(levels):
            ok = (a < n) & (b < n)
            same = np.zeros(len(a), bool)
            same[ok] = rank[a[ok]] == rank[b[ok]]
            got += h * same
            a += h * same
            b += h * same
        h = pack // 2
        while h >= 1:  # below the first packed level, by the symbols themselves
            ok = (a + h <= n) & (b + h <= n)
            same = ok.copy()
            for j in range(h):
                same[ok] &= self.text[a[ok] + j] == self.text[b[ok] + j]
            got += h * same
            a += h * same
            b += h * same
            h //= 2
        return np.concatenate([[-1], got, [-1]]) if n else np.array([-1])

    def bwt(self) -> np.ndarray:
        return self.text[self.sa - 1] if self.n else self.text


class Parents:
    """Shortens matches: intervals of fixed depth, and parent intervals by descent over minima of the LCP array."""

    def __init__(self, lcp: np.ndarray, cap: int) -> None:
        lcp = lcp.astype(np.int16 if cap < 16_000 else np.int32)
        self.lcp = lcp
        n = len(lcp) - 1
        at = np.arange(n + 1)
        cut = lcp < cap - 1
        self.low = np.maximum.accumulate(np.where(cut, at, 0))  # of depth cap - 1
        self.high = np.minimum.accumulate(np.where(cut, at, n)[::-1])[::-1]
        self.minima = [lcp]
        span = 1
        while 2 * span <= n:
            last = self.minima[-1]
            self.minima.append(np.minimum(last[: len(last) - span], last[span:]))
            span *= 2

    def truncated(self, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of the first cap - 1 symbols of a match whose interval begins at lo."""
        return self.low[lo], self.high[lo + 1]

    def parent(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The smallest interval that holds [lo, hi) and is larger, and its match length."""
        depth = np.maximum(self.lcp[lo], self.lcp[hi])
        lo, hi = lo.copy(), hi.copy()
        for k in range(len(self.minima) - 1, -1, -1):
            m, span = self.minima[k], 1 << k
            at = lo - span + 1
            ok = at >= 0
            ok[ok] = m[at[ok]] >= depth[ok]
            lo -= span * ok
            ok = hi < len(m)
            ok[ok] = m[hi[ok]] >= depth[ok]
            hi += span * ok
        return lo, hi, np.maximum(depth, 0).astype(np.int64)


class FMIndex:
    """Wavelet matrix over the transform: one packed bit vector with block counts for each bit of a symbol."""

    def __init__(self, suffixes: Suffixes) -> None:
        seq = suffixes.bwt()
        self.n = len(seq)
        self.bits = max(1, int(seq.max(initial=0)).bit_length())
        self.words, self.before, self.zeros = [], [], []
        sigma = int(seq.max(initial=0)) + 1
        count = np.bincount(seq, minlength=sigma)
        self.first = np.cumsum(count) - count
        for b in range(self.bits - 1, -1, -1):
            bit = (seq >> b & 1).astype(np.uint8)
            padded = np.zeros((self.n // 64 + 1) * 64, np.uint8)
            padded[: self.n] = bit
            words = np.packbits(padded, bitorder="little").view("<u8")
            ones = np.bitwise_count(words).astype(np.int64)
            self.words.append(words)
            self.before.append(np.cumsum(ones) - ones)
            self.zeros.append(int(self.n - ones.sum()))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])
        self.base = self._down(np.arange(sigma), np.zeros(sigma, np.int64))

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, b in enumerate(range(self.bits - 1, -1, -1)):
            block, inside = i >> 6, (i & 63).astype(np.uint64)
            mask = (np.uint64(1) << inside) - np.uint64(1)
            ones = self.before[k][block] + np.bitwise_count(self.words[k][block] & mask)
            i = np.where(c >> b & 1, self.zeros[k] + ones, i - ones)
        return i

    def step(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self.first[c] + self._down(c, i) - self.base[c]


class RunIndex:
    """Run-length transform: heads, starts, for each symbol its runs with the lengths before them, samples at run ends."""

    def __init__(self, suffixes: Suffixes) -> None:
        seq = suffixes.bwt()
        self.n = len(seq)
        begin = np.flatnonzero(np.concatenate([[True], seq[1:] != seq[:-1]])) if self.n else np.zeros(0, np.int64)
        self.start = begin
        self.head = seq[begin]
        ends = np.concatenate([begin[1:], [self.n]]).astype(np.int64) if self.n else begin
        self.sample_first, self.sample_last = suffixes.sa[begin], suffixes.sa[ends - 1]
        sigma = int(seq.max(initial=0)) + 1
        length = ends - begin
        count = np.bincount(self.head, length, sigma).astype(np.int64) if self.n else np.zeros(sigma, np.int64)
        self.first = np.cumsum(count) - count
        order = np.argsort(self.head, kind="stable")
        self.place = self.head[order] * (len(begin) + 1) + order  # sorted: by symbol, then by run
        self.summed = np.concatenate([[0], np.cumsum(length[order])])

    def step(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        run = np.searchsorted(self.start, i, side="right") - 1
        inside = np.where(self.head[run] == c, i - self.start[run], 0)
        k = np.searchsorted(self.place, c * (len(self.start) + 1) + run)
        # lengths of the runs of smaller symbols are counted in summed as well as in first, so summed alone is the rank
        return self.summed[k] + inside


def matching_statistics(index: FMIndex | RunIndex, parents: Parents, sequences: list[np.ndarray], cap: int, least: int = 2) -> list[np.ndarray]:
    """For each position of each sequence, the longest match (up to cap) that starts there and occurs least times."""
    n = index.n
    sizes = np.array([len(s) for s in sequences], np.int64)
    out = [np.zeros(k, np.int32) for k in sizes]
    if not len(sizes) or not n:
        return out
    order = np.argsort(-sizes, kind="stable")
    left = sizes[order]
    flat = np.concatenate(sequences) if len(sequences) else np.zeros(0, np.int64)
    result = np.zeros(len(flat), np.int32)
    end = np.cumsum(sizes)[order]
    lo, hi, length = np.zeros(len(order), np.int64), np.full(len(order), n), np.zeros(len(order), np.int64)
    for t in range(1, int(left[0]) + 1):
        m = int(np.searchsorted(-left, -t, side="right"))
        c = flat[end[:m] - t]
        full = np.flatnonzero(length[:m] == cap)
        if len(full):
            lo[full], hi[full] = parents.truncated(lo[full])
            length[full] = cap - 1
        todo = np.arange(m)
        while len(todo):
            both = index.step(np.concatenate([c[todo], c[todo]]), np.concatenate([lo[todo], hi[todo]]))
            a, b = both[: len(todo)], both[len(todo) :]
            ok = b - a >= least
            good = todo[ok]
            lo[good], hi[good] = a[ok], b[ok]
            length[good] += 1
            todo = todo[~ok]
            todo = todo[length[todo] > 0]  # a single symbol that is too rare stays at length 0
            if len(todo):
                lo[todo], hi[todo], length[todo] = parents.parent(lo[todo], hi[todo])
        result[end[:m] - t] = length[:m]
    begin = np.cumsum(sizes) - sizes
    return [result[x : x + k] for x, k in zip(begin, sizes, strict=True)]
