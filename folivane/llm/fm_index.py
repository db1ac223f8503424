"""A word-level FM-index in numpy: suffix array, BWT in a wavelet matrix, sampled positions."""

from __future__ import annotations

import numpy as np


class FMIndex:
    """Index of ``text``, an array of symbols below ``sigma``; symbol 0 separates and is in no pattern."""

    def __init__(self, text: np.ndarray, sigma: int, sample: int = 8):
        text = np.append(np.asarray(text, "i8") + 1, 0)  # the end is a symbol of its own, below all others
        order = self._suffixes(text)
        marked = order % sample == 0
        self._build(text[order - 1], sigma + 1, marked, order[marked])

    @classmethod
    def load(cls, kept: bytes) -> "FMIndex":
        """The index that ``dump`` gave; nothing is sorted again."""
        sigma, n = np.frombuffer(kept, "i8", 2)
        bwt = np.frombuffer(kept, "i4", n, 16)
        marked = np.unpackbits(np.frombuffer(kept, "u1", -(-n // 8), 16 + 4 * n), count=n).astype(bool)
        made = cls.__new__(cls)
        made._build(bwt.astype("i8"), int(sigma), marked, np.frombuffer(kept, "i4", int(marked.sum()), 16 + 4 * n + -(-n // 8)).astype("i8"))
        return made

    def dump(self) -> bytes:
        """What ``load`` needs: the transformed text and the sampled positions, about five bytes a symbol."""
        return b"".join(x.tobytes() for x in (np.array([len(self.first) - 1, self.n], "i8"), self.bwt.astype("i4"), np.packbits(self.marked), self.kept.astype("i4")))

    def _build(self, bwt: np.ndarray, sigma: int, marked: np.ndarray, kept: np.ndarray) -> None:
        self.n, self.bwt, self.marked, self.kept = len(bwt), bwt, marked, kept
        self.first = np.concatenate([[0], np.cumsum(np.bincount(bwt, minlength=sigma))])
        self.bits = max(1, int(sigma - 1).bit_length())
        self.ranks, self.zeros, level = [], [], bwt
        for b in range(self.bits - 1, -1, -1):
            bit = (level >> b) & 1
            self.ranks.append(np.concatenate([[0], np.cumsum(bit)]).astype("i4"))
            self.zeros.append(int(self.n - self.ranks[-1][-1]))
            level = np.concatenate([level[bit == 0], level[bit == 1]])
        self.marks = np.concatenate([[0], np.cumsum(marked)]).astype("i4")

    @staticmethod
    def _suffixes(text: np.ndarray) -> np.ndarray:
        """Prefix doubling; a suffix's rank is the number of smaller ones, and only suffixes whose rank another has
        too are sorted again, by the rank of what follows them."""
        n, h = len(text), 1
        order = np.argsort(text, kind="stable")
        rank = np.empty(n, "i8")
        first = np.flatnonzero(np.append(True, text[order][1:] != text[order][:-1]))
        rank[order] = np.repeat(first, np.diff(np.append(first, n)))
        active = np.arange(n)
        while True:
            base = rank[active]
            after = active + h
            key = base << 32 | np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
            by = np.argsort(key)
            active, key, base = active[by], key[by], base[by]
            new = np.append(True, key[1:] != key[:-1])
            group = np.append(True, base[1:] != base[:-1])
            place = np.arange(len(active))
            # The rank grows by the members of the old group that come before the new one.
            rank[active] = base + np.maximum.accumulate(np.where(new, place, 0)) - np.maximum.accumulate(np.where(group, place, 0))
            single = new & np.append(new[1:], True)
            active, h = active[~single], 2 * h
            if not len(active):
                order[rank] = np.arange(n)
                return order

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the BWT before each place, through the wavelet matrix."""
        start = np.zeros_like(upto)
        end = upto
        for k in range(self.bits):
            ones, zeros = self.ranks[k], self.zeros[k]
            bit = (symbol >> (self.bits - 1 - k)) & 1
            s1, e1 = ones[start], ones[end]
            start = np.where(bit, zeros + s1, start - s1)
            end = np.where(bit, zeros + e1, end - e1)
        return end - start

    def _access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The BWT's symbol at each place and its rank there."""
        symbol, start, here = np.zeros_like(at), np.zeros_like(at), at
        for k in range(self.bits):
            ones, zeros = self.ranks[k], self.zeros[k]
            bit = ones[here + 1] - ones[here]
            symbol = symbol << 1 | bit
            s1, h1 = ones[start], ones[here]
            start = np.where(bit, zeros + s1, start - s1)
            here = np.where(bit, zeros + h1, here - h1)
        return symbol, here - start

    def ranges(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the suffixes that begin with each pattern. ``patterns`` is padded on its left."""
        low, high = np.zeros(len(patterns), "i8"), np.full(len(patterns), self.n, "i8")
        width = patterns.shape[1]
        for k in range(width - 1, -1, -1):
            on = np.flatnonzero((lengths >= width - k) & (low < high))
            if not len(on):
                continue
            c = patterns[on, k] + 1
            low[on] = self.first[c] + self.rank(c, low[on])
            high[on] = self.first[c] + self.rank(c, high[on])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions in the text: steps back through the text until a sampled position."""
        at, steps, out = rows.astype("i8").copy(), np.zeros(len(rows), "i8"), np.full(len(rows), -1, "i8")
        left = np.arange(len(rows))
        while len(left):
            hit = self.marked[at[left]]
            done = left[hit]
            out[done] = self.kept[self.marks[at[done]]] + steps[done]
            left = left[~hit]
            symbol, before = self._access(at[left])
            at[left] = self.first[symbol] + before
            steps[left] += 1
        return out
