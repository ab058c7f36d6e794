"""Words and word shingles of whole texts as 64-bit numbers, for many texts at once in numpy.

A word is a run of ASCII letters and digits and of non-ASCII characters, lower-cased. Its number
comes from differences of one running sum over the bytes, so that no word is ever cut out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are hashed at a time.
BLOCK = 1 << 18
_rng = np.random.Generator(np.random.PCG64(20_240_611))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Powers:
    """Powers of the base and of its inverse, as many as the longest block so far needs: a worker keeps them."""

    def __init__(self):
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = (n + 0xFFFF) // 0x10000 * 0x10000
            for name, factor in (("up", _BASE), ("down", _INVERSE)):
                steps = np.full(size, factor, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self.up[:n], self.down[:n]


_powers = Powers()


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of all words of all texts one after the other, where each text begins and the last
    one ends). Null has no words."""
    lower = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    offsets = np.frombuffer(lower.buffers()[1], np.int64, len(lower) + 1, lower.offset * 8)
    out, counts = [], np.zeros(len(lower) + 1, np.int64)
    data = np.frombuffer(lower.buffers()[2], np.uint8) if lower.buffers()[2] is not None else np.empty(0, np.uint8)
    i = 0
    while i < len(lower):  # blocks of BLOCK bytes or so, a long text alone
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + BLOCK, side="right")) - 1)
        block, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        inside = _WORD[block]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        cuts = at[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(block))]
        first[cuts] |= inside[cuts]  # a text's end ends a word
        last[cuts - 1] |= inside[cuts - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        up, down = _powers.to(len(block) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[block] * up[: len(block)], dtype=np.uint64)])
        out.append(mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)))
        counts[i + 1 : j + 1] = np.diff(np.searchsorted(starts, at))
        i = j
    return np.concatenate(out) if out else np.empty(0, np.uint64), np.cumsum(counts)


def shingle_hashes(words: np.ndarray, at: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of all runs of ``n`` words, where each text begins and the last one ends). A text of
    fewer words, but not none, is one run."""
    size = np.diff(at)
    runs = np.where(size >= n, size - n + 1, np.minimum(size, 1))
    new = np.concatenate([[0], np.cumsum(runs)])
    place = np.repeat(at[:-1] - new[:-1], runs) + np.arange(new[-1])
    end = np.repeat(at[1:], runs)
    h = np.zeros(len(place), np.uint64)
    for k in range(n):
        p = place + k
        ok = p < end
        part = np.zeros(len(place), np.uint64)
        part[ok] = words[p[ok]]
        h = mixed(h * np.uint64(_BASE) + part + np.uint64(k + 1))
    return h, new


def multiset(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct numbers, how often each occurs, where each text begins and the last one ends)."""
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.concatenate([first, [len(h)]]))
    return h[first], count, np.searchsorted(text[first], np.arange(len(at)))
