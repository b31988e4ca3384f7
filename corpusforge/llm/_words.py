"""Vectorised words and 64-bit word hashes over the UTF-8 bytes of many texts."""

from __future__ import annotations

import hashlib

import numpy as np

#: The words of the copy operators end at space and the ASCII controls 9 to 13.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: The words of benchmark and toxicity text are ASCII letters and digits and all non-ASCII bytes.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
SAME = np.arange(256, dtype=np.uint8)

#: Words of more bytes are hashed one by one.
_LONG = 256
#: For each of the independent hashes a start and an odd factor.
_SEEDS = ((0x9E3779B97F4A7C15, 0xD1342543DE82EF95), (0xA0761D6478BD642F, 0xE7037ED1A0B428DB))
_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spans(data: np.ndarray, at: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, word offsets by text) of all words; a word never crosses texts."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(at), np.int64)
    inside = ~sep[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    edges = at[(at > 0) & (at < n)]
    begin[edges] = inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, at)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray = SAME, most: int = 0, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each word (of its first ``most`` bytes if that is set).

    The bytes go in by eights, with a non-linear mix after each, so words of at most eight bytes and
    one length never collide and no words are known to. ``which`` chooses one of two hashes that
    share no constants; words of more than 256 bytes are hashed by BLAKE2."""
    seed, factor = _SEEDS[which]
    size = np.minimum(ends - starts, most) if most else ends - starts
    out = mix(size.astype(np.uint64) + np.uint64(seed))
    if not len(starts):
        return out
    folded = np.zeros(len(data) + 8, np.uint8)
    np.take(fold, data, out=folded[: len(data)])
    eights = np.ndarray((len(data) + 1,), "<u8", folded, strides=(1,))
    live, done = np.flatnonzero(size <= _LONG), 0
    while len(live):
        block = eights[starts[live] + done] & _BYTES[np.minimum(size[live] - done, 8)]
        out[live] = mix((out[live] ^ block) * np.uint64(factor))
        done += 8
        live = live[size[live] > done]
    for i in np.flatnonzero(size > _LONG).tolist():
        word = folded[starts[i] : starts[i] + size[i]]
        out[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8, key=seed.to_bytes(8, "little")).digest(), "little")
    return out


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One hash of two, in order; not linear in either, so sequences have no algebra to collide by."""
    x = (a ^ (a >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    x += b
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all ``k`` consecutive items of ``h`` (over text borders too), joined by doubling."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, at, level, size = None, 0, h, 1
    while True:
        if k & size:
            part = level[at : at + n]
            out = part if out is None else _join(out, part)
            at += size
        if 2 * size > k:
            return mix(out + np.uint64(k))
        level = _join(level[:-size], level[size:])
        size *= 2


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` consecutive items, by doubling."""
    out, have = x, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out
