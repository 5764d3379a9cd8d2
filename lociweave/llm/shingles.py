"""Word and word-sequence hashes of whole texts, vectorised over blocks of documents.

A word's hash is a polynomial over a table of random 64-bit values of its bytes, mixed; the hash of a
sequence is a polynomial over its words' hashes, built by doubling, mixed. Words are runs of anything
but the six ASCII white-space characters, which UTF-8 never holds inside another character.
"""

from __future__ import annotations

import numpy as np

SPACES = np.zeros(256, dtype=bool)
SPACES[[32, *range(9, 14)]] = True
#: Byte -> random value; white space counts nothing.
EXACT = np.random.default_rng(20250101).integers(1, 1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
EXACT[SPACES] = 0
#: The same with A-Z as a-z.
LOWER = EXACT.copy()
LOWER[ord("A") : ord("Z") + 1] = EXACT[ord("a") : ord("z") + 1]
BASE = np.uint64(0x9E3779B97F4A7C15)
NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)
_powers = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        p = np.full(max(n, 1024), BASE, dtype=np.uint64)
        p[0] = 1
        _powers = np.cumprod(p, dtype=np.uint64)
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit over all 64 (in place)."""
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def word_hashes(texts: list[bytes], table: np.ndarray = EXACT) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, bounds): the words of text i are hashes[bounds[i]:bounds[i + 1]]."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    ends = np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1)
    space = SPACES[buf]
    first = np.empty(len(buf), dtype=bool)
    first[0] = not space[0]
    np.logical_and(space[:-1], ~space[1:], out=first[1:])
    starts = np.flatnonzero(first)
    bounds = np.concatenate([[0], np.searchsorted(starts, ends)])
    if not len(starts):
        return np.empty(0, dtype=np.uint64), bounds
    s0 = starts[0]
    sizes = np.diff(np.append(starts, len(buf)))
    place = np.arange(len(buf) - s0) - np.repeat(starts - s0, sizes)
    values = table[buf[s0:]]
    values *= powers(int(sizes.max()))[place]
    return mix(np.add.reduceat(values, starts - s0)), bounds


def sequences(h: np.ndarray, length: int, base: np.uint64 = BASE) -> np.ndarray:
    """Unmixed hashes of ``length`` consecutive words, from every word on (the last ones are not whole)."""
    out, have, part, size = None, 0, h.copy(), 1
    step = int(base)
    rest = length
    while rest:
        if rest & 1:
            if out is None:
                out = part.copy()
            else:
                out[: len(out) - have] += np.uint64(pow(int(base), have, 1 << 64)) * part[have:]
            have += size
        rest >>= 1
        if rest:
            nxt = part.copy()
            nxt[: len(part) - size] += np.uint64(step) * part[size:]
            part, size, step = nxt, 2 * size, step * step % (1 << 64)
    return out


def room(bounds: np.ndarray, n: int) -> np.ndarray:
    """Of every word, how many words its text has from it on."""
    sizes = np.diff(bounds)
    return np.repeat(bounds[1:], sizes) - np.arange(n)


def sliding(values: np.ndarray, length: int, least: bool = True, back: bool = False) -> np.ndarray:
    """Minimum (or maximum) over ``length`` values from each place on, or up to it."""
    f = np.minimum if least else np.maximum
    out, size = values.copy(), 1
    while size < length:
        step = min(size, length - size)
        nxt = out.copy()
        if len(out) > step:
            if back:
                f(out[step:], out[:-step], out=nxt[step:])
            else:
                f(out[:-step], out[step:], out=nxt[:-step])
        out, size = nxt, size + step
    return out
