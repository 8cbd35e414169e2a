"""Word boundaries and word hashes of many texts at once, in numpy."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_RNG = np.random.default_rng(20_240_817)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE[SPACE] = 0
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Texts are handled together until they hold so many bytes.
GROUP_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def unmix(x: np.ndarray) -> np.ndarray:
    """What ``mix`` made ``x`` of."""
    x = (x ^ (x >> np.uint64(31)) ^ (x >> np.uint64(62))) * np.uint64(0x319642B2D24D8EC3)
    x = (x ^ (x >> np.uint64(27)) ^ (x >> np.uint64(54))) * np.uint64(0x96DE1B173F119089)
    return x ^ (x >> np.uint64(30)) ^ (x >> np.uint64(60))


class Tokens(NamedTuple):
    data: np.ndarray  # the bytes of all texts, one space after each
    starts: np.ndarray  # first byte of each word
    ends: np.ndarray  # byte after each word
    hashes: np.ndarray  # of each word
    first: np.ndarray  # first word of each text, and the number of words at the end
    offsets: np.ndarray  # first byte of each text, and the number of bytes at the end


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """Powers of ``_STEP`` and of its inverse, ``n`` at least; those for a usual group of texts are kept."""
    if _POWERS and len(_POWERS[0]) >= n:
        return _POWERS
    size = max(n, 2 * GROUP_BYTES)
    steps = _STEP, np.uint64(pow(int(_STEP), -1, 1 << 64))
    made = [np.cumprod(np.r_[np.uint64(1), np.full(size - 1, x, np.uint64)]) for x in steps]
    if size == 2 * GROUP_BYTES:
        _POWERS[:] = made
    return made


def tokenise(texts: list[bytes], lower: bool = True) -> Tokens:
    data = np.frombuffer(b" ".join([*texts, b""]) or b" ", np.uint8)
    if lower:
        data = LOWER[data]
    offsets = np.r_[0, np.cumsum([len(t) + 1 for t in texts])].astype(np.int64) if texts else np.zeros(1, np.int64)
    word = ~SPACE[data]
    edges = np.flatnonzero(word[1:] != word[:-1]) + 1
    if word[0]:
        edges = np.r_[0, edges]
    starts, ends = edges[::2].copy(), edges[1::2].copy()  # the last byte is a space
    first = np.searchsorted(starts, offsets)
    if not len(starts):
        return Tokens(data, starts, ends, np.empty(0, np.uint64), first, offsets)
    # a word's sum of byte * step^place, counted from its start: a difference of running sums, divided by a power
    up, down = _powers(len(data))
    sums = _BYTE[data]
    sums *= up[: len(data)]
    np.cumsum(sums, out=sums)
    before = np.where(starts > 0, sums[starts - 1], np.uint64(0))
    hashes = (sums[ends - 1] - before) * down[starts]
    return Tokens(data, starts, ends, mix(hashes + (ends - starts).astype(np.uint64)), first, offsets)


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` words from each position on; the last positions reach over the end and wrap nowhere."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out * _STEP + hashes[k : k + n]
    return mix(out)


def grouped(rows: Iterable[tuple], text_at: int, limit: int = GROUP_BYTES) -> Iterator[list[tuple]]:
    """Rows in lists that hold about ``limit`` bytes of text; a longer text is alone in its list."""
    held, size = [], 0
    for row in rows:
        n = len(row[text_at] or b"")
        if held and size + n > limit:
            yield held
            held, size = [], 0
        held.append(row)
        size += n
    if held:
        yield held
