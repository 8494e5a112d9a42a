"""64-bit hashes of the words of many texts at once, in numpy.

A word's hash is the sum of a random value for each of its bytes times a power of an odd number that
depends on the place in the word, modulo 2**64; running sums over a buffer of texts give all of them.
"""

from __future__ import annotations

import numpy as np

_RANDOM = np.random.default_rng(20240607)
_BYTE_VALUES = _RANDOM.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
#: Bytes between words: space and 0x09-0x0D.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes between words when words are runs of ASCII letters, digits and all bytes beyond ASCII.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])

_powers = np.empty(0, np.uint64), np.empty(0, np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        up, down = np.full(n, _BASE, np.uint64), np.full(n, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        _powers = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit over the result."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD1B54A32D192ED03)
    return x ^ (x >> np.uint64(32))


def word_hashes(texts: list[str | None], separators: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, A-Z lower-cased, and where each text's words begin (one entry more than texts)."""
    hashes, begins = prefix_hashes(texts, separators, ())
    return hashes[0], begins


def prefix_hashes(texts: list[str | None], separators: np.ndarray, lengths: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Like ``word_hashes``, with a row of hashes of whole words and one of their first bytes for each length. Different rows never share hashes by design."""
    parts = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    ends_of_texts = np.cumsum([len(p) + 1 for p in parts]) if parts else np.empty(0, np.int64)
    data = np.frombuffer((b" ".join(parts) + b" ").lower(), np.uint8)
    gap = separators[data]
    change = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if not gap[0]:
        change = np.concatenate(([0], change))
    starts, ends = change[0::2], change[1::2]
    up, down = _power_tables(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * up[: len(data)], out=sums[1:])
    shift = down[starts]
    rows = [mixed((sums[ends] - sums[starts]) * shift)]
    rows += [mixed((sums[np.minimum(starts + n, ends)] - sums[starts]) * shift + np.uint64(n)) for n in lengths]
    return np.stack(rows), np.concatenate(([0], np.searchsorted(starts, ends_of_texts)))
