"""Word shingles as sorted arrays of 64-bit hashes.

Words are maximal runs of bytes other than space and 0x09-0x0D; A-Z is lower-cased. A text's set holds
its distinct runs of ``width`` words; a text with fewer words has one shingle, all its words; a null text
or one without words has none. Two shingles are taken as equal if their 64-bit hashes are.
"""

from __future__ import annotations

import numpy as np

from cadentia.llm.words import mixed, word_hashes

_STEP = np.uint64(0xA0761D6478BD642F)


def _rolled(hashes: np.ndarray, width: int) -> np.ndarray:
    count = max(len(hashes) - width + 1, 0)
    out = np.full(count, width, np.uint64)
    for k in range(width):
        out = out * _STEP + hashes[k : k + count]
        out ^= out >> np.uint64(31)
    return mixed(out)


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """For each text its distinct shingle hashes, ascending, as uint64."""
    hashes, begins = word_hashes(texts)
    rolled = _rolled(hashes, width)
    out = []
    for lo, hi in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
        own = rolled[lo : hi - width + 1].copy() if hi - lo >= width else _rolled(hashes[lo:hi], hi - lo) if hi > lo else rolled[:0].copy()
        own.sort()
        out.append(own[np.concatenate(([True], own[1:] != own[:-1]))] if len(own) > 1 else own)
    return out
