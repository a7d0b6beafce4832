"""Exact word numbers for batches of texts: equal words, and only those, have equal numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd

_WORDS = 1 << 19  # words handled at once; a longer text is a batch of its own


def batches(texts: list[bytes]) -> Iterator[tuple[int, list[list[bytes]]]]:
    """Words, cut at blanks and 0x09 to 0x0D, of runs of texts; the first text's place with each run."""
    held: list[list[bytes]] = []
    at = size = 0
    for i, text in enumerate(texts):
        words = text.split()
        if held and size + len(words) > _WORDS:
            yield at, held
            held, at, size = [], i, 0
        held.append(words)
        size += len(words)
    if held:
        yield at, held


def numbered(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all words in a row, and where each text starts in it (one more entry at the end)."""
    starts = np.zeros(len(words) + 1, dtype=np.int64)
    np.cumsum([len(w) for w in words], out=starts[1:])
    flat = np.empty(int(starts[-1]), dtype=object)
    for w, a, b in zip(words, starts[:-1], starts[1:]):
        flat[a:b] = w
    return pd.factorize(flat)[0].astype(np.int64), starts


def named(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """One number for each different pair of numbers below 2**31."""
    return pd.factorize(first << 32 | second)[0].astype(np.int64)
