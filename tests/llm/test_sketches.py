"""The sketches of the Jaccard join never tell two sets further apart than they are."""

from __future__ import annotations

import numpy as np
import pytest

from ecocline.llm.jaccard import differing, sketch_of


@pytest.mark.parametrize("size", [1, 40, 256, 257, 700, 5000])
@pytest.mark.parametrize("share", [0.0, 0.5, 0.9, 1.0])
def test_distance_is_a_lower_bound_at_any_two_lengths(size, share):
    rng = np.random.default_rng(size)
    pool = np.unique(rng.integers(0, 1 << 63, 4 * size + 8, dtype=np.uint64))
    rng.shuffle(pool)
    common = int(size * share)
    for other in (size, int(size * 1.25) + 1, 2 * size + 3):
        left = np.sort(pool[:size])
        right = np.sort(np.concatenate([pool[:common], pool[size : size + max(other - common, 0)]]))
        apart = len(np.setxor1d(left, right))
        found = differing(sketch_of(left), sketch_of(right))
        assert found <= apart and found == differing(sketch_of(right), sketch_of(left))
        assert (apart - found) % 2 == 0
    assert differing(sketch_of(left), sketch_of(left)) == 0


def test_long_sets_that_share_nothing_are_told_apart():
    pool = np.random.default_rng(1).integers(0, 1 << 63, 40_000, dtype=np.uint64)
    left, right = sketch_of(np.unique(pool[:20_000])), sketch_of(np.unique(pool[20_000:]))
    assert 180 * differing(left, right) > 20 * 40_000
    # the first 32 bytes are the fold of the long sketch
    bits = np.unpackbits(np.frombuffer(left[32:], dtype=np.uint8), bitorder="little")
    short = np.packbits((bits.reshape(-1, 256).sum(axis=0) & 1).astype(np.uint8), bitorder="little")
    assert short.tobytes() == left[:32]
