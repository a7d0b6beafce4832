"""What several operators share: word hashes, stored tables and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ecocline.sources.storage import materialise

# ASCII white space: blank and 0x09 to 0x0D, the characters at which bytes.split() cuts.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SEGMENT = 1 << 20
_U = np.uint64


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=_U)
    out[0] = 1
    return np.multiply.accumulate(out)


class WordHasher:
    """64-bit hashes of the words of texts, many words to one numpy call.

    A word's hash is a polynomial over random values of its bytes, taken as a difference of prefix
    sums and shifted to position 0, so that the same word has the same hash wherever it stands.
    """

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        base = 0x9E3779B97F4A7C15
        self.values = rng.integers(0, 1 << 64, 256, dtype=_U) | _U(1)
        self.up = _powers(base, _SEGMENT + 1)
        self.down = _powers(pow(base, -1, 1 << 64), _SEGMENT + 1)

    def _segment(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        inside = np.zeros(len(raw) + 2, dtype=np.int8)
        inside[1:-1] = ~_SPACE[raw]
        edge = np.diff(inside)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        sums = np.zeros(len(raw) + 1, dtype=_U)
        np.cumsum(self.values[raw] * self.up[: len(raw)], out=sums[1:])
        return starts, mix((sums[ends] - sums[starts]) * self.down[starts])

    def text(self, text: str) -> np.ndarray:
        """Hashes of the words of one text, A-Z lower-cased, in order; any length."""
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), dtype=np.uint8)
        if len(raw) <= _SEGMENT:
            return self._segment(raw)[1]
        parts, at = [], 0
        while at < len(raw):
            end = min(at + _SEGMENT, len(raw))
            if end < len(raw):
                spaces = np.flatnonzero(_SPACE[raw[at:end]])
                if len(spaces):
                    end = at + int(spaces[-1]) + 1
                else:  # one word longer than a segment: take it whole, hashed by its bytes
                    after = np.flatnonzero(_SPACE[raw[end:]])
                    end = end + int(after[0]) if len(after) else len(raw)
                    parts.append(mix(np.array([_long_word(raw[at:end])], dtype=_U)))
                    at = end
                    continue
            parts.append(self._segment(raw[at:end])[1])
            at = end
        return np.concatenate(parts)

    def texts(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Word hashes text by text; short texts are hashed together."""
        held: list[bytes] = []
        size = 0
        for text in texts:
            raw = (text or "").encode("utf-8", "surrogatepass").lower()
            if size + len(raw) + 1 > _SEGMENT // 4 and held:
                yield from self._joined(held)
                held, size = [], 0
            if len(raw) + 1 > _SEGMENT // 4:
                yield self.text(text)
            else:
                held.append(raw)
                size += len(raw) + 1
        yield from self._joined(held)

    def _joined(self, held: list[bytes]) -> Iterator[np.ndarray]:
        if not held:
            return
        starts, hashes = self._segment(np.frombuffer(b"\n".join(held), dtype=np.uint8))
        ends = np.cumsum([len(x) + 1 for x in held])
        at = 0
        for stop in np.searchsorted(starts, ends):
            yield hashes[at:stop]
            at = stop


def _long_word(raw: np.ndarray) -> int:
    import hashlib

    return int.from_bytes(hashlib.blake2b(raw.tobytes(), digest_size=8).digest(), "little")


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (a multiply and shift finaliser)."""
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(29))) * _U(0xA0761D6478BD642F)
    return x ^ (x >> _U(32))


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words; a shorter text is one run."""
    if not len(words):
        return words
    size = min(size, len(words))
    runs = np.zeros(len(words) - size + 1, dtype=_U)
    for k in range(size):
        runs = mix(runs * _U(0x9FB21C651E98DF25) + words[k : k + len(runs)] + _U(k + 1))
    return np.unique(runs)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Smallest node reachable over ``edges`` (a, b), for every node that has an edge.

    Large-star and small-star steps in turn: every round is grouped minima and joins, so a hub's
    links are reduced where they lie and nothing is gathered on the driver. Each round is written
    to the shared folder. Returns node, component.
    """
    stars = edges.filter("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    stars = materialise(stars.distinct(), name)
    before = None
    while True:
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or now[0] == 0:
            break
        before = now
        # large star: every greater neighbour is linked to the least node of the neighbourhood
        around = stars.union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = around.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = (
            stars.join(least.withColumnRenamed("a", "b"), "b").select("a", F.col("m").alias("b"))
            .filter("a <> b").distinct()
        )
        # small star: a node and its lesser neighbours are linked to the least of them
        large = materialise(large, name)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        stars = materialise(
            small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(least.select("a", F.col("m").alias("b"))).distinct(),
            name,
        )
    roots = stars.groupBy("a").agg(F.min("b").alias("component"))
    named = roots.select(F.col("a").alias("node"), "component")
    return named.union(stars.select("b", "b").distinct())
