"""Packing documents into sequences by minimum bin slack (operator 3).

A document's tokens fill whole windows of ``capacity`` first; what remains is shorter than a window.
Only the number of remainders of each length matters for packing them: a table of at most
capacity - 1 counts. For the longest length left, a subset-sum dynamic program over a bitset finds
the multiset of other lengths that fills the window closest to capacity, and backtracking gives how
often each is taken; the pattern is repeated while the counts last. Documents may be cut, so a length
that no multiset completes exactly goes to a stream that is cut at every window, and the stream's
end falls into sequences of powers of two, which need no padding. No padding is left at all.

A remainder finds its place by its rank among those of its length: a counter inside the partition
that tokenised it, and the partitions' sums. The plan that maps ranks to places is bounded by
capacity, not by the data.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ecocline.llm.tokens import Encoder
from ecocline.sources.storage import materialise

Pattern = tuple[dict[int, int], int]  # how often each length is taken, and how often the pattern


def encoded(path: str, texts: list[str | None], end: int) -> Iterator[np.ndarray]:
    """Token ids of whole texts, each ended by ``end``."""
    last = np.array([end], dtype="<u4")
    for ids in Encoder(path)(texts):
        yield np.concatenate([ids.astype("<u4"), last])


def fill(counts: dict[int, int], seed: int, capacity: int) -> dict[int, int]:
    """The lengths, ``seed`` among them, whose sum is nearest to capacity, and how many of each."""
    room = capacity - seed
    left = dict(counts)
    left[seed] -= 1
    steps: list[tuple[int, int, int]] = []  # length, how many there are, sums reached before it
    reach = 1
    mask = (1 << (room + 1)) - 1
    for length in sorted((n for n, c in left.items() if c and n <= room), reverse=True):
        if reach >> room & 1:
            break
        steps.append((length, left[length], reach))
        many, part = left[length], 1
        while many:  # 1, 2, 4, ... copies and the rest reach every number of copies
            take = min(part, many)
            reach |= (reach << (take * length)) & mask
            many -= take
            part *= 2
    best = reach.bit_length() - 1
    taken = {seed: 1}
    for length, many, before in reversed(steps):
        k = next(k for k in range(many + 1) if best - k * length >= 0 and before >> (best - k * length) & 1)
        if k:
            taken[length] = taken.get(length, 0) + k
            best -= k * length
    return taken


def plan(counts: dict[int, int], capacity: int) -> tuple[list[Pattern], dict[int, int]]:
    """(patterns that fill a window exactly, what is left of each length)."""
    counts = {n: c for n, c in counts.items() if c > 0}
    patterns: list[Pattern] = []
    rest: dict[int, int] = {}
    while counts:
        seed = max(counts)
        taken = fill(counts, seed, capacity)
        if sum(n * k for n, k in taken.items()) < capacity:
            rest[seed] = counts.pop(seed)  # no exact window with it: to the stream
            continue
        times = min(counts[n] // k for n, k in taken.items())
        patterns.append((taken, times))
        for n, k in taken.items():
            counts[n] -= k * times
            if not counts[n]:
                del counts[n]
    return patterns, rest


class Places:
    """Where the remainder of a length and rank goes: [(piece length, sequence, offset), ...]."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        patterns, rest = plan(counts, capacity)
        spans: dict[int, list[tuple[int, int, int, int]]] = {}
        used: dict[int, int] = {}
        sequence = 0
        for taken, times in patterns:
            offset = 0
            for n, k in taken.items():
                spans.setdefault(n, []).append((used.get(n, 0), k, sequence, offset))
                used[n] = used.get(n, 0) + k * times
                offset += n * k
            sequence += times
        self.spans = {n: np.array(s, dtype=np.int64) for n, s in spans.items()}
        self.used = used
        self.stream_sequence = sequence
        self.stream_at: dict[int, int] = {}
        at = 0
        for n, c in rest.items():
            self.stream_at[n] = at
            at += n * c
        whole = at // capacity
        self.whole = whole * capacity
        # the stream's last tokens, in sequences of powers of two
        self.ends, last = [], self.whole
        for bit in reversed(range(capacity.bit_length())):
            if (at - self.whole) >> bit & 1:
                last += 1 << bit
                self.ends.append(last)
        self.sequences = sequence + whole + len(self.ends)

    def __call__(self, length: int, rank: int) -> list[tuple[int, int, int]]:
        if rank < self.used.get(length, 0):
            spans = self.spans[length]
            first, k, sequence, offset = spans[np.searchsorted(spans[:, 0], rank, side="right") - 1]
            nth = rank - first
            return [(length, int(sequence + nth // k), int(offset + nth % k * length))]
        at = self.stream_at[length] + (rank - self.used.get(length, 0)) * length
        out = []
        while length:
            if at < self.whole:
                sequence, start = at // self.capacity, at // self.capacity * self.capacity
                end = start + self.capacity
            else:
                nth = int(np.searchsorted(self.ends, at, side="right"))
                sequence = self.whole // self.capacity + nth
                start, end = (self.ends[nth - 1] if nth else self.whole), self.ends[nth]
            size = min(length, end - at)
            out.append((size, int(self.stream_sequence + sequence), int(at - start)))
            at += size
            length -= size
        return out


_TOKENISED = (
    "id long, place long, part int, tokens long, windows array<long>, window long, rest int, "
    "rest_crc long, nth long"
)
_PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
    "offset long, place long"
)


def _tokenised(path: str, end: int, capacity: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        window = 0
        for batch in batches:
            out: list[tuple] = []
            for ids in encoded(path, batch.column("text").to_pylist(), end):
                full = len(ids) // capacity
                crcs = [zlib.crc32(ids[k * capacity : (k + 1) * capacity].tobytes()) for k in range(full)]
                rest = len(ids) - full * capacity
                nth = seen.get(rest, 0)
                seen[rest] = nth + 1
                crc = zlib.crc32(ids[full * capacity :].tobytes())
                out.append((part, len(ids), crcs, window, rest, crc, nth))
                window += full
            kinds = (pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int32(), pa.int64(),
                     pa.int64())
            names = ["part", "tokens", "windows", "window", "rest", "rest_crc", "nth"]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("place"),
                 *[pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)]],
                names=["id", "place", *names],
            )

    return rows


def _placed(places: Places):
    capacity = places.capacity

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                own = (r["tokens"], r["place"])
                for k, crc in enumerate(r["windows"]):
                    sequence = places.sequences + (r["part"] << 36) + r["window"] + k
                    out.append((r["id"], k * capacity, capacity, crc, own[0], sequence, 0, own[1]))
                start = len(r["windows"]) * capacity
                found = places(r["rest"], r["rank"]) if r["rest"] else []
                for size, sequence, offset in found:
                    crc = r["rest_crc"] if len(found) == 1 else None
                    out.append((r["id"], start, size, crc, own[0], sequence, offset, own[1]))
                    start += size
            names = [x.split()[0] for x in _PIECES.split(", ")]
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[i] for o in out], pa.int64()) for i in range(len(names))], names=names
            )

    return rows


def _summed(path: str, end: int):
    """The checksum of pieces of cut remainders, from their texts."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crcs = [
                zlib.crc32(ids[start : start + length].tobytes())
                for ids, start, length in zip(
                    encoded(path, batch.column("text").to_pylist(), end),
                    batch.column("start").to_pylist(), batch.column("length").to_pylist(), strict=True,
                )
            ]
            at = batch.schema.get_field_index("ids_crc32")
            filled = batch.set_column(at, "ids_crc32", pa.array(crcs, pa.int64()))
            yield filled.select([x.split()[0] for x in _PIECES.split(", ")])

    return rows


def pack(
    documents: DataFrame,
    vocabulary: str,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    capacity: int = 2048,
    end: int = 1,
) -> DataFrame:
    """Cut and place the tokens of all documents into sequences of at most ``capacity`` tokens.

    The file must be readable at ``vocabulary`` on every executor. Returns one row per piece:
    id_column, start (tokens of its document before it), length, ids_crc32 (of the ids as
    little-endian unsigned 32-bit numbers), doc_tokens (with the end token), sequence_id and offset
    (where the piece starts in its sequence).

    A NULL or empty text is its end token alone. Repeated rows are packed one by one, rows without an
    id as well. An empty table gives no rows. Other columns are not read, whatever their names.
    """
    source = documents.select(
        F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"),
        F.xxhash64(F.col(id_column).cast("long"), F.col(text_column)).alias("place"),
    )
    rows = materialise(source.mapInArrow(_tokenised(vocabulary, end, capacity), _TOKENISED), "tokens")
    sums = materialise(rows.groupBy("part", "rest").agg(F.count("*").alias("n")), "lengths")
    counted = sums.filter("rest > 0").groupBy("rest").agg(F.sum("n").alias("n"))
    places = Places({r.rest: r.n for r in counted.collect()}, capacity)  # capacity - 1 rows at most
    before = Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        "part", "rest", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")
    )
    ranked = rows.join(offsets, ["part", "rest"]).withColumn("rank", F.col("before") + F.col("nth"))
    pieces = materialise(
        ranked.select("id", "place", "part", "tokens", "windows", "window", "rest", "rest_crc", "rank")
        .mapInArrow(_placed(places), _PIECES),
        "pieces",
    )
    cut = pieces.filter("ids_crc32 is null")
    texts = source.join(cut.select("place").distinct(), "place", "left_semi")
    texts = texts.select("place", "text").dropDuplicates(["place"])
    summed = cut.join(texts, "place").mapInArrow(_summed(vocabulary, end), _PIECES)
    out = pieces.filter("ids_crc32 is not null").union(summed).drop("place")
    return out.withColumnRenamed("doc_id", id_column)
