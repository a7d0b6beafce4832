"""N-gram Jaccard join by parity sketches (operator 1).

A text is the set of its distinct word shingles. The space of shingle hashes is cut into m ranges;
the XOR of a set's hashes inside a range is that range's parity. A shingle that only one of two
sets holds changes one range, so the number of differing parities is at most the symmetric
difference d, and at similarity t that is at most (1 - t) / (1 + t) * (|A| + |B|). With m > d at
least one range agrees (pigeonhole), and texts meet on (size band, range, parity).

Sizes are cut into bands; a set also enters the next band where it could meet a larger partner.
Ranges that hold no shingle agree by chance, so they are no keys. A band has some spare ranges; a
set with more empty ranges than that is also keyed by the first shingles of its prefix, of which
two similar sets always share one. So no pair is lost.

Meeting texts are never expanded into pairs of a group: every text is first checked against one
text, of the first ones of its keys that with which it shares most keys; links become components,
and only texts of one key that are still in different components, of fitting size and with a Hamming
distance of their 256-bit parity sketches within the bound, are compared further. Near texts share
many keys, so that each carries its smallest ones: a pair that has one of them in common is listed
at that key alone, and every pair at its smallest common key. 256 bits cannot tell texts of a
thousand words apart, so that the second round's join also compares sketches of a bit for two
shingles: long texts that only have a phrase in common share a key, but are never listed. In both rounds
the long sketches, of a bit a shingle or more, are compared before any text is moved.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ecocline.llm.common import WordHasher, components, mix, shingles
from ecocline.sources.storage import materialise

_U = np.uint64
_BAND_RATIO = 0.7
_KEYS = "key long, id long, size int, sketch binary"
_FIRST = 16  # a text's smallest open keys, by which a pair is told that met on another key


def bands(percent: int, limit: int = 1 << 40) -> tuple[tuple[int, int, int, int], ...]:
    """(first size, first size of the next band, ranges, spare ranges) from small to large."""
    out, low = [], 1
    while low < limit:
        high = max(low + 1, math.ceil(low / _BAND_RATIO))
        differ = (100 - percent) * 2 * (high - 1) // (100 + percent)
        ranges = differ + 1
        empty = ranges * math.exp(-low / ranges)
        spare = math.ceil(empty + 3 * math.sqrt(empty)) if differ and low > 20 else 0
        out.append((low, high, ranges + spare, spare))
        low = high
    return tuple(out)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(_U).view(np.int64)


def keys_of(runs: np.ndarray, percent: int, table: tuple) -> np.ndarray:
    """The keys under which a set can meet every set of the given similarity but its equals."""
    n = len(runs)
    most = n * 100 // percent  # largest partner
    if (100 - percent) * (n + most) // (100 + percent) < 1:
        return np.zeros(0, dtype=np.int64)
    at = next(i for i, b in enumerate(table) if b[0] <= n < b[1])
    parity = mix(runs * _U(0xC2B2AE3D27D4EB4F))
    out, prefix = [], False
    for band in (at, at + 1):
        first, _, ranges, spare = table[band]
        if band > at and most < first:
            break
        part = ((runs >> _U(32)) * _U(ranges)) >> _U(32)  # runs are sorted, so parts are too
        starts = np.flatnonzero(np.diff(part, prepend=part[:1] + _U(1)))
        held = np.bitwise_xor.reduceat(parity, starts)
        place = part[starts] * _U(0x9FB21C651E98DF25) + _U((band + 1) * 0x2545F4914F6CDD1D % 2**64)
        out.append(mix(mix(held) ^ mix(place)))
        prefix |= ranges - len(starts) > spare
    if prefix:
        short = n - -(-percent * n // 100) + 1
        out.append(mix(runs[:short] ^ _U(0x5851F42D4C957F2D)))
    return _signed(np.concatenate(out))


def sketch_of(runs: np.ndarray) -> bytes:
    """256 parity bits: bit k tells whether an odd number of shingles falls on k.

    For larger sets the long sketch follows, of at least a bit a shingle. Its length is a power of
    two, so that the XOR of its halves is the sketch of half the length.
    """
    bits = max(256, 1 << (len(runs) - 1).bit_length())
    odd = np.bincount((mix(runs) & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
    pack = lambda x: np.packbits(x.astype(np.uint8), bitorder="little").tobytes()
    return pack(odd.reshape(-1, 256).sum(axis=0) & 1) + (pack(odd) if bits > 256 else b"")


def differing(left: bytes, right: bytes) -> int:
    """Hamming distance of two sketches at the lesser of their lengths: at most the number of
    shingles that one of the sets holds alone."""
    short, long = sorted((left[32:] or left, right[32:] or right), key=len)
    bits, x = len(long) * 8, int.from_bytes(long, "little")
    while bits > len(short) * 8:
        bits //= 2
        x = (x >> bits) ^ (x & ((1 << bits) - 1))
    return (x ^ int.from_bytes(short, "little")).bit_count()


def _key_rows(ids: str, text: str, words: int, percent: int):
    schema = pa.schema(
        [("key", pa.int64()), ("id", pa.int64()), ("size", pa.int32()), ("sketch", pa.binary())]
    )

    table = bands(percent)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            names = batch.column(ids).to_numpy(zero_copy_only=False)
            keys, owners, sizes, sketches, held = [], [], [], [], 0
            for name, found in zip(names, hasher.texts(batch.column(text).to_pylist()), strict=True):
                runs = shingles(found, words)
                if len(runs):
                    with np.errstate(over="ignore"):
                        whole = np.array([np.add.reduce(mix(runs)) + _U(len(runs))], dtype=_U)
                    own = np.concatenate([_signed(mix(whole)), keys_of(runs, percent, table)])
                    sketch = sketch_of(runs)
                else:
                    own, sketch = _signed(mix(np.array([name], dtype=np.int64).view(_U))), b""
                keys.append(own)
                owners.append(np.full(len(own), name, dtype=np.int64))
                sizes.append(np.full(len(own), len(runs), dtype=np.int32))
                sketches += [sketch, *[None] * (len(own) - 1)]
                held += len(own)
                if held > 50_000:
                    yield _batch(schema, keys, owners, sizes, sketches)
                    keys, owners, sizes, sketches, held = [], [], [], [], 0
            if held:
                yield _batch(schema, keys, owners, sizes, sketches)

    return rows


def _batch(schema, keys, owners, sizes, sketches) -> pa.RecordBatch:
    flat = [np.concatenate(x) for x in (keys, owners, sizes)]
    return pa.RecordBatch.from_arrays(
        [*map(pa.array, flat), pa.array(sketches, pa.binary())], schema=schema
    )


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key: keep those that share their key, and every row with a sketch.

    ``first`` is the first row's id of the key. Only one row is held from batch to batch.
    """
    last = None  # the row before this batch: (key, first id, its own row still to be written)
    schema = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if schema is None:
            schema = batch.schema.append(pa.field("first", pa.int64()))
        whole = pa.concat_batches([last[1], batch]) if last is not None else batch
        key, ids = (whole.column(c).to_numpy() for c in ("key", "id"))
        new = np.concatenate([[True], key[1:] != key[:-1]])
        first = ids[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))]
        carried = last is not None
        if carried and not new[1]:
            first[: int(np.argmax(new[1:])) + 1 if new[1:].any() else len(first)] = last[0]
        shared = np.zeros(len(key), dtype=bool)
        shared[1:] |= ~new[1:]
        shared[:-1] |= ~new[1:]
        if carried and last[2]:
            shared[0] = True
        kept = (shared | whole.column("sketch").is_valid().to_numpy(zero_copy_only=False))[:-1]
        out = whole.append_column("first", pa.array(first)).slice(0, whole.num_rows - 1)
        yield out.filter(pa.array(kept)).cast(schema)
        last = (int(first[-1]), whole.slice(whole.num_rows - 1), bool(shared[-1]))
    if last is not None:
        kept = last[2] or last[1].column("sketch")[0].is_valid
        if kept:
            yield last[1].append_column("first", pa.array([last[0]], pa.int64())).cast(schema)


def _checked(words: int, percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            left, right = ([shingles(w, words) for w in hasher.texts(batch.column(c).to_pylist())]
                           for c in ("text_a", "text_b"))
            linked = []
            for x, y in zip(left, right, strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(linked)).cast(schema)

    return rows


def _near(percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = batch.column("size_a").to_numpy() + batch.column("size_b").to_numpy()
            sketches = (batch.column(c).to_pylist() for c in ("sketch_a", "sketch_b"))
            apart = np.array([differing(x, y) for x, y in zip(*sketches, strict=True)], dtype=np.int64)
            near = (100 + percent) * apart <= (100 - percent) * total.astype(np.int64)
            yield batch.select(["a", "b"]).filter(pa.array(near)).cast(schema)

    return rows


def _plausible(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) that their sketches do not rule out; an id may name several texts."""
    for side in "ab":
        named = sketches.select(*[F.col(c).alias(n) for c, n in (
            ("id", side), ("size", f"size_{side}"), ("sketch", f"sketch_{side}"))])
        pairs = pairs.join(named.hint("merge"), side)
    pairs = pairs.select("a", "b", "size_a", "size_b", "sketch_a", "sketch_b")
    return materialise(pairs.mapInArrow(_near(percent), "a long, b long").distinct(), "plausible")


def _links(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Those pairs (a, b) whose whole texts are similar enough."""
    for side in "ab":
        named = texts.select(F.col("id").alias(side), F.col("text").alias(f"text_{side}"))
        pairs = pairs.join(named.hint("merge"), side)
    checked = pairs.select("a", "b", "text_a", "text_b").mapInArrow(
        _checked(words, percent), "a long, b long"
    )
    return materialise(checked, "links")


def jaccard_join(
    documents: DataFrame,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    words: int = 5,
    percent: int = 80,
) -> DataFrame:
    """Group texts whose sets of ``words``-word shingles have a Jaccard similarity of
    ``percent`` / 100 or more.

    Returns id_column, n_shingles and component_id (smallest id reachable by links, itself
    included): one row for every row of ``documents``.

    Words are lower-cased in A-Z and cut at ASCII white space. A text with fewer words is one
    shingle of them all. A NULL, empty or blank text has n_shingles 0 and links with nothing; so
    does a row without an id, whose component is NULL. Rows that share an id are one node: each
    keeps its row and they share a component. Other columns are not read, whatever their names.
    """
    source = documents.select(
        F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text")
    )
    known = source.filter("id is not null")
    keyed = known.mapInArrow(_key_rows("id", "text", words, percent), _KEYS)
    met = materialise(
        keyed.repartition("key").sortWithinPartitions("key", "id")
        .mapInArrow(_meetings, f"{_KEYS}, first long"),
        "meetings",
    )

    # Equal sets share their whole-set key: its first id stands for them all.
    whole = met.filter("sketch is not null")
    stands = whole.groupBy("id").agg(
        F.min("first").alias("rep"), F.count_distinct("first").alias("texts")
    )
    same = whole.filter("first <> id").select(F.col("id").alias("a"), F.col("first").alias("b"))
    alone = whole.filter("id = first").withColumnRenamed("key", "set")
    reps = alone.select(
        "set", "id", "size", *[_word("sketch", F.lit(k)).alias(f"s{k}") for k in range(4)]
    ).distinct()  # one row for every text that an id names
    rows = met.filter("sketch is null")

    # Texts that share a key are moved once, and read for both rounds. The join does not depend on
    # the size of the list.
    used = rows.select("id").distinct().join(reps.select("id"), "id", "left_semi")
    texts = materialise(known.join(used.hint("merge"), "id", "left_semi"), "texts")
    sketches = whole.select("id", "size", "sketch").join(used, "id", "left_semi")
    sketches = materialise(sketches, "sketches")

    pairs = rows.filter("first <> id").groupBy(F.col("id").alias("a"), F.col("first").alias("b"))
    pairs = _by_rep(pairs.agg(F.count("*").alias("keys")), stands)
    often = pairs.groupBy("a").agg(F.max(F.struct("keys", -F.col("b"))).alias("best"))
    pairs = materialise(often.select("a", (-F.col("best.col2")).alias("b")), "pairs")
    links = _links(_plausible(pairs, sketches, percent), texts, words, percent)
    groups = components(links.union(same))

    # What one text of a key does not settle: texts of that key in different components.
    placed = rows.select("key", "id").join(reps, "id").join(
        groups.withColumnRenamed("node", "id"), "id", "left"
    ).withColumn("component", F.coalesce("component", "id"))
    open_keys = placed.groupBy("key").agg(
        F.min("component").alias("low"), F.max("component").alias("high")
    ).filter("low < high").select("key")
    left = materialise(placed.join(open_keys, "key", "left_semi"), "open")
    firsts = left.groupBy("set").agg(F.slice(F.sort_array(F.collect_set("key")), 1, _FIRST).alias("firsts"))
    held = alone.join(left.select("set").distinct(), "set", "left_semi").select("set", _bits("sketch").alias("bits"))
    left = left.join(firsts, "set").join(held.dropDuplicates(["set"]), "set")
    right = left.select("key", *[F.col(c).alias(f"{c}_b") for c in left.columns if c != "key"])
    apart = sum(F.bit_count(F.col(f"s{k}").bitwiseXOR(F.col(f"s{k}_b"))) for k in range(4))
    met_before = F.array_min(F.array_intersect("firsts", "firsts_b")) < F.col("key")
    meet = left.join(right, "key").filter(
        (F.col("id") < F.col("id_b"))
        & (F.col("component") != F.col("component_b"))
        & (100 * F.least("size", "size_b") >= percent * F.greatest("size", "size_b"))
        & ((100 + percent) * apart <= (100 - percent) * (F.col("size") + F.col("size_b")))
        & ~F.coalesce(met_before, F.lit(False))
        & F.coalesce((100 + percent) * _apart("bits", "bits_b") <= (100 - percent) * (F.col("size") + F.col("size_b")),
                     F.lit(True))
    )
    rest = _listed(meet)
    rest = rest.join(pairs, ["a", "b"], "left_anti")
    more = _links(_plausible(rest, sketches, percent), texts, words, percent)
    groups = components(
        groups.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more)
    )

    sizes = whole.select(F.col("id"), "size", "first")
    named = sizes.join(groups.withColumnRenamed("node", "id"), "id", "left")
    out = named.select(
        F.col("id").alias(id_column), F.col("size").cast("long").alias("n_shingles"),
        F.coalesce("component", "id").alias("component_id"),
    )
    nameless = source.filter("id is null").mapInArrow(
        _nameless(words), f"{id_column} long, n_shingles long, component_id long"
    )
    return out.union(nameless)


def _word(sketch: str, k: Column) -> Column:
    """The k-th 64 bits of a binary column."""
    return F.conv(F.hex(F.substring(sketch, 1 + 8 * k, F.lit(8))), 16, -10).cast("long")


def _halved(bits: Column) -> Column:
    """The sketch of half the length."""
    half = F.floor(F.size(bits) / 2).cast("int")
    return F.zip_with(F.slice(bits, 1, half), F.slice(bits, half + 1, half), lambda x, y: x.bitwiseXOR(y))


def _bits(sketch: str) -> Column:
    """A set's sketch of at least a bit for two shingles, as an array of 64 bits each."""
    longs = F.floor(F.length(sketch) / 8).cast("int")
    long = F.transform(F.sequence(F.lit(4), longs - 1), lambda k: _word(sketch, k))
    return F.when(longs > 4, _halved(long)).otherwise(F.array(*[_word(sketch, F.lit(k)) for k in range(4)]))


def _apart(left: str, right: str) -> Column:
    """Hamming distance of two sketches at the lesser of their lengths; NULL if one is more than twice as long."""
    x, y = F.col(left), F.col(right)
    short = [F.when(F.size(a) > F.size(b), _halved(a)).otherwise(a) for a, b in ((x, y), (y, x))]
    differ = F.zip_with(*short, lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.aggregate(differ, F.lit(0), lambda total, n: total + n)


def _listed(meet: DataFrame) -> DataFrame:
    """The pairs (a, b) of the second round's join, each once."""
    return meet.select(F.col("id_b").alias("a"), F.col("id").alias("b")).distinct()


def _by_rep(pairs: DataFrame, stands: DataFrame) -> DataFrame:
    """Pairs of first texts instead of their copies, with the keys they share.

    Ids that name several texts stay themselves.
    """
    alone = stands.filter("texts = 1 and rep <> id").select("id", "rep")
    for side in "ab":
        pairs = pairs.join(alone.withColumnsRenamed({"id": side, "rep": "to"}), side, "left")
        pairs = pairs.withColumn(side, F.coalesce("to", side)).drop("to")
    ends = (F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    return pairs.filter("a <> b").groupBy(*ends).agg(F.sum("keys").alias("keys"))


def _nameless(words: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            sizes = [len(shingles(w, words)) for w in hasher.texts(batch.column("text").to_pylist())]
            none = pa.nulls(len(sizes), pa.int64())
            columns = [none, pa.array(sizes, pa.int64()), none]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "component"])

    return rows
