"""Near duplicates among embeddings by random hyperplanes (operator 7).

Every vector gets, in each of several tables, the signs of its products with random hyperplanes as
a code. Vectors that share a code are compared by exact cosine inside their bucket; a pair that
meets in several tables is counted in the first one only, which its codes tell without looking
elsewhere. A bucket returns one row per vector (its number of links and its local component), never
its pairs; a bucket above ``BLOCK`` rows is cut into blocks that meet two by two in separate tasks.
Equal vectors are one vector with a count, so groups of copies cost one row.

The bits per code follow the number of vectors, so that buckets keep their size, and the tables
follow the bits, so that a pair just at the threshold is found with probability ``recall``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ecocline.llm.common import components
from ecocline.sources.storage import materialise

BLOCK = 1024
_BUCKET = 512


def usable(vector: Column) -> Column:
    """True for a vector with components, none of them NULL or not finite."""
    bad = F.exists(
        vector,
        lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")),
    )
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ~bad, F.lit(False))


def plan(rows: int, threshold: float, recall: float) -> tuple[int, int]:
    """(bits, tables) for so many vectors."""
    bits = max(4, math.ceil(math.log2(max(rows, 1) / _BUCKET)))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return min(bits, 62), math.ceil(math.log(1 - recall) / math.log(1 - agree))


def _coded(bits: int, tables: int, seed: int):
    def rows(batches):
        planes: dict[int, np.ndarray] = {}
        weights = np.int64(1) << np.arange(bits, dtype=np.int64)
        for batch in batches:
            out: list[tuple] = []
            for rep, copies, vector in zip(
                batch.column("rep").to_pylist(), batch.column("copies").to_pylist(),
                batch.column("vector"), strict=True,
            ):
                x = vector.values.to_numpy(zero_copy_only=False).astype(np.float64)
                d = len(x)
                if d not in planes:
                    planes[d] = np.random.default_rng([seed, d]).standard_normal((tables * bits, d))
                signs = (planes[d] @ x > 0).reshape(tables, bits)
                out.append((rep, copies, x.tobytes(), (signs @ weights).astype(np.int64).tobytes()))
            names = ("rep", "copies", "x", "codes")
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names
            )

    return rows


def _tabled(bits: int):
    """One row per vector and table, with the table's code."""

    def rows(batches):
        for batch in batches:
            codes = [np.frombuffer(c, dtype=np.int64) for c in batch.column("codes").to_pylist()]
            for t in range(len(codes[0]) if codes else 0):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(codes), t, dtype=np.int32)),
                     pa.array(np.array([c[t] for c in codes])),
                     *[batch.column(c) for c in ("rep", "copies", "x", "codes")]],
                    names=["tab", "code", "rep", "copies", "x", "codes"],
                )

    return rows


def _compared(threshold: float):
    schema = pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def of_size(table: pa.Table, tab: int, cross: bool):
        rep = table.column("rep").to_numpy()
        copies = table.column("copies").to_numpy()
        side = table.column("side").to_numpy()
        x = np.stack([np.frombuffer(v, dtype=np.float64) for v in table.column("x").to_pylist()])
        codes = np.stack([np.frombuffer(v, dtype=np.int64) for v in table.column("codes").to_pylist()])
        norm = np.sqrt((x * x).sum(axis=1))
        near = (x @ x.T) >= threshold * norm[:, None] * norm[None, :]
        np.fill_diagonal(near, False)
        near &= (norm > 0)[:, None] & (norm > 0)[None, :]
        if cross:
            near &= side[:, None] != side[None, :]
        new = near.copy()
        for t in range(tab):
            new &= codes[:, t, None] != codes[None, :, t]
        links = new @ copies
        root = np.arange(len(rep))
        order = np.argsort(rep, kind="stable")
        ranked = near[order][:, order]
        while True:  # least label of the neighbourhood, until nothing changes
            least = np.minimum(root, np.where(ranked, root[None, :], len(root)).min(axis=1))
            least = least[least]
            if (least == root).all():
                break
            root = least
        to = np.empty_like(rep)
        to[order] = rep[order][root]
        found = near.any(axis=1)
        return [c[found] for c in (rep, links.astype(np.int64), to)]

    def group(key: tuple, table: pa.Table) -> pa.Table:
        tab, _, one, two = (k.as_py() for k in key)
        sizes = np.array([len(v) for v in table.column("x").to_pylist()])
        parts = [
            of_size(table.filter(pa.array(sizes == s)), tab, one != two) for s in np.unique(sizes)
        ]
        return pa.Table.from_arrays(
            [pa.array(np.concatenate([p[i] for p in parts])) for i in range(3)], schema=schema
        )

    return group


def near_vectors(
    vectors: DataFrame,
    *,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    threshold: float = 0.9,
    recall: float = 0.97,
    seed: int = 11,
    block: int = BLOCK,
) -> DataFrame:
    """Link vectors with a cosine of ``threshold`` or more, in double precision.

    Returns id_column, n_links (other ids linked directly), component_id (smallest id reachable by
    links, itself included) and kept (the id is its component's): one row for every input row.

    Vectors that are NULL, empty, zero or hold NULL or non-finite components link with nothing, and
    so do vectors of different length. A row without an id has no links and no component, and is
    kept. Rows that repeat an id are one vertex. Other columns are not read, whatever their names.
    """
    source = vectors.select(
        F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("vector")
    )
    nonzero = F.exists("vector", lambda x: x != 0)
    valid = F.col("id").isNotNull() & usable(F.col("vector"))
    keyed = source.withColumn("ok", valid).withColumn("ok", F.col("ok") & nonzero)
    keyed = keyed.filter("ok").select(
        "id", "vector", F.xxhash64("vector").alias("h1"),
        F.xxhash64(F.lit(1), F.reverse("vector")).alias("h2"),
    )
    groups = materialise(
        keyed.groupBy("h1", "h2").agg(
            F.min("id").alias("rep"), F.count_distinct("id").alias("copies"),
            F.min("vector").alias("vector"),
        ),
        "vectors",
    )
    bits, tables = plan(groups.count(), threshold, recall)
    coded = groups.select("rep", "copies", "vector").mapInArrow(
        _coded(bits, tables, seed), "rep long, copies long, x binary, codes binary"
    )
    rows = coded.mapInArrow(
        _tabled(bits), "tab int, code long, rep long, copies long, x binary, codes binary"
    )
    rows = materialise(rows, "codes")
    blocks = rows.groupBy("tab", "code").agg(F.ceil(F.count("*") / block).cast("int").alias("n"))
    side = F.pmod(F.xxhash64("rep"), F.col("n")).cast("int")
    cells = (
        rows.join(blocks, ["tab", "code"]).withColumn("side", side)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        .withColumn("one", F.least("side", "other")).withColumn("two", F.greatest("side", "other"))
    )
    found = materialise(
        cells.select("tab", "code", "one", "two", "side", "rep", "copies", "x", "codes")
        .groupBy("tab", "code", "one", "two")
        .applyInArrow(_compared(threshold), "rep long, links long, root long"),
        "near",
    )
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    named = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")).distinct())
    placed = groups.join(links, "rep", "left").join(
        named.withColumnRenamed("node", "rep"), "rep", "left"
    )
    placed = placed.select(
        "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "rep").alias("component"),
    )
    per_id = keyed.join(placed, ["h1", "h2"]).groupBy("id").agg(
        F.max("n_links").alias("n_links"), F.min("component").alias("component")
    )
    return source.select("id").join(per_id, "id", "left").select(
        F.col("id").alias(id_column),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "id").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component", "id"), F.lit(True)).alias("kept"),
    )
