"""Exact top-k by a pivot table (operator 2).

Every vector carries its distances to many pivots. By the triangle inequality the largest
difference of two vectors' pivot distances is a lower bound of their distance, and so gives an
upper bound of their inner product: q.c = (|q|^2 + |c|^2 - d(q, c)^2) / 2. For every query the
candidates are taken in the order of that bound until it falls below the k-th best score found; what
is left cannot enter, so the result is exact.

Queries and candidates meet in blocks: a task holds one block of each, and returns k rows a query.
Pivots come from a bounded sample (``sample`` rows with the smallest hash of the id); every row is
in the table and can be found.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ecocline.llm.vectors import usable
from ecocline.sources.storage import materialise

_MARGIN = 1e-9


def choose_pivots(vectors: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first: each next pivot is the vector farthest from those taken."""
    taken = [0]
    nearest = np.linalg.norm(vectors - vectors[0], axis=1)
    while len(taken) < min(count, len(vectors)) and nearest.max() > 0:
        taken.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, np.linalg.norm(vectors - vectors[taken[-1]], axis=1))
    return vectors[taken]


def _distances(pivots: dict[int, np.ndarray]):
    """Pivot table rows: the vector and its distances as packed doubles."""

    def rows(batches):
        for batch in batches:
            out = []
            for vector in batch.column("vector"):
                x = vector.values.to_numpy(zero_copy_only=False).astype(np.int64)
                table = pivots.get(len(x))
                far = b"" if table is None else np.linalg.norm(table - x, axis=1).tobytes()
                out.append((x.tobytes(), far))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("vector").value_lengths().cast(pa.int32()),
                 pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.binary())],
                names=["id", "dim", "x", "far"],
            )

    return rows


def _matrix(table: pa.Table, column: str, kind) -> np.ndarray:
    return np.stack([np.frombuffer(v, dtype=kind) for v in table.column(column).to_pylist()])


def search_block(
    q_id: int, q: np.ndarray, q_far: np.ndarray, ids: np.ndarray, x: np.ndarray, far: np.ndarray,
    k: int, step: int = 128,
) -> tuple[np.ndarray, np.ndarray, int]:
    """(ids, scores) of one query's k best in a block, and how many candidates were evaluated."""
    squares = (x.astype(np.float64) ** 2).sum(axis=1)
    own = float((q.astype(np.float64) ** 2).sum())
    low = np.abs(far - q_far).max(axis=1) if far.shape[1] else np.zeros(len(x))
    bound = (own + squares - low * low) / 2
    bound += _MARGIN * (own + squares) + 1e-6  # rounding of the distances
    order = np.argsort(-bound, kind="stable")
    order = order[ids[order] != q_id]
    best_ids, best = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    seen = 0
    while seen < len(order):
        if len(best) == k and bound[order[seen]] < best[-1]:
            break
        now = order[seen : seen + step]
        seen += len(now)
        best = np.concatenate([best, x[now] @ q])
        best_ids = np.concatenate([best_ids, ids[now]])
        keep = np.lexsort((best_ids, -best))
        keep = keep[np.sort(np.unique(best_ids[keep], return_index=True)[1])][:k]
        best, best_ids = best[keep], best_ids[keep]
    return best_ids, best, seen


def _searched(k: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def group(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        if not queries.num_rows or not candidates.num_rows:
            return schema.empty_table()
        ids, x, far = (
            candidates.column("id").to_numpy(), _matrix(candidates, "x", np.int64),
            _matrix(candidates, "far", np.float64),
        )
        found = [
            (q_id, *search_block(q_id, q, q_far, ids, x, far, k)[:2])
            for q_id, q, q_far in zip(
                queries.column("q_id").to_pylist(), _matrix(queries, "q_x", np.int64),
                _matrix(queries, "q_far", np.float64), strict=True,
            )
        ]
        return pa.Table.from_arrays(
            [pa.array(np.repeat([f[0] for f in found], [len(f[1]) for f in found]), pa.int64()),
             pa.array(np.concatenate([f[1] for f in found]), pa.int64()),
             pa.array(np.concatenate([f[2] for f in found]), pa.int64())],
            schema=schema,
        )

    return group


def top_k(
    vectors: DataFrame,
    is_query: str,
    *,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    k: int = 10,
    pivots: int = 64,
    sample: int = 4096,
    block: int = 8192,
) -> DataFrame:
    """The k candidates with the highest inner product for every row that ``is_query`` selects.

    ``vector_column`` holds integers (each product sum must fit 63 bits). Returns query_id, rank
    (from 1), vec_id and score; ties go to the smaller id. Candidates are all rows with another id.

    Vectors that are NULL, empty or hold NULL components, and rows without an id, take no part;
    vectors of another length are no candidates. A query id that repeats is asked once per distinct
    vector row and its results are merged by rank; a candidate id that repeats counts once with its
    best score. An empty table gives no rows. Other columns are not read, whatever their names.
    """
    source = vectors.withColumn("_query", F.coalesce(F.expr(is_query), F.lit(False)))
    source = source.select(
        F.col(id_column).cast("long").alias("id"),
        F.col(vector_column).cast("array<long>").alias("vector"), F.col("_query").alias("query"),
    ).filter(F.col("id").isNotNull() & usable(F.col("vector")))
    source = materialise(source.distinct(), "vectors")
    drawn = (
        source.select("id", "vector").orderBy(F.xxhash64("id"), "id").limit(sample).collect()
    )  # bounded by ``sample``
    by_dim: dict[int, list] = {}
    for row in drawn:
        by_dim.setdefault(len(row.vector), []).append(row.vector)
    tables = {d: choose_pivots(np.array(v, dtype=np.float64), pivots) for d, v in by_dim.items()}
    schema = "id long, dim int, x binary, far binary"
    table = materialise(source.select("id", "vector").mapInArrow(_distances(tables), schema), "pivots")
    asked = source.filter("query").select("id").distinct()
    queries = materialise(table.join(asked, "id", "left_semi"), "asked")

    def blocks(df: DataFrame) -> int:
        return max(1, -(-df.count() // block))

    n_candidates, n_queries = blocks(table), blocks(queries)

    def dealt(df: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        """Every row once for each block of the other side."""
        every = F.sequence(F.lit(0), F.lit(n_other - 1))
        return df.withColumn(own, F.pmod(F.xxhash64("id"), F.lit(n_own)).cast("int")).withColumn(
            other, F.explode(every)
        )

    left = dealt(queries, "qb", n_queries, "cb", n_candidates)
    left = left.withColumnsRenamed({c: f"q_{c}" for c in ("id", "dim", "x", "far")})
    left = left.withColumnsRenamed({"qb": "q_qb", "cb": "q_cb"}).groupBy("q_qb", "q_cb", "q_dim")
    right = dealt(table, "cb", n_candidates, "qb", n_queries).groupBy("qb", "cb", "dim")
    found = left.cogroup(right).applyInArrow(
        _searched(k), "query_id long, vec_id long, score long"
    )
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = F.expr("row_number() over (partition by query_id order by score desc, vec_id)")
    return once.withColumn("rank", best.cast("int")).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
