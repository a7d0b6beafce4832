"""Removal of repeated lines by overlapping three-line windows (operator 5).

Every three consecutive lines are a window; its hash is looked for in all documents. Of windows that
occur more than once the first occurrence, in the order of documents and lines, stays; the lines that
later occurrences cover are merged per document and removed. Only DataFrame functions are used: a
window that many documents share is counted where it lies, and meets its places by a join that
adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3


def drop_repeated_lines(
    documents: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW
) -> DataFrame:
    """``documents`` with repeated lines taken out of the text, and n_lines and n_removed.

    Lines end at line feeds. A window of blanks alone is no repeat, and neither is one that
    overlaps its own first occurrence. A text with fewer lines than a window, an empty or a NULL text
    stays as it is (NULL: n_lines 0). Documents are ordered by id, NULL ids last, then by a hash
    of the text. Rows alike in id and text are one document: each gets the same text. Other columns
    are kept, but for own columns named n_lines and n_removed, which are replaced.
    """
    names = [c for c in documents.columns if c not in ("n_lines", "n_removed")]
    keyed = documents.select(
        *names, F.xxhash64(F.col(id_column), F.col(text_column)).alias("_place")
    )
    lines = F.split(text_column, "\n", -1)
    own = keyed.select(
        F.struct(F.col(id_column).isNull().alias("none"), F.col(id_column).alias("id"), "_place").alias("doc"),
        lines.alias("lines"),
    )
    # Neighbouring lines side by side; the shifted copies end early, which leaves NULLs at the end.
    shifted = [F.slice("lines", k + 1, F.greatest(F.size("lines"), F.lit(1))) for k in range(window)]
    runs = F.arrays_zip(*[s.alias(f"l{k}") for k, s in enumerate(shifted)])
    parts = [F.col(f"run.l{k}") for k in range(window)]
    windows = (
        own.select("doc", F.posexplode(runs).alias("line", "run"))
        .filter(parts[-1].isNotNull() & (F.length(F.trim(F.concat(*parts))) > 0))
        .select("doc", "line", F.xxhash64(*parts).alias("hash"))
    )
    repeated = (
        windows.groupBy("hash")
        .agg(F.count("*").alias("n"), F.min(F.struct("doc", "line")).alias("first"))
        .filter("n > 1").select("hash", "first")
    )
    later = windows.join(repeated, "hash").filter(
        (F.struct("doc", "line") > F.col("first"))
        & ((F.col("doc") != F.col("first.doc")) | (F.col("line") >= F.col("first.line") + window))
    )
    covered = (
        later.groupBy(F.col("doc._place").alias("_place"), F.col("doc.id").alias("_id"))
        .agg(F.collect_set("line").alias("_starts"))
    )
    joined = keyed.join(
        covered, (F.col("_id").eqNullSafe(F.col(id_column))) & (keyed._place == covered._place), "left"
    ).drop(covered._place)
    hit = F.array_distinct(
        F.flatten(F.transform("_starts", lambda s: F.sequence(s, s + window - 1)))
    )
    kept = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), hit)
    text = F.array_join(F.transform(kept, lambda i: F.get("_lines", i)), "\n")
    joined = joined.withColumn(
        # split once for documents that change; the others only count line feeds
        "_lines", F.when(F.col("_starts").isNotNull(), lines)
    ).withColumn(
        "_text", F.when(F.col("_starts").isNull(), F.col(text_column)).otherwise(text)
    )
    return joined.select(
        *[F.col("_text").alias(c) if c == text_column else F.col(c) for c in names],
        F.coalesce(F.regexp_count(F.col(text_column), F.lit("\n")) + 1, F.lit(0))
        .cast("long").alias("n_lines"),
        F.when(F.col("_starts").isNull(), 0).otherwise(F.size(hit)).cast("long").alias("n_removed"),
    )
