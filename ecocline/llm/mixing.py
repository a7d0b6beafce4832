"""Mixing sources to target weights under a time-varying curriculum (operator 10).

Targets: the mix holds ``share`` times all words, divided by weight; no source is taken more than
``repeats`` times, and what that cuts goes to the others by weight.

Inside a source, documents stand in the order of a hash and are taken pass after pass, the last pass
up to the word that meets the target, so that a source gives exactly its rounded target.

A source's weight varies over training: it starts at 1 + tilt times its mean and falls evenly to
1 - tilt. The integral of that schedule is the share of its demand met by time t; inverted, it turns
the words a source has given before a document into the document's training position in [0, 1].

Running sums are taken in two steps, over buckets of the hash and inside a bucket, so that a source
that holds most rows is spread like any other. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ecocline.sources.storage import materialise

WORD = r"[^\x20\x09-\x0D]+"
_BUCKET_ROWS = 2000


def source_targets(
    totals: DataFrame, weights: list[float], share: float, repeats: float
) -> DataFrame:
    """``target`` for every source: totals has source and source_size.

    Sources in code point order, NULL last, take the weights in turn. A source is at its limit if
    the level at which all remaining ones would be served, weight for weight, reaches it; taken in
    the order of limit over weight, the limits come first. The catalogue has one row per source.
    """
    turn = F.pmod(F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1)
    catalogue = totals.withColumn("weight", weight).withColumn("limit", F.col("source_size") * repeats)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.orderBy(F.col("limit") / F.col("weight"), F.asc_nulls_last("source"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = (
        F.sum("source_size").over(every) * share - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    ) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    levelled = catalogue.withColumn("nth", F.row_number().over(order)).withColumn("level", level)
    below = F.when(F.col("level") * F.col("weight") < F.col("limit"), F.struct("nth", "level"))
    served = F.min(below).over(every)["level"]  # of the first source below its limit
    return levelled.select(
        "source", "source_size", turn.alias("turn"),
        F.least(F.coalesce(served * F.col("weight"), "limit"), "limit").alias("target"),
    )


def place_of(id_column: str, text_column: str) -> Column:
    """A row's place in its source's order: a 128-bit hash of id and text."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    return F.md5(F.concat_ws(":", F.col(id_column).cast("string"), F.md5(text)))


def mix(
    documents: DataFrame,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    repeats: int = 2,
    tilts: tuple[float, ...] = (0.5, 0.0, -0.5),
    with_place: bool = False,
) -> DataFrame:
    """Take words from every source up to its target and give each take its training position.

    Returns id_column, size (words), source_size, target, taken (words taken, repeats counted),
    position (of the first take; NULL if nothing is taken) and positions (of every take), in the
    order of position. With ``with_place`` the row's ``place_of``, passes (whole takes) and part (words of
    the last take, 0 without one) come along, and the order is left to the caller: rows are ranked and
    placed without their texts.

    A NULL or empty text has size 0 and nothing is taken of it; a NULL source is a source of its
    own. Rows that are alike in every used column are taken one by one; which of them comes first
    does not show. An empty table gives no rows. Other columns are not read, whatever their names.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    sized = documents.select(
        F.col(id_column).alias("id"), F.col(source_column).alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        place_of(id_column, text_column).alias("place"),
    )
    sized = materialise(sized, "sizes")
    rows = sized.count()
    buckets = min(max(64, rows // _BUCKET_ROWS), 1 << 20)
    # the place's first five hex digits, as a bucket in the order of the place
    ahead = F.conv(F.substring("place", 1, 5), 16, 10).cast("long")
    sized = sized.withColumn("bucket", F.shiftright(ahead * buckets, 20))
    sums = sized.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    totals = sums.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = source_targets(totals, list(weights), share, repeats)
    offset = F.sum("words").over(
        Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    sums = sums.withColumn("offset", F.coalesce(offset, F.lit(0))).drop("words")
    known = (
        sums.alias("s").join(targets.alias("t"), F.expr("s.source <=> t.source"))
        .select("s.source", "bucket", "offset", "source_size", "target", "turn")
    )
    inside = Window.partitionBy("source", "bucket").orderBy("place", "size")
    running = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    placed = sized.withColumn("running", running).alias("d").join(
        known.alias("k"), F.expr("d.source <=> k.source AND d.bucket = k.bucket")
    )
    c = F.col
    wanted = F.round("target").cast("long")
    passes = F.when(c("source_size") > 0, F.floor(wanted / c("source_size"))).otherwise(0)
    taking = (
        placed.select("d.*", "offset", "source_size", "target", "turn")
        .withColumn("before", c("offset") + c("running"))
        .withColumn("passes", passes.cast("long"))
        .withColumn("rest", wanted - c("passes") * c("source_size"))
        .withColumn("part", F.greatest(F.lit(0), F.least(c("rest") - c("before"), c("size"))))
    )
    tilt = F.element_at(F.array(*[F.lit(float(t)) for t in tilts]), F.pmod("turn", F.lit(len(tilts))) + 1)
    takes = c("passes") + F.when(c("part") > 0, 1).otherwise(0)

    def at(k):
        y = (k * c("source_size") + c("before")) / c("target")
        lead = 1 + tilt
        return F.round(2 * y / (lead + F.sqrt(lead * lead - 4 * tilt * y)), 9)

    positions = F.when(
        (c("size") > 0) & (takes > 0), F.transform(F.sequence(F.lit(0), takes - 1), at)
    ).otherwise(F.array().cast("array<double>"))
    out = taking.withColumn("positions", positions).select(
        c("id").alias(id_column), "size", "source_size", "target",
        (c("passes") * c("size") + c("part")).alias("taken"),
        F.try_element_at("positions", F.lit(1)).alias("position"), "positions",
        *(["place", "part", "passes"] if with_place else []),
    )
    return out if with_place else out.orderBy(F.asc_nulls_last("position"), id_column)
