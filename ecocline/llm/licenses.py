"""Licence scan by diagonal voting (operator 4).

The hashes of all rolling word k-grams of a text are joined to the positions of the same k-grams in
the templates. A hit votes for its diagonal, the difference of both positions: a template that
stands in a text word for word has all its votes on one diagonal, the place where it starts. Words
put in or left out move later votes to a neighbouring diagonal; neighbours are merged into spans, and
a span counts if it holds enough different positions of its template at enough density. Hits compare
the words themselves, so a span does not rest on hashes alone. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Everything that is ASCII but neither digit nor lower-case letter stands between words.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases that count word for word.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Notices that count where most of them stands, in their order.
NOTICES = {
    "released under the terms of the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "licensed under the apache license version 2 0": "apache-2",
    "this work is licensed under the gnu general public license version 3": "gpl-3",
    "this work is licensed under a creative commons attribution noncommercial license": "cc-by-nc",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "this source code form is subject to the terms of the mozilla public license": "mpl-2",
}


def _templates(spark, k: int) -> DataFrame:
    rows, at = [], 0
    for exact, table in ((True, PHRASES), (False, NOTICES)):
        for text, label in table.items():
            words = text.split(" ")
            grams = len(words) - k + 1
            rows += [(at, label, exact, grams, i, words[i : i + k]) for i in range(grams)]
            at += 1
    # One more template that every text meets once, so that a text without hits keeps its row.
    rows.append((-1, None, False, 1, 0, [""] * k))
    schema = "template int, label string, exact boolean, grams int, tpos int, words array<string>"
    return spark.createDataFrame(rows, schema).withColumn(
        "hash", F.xxhash64(*[F.get("words", F.lit(j)) for j in range(k)])
    )


def scan_licenses(
    documents: DataFrame,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    k: int = 2,
    least: float = 0.75,
    apart: int = 2,
) -> DataFrame:
    """Licence phrases and notices in every whole text.

    Words are lower-cased in A-Z; ASCII characters other than letters and digits stand between them.
    Returns id_column, n_words, n_base (places of the phrases), first_word and last_word (smallest
    and largest start of a phrase, from 0; NULL without one), base_labels, labels (with those of the
    notices; both distinct, sorted and joined by commas) and score: 1 with a phrase, else the
    largest share of a notice that was found, if at least ``least``, else 0.

    NULL and empty texts have no words and no labels. Rows alike in id and text each get the same
    row. An empty table gives no rows. Other columns are not read, whatever their names.
    """
    spark = documents.sparkSession
    text = F.translate(F.coalesce(F.col(text_column), F.lit("")), _UPPER, _LOWER)
    worded = documents.select(
        F.col(id_column).alias("id"), F.xxhash64(text_column).alias("place"),
        F.array_remove(F.split(text, BETWEEN), "").alias("words"),
    )
    n = F.size("words")
    # The runs of k words as one array of structs: what is exploded does not carry the whole text.
    names = [f"w{j}" for j in range(k)]
    runs = F.arrays_zip(*[F.slice("words", j + 1, F.greatest(n, F.lit(1))).alias(names[j]) for j in range(k)])
    own = F.array(F.struct(*[F.lit("").alias(name) for name in names]))  # after the last word
    rolled = worded.select("id", "place", n.alias("n_words"), F.concat(runs, own).alias("runs")).select(
        "id", "place", "n_words", F.posexplode("runs").alias("pos", "run")
    )
    words = [F.col(f"run.{name}") for name in names]
    rolled = rolled.withColumn("hash", F.xxhash64(*words))
    templates = F.broadcast(_templates(spark, k).withColumnRenamed("words", "gram"))  # fixed, short
    verified = F.lit(True)
    for j, word in enumerate(words):
        verified = verified & (word == F.get("gram", F.lit(j)))
    hits = rolled.join(templates, "hash").filter(verified).select(
        "id", "place", "template", "label", "exact", "grams", "tpos", "pos", "n_words"
    )
    # Votes by diagonal. Rows that repeat add nothing but their number, kept by the extra template.
    votes = hits.groupBy(
        "id", "place", "template", "label", "exact", "grams", (F.col("pos") - F.col("tpos")).alias("diagonal")
    ).agg(
        F.collect_set("tpos").alias("found"), F.min("pos").alias("low"), F.max("pos").alias("high"),
        F.max("n_words").alias("n_words"), F.count("*").alias("rows"),
    )
    # Neighbouring diagonals become one span.
    along = Window.partitionBy("id", "place", "template").orderBy("diagonal")
    fresh = F.coalesce(
        (F.col("diagonal") - F.lag("diagonal").over(along) > apart) | F.col("exact"), F.lit(True)
    )
    spans = (
        votes.withColumn("fresh", fresh.cast("int"))
        .withColumn("span", F.sum("fresh").over(along.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("id", "place", "template", "label", "exact", "grams", "span")
        .agg(
            F.size(F.array_distinct(F.flatten(F.collect_list("found")))).alias("held"),
            F.min("low").alias("low"), F.max("high").alias("high"),
            F.max("n_words").alias("n_words"), F.max("rows").alias("rows"),
        )
    )
    share = F.col("held") / F.col("grams")
    base = F.col("exact") & (F.col("held") == F.col("grams"))
    dense = (F.col("high") - F.col("low") + 1) <= F.col("grams") * 2
    notice = ~F.col("exact") & (F.col("template") >= 0) & (share >= least) & dense

    def labels(where):
        return F.array_join(F.sort_array(F.collect_set(F.when(where, F.col("label")))), ",")

    out = spans.groupBy("id", "place").agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("low"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("low"))).cast("long").alias("last_word"),
        labels(base).alias("base_labels"), labels(base | notice).alias("labels"),
        F.max(F.when(base, 1.0).when(notice, share).otherwise(0.0)).alias("score"),
        F.max(F.when(F.col("template") == -1, F.col("rows"))).alias("copies"),
    )
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(
        F.col("id").alias(id_column), "n_words", "n_base", "first_word", "last_word", "base_labels",
        "labels", "score",
    )
