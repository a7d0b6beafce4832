"""From raw documents to packed training sequences: filter, deduplicate, mix, pack."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ecocline.llm.jaccard import jaccard_join
from ecocline.llm.lines import drop_repeated_lines
from ecocline.llm.mixing import WORD, mix, place_of
from ecocline.llm.packing import pack
from ecocline.llm.queries import vocabulary
from ecocline.llm.toxicity import score_toxicity
from ecocline.sources.storage import collected, materialise, release
from ecocline.sources.tables import parquet

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


#: Tables that the stage before wrote for itself; they go once its result is written.
_OWN: list[str] = []


def tidy(stage: Stage) -> Stage:
    """A stage that deletes the tables of the one before; those that ``docs`` still reads stay."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _OWN[:] = release(spark, _OWN, docs)
        with collected() as own:
            out = stage(spark, docs, sf_dir)
        _OWN.extend(own)
        return out

    return run_stage


@tidy
def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score rejects go; rows are told apart by id and text.

    Rows with one id and different texts are judged one by one.
    """
    scored = score_toxicity(docs, parquet(spark, sf_dir, "labels"), with_place=True)
    rejected = materialise(scored.filter("predicted = 1").select("place").distinct(), "rejected")
    place = F.xxhash64(F.col("doc_id").cast("long"), F.col("text"))
    return docs.join(rejected, place == rejected.place, "left_anti")


@tidy
def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three repeated lines go; a document that loses all stays, empty."""
    cleaned = drop_repeated_lines(docs).withColumn("n_chars", F.length("text").cast("long"))
    return cleaned.select(docs.columns)


@tidy
def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group one document stays: the one with the smallest id.

    Rows are nodes of their own, also where they share an id: equal texts of one id are copies, of which
    one stays, and an unrelated text of that id stays too. Rows without an id all do.
    """
    # An id that names one row is its own node; further rows of an id get negative ones, told by their text.
    again = docs.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("rows"))
    again = materialise(again.filter("rows > 1").select("doc_id"), "repeated")
    named = docs
    if again.head(1):
        shared = docs.join(again, "doc_id", "left_semi")
        order = Window.partitionBy("doc_id").orderBy(F.md5("text"))
        nth = F.row_number().over(order)
        # Beyond the first row a node is made of the id and its number; texts are read from the rows.
        more = shared.withColumn("__nth", nth).filter("doc_id IS NOT NULL")
        one = docs.join(again, "doc_id", "left_anti").withColumn("__node", F.col("doc_id").cast("long"))
        made = F.when(F.col("__nth") == 1, F.col("doc_id").cast("long")).otherwise(
            F.xxhash64("doc_id", "__nth").bitwiseOR(F.lit(-(2**63)))
        )
        named = materialise(one.unionByName(more.withColumn("__node", made).drop("__nth")), "nodes")
        # A made node is below every id, so that groups are named by the least id they hold instead.
        groups = jaccard_join(named, id_column="__node").select(F.col("__node"), "component_id")
        ids = named.filter("`__node` IS NOT NULL").select("__node", "doc_id").join(groups, "__node")
        first = ids.groupBy("component_id").agg(F.min_by("__node", F.struct("doc_id", -F.col("__node"))).alias("__node"))
        kept = ids.join(first.select("__node"), "__node", "left_anti").select("__node")
        return named.join(materialise(kept, "followers"), "__node", "left_anti").select(docs.columns)
    followers = jaccard_join(docs).filter("doc_id <> component_id").select("doc_id").distinct()
    # Stored, so that Spark knows its size: only beyond that of a broadcast are the texts shuffled.
    return docs.join(materialise(followers, "followers"), "doc_id", "left_anti").select(docs.columns)


@tidy
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for every take, in the order of training; a part of a document is its first words.

    Rows are ranked without their texts, which join once, on the way into the last sort. Rows alike in
    id and text share their takes in the order of a number each.
    """
    taken = mix(docs, with_place=True).select("place", "passes", "part", "positions")
    alike = Window.partitionBy("place")
    nth = F.row_number().over(alike.orderBy("positions", "part"))
    taken = materialise(taken.withColumns({"nth": nth, "alike": F.count("*").over(alike)}), "takes")
    # Names that no column of docs can clash with: its columns travel in a struct.
    rows = docs.select(place_of("doc_id", "text").alias("place"), F.struct(*docs.columns).alias("row"))
    single = rows.join(taken.filter("alike = 1 AND size(positions) > 0"), "place")
    several = taken.filter("alike > 1")
    if several.head(1):
        of_them = rows.join(several.select("place").distinct(), "place", "left_semi").withColumn(
            "nth", F.row_number().over(alike.orderBy(F.xxhash64("row")))
        )
        single = single.unionByName(of_them.join(several, ["place", "nth"]))
    takes = single.select("row", "passes", "part", F.posexplode("positions").alias("nth", "position"))
    first_words = F.array_join(
        F.slice(F.regexp_extract_all("row.text", F.lit(f"({WORD})")), 1, F.col("part").cast("int")), " "
    )
    whole = (F.col("nth") < F.col("passes")) | (F.regexp_count("row.text", F.lit(WORD)) <= F.col("part"))
    text = F.when(whole, F.col("row.text")).otherwise(first_words)
    rows = takes.select("row", "position", text.alias("text"))
    own = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    # Only what the result holds is sorted; in a struct its names cannot clash with the order's.
    doc = F.struct(*[own.get(c, F.col(f"row.{c}")).alias(c) for c in docs.columns])
    ordered = rows.select(F.struct("position", "row.doc_id").alias("at"), doc.alias("doc")).orderBy("at")
    return ordered.select("doc.*")


@tidy
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all takes in sequences of at most 2048 tokens."""
    return pack(docs, vocabulary(), capacity=2048, end=1)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", without_toxic),
    ("line_dedup", without_repeated_lines),
    ("near_duplicates", without_near_duplicates),
    ("mixing", mixed),
    ("packing", packed),
]

# Tokenizer, classifier and checksums are beyond SQL. No test compares the rows of run() with a brute-force
# version: tests check the stages' columns, who stays of near duplicates, and the total of tokens packed.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents; each result is written and read again."""
    docs = parquet(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
