"""Phrase collocation mining over a prefix-free parse (operator 11).

Texts are cut at punctuation into pieces. A window of ``longest - 1`` words whose hash falls into one
of ``period`` classes is a trigger: it closes the chunk before it and opens the next, so that
neighbouring chunks overlap by that window and equal passages give equal chunks wherever they stand.
The distinct chunks and how often each was parsed are the dictionary.

Phrases are counted inside distinct chunks, weighted by the chunk's frequency. A phrase belongs to
the chunk in which it starts before the closing trigger; as no phrase is longer than the trigger and
one word more, every occurrence lies whole in exactly one chunk and is counted once.

Only DataFrame functions are used. All counts are summed where the rows lie before they are shuffled,
one phrase length at a time, so that no more than one length's counts are on disk at once. The phrases of
one word less that are frequent enough are known by then: a bit map of them leaves out most places that
cannot count, before anything is summed. What falls on a mark by chance is counted and found too rare.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ecocline.sources.storage import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PIECE = r"[.,;:!?\x0A-\x0D]"
PERIOD = 8
_SCALE = 1_000_000
_SLOTS = 1 << 27  # bits of a map of phrases at the most (16 MB)


def parse(
    documents: DataFrame,
    *,
    text_column: str = "text",
    lang_column: str = "lang",
    longest: int = 3,
    period: int = PERIOD,
) -> DataFrame:
    """The dictionary: ``lang``, ``chunk`` (words joined by a blank), ``owned`` (words that are not
    part of the closing trigger) and ``freq`` (how often the parse holds the chunk)."""
    window = longest - 1
    pieces = documents.select(
        F.coalesce(F.col(lang_column).cast("string"), F.lit("und")).alias("lang"),
        F.explode(F.split(F.coalesce(text_column, F.lit("")), PIECE)).alias("piece"),
    )
    ascii_ = F.octet_length("piece") == F.char_length("piece")
    lower = F.when(ascii_, F.lower("piece")).otherwise(F.translate("piece", UPPER, LOWER))
    words = F.array_remove(F.split(F.replace(lower, F.lit("\t"), F.lit(" ")), " "), "")
    worded = pieces.filter(F.col("piece").rlike(r"[^\x20\x09]")).select("lang", words.alias("w"))
    cuts = F.filter(
        F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0))),
        lambda i: (i == 0)
        | (F.pmod(F.xxhash64(*[F.get("w", i + k) for k in range(window)]), F.lit(period)) == 0),
    )
    cutting = worded.select("lang", "w", F.when(F.size("w") > window, cuts).otherwise(F.array(F.lit(0))).alias("cuts"))

    def chunk(start: Column, nth: Column) -> Column:
        end = F.get("cuts", nth + 1)
        held = F.coalesce(end + window, F.size("w")) - start
        return F.struct(
            F.array_join(F.slice("w", start + 1, held), " ").alias("chunk"),
            (F.coalesce(end, F.size("w")) - start).alias("owned"),
        )

    # The array is made inside the generator: exploding a column of it would have Spark test the
    # column's size first, by the whole chain of expressions that makes it.
    chunks = cutting.select("lang", F.inline(F.transform("cuts", chunk)))
    return chunks.groupBy("lang", "chunk", "owned").agg(F.count("*").alias("freq"))


def _slot(lang: Column, words: list[Column], slots: int) -> Column:
    return F.pmod(F.xxhash64(lang, *words), F.lit(slots))


def marks(counted: DataFrame, size: int, most: int = _SLOTS) -> tuple[DataFrame, int]:
    """One row with a bit map of the phrases of ``size`` words in ``counted``, and its number of bits.

    Every phrase of the table is marked. Others may fall on a mark, the more so the fuller the map is:
    it has 16 bits a phrase, ``most`` at the most. Its longs lie in blocks of 1024.
    """
    slots = min(max(1 << 16, 1 << (16 * counted.count()).bit_length()), most)
    words = F.split("phrase", " ")
    slot = _slot(F.col("lang"), [F.get(words, F.lit(k)) for k in range(size)], slots)
    bit = F.expr("shiftleft(1L, CAST(slot & 63 AS INT))")
    held = counted.select(slot.alias("slot")).groupBy(F.expr("slot >> 6").alias("id")).agg(F.bit_or(bit).alias("bits"))
    every = counted.sparkSession.range(slots >> 6).join(held, "id", "left").select(
        "id", F.expr("id >> 10").alias("block"), F.coalesce("bits", F.lit(0)).alias("bits")
    )
    in_order = lambda at, what: F.sort_array(F.collect_list(F.struct(at, what))).getField(what)
    blocks = every.groupBy("block").agg(in_order("id", "bits").alias("longs"))
    return materialise(blocks.agg(in_order("block", "longs").alias("blocks")), "marks"), slots


def places_of(dictionary: DataFrame, size: int, shorter: DataFrame | None = None, most: int = _SLOTS) -> DataFrame:
    """``lang``, ``phrase`` and ``freq`` of the places of ``size`` words in the dictionary's chunks.

    With ``shorter``, phrases of one word less, only places where both of these in it are marked.
    """
    split = dictionary.select("lang", F.split("chunk", " ").alias("w"), "owned", "freq")
    # Shifted copies side by side; they end early, and a place that lacks a word has NULL there. No row
    # but the chunk's own holds all of its words.
    shifted = [F.slice("w", k + 1, F.col("owned")).alias(f"w{k}") for k in range(size)]
    words = [F.col(f"w{k}") for k in range(size)]
    places = split.select("lang", "freq", F.inline(F.arrays_zip(*shifted))).filter(words[-1].isNotNull())
    if shorter is not None:
        marked, slots = marks(shorter, size - 1, most)
        map_ = marked.scalar()
        for part in (words[:-1], words[1:]):
            slot = _slot(F.col("lang"), part, slots)
            block = F.get(map_, F.shiftright(slot, 16).cast("int"))
            long = F.get(block, F.shiftright(slot, 6).bitwiseAND(1023).cast("int"))
            places = places.filter(F.getbit(long, slot.bitwiseAND(63).cast("int")) == 1)
    return places.select("lang", F.concat_ws(" ", *words).alias("phrase"), "freq")


def phrase_counts(dictionary: DataFrame, size: int, least: int, shorter: DataFrame | None = None) -> DataFrame:
    """``lang``, ``phrase`` and ``f`` of all phrases of ``size`` words that occur ``least`` times.

    ``shorter``, if given, holds all phrases of one word less that occur ``least`` times: a phrase is no
    more frequent than the two of these in it.
    """
    found = places_of(dictionary, size, shorter)
    return found.groupBy("lang", "phrase").agg(F.sum("freq").alias("f")).filter(F.col("f") >= least)


def mine_collocations(
    documents: DataFrame,
    *,
    text_column: str = "text",
    lang_column: str = "lang",
    longest: int = 3,
    least: int = 10,
    covered: int = 50,
    top: int = 2000,
    period: int = PERIOD,
) -> DataFrame:
    """The ``top`` collocations of every language, best first.

    A candidate is a phrase of 2 to ``longest`` words with a = f(phrase) >= ``least``. Cut after its
    first words it scores floor(1000000 * a * a / (l * r)), l and r being the counts of the parts; the
    lowest-scoring cut counts, ties to the smallest. A candidate goes if a longer candidate that
    holds it occurs at least ``covered`` percent as often. Returns lang, rank (by score and a, both
    descending, then phrase in byte order), phrase, a, l, r, n (words of the language) and score.

    A-Z are lower-cased. NULL and empty texts hold no words; a NULL language is ``und``. Rows that are
    alike count as often as they stand there. A language without candidates and an empty table give
    no rows. Other columns are not read, whatever their names.
    """
    dictionary = materialise(
        parse(documents, text_column=text_column, lang_column=lang_column, longest=longest, period=period),
        "chunks",
    )
    counts: list[DataFrame] = []
    for k in range(1, longest + 1):
        shorter = counts[-1] if counts else None
        counts.append(materialise(phrase_counts(dictionary, k, least, shorter), f"phrases{k}"))
    words = dictionary.groupBy("lang").agg(F.sum(F.col("freq") * F.col("owned")).alias("n"))
    parts, candidates = counts[0], counts[1].withColumn("size", F.lit(2))
    for k, table in enumerate(counts[1:], start=2):
        if k < longest:
            parts = parts.unionByName(table)
        if k > 2:
            candidates = candidates.unionByName(table.withColumn("size", F.lit(k)))

    cut = F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("cut")
    cuts = candidates.select("lang", "phrase", F.col("f").alias("a"), "size", cut).select(
        "lang", "phrase", "a", "cut",
        F.expr("substring_index(phrase, ' ', cut)").alias("head"),
        F.expr("substring_index(phrase, ' ', cut - size)").alias("tail"),
    )
    side = lambda part, count: parts.select(
        "lang", F.col("phrase").alias(part), F.col("f").alias(count)
    )
    scored = cuts.join(side("head", "l"), ["lang", "head"]).join(side("tail", "r"), ["lang", "tail"])
    wide = lambda c: f"CAST({c} AS DECIMAL(19, 0))"
    # The score is at most _SCALE, as no part is rarer than the phrase; the products need 38 digits.
    score = F.expr(f"({wide('a')} * {wide('a')}) * {_SCALE} div ({wide('l')} * {wide('r')})")
    best = scored.groupBy("lang", "phrase", "a").agg(
        F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("best")
    )
    inner = lambda w, k, i: F.array_join(F.slice(w, i, k), " ")
    longer = candidates.filter("size > 2").select("lang", "f", "size", F.split("phrase", " ").alias("w"))
    inside = F.flatten(F.transform(
        F.sequence(F.lit(2), F.col("size") - 1),
        lambda k: F.transform(F.sequence(F.lit(1), F.col("size") - k + 1), lambda i: inner(F.col("w"), k, i)),
    ))
    around = longer.select("lang", "f", F.explode(inside).alias("phrase")).groupBy("lang", "phrase").agg(
        F.max("f").alias("around")
    )
    kept = best.join(around, ["lang", "phrase"], "left").filter(
        F.col("around").isNull() | (100 * F.col("around") < covered * F.col("a"))
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.select("lang", "phrase", "a", "best.l", "best.r", "best.score").withColumn(
        "rank", F.row_number().over(order)
    ).filter(F.col("rank") <= top)
    return ranked.join(words, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
