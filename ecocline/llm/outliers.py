"""Quality rules by robust multivariate outliers (operator 12).

Every text gets simple statistics and fails the base rules if it is too short or repeats itself. Of the
others, a vector of transformed statistics is compared with those of its language and source: the
squared Mahalanobis distance under a minimum-covariance-determinant estimate rejects it beyond a chi-square
quantile.

The estimate of a group is the mean and covariance of the share ``half`` of its rows whose covariance has
the smallest determinant. From three robust starts (quartile scales alone, and those with the correlations
of squashed values and of spatial signs) concentration steps take the rows nearest to the last estimate until
nothing changes; the start with the smallest determinant wins and is reweighted once by the rows within the
97.5 % quantile. All groups and starts take a step in one pass over all rows: distances fall into
logarithmic bins a hundredth apart, each bin returns its count and moments, and of the bin that the
share ends in every row counts for the same part.

Statistics are whole multiples of 1/1024 and their moments whole numbers, so that results do not
depend on the order of rows. A covariance gets the square of each statistic's least scale on its
diagonal: most texts have no symbols or repeats at all, and a deviation below that scale means nothing.
Groups below ``least`` rows share the estimate of their language's other small groups, and where
those are too few as well that of all such rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ecocline.llm.wording import batches, named, numbered
from ecocline.sources.storage import materialise

SYMBOLS = "#*$%&|<>"
_UNIT = 1024  # statistics are whole multiples of 1 / _UNIT
_FINE = 1 << 20  # of the starts' bounded products
_BINS, _STEP = 4000, 70.0  # bins of distance, and bins to one e-fold
_ROUNDS = 25
_PRIOR_WORDS, _PRIOR_LENGTH = 50, 5.0  # short texts lean towards words of this length

#: Statistic and its least scale: a deviation that says nothing about a text.
FEATURES = {"length": 1.0, "word_length": 0.05, "symbols": 0.4, "dup_lines": 0.1, "repeats": 0.06}


def chi_square_share(x: float, df: int) -> float:
    """Chi-square distribution function."""
    if x <= 0:
        return 0.0
    k, share = (1, math.erf(math.sqrt(x / 2))) if df % 2 else (2, -math.expm1(-x / 2))
    while k < df:
        share -= math.exp(k / 2 * math.log(x / 2) - x / 2 - math.lgamma(k / 2 + 1))
        k += 2
    return share


def chi_square_quantile(p: float, df: int) -> float:
    low, high = 0.0, 1.0
    while chi_square_share(high, df) < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_share(mid, df) < p else (low, mid)
    return high


def consistency(share: float, df: int) -> float:
    """What the covariance of the nearest ``share`` of normal rows is to be multiplied by."""
    if share >= 1:
        return 1.0
    return share / chi_square_share(chi_square_quantile(share, df), df + 2)


def _byte_marks() -> tuple[np.ndarray, np.ndarray]:
    starts_sign, symbol = np.zeros(256, dtype=np.int8), np.zeros(256, dtype=np.int8)
    starts_sign[[b for b in range(256) if b & 0xC0 != 0x80 and b != 0x20 and not 9 <= b <= 13]] = 1
    symbol[[ord(c) for c in SYMBOLS]] = 1
    return starts_sign, symbol


_SIGN, _SYMBOL = _byte_marks()


def repeated_words(numbers: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """Words of every text that lie in a window of ``window`` words found twice or more in it."""
    texts = len(starts) - 1
    owner = np.repeat(np.arange(texts), np.diff(starts))
    if len(numbers) < window:
        return np.zeros(texts, dtype=np.int64)
    name = numbers
    for k in range(1, window):
        name = named(name[:-1], numbers[k:])
    whole = np.flatnonzero(owner[: len(name)] == owner[window - 1 :])
    own = named(name[whole], owner[whole])
    again = whole[np.bincount(own)[own] > 1] if len(own) else whole
    marks = np.zeros(len(numbers) + 1, dtype=np.int64)
    marks[again] += 1
    np.subtract.at(marks, again + window, 1)
    return np.bincount(owner[np.cumsum(marks[:-1]) > 0], minlength=texts)


def _statistics(texts: list[bytes], words: list[list[bytes]], window: int) -> list[np.ndarray]:
    numbers, starts = numbered(words)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    filled = np.flatnonzero(sizes)
    raw = np.frombuffer(b"".join(texts), dtype=np.uint8)
    chars, symbols = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
    if len(filled):
        begins = (np.cumsum(sizes) - sizes)[filled]
        chars[filled] = np.add.reduceat(_SIGN[raw], begins, dtype=np.int64)
        symbols[filled] = np.add.reduceat(_SYMBOL[raw], begins, dtype=np.int64)
    lines = [[x for x in t.split(b"\n") if x.strip()] for t in texts]
    n_lines = np.array([len(x) for x in lines], dtype=np.int64)
    dup = n_lines - np.array([len(set(x)) for x in lines], dtype=np.int64)
    return [np.diff(starts), chars, symbols, n_lines, dup, repeated_words(numbers, starts, window)]


COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def text_statistics(documents: DataFrame, text: Column, keep: Sequence[Column], window: int = 5) -> DataFrame:
    """The ``keep`` columns (strings and longs) and the counts of ``COUNTS`` for every row."""
    source = documents.select(*keep, F.coalesce(text, F.lit("")).alias("__text"))
    schema = source.drop("__text").schema
    for c in COUNTS:
        schema = schema.add(c, "long")
    fields = schema.names[: -len(COUNTS)]

    def rows(held: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in held:
            texts = batch.column("__text").cast(pa.binary()).to_pylist()
            for at, words in batches(texts):
                counts = _statistics(texts[at : at + len(words)], words, window)
                kept = [batch.column(c).slice(at, len(words)) for c in fields]
                yield pa.RecordBatch.from_arrays(
                    [*kept, *(pa.array(c, pa.int64()) for c in counts)], names=[*fields, *COUNTS]
                )

    return source.mapInArrow(rows, schema)


def feature_columns() -> dict[str, Column]:
    """The transformed statistics, as whole multiples of 1 / 1024."""
    c, one = F.col, F.greatest(F.col("n_words"), F.lit(1))
    smooth = c("n_words") + _PRIOR_WORDS
    values = {
        "length": F.log(one),
        "word_length": F.log((c("word_chars") + _PRIOR_WORDS * _PRIOR_LENGTH) / smooth),
        "symbols": F.log(1 + 100 * c("n_symbols") / smooth),
        "dup_lines": c("n_dup_lines") / (c("n_lines") + 1),
        "repeats": c("n_repeat_words") / one,
    }
    return {k: F.round(v * _UNIT).cast("long") for k, v in values.items()}


def _pairs(p: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(p) for j in range(i, p)]


def _symmetric(upper: np.ndarray, p: int) -> np.ndarray:
    out = np.zeros((len(upper), p, p))
    for k, (i, j) in enumerate(_pairs(p)):
        out[:, i, j] = out[:, j, i] = upper[:, k]
    return out


_STATE = "centre array<double>, inverse array<double>, logdet double"


def _state(centre: np.ndarray, cov: np.ndarray) -> dict[str, list]:
    inverse = np.linalg.inv(cov)
    upper = np.stack([inverse[:, i, j] for i, j in _pairs(cov.shape[1])], axis=1)
    return {"centre": list(centre), "inverse": list(upper), "logdet": np.linalg.slogdet(cov)[1]}


def _distance(names: Sequence[str]) -> Column:
    """Squared Mahalanobis distance of the statistics from the state beside them."""
    off = [F.col(c) / float(_UNIT) - F.col("centre")[i] for i, c in enumerate(names)]
    total = F.lit(0.0)
    for k, (i, j) in enumerate(_pairs(len(names))):
        total = total + (1 if i == j else 2) * F.col("inverse")[k] * off[i] * off[j]
    return F.greatest(total, F.lit(0.0))


def _moments(names: Sequence[str]) -> list[Column]:
    c = F.col
    return [
        F.count("*").alias("n"),
        *[F.sum(x).alias(f"s{i}") for i, x in enumerate(names)],
        *[F.sum(c(names[i]) * c(names[j])).alias(f"q{k}") for k, (i, j) in enumerate(_pairs(len(names)))],
    ]


def _moment_names(p: int) -> list[str]:
    return [f"s{i}" for i in range(p)] + [f"q{k}" for k in range(len(_pairs(p)))]


def _starts(rows: DataFrame, names: Sequence[str], floors: np.ndarray) -> DataFrame:
    """Three estimates ``(cell, start, centre, inverse, logdet)`` of every cell.

    Quartiles are exact: a statistic takes a bounded number of values, and Spark counts those.
    """
    p, c = len(names), F.col
    quartiles = rows.groupBy("cell").agg(
        *[F.percentile(x, [0.25, 0.5, 0.75]).alias(f"__{x}") for x in names]
    )
    scale = lambda x, f: F.sqrt(
        F.pow((c(f"__{x}")[2] - c(f"__{x}")[0]) / (1.349 * _UNIT), F.lit(2)) + f * f
    )
    framed = quartiles.select(
        "cell", F.array(*[c(f"__{x}")[1] / float(_UNIT) for x in names]).alias("centre"),
        F.array(*[scale(x, float(f)) for x, f in zip(names, floors)]).alias("scale"),
    )
    z = [(c(x) / float(_UNIT) - c("centre")[i]) / c("scale")[i] for i, x in enumerate(names)]
    zs = rows.join(framed, "cell").select("cell", "centre", "scale", *[v.alias(f"z{i}") for i, v in enumerate(z)])
    norm = F.greatest(sum(((c(f"z{i}") * c(f"z{i}") for i in range(p))), F.lit(0.0)), F.lit(1e-12))
    whole = lambda v: F.sum(F.round(v * _FINE).cast("long"))
    sums = zs.groupBy("cell").agg(
        F.first("centre").alias("centre"), F.first("scale").alias("scale"),
        F.array(*[whole(F.tanh(f"z{i}") * F.tanh(f"z{j}")) for i, j in _pairs(p)]).alias("t"),
        F.array(*[whole(c(f"z{i}") * c(f"z{j}") / norm) for i, j in _pairs(p)]).alias("u"),
    )

    def solve(held: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in held:
            if not len(pdf):
                continue
            centre, scale = np.stack(pdf["centre"]), np.stack(pdf["scale"])
            outer = scale[:, :, None] * scale[:, None, :]
            for start, column in enumerate((None, "t", "u")):
                corr = np.broadcast_to(np.eye(p), outer.shape)
                if column:
                    m = _symmetric(np.stack(pdf[column]).astype(float), p)
                    spread = np.sqrt(np.maximum(np.einsum("nii->ni", m), 1e-9))
                    corr = m / (spread[:, :, None] * spread[:, None, :])
                    corr = 0.95 * corr + 0.05 * np.eye(p)
                    corr[:, range(p), range(p)] = 1.0
                yield pd.DataFrame({"cell": pdf["cell"], "start": start} | _state(centre, outer * corr))

    return sums.mapInPandas(solve, f"cell long, start int, {_STATE}")


def _fit(parts: DataFrame, names: Sequence[str], floors: np.ndarray, factor: Column) -> DataFrame:
    """States from one row of weighted moments a cell and start; ``factor`` makes them consistent."""
    p = len(names)
    sums = F.array(*[F.col(m).cast("double") for m in _moment_names(p)])
    ready = parts.select("cell", "start", F.col("n").cast("double").alias("n"), sums.alias("m"),
                         factor.cast("double").alias("factor"))

    def solve(held: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in held:
            if not len(pdf):
                continue
            m, n = np.stack(pdf["m"]), pdf["n"].to_numpy()[:, None]
            mean = m[:, :p] / n
            cov = _symmetric(m[:, p:] / n, p) - mean[:, :, None] * mean[:, None, :]
            cov = cov / _UNIT**2 * pdf["factor"].to_numpy()[:, None, None] + np.diag(floors**2)
            yield pd.DataFrame(
                {"cell": pdf["cell"], "start": pdf["start"]} | _state(mean / _UNIT, cov)
            )

    return ready.mapInPandas(solve, f"cell long, start int, {_STATE}")


def _concentrated(rows: DataFrame, states: DataFrame, names: Sequence[str], floors: np.ndarray, half: float):
    """One concentration step of all cells and starts."""
    c, moments = F.col, _moment_names(len(names))
    bin_ = F.least(F.floor(F.log1p(_distance(names)) * _STEP), F.lit(_BINS)).cast("int")
    binned = rows.join(states, "cell").withColumn("bin", bin_)
    bins = binned.groupBy("cell", "start", "bin").agg(*_moments(names))
    # A cell's bins are few: they are summed in one array, in order.
    listed = bins.groupBy("cell", "start").agg(
        F.array_sort(F.collect_list(F.struct("bin", "n", *moments))).alias("bins"), F.sum("n").alias("rows")
    )
    wanted = F.ceil(half * c("rows")).cast("double")

    def taken(state: Column, b: Column) -> Column:
        part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (wanted - state["n"]) / b["n"]))
        return F.struct(
            (state["n"] + part * b["n"]).alias("n"),
            *[(state[m] + part * b[m]).alias(m) for m in moments],
        )

    zero = F.struct(*[F.lit(0.0).alias(m) for m in ("n", *moments)])
    sums = listed.select("cell", "start", "rows", F.aggregate("bins", zero, taken).alias("s"))
    return _fit(sums.select("cell", "start", "s.*"), names, floors, F.lit(consistency(half, len(names))))


def robust_estimates(
    rows: DataFrame, names: Sequence[str], floors: Sequence[float], half: float = 0.6
) -> DataFrame:
    """Reweighted minimum-covariance-determinant estimate ``(cell, centre, inverse)`` of every cell.

    ``rows`` hold ``cell`` (long) and the statistics ``names``, whole multiples of 1 / 1024.
    """
    floors = np.asarray(floors, dtype=float)
    states = materialise(_starts(rows, names, floors), "starts")
    before = None
    for _ in range(_ROUNDS):
        states = materialise(_concentrated(rows, states, names, floors, half), "concentrated")
        # settled once no determinant falls any more (beyond rounding)
        now = states.agg(F.sum(F.round("logdet", 4).cast("decimal(30, 4)")), F.count("*")).first()
        if now == before:
            break
        before = now
    best = states.groupBy("cell").agg(F.min_by(F.struct("centre", "inverse"), F.struct("logdet", "start")).alias("b"))
    best = best.select("cell", F.lit(0).alias("start"), "b.*")
    share, p = 0.975, len(names)
    near = rows.join(best, "cell").filter(_distance(names) <= chi_square_quantile(share, p))
    parts = near.groupBy("cell", "start").agg(*_moments(names))
    return _fit(parts, names, floors, F.lit(consistency(share, p))).select("cell", "centre", "inverse")


def _cells(counted: DataFrame, groups: Sequence[str], least: int) -> DataFrame:
    """``groups`` and the number of the cell whose estimate serves them; 0 pools what is left."""
    first = groups[0]
    small = counted.filter(F.col("n") < least)
    pools = small.groupBy(first).agg(F.sum("n").alias("pooled"))
    joined = counted.alias("c").join(pools.alias("p"), F.expr(f"c.{first} <=> p.{first}"), "left")
    # Two hashes of the names make the number; of a group a long, so that it joins fast.
    name = lambda cols, seed: F.xxhash64(
        F.lit(seed), *[F.coalesce(F.concat(F.lit("="), F.col(f"c.{c}")), F.lit("")) for c in cols]
    )
    cell = (
        F.when(F.col("c.n") >= least, name(groups, "own"))
        .when(F.col("pooled") >= least, name(groups[:1], "pool")).otherwise(F.lit(0).cast("long"))
    )
    return joined.select(*[f"c.{g}" for g in groups], cell.alias("cell"))


def judge_quality(
    documents: DataFrame,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    lang_column: str = "lang",
    source_column: str = "source",
    least_words: int = 10,
    repeat_percent: int = 20,
    half: float = 0.6,
    quantile: float = 0.9999,
    least: int = 100,
) -> DataFrame:
    """Statistics, base rules and the robust verdict for every row.

    Returns id_column, n_words, word_chars (code points in words), n_symbols, n_dup_lines (lines with a
    word that equal an earlier one), n_repeat_words (words in 5-word windows that occur again),
    base_failed (below ``least_words``, or more than ``repeat_percent`` of the words repeated), distance
    (squared, NULL where nothing was judged) and kept.

    Words are what blanks and 0x09 to 0x0D separate. NULL and empty texts have none and fail. A NULL
    language or source is one of its own. Estimates are of all rows that pass the base rules; where even
    all small groups together have fewer than ``least`` rows, theirs are kept without a verdict. Every
    input row gives one row, rows alike and NULL ids included; an empty table gives none. Other columns
    are not read, whatever their names.
    """
    groups = ["lang", "source"]
    keep = [
        F.col(id_column).cast("long").alias("id"), F.col(lang_column).cast("string").alias("lang"),
        F.col(source_column).cast("string").alias("source"),
    ]
    counted = text_statistics(documents, F.col(text_column), keep)
    failed = (F.col("n_words") < least_words) | (
        100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words")
    )
    names = list(FEATURES)
    stats = materialise(counted.withColumn("base_failed", failed).withColumns(feature_columns()), "statistics")
    passed = stats.filter("NOT base_failed")
    cells = materialise(_cells(passed.groupBy(*groups).agg(F.count("*").alias("n")), groups, least), "cells")
    celled = stats.alias("s").join(
        cells.alias("g"), F.expr(" AND ".join(f"s.{g} <=> g.{g}" for g in groups)), "left"
    ).select("s.*", "cell")
    judged_rows = materialise(
        celled.filter("NOT base_failed").select("cell", *names), "vectors"
    )
    enough = judged_rows.groupBy("cell").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    rows = judged_rows.join(enough.select("cell"), "cell", "left_semi")
    estimates = materialise(robust_estimates(rows, names, list(FEATURES.values()), half), "estimates")
    limit = chi_square_quantile(quantile, len(names))
    out = celled.join(estimates, "cell", "left").withColumn(
        "distance", F.when(~F.col("base_failed") & F.col("centre").isNotNull(), _distance(names))
    )
    kept = ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= limit)
    counts = [c for c in COUNTS if c != "n_lines"]
    return out.select(
        F.col("id").alias(id_column), *counts, "base_failed", F.round("distance", 6).alias("distance"),
        kept.alias("kept"),
    )
