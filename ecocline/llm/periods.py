"""Periodic runs of words by recompression (operator 13).

A run is a stretch of words that repeats with its smallest period q over at least ``least_powers``
periods and ``least_length`` words, and that no neighbouring word extends.

The words of many texts stand in one row, a number of its own after each text. Candidates come from a
harmonic grid: a run of four periods q holds four neighbouring multiples of q, whose words are equal;
over all q the grid has n ln n places. Only texts with a candidate go further.

Recompression makes them a run-length grammar. Levels alternate: block compression replaces the
repetitions of a symbol by one symbol, pair compression splits the symbols into two classes by a hash
and replaces every left symbol followed by a right one. A cut depends on its two neighbours alone, so
equal stretches are cut alike but for a few symbols at their edges, and each level shrinks by a
constant share until one symbol is left of every text. The grammar keeps, level by level, the symbols, their
lengths in words, and for every symbol where it lies in the next level.

An extension query (how many words after, or before, two places are equal) climbs: both places skip
equal symbols until both stand at a cut of the next level; at a difference it goes down again, taking
one equal child a level. That is a constant number of steps a level, done for all candidates at once.
A candidate (i, i + q) with f equal words ahead and b behind is the run of b + q + f words. A stretch
found with several periods keeps the smallest: all are its multiples, as four of the largest fit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ecocline.llm.common import mix
from ecocline.llm.wording import batches, named, numbered

_U = np.uint64
_QUERIES = 1 << 19  # candidates extended at once


@dataclass
class Level:
    """One line of the grammar: symbols, and where each stands in the line above."""

    symbol: np.ndarray
    length: np.ndarray  # words of one symbol
    parent: np.ndarray  # place in the next line; empty on the last
    first: np.ndarray  # of every place of the next line, its first place here
    last: np.ndarray
    blocks: bool  # the next line merges repetitions, not pairs


def grammar(words: np.ndarray, texts: int) -> list[Level]:
    """Lines from the words up to one symbol for every text.

    Negative numbers are ends of texts: each occurs once, and they are never merged.
    """
    levels: list[Level] = []
    symbol, length = words, np.ones(len(words), dtype=np.int64)
    step = 0
    while True:
        n = len(symbol)
        inner = symbol >= 0
        if step % 2 == 0:
            joined = (symbol[1:] == symbol[:-1]) & inner[1:]
        else:
            # hashes of the symbols with the step, so that each line draws the classes anew
            left = (mix(symbol.astype(_U) * _U(0x9E3779B97F4A7C15) + _U(step)) >> _U(63)).astype(bool)
            joined = inner[1:] & inner[:-1] & left[:-1] & ~left[1:]
        if not joined.any():
            if step % 2 == 1 and int(inner.sum()) <= texts:
                levels.append(Level(symbol, length, symbol[:0], symbol[:0], symbol[:0], False))
                return levels
            step += 1  # nothing to merge in this line: the next way, or other classes
            continue
        fresh = np.concatenate([[True], ~joined])
        first = np.flatnonzero(fresh)
        last = np.concatenate([first[1:], [n]]) - 1
        levels.append(Level(symbol, length, np.cumsum(fresh) - 1, first, last, step % 2 == 0))
        # a block is named by its symbol and count, a pair by both symbols; single symbols keep their own
        merged = last > first
        with_ = last - first + 1 if step % 2 == 0 else symbol[last]
        name = symbol[first].copy()
        base = int(symbol.max()) + 1
        name[merged] = base + named(symbol[first[merged]], with_[merged])
        words_of = np.concatenate([[0], np.cumsum(length)])
        length = words_of[last + 1] - words_of[first]
        # numbers stay small: the symbols of a line are renumbered
        kept = name >= 0
        name[kept] = pd.factorize(name[kept])[0]
        symbol = name
        step += 1


def extensions(levels: list[Level], one: np.ndarray, two: np.ndarray, ahead: bool) -> np.ndarray:
    """How many words from places ``one`` and ``two`` on, ahead or backwards, are equal.

    The row starts and ends with an end of a text, so that every query meets a difference.
    """
    way = 1 if ahead else -1
    equal = np.zeros(len(one), dtype=np.int64)
    x, y = one.copy(), two.copy()
    at = np.full(len(one), -1, dtype=np.int64)  # the line in which the difference was met
    climbing = np.arange(len(one))
    for k, level in enumerate(levels):
        if not len(climbing):
            break
        top = not len(level.parent)
        edge = level.first if ahead else level.last
        todo = climbing
        up: list[np.ndarray] = []
        while len(todo):
            i, j = x[todo], y[todo]
            differ = level.symbol[i] != level.symbol[j]
            at[todo[differ]] = k
            todo, i, j = todo[~differ], i[~differ], j[~differ]
            if not len(todo):
                break
            if top:
                x[todo] += way
                y[todo] += way
                equal[todo] += level.length[i]
                continue
            p, q = level.parent[i], level.parent[j]
            ready = (edge[p] == i) & (edge[q] == j)
            up.append(todo[ready])
            todo, i, j, p, q = (v[~ready] for v in (todo, i, j, p, q))
            if level.blocks:  # as many repetitions as both still have
                far = level.last if ahead else level.first
                steps = np.minimum(abs(far[p] - i), abs(far[q] - j)) + 1
            else:
                steps = 1
            equal[todo] += level.length[i] * steps
            x[todo] += way * steps
            y[todo] += way * steps
        climbing = np.concatenate(up) if up else climbing[:0]
        if not top:
            x[climbing] = level.parent[x[climbing]]
            y[climbing] = level.parent[y[climbing]]
    for k in range(len(levels) - 1, 0, -1):
        down = np.flatnonzero(at == k)
        if not len(down):
            continue
        below = levels[k - 1]
        near, far = (below.first, below.last) if ahead else (below.last, below.first)
        i, j = near[x[down]], near[y[down]]
        same = below.symbol[i] == below.symbol[j]
        steps = 1 if not below.blocks else (
            np.minimum(abs(far[x[down]] - i), abs(far[y[down]] - j)) + 1
        )
        steps = np.where(same, steps, 0)
        equal[down] += below.length[i] * steps
        x[down], y[down] = i + way * steps, j + way * steps
        at[down] = k - 1
    return equal


def grid_candidates(words: np.ndarray, longest: int, powers: int) -> tuple[np.ndarray, np.ndarray]:
    """Places i and periods q at which ``powers`` neighbouring multiples of q hold one word.

    ``longest`` is the number of words of the longest text: no period beyond its share is tried.
    """
    places, periods = [], []
    for q in range(1, longest // powers + 1):
        grid = words[::q]
        if len(grid) < powers:
            break
        same = grid[1:] == grid[:-1]
        for _ in range(powers - 2):
            same = same[1:] & same[: len(same) - 1]
        hits = np.flatnonzero(same)
        if len(hits):
            places.append(hits * q)
            periods.append(np.full(len(hits), q, dtype=np.int64))
    if not places:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate(places), np.concatenate(periods)


def runs(
    words: np.ndarray, starts: np.ndarray, least_length: int = 6, least_powers: int = 4
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, start in the text, length and period of every run, by text, start and period.

    ``words`` are the numbers of all texts in a row; text t is ``words[starts[t]:starts[t + 1]]``.
    """
    sizes = np.diff(starts)
    row, begins = _with_ends(words, starts)
    places, periods = grid_candidates(row, int(sizes.max(initial=0)), least_powers)
    nothing = np.zeros(0, dtype=np.int64)
    # Only texts that hold a candidate are compressed.
    owner = np.searchsorted(begins, places, side="right") - 1
    within = places + (least_powers - 1) * periods < (begins + sizes)[owner]
    places, periods, owner = places[within], periods[within], owner[within]
    some = np.unique(owner)
    if not len(some):
        return nothing, nothing, nothing, nothing
    lie = np.zeros(len(some) + 1, dtype=np.int64)
    np.cumsum(sizes[some], out=lie[1:])
    row, inner = _with_ends(
        np.concatenate([words[starts[t] : starts[t + 1]] for t in some]), lie
    )
    at = np.searchsorted(some, owner)
    places = places - begins[owner] + inner[at]
    levels = grammar(row, len(some))
    found = [(nothing, nothing, nothing, nothing)]
    for a in range(0, len(places), _QUERIES):
        i, q, t = (v[a : a + _QUERIES] for v in (places, periods, at))
        ahead = extensions(levels, i, i + q, ahead=True)
        behind = extensions(levels, i - 1, i + q - 1, ahead=False)
        length = behind + q + ahead
        enough = length >= np.maximum(least_length, least_powers * q)
        made = (some[t], i - behind - inner[t], length, q)
        found.append(_smallest(*(v[enough] for v in made)))
    text, start, length, period = _smallest(*(np.concatenate(v) for v in zip(*found)))
    order = np.lexsort((period, start, text))
    return text[order], start[order], length[order], period[order]


def _smallest(text, start, length, period) -> tuple[np.ndarray, ...]:
    """Every stretch once, with its smallest period."""
    order = np.lexsort((period, length, start, text))
    text, start, length, period = (v[order] for v in (text, start, length, period))
    fresh = np.ones(len(text), dtype=bool)
    fresh[1:] = (np.diff(text) != 0) | (np.diff(start) != 0) | (np.diff(length) != 0)
    return text[fresh], start[fresh], length[fresh], period[fresh]


def _with_ends(words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words with an end before, between and after texts, and where each text starts then."""
    texts = len(starts) - 1
    row = np.empty(len(words) + texts + 1, dtype=np.int64)
    begins = starts[:-1] + np.arange(1, texts + 1)
    ends = np.concatenate([[0], begins + np.diff(starts)])
    inner = np.ones(len(row), dtype=bool)
    inner[ends] = False
    row[inner] = words
    row[ends] = -1 - np.arange(texts + 1)
    return row, begins


def find_runs(
    documents: DataFrame,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    least_length: int = 6,
    least_powers: int = 4,
) -> DataFrame:
    """Runs of every text and the text without their repetitions.

    Returns id_column, n_words, runs (array of start, length and period in words, by start, then
    period) and collapsed: the words that no run repeats (each run keeps its first period), joined by one blank.

    Words are what blanks and 0x09 to 0x0D separate, compared exactly. NULL and empty texts have no
    words, no runs and an empty collapsed text. Every input row gives one row, rows alike and NULL
    ids included; an empty table gives none. Other columns are not read, whatever their names.
    ``least_powers`` is 3 at least.
    """
    if least_powers < 3:
        raise ValueError("least_powers must be 3 at least")
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    schema = pa.schema([
        ("id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(run)), ("collapsed", pa.string())
    ])

    def rows(held: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in held:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for at, words in batches(texts):
                numbers, starts = numbered(words)
                text, start, length, period = runs(numbers, starts, least_length, least_powers)
                begin = starts[text] + start
                marks = np.zeros(len(numbers) + 1, dtype=np.int64)
                np.add.at(marks, begin + period, 1)
                np.add.at(marks, begin + length, -1)
                kept = np.cumsum(marks[:-1]) == 0
                collapsed = [
                    b" ".join(w if k.all() else [v for v, keep in zip(w, k) if keep]).decode("utf-8")
                    for w, k in ((w, kept[a:b]) for w, a, b in zip(words, starts[:-1], starts[1:]))
                ]
                offsets = np.searchsorted(text, np.arange(len(words) + 1))
                structs = pa.StructArray.from_arrays(
                    [pa.array(v, pa.int64()) for v in (start, length, period)], fields=list(run)
                )
                yield pa.RecordBatch.from_arrays([
                    batch.column("id").slice(at, len(words)), pa.array(np.diff(starts), pa.int64()),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs),
                    pa.array(collapsed, pa.string()),
                ], schema=schema)

    source = documents.select(
        F.col(id_column).cast("long").alias("id"), F.coalesce(text_column, F.lit("")).alias("text")
    )
    found = source.mapInArrow(
        rows,
        "id long, n_words long, runs array<struct<start: long, length: long, period: long>>, "
        "collapsed string",
    )
    return found.withColumnRenamed("id", id_column)
