"""Long texts that have only a passage in common are not listed in pairs by the Jaccard join."""

from __future__ import annotations

import random

import numpy as np
import pytest

from ecocline.llm import jaccard
from ecocline.llm.jaccard import differing, sketch_of


def test_texts_with_a_common_passage_are_told_apart_inside_the_join(spark, monkeypatch):
    rnd = random.Random(3)
    passage = [f"p{i}" for i in range(300)]
    rows = []
    for i in range(40):
        words = passage + [f"t{i}_{k}" for k in range(rnd.choice([715, 728, 900, 1700]))]
        rows.append((10 * i, " ".join(words)))
        if i % 4 == 0:  # linked, over both sides of 1024 shingles too
            for k in (1, 2):
                rows.append((10 * i + k, " ".join([*words, *(f"more{i}_{k}_{n}" for n in range(25 * k))])))
    made = []
    listed = jaccard._listed
    monkeypatch.setattr(jaccard, "_listed", lambda meet: made.append(meet) or listed(meet))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in jaccard.jaccard_join(docs).collect()}
    assert found == {i: i // 10 * 10 for i, _ in rows}
    assert made[0].count() < 150  # 988 by 256 bits, which cannot tell texts of a thousand words apart


@pytest.mark.parametrize(("left", "right"), [(3, 4), (250, 300), (500, 600), (1000, 1100), (2000, 2100), (3000, 3000)])
def test_distance_inside_the_join_is_a_lower_bound(spark, left, right):
    rng = np.random.default_rng(left)
    pool = np.unique(rng.integers(0, 1 << 63, 3 * right, dtype=np.uint64))
    rng.shuffle(pool)
    for common in (0, left // 2, left):
        x, y = np.sort(pool[:left]), np.sort(np.concatenate([pool[:common], pool[left : left + right - common]]))
        made = spark.createDataFrame([(bytearray(sketch_of(x)), bytearray(sketch_of(y)))], "x binary, y binary")
        made = made.select(jaccard._bits("x").alias("x"), jaccard._bits("y").alias("y"))
        ours, bits, back = made.select(jaccard._apart("x", "y"), 64 * jaccard.F.size("x"), jaccard._apart("y", "x")).first()
        assert ours == back <= differing(sketch_of(x), sketch_of(y)) <= len(np.setxor1d(x, y))
        assert 2 * bits >= left and (ours - len(np.setxor1d(x, y))) % 2 == 0
        if left > 500:
            assert (180 * ours <= 20 * (left + right)) == (common == left)


def test_sketches_of_very_different_lengths_are_not_compared(spark):
    rows = [(bytearray(sketch_of(np.arange(1, n, dtype=np.uint64))),) for n in (300, 9000)]
    made = spark.createDataFrame(rows, "s binary").select(jaccard._bits("s").alias("x"))
    pairs = made.crossJoin(made.withColumnRenamed("x", "y")).filter("size(x) <> size(y)")
    assert [r[0] for r in pairs.select(jaccard._apart("x", "y")).collect()] == [None, None]
