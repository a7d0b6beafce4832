"""Search, vector links and url rules on missing, empty, repeated and odd rows, against plain versions."""

from __future__ import annotations

import numpy as np
import pytest

from ecocline.llm import topk, urls, vectors

#: Columns with the names that operators use inside.
CLASH = ["id", "vector", "query", "far", "x", "h1", "rep", "tab", "code", "key", "host", "rule"]


def _table(spark, rows, kind):
    names = ", ".join(f"{c} string" for c in CLASH)
    return spark.createDataFrame([(*r, *["z"] * len(CLASH)) for r in rows], f"vec_id long, embedding array<{kind}>, {names}")


def _best(rows, k):
    """query -> [(id, score)], by plain products: best score of an id, ties to the smaller id."""
    fit = [(i, v) for i, v in rows if i is not None and v and None not in v]
    out = {}
    for q in {i for i, _ in fit if i % 100 == 0}:
        scores: dict = {}
        for own, v in ((i, v) for i, v in fit if i == q):
            for i, w in fit:
                if i != q and len(w) == len(v):
                    s = sum(a * b for a, b in zip(v, w))
                    scores[i] = max(s, scores.get(i, s))
        out[q] = sorted(scores.items(), key=lambda t: (-t[1], t[0]))[:k]
    return {q: b for q, b in out.items() if b}


@pytest.mark.parametrize("block", [3, 8192])
def test_search_over_odd_rows(spark, block):
    rng = np.random.default_rng(8)
    rows = [(i, [int(x) for x in rng.integers(-9, 10, 4)]) for i in range(1, 30)]
    rows += [(100, [3, 0, -2, 5]), (200, [0, 0, 0, 0]), (300, None), (400, []), (500, [1, None, 2, 3]), (None, [9, 9, 9, 9])]
    rows += [(31, [1, 2]), (600, [4, 4]), (7, rows[6][1]), (8, [9, 9, 9, 9]), (700, [7])]  # other lengths, repeated ids
    rows += [(i, [5, 5, 5, 5]) for i in range(40, 55)]  # ties at the tenth place
    out = topk.top_k(_table(spark, rows, "long"), "vec_id % 100 = 0", block=block)
    found: dict = {}
    for r in sorted(out.collect(), key=lambda r: (r.query_id, r["rank"])):
        assert r["rank"] == len(found.setdefault(r.query_id, [])) + 1
        found[r.query_id].append((r.vec_id, r.score))
    assert found == _best(rows, 10)


def test_search_without_rows(spark):
    empty = _table(spark, [(1, [1])], "long").limit(0)
    assert topk.top_k(empty, "vec_id % 100 = 0").count() == 0
    assert topk.top_k(_table(spark, [(100, None), (1, None)], "long"), "vec_id % 100 = 0").count() == 0


@pytest.mark.parametrize("block", [3, 4096])
def test_vector_links_over_odd_rows(spark, block):
    nan, inf = float("nan"), float("inf")
    near = [1.0, 0.0, 0.0, 0.1]
    rows = [
        (1, [1.0, 0.0, 0.0, 0.0]), (2, near), (3, near), (3, near), (4, [2.0, 0.0, 0.0, 0.2]),  # four linked ids, one repeated
        (5, None), (6, []), (7, [0.0] * 4), (8, [1.0, None, 0.0, 0.0]), (9, [nan, 0.0, 0.0, 0.0]), (10, [inf, 0.0, 0.0, 0.0]),
        (None, near), (11, [1.0, 0.0]), (12, [0.0, 1.0, 0.0, 0.0]), (13, [-1.0, 0.0, 0.0, 0.0]),
    ]
    out = vectors.near_vectors(_table(spark, rows, "double"), threshold=0.9, recall=0.9999, block=block).collect()
    assert len(out) == len(rows)
    for r in out:
        if r.vec_id in (1, 2, 3, 4):
            assert (r.n_links, r.component_id, r.kept) == (3, 1, r.vec_id == 1)
        else:
            assert (r.n_links, r.component_id, r.kept) == (0, r.vec_id, True)


def test_vector_links_without_rows(spark):
    assert vectors.near_vectors(_table(spark, [(1, [1.0])], "double").limit(0)).count() == 0
    alone = vectors.near_vectors(_table(spark, [(1, None), (1, None)], "double")).collect()
    assert [(r.vec_id, r.n_links, r.component_id, r.kept) for r in alone] == [(1, 0, 1, True)] * 2


def test_rules_over_repeated_and_very_long_urls(spark):
    long = "http://a.example.org/es/" + "x" * 300_000
    rows = [(1, "http://a.example.org/es/1"), (1, "http://a.example.org/es/1"), (2, long), (2, long), (3, "http://" + "s." * 20_000 + "org/q"),
            (4, None), (5, ""), (None, "http://x.org/?a://b"), (6, "HTTP://EXAMPLE.org/ES/"), (7, "http://notexample.org/es/")]
    extra = ", ".join(f"{c} string" for c in ["key", "prefix", "verdict", "_url"])
    pages = spark.createDataFrame([(*r, "z", "z", "z", "z") for r in rows], f"page_id long, url string, {extra}")
    rules = spark.createDataFrame([("org", "/", "allow"), ("example.org", "/es/", "block")], "host string, path string, verdict string")
    out = sorted(((r.page_id or 0, r.rule, r.verdict) for r in urls.judge_urls(pages, rules).collect()), key=str)
    es, org, none = ("example.org/es/", "block"), ("org/", "allow"), (None, "allow")
    want = [(0, *org), (1, *es), (1, *es), (2, *es), (2, *es), (3, *org), (4, *none), (5, *none), (6, *org), (7, *org)]
    assert out == sorted(want, key=str)
