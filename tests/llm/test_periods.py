"""Periodic runs against a plain search over all periods and places."""

import hashlib
import os
import random
import sys
import zlib

import numpy as np
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from ecocline.llm import periods, queries  # noqa: E402
from ecocline.llm.wording import numbered  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


def plain_runs(words, least=6, powers=4):
    """(start, length, period) of every run, by comparing all words q apart."""
    out = {}
    for q in range(1, len(words) // powers + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, powers * q):
                out.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in out.items())


def plain_collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def found(texts, **options):
    numbers, starts = numbered([[w.encode() for w in t] for t in texts])
    got = [[] for _ in texts]
    for t, *run in zip(*periods.runs(numbers, starts, **options)):
        got[t].append(tuple(int(v) for v in run))
    return got


def odd_texts(seed):
    rnd = random.Random(seed)
    texts = [[], ["a"], ["a"] * 5, ["a"] * 6, ["a"] * 200, list("ab" * 50), list("aab" * 30 + "ab" * 9)]
    for _ in range(120):
        t = []
        while len(t) < rnd.randrange(1, 150):
            unit = [rnd.choice("abc"[: rnd.randrange(1, 4)]) for _ in range(rnd.randrange(1, 9))]
            t += unit * rnd.randrange(1, 9) + unit[: rnd.randrange(len(unit))]
        texts.append(t)
    fib = ["a", "ab"]
    while len(fib[-1]) < 900:
        fib.append(fib[-1] + fib[-2])
    return texts + [list(fib[-1]), [str(i) for i in range(300)] * 5]


@pytest.mark.parametrize("seed", range(4))
def test_runs_equal_a_plain_search(seed):
    texts = odd_texts(seed)
    assert found(texts) == [plain_runs(t) for t in texts]
    assert found(texts, least_length=4, least_powers=3) == [plain_runs(t, 4, 3) for t in texts]


def test_slices_of_candidates_agree(monkeypatch):
    texts = odd_texts(9)
    whole = found(texts)
    monkeypatch.setattr(periods, "_QUERIES", 7)
    assert found(texts) == whole


def test_words_that_texts_share_make_no_candidates():
    texts = [[f"u{t}", "the", f"v{t}", "the"] for t in range(200)] + [["a", "b"] * 3 + ["the"] * 2] * 3
    texts += [["the"] * 7, ["x", "y"] * 6]
    assert found(texts) == [plain_runs(t) for t in texts]


def test_extensions_count_equal_words():
    rnd = random.Random(2)
    words = [rnd.choice("ab") for _ in range(60)] * 4 + ["a"] * 70 + [rnd.choice("abc") for _ in range(300)]
    numbers, starts = numbered([[w.encode() for w in words]])
    row, _ = periods._with_ends(numbers, starts)
    levels = periods.grammar(row, 1)
    assert levels[-1].length.max() == len(words) and len(levels) < 60
    one = np.array([rnd.randrange(1, len(words)) for _ in range(4000)])
    two = np.array([rnd.randrange(1, len(words)) for _ in range(4000)])
    one, two = one[one != two], two[one != two]
    for ahead in (True, False):
        got = periods.extensions(levels, one, two, ahead)
        for x, y, n in zip(one, two, got):
            k = 0
            while row[x + k if ahead else x - k] == row[y + k if ahead else y - k]:
                k += 1
            assert n == k


def test_long_text_of_one_word():
    (runs,) = found([["x"] * 200_000])
    assert runs == [(0, 200_000, 1)]


def test_odd_rows(spark):
    schema = "doc_id long, text string, runs string, id string, n_words string, collapsed string"
    rows = [(None, "a b " * 9), (1, None), (2, ""), (3, " \n\t"), (4, "x\ny " * 8), (4, "x\ny " * 8), (5, "é " * 7)]
    df = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], schema)
    got = {(r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in periods.find_runs(df).collect()}
    assert got == {
        (None, 18, ((0, 18, 2),), "a b"), (1, 0, (), ""), (2, 0, (), ""), (3, 0, (), ""),
        (4, 16, ((0, 16, 2),), "x y"), (5, 7, ((0, 7, 1),), "é"),
    }
    assert periods.find_runs(df).count() == len(rows)
    assert periods.find_runs(df.limit(0)).collect() == []


def test_query_equals_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = queries.QUERIES["op13_periodic_runs"](spark, FOLDER).collect()
    assert len(rows) == len(docs)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    with_runs = 0
    for r in rows:
        text = docs[r.doc_id] or ""
        words = planted(r.doc_id, [w.decode() for w in text.encode().split()])
        runs = plain_runs(words)
        with_runs += bool(runs)
        best = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=(None, None, None))
        milli = 1000 * best[1] // best[2] if runs else None
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (len(runs), *best, milli)
        assert r.runs_sha256 == sha("".join(f"{a},{b},{c}\n" for a, b, c in runs))
        assert r.collapsed_sha256 == sha(plain_collapsed(words, runs))
    assert with_runs > 5
