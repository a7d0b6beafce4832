"""Text statistics against plain counting, and robust estimates against plain concentration steps."""

import math
import os
import random
import re
import sys

import numpy as np
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from ecocline.llm import outliers, queries  # noqa: E402

FOLDER = "/root/testdata/sf0.01"
NAMES, FLOORS = list(outliers.FEATURES), np.array(list(outliers.FEATURES.values()))


def plain_statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    again = {w for w in windows if windows.count(w) > 1} if len(windows) < 300 else _repeated(windows)
    inside = {i + k for i, w in enumerate(windows) if w in again for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
        len(lines), len(lines) - len(set(lines)), len(inside),
    )


def _repeated(windows):
    seen, again = set(), set()
    for w in windows:
        (again if w in seen else seen).add(w)
    return again


def vector(stats):
    n, chars, symbols, lines, dup, rep = stats
    one, smooth = max(n, 1), n + 50
    v = [math.log(one), math.log((chars + 250) / smooth), math.log(1 + 100 * symbols / smooth),
         dup / (lines + 1), rep / one]
    return [math.floor(abs(x) * 1024 + 0.5) * (1 if x >= 0 else -1) / 1024 for x in v]


def plain_estimate(x, half=0.6):
    """Concentration steps on exactly sorted distances from many starts, then one reweighting."""
    p, ridge, best = x.shape[1], np.diag(FLOORS**2), None
    h = math.ceil(half * len(x))
    rng = np.random.default_rng(1)
    factor = outliers.consistency(half, p)

    def far(mean, cov):
        return np.einsum("ni,ij,nj->n", x - mean, np.linalg.inv(cov), x - mean)

    for start in range(30):
        some = x if not start else x[rng.choice(len(x), min(len(x), 12), replace=False)]
        mean, cov = np.median(some, axis=0), np.cov(some.T, bias=True) + ridge
        for _ in range(60):
            near = x[np.argsort(far(mean, cov), kind="stable")[:h]]
            mean, cov = near.mean(axis=0), np.cov(near.T, bias=True) * factor + ridge
        det = np.linalg.slogdet(cov)[1]
        if best is None or det < best[0]:
            best = (det, mean, cov)
    near = x[far(*best[1:]) <= outliers.chi_square_quantile(0.975, p)]
    mean = near.mean(axis=0)
    return far(mean, np.cov(near.T, bias=True) * outliers.consistency(0.975, p) + ridge)


@pytest.fixture(scope="module")
def judged(spark):
    return queries.QUERIES["op12_quality_outliers"](spark, FOLDER).collect()


def test_chi_square():
    assert outliers.chi_square_quantile(0.95, 1) == pytest.approx(3.8414588)
    assert outliers.chi_square_quantile(0.975, 5) == pytest.approx(12.8325)
    assert outliers.chi_square_quantile(0.99, 4) == pytest.approx(13.2767, abs=1e-4)
    # the nearest 60 % of normal rows, made consistent, have the covariance of all
    x = np.random.default_rng(3).normal(size=(200_000, 3))
    d = (x * x).sum(axis=1)
    near = x[d <= np.quantile(d, 0.6)]
    assert near.var(axis=0) * outliers.consistency(0.6, 3) == pytest.approx(np.ones(3), abs=0.02)


def test_base_columns_equal_plain_counting(spark, judged):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    assert len(judged) == len(texts)
    for r in judged:
        n, chars, symbols, _, dup, rep = plain_statistics(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            n, chars, symbols, dup, rep,
        )
        assert r.base_failed == (n < 10 or 100 * rep > 20 * n)
        assert not (r.base_failed and r.kept)


def test_verdicts_equal_plain_concentration(spark, judged):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = [r for r in judged if not r.base_failed]
    size, own = {}, {}
    for r in rows:
        key = (docs[r.doc_id].lang, docs[r.doc_id].source)
        size[key] = size.get(key, 0) + 1
    pool = {}
    for (lang, _), n in size.items():
        pool[lang] = pool.get(lang, 0) + (n if n < 100 else 0)
    for r in rows:
        lang, source = docs[r.doc_id].lang, docs[r.doc_id].source
        cell = (lang, source) if size[lang, source] >= 100 else lang if pool[lang] >= 100 else None
        own.setdefault(cell, []).append(r)
    checked = judged_at_all = 0
    limit = outliers.chi_square_quantile(0.9999, 5)
    for members in own.values():
        if len(members) < 100:
            assert all(r.kept for r in members)
            continue
        judged_at_all += len(members)
        x = np.array([vector(plain_statistics(docs[r.doc_id].text)) for r in members])
        for r, d in zip(members, plain_estimate(x)):
            assert r.kept == (r.distance <= limit)
            if not 0.75 * limit < d < 1.35 * limit:
                checked += 1
                assert r.kept == (d <= limit), (r, d)
    assert checked > 0.95 * judged_at_all > 0


def test_junk_goes_and_clean_documents_stay(spark, judged):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    good = [r for r in judged if labels.get(r.doc_id) == 1 and not r.base_failed]
    bad = [r for r in judged if labels.get(r.doc_id) == 0]
    assert sum(r.kept for r in good) >= 0.99 * len(good)
    assert sum(r.kept for r in bad) <= 0.1 * len(bad)


def texts(seed=5):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("aeinorst") for _ in range(rnd.randrange(2, 9))) for _ in range(900)]
    rows = []
    for i in range(700):
        words = [rnd.choice(vocabulary) for _ in range(rnd.randrange(12, 200))]
        if i % 10 == 0:
            words = [w + "###" for w in words]
        rows.append((i, " ".join(words), rnd.choice(["en", None]), rnd.choice(["a", "b", "b", None])))
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, cell string, n string, length string, id string"


def test_order_and_partitions_do_not_matter(spark):
    df = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in texts()], SCHEMA)
    one = outliers.judge_quality(df.repartition(3))
    two = outliers.judge_quality(df.orderBy("text").repartition(7))
    rows = sorted(tuple(r) for r in one.collect())
    assert rows == sorted(tuple(r) for r in two.collect())
    kept = {r[0]: r[-1] for r in rows}
    assert [i for i, k in kept.items() if not k] == list(range(0, 700, 10))


def test_odd_rows(spark):
    rows = [(None, "a " * 20, "en", "s"), (1, None, None, None), (2, "", "en", "s"), (3, " \n\t", "en", None),
            (4, "the same words here and there again as ever before now", "en", "s"),
            (4, "the same words here and there again as ever before now", "en", "s"),
            (5, "é中😀 # * " + "x" * 100_000, "en", "s"), (6, "a b\n\na b\n c\n c", "fr", "t")]
    df = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA)
    got = outliers.judge_quality(df).collect()
    assert {tuple(r)[:7] for r in got} == {
        (None, 20, 20, 0, 0, 20, True), (1, 0, 0, 0, 0, 0, True), (2, 0, 0, 0, 0, 0, True),
        (3, 0, 0, 0, 0, 0, True), (4, 11, 44, 0, 0, 0, False), (5, 4, 100_005, 2, 0, 0, True),
        (6, 6, 6, 0, 2, 0, True),
    }
    assert len(got) == len(rows) and all(r.kept != r.base_failed for r in got)
    assert outliers.judge_quality(df.limit(0)).collect() == []
