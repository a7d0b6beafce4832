"""Collocations against plain counting."""

import os
import random
import re
import sys
from collections import Counter

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from ecocline.llm import collocations  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, chunk string, freq string, phrase string, n string, rank string"


def frame(spark, rows):
    return spark.createDataFrame([(i, *r, *["x"] * 5) for i, r in enumerate(rows)], SCHEMA)


def pieces(rows):
    for text, lang in rows:
        lower = re.sub("[A-Z]+", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            yield lang if lang is not None else "und", re.findall(r"[^\x20\x09]+", piece)


def plain(rows, longest=3, least=10, covered=50, top=2000):
    count, total = Counter(), Counter()
    for lang, w in pieces(rows):
        total[lang] += len(w)
        for k in range(1, longest + 1):
            count.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    out = {}
    for (lang, w), a in count.items():
        if len(w) < 2 or a < least:
            continue
        l, r, score, _ = min(
            ((count[lang, w[:k]], count[lang, w[k:]], 1_000_000 * a * a // (count[lang, w[:k]] * count[lang, w[k:]]), k)
             for k in range(1, len(w))), key=lambda x: (x[2], x[3]))
        out[lang, w] = (a, l, r, total[lang], score)
    held = set()
    for (lang, w), row in out.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                inner = out.get((lang, w[i : i + k]))
                if inner and 100 * row[0] >= covered * inner[0]:
                    held.add((lang, w[i : i + k]))
    result = []
    for lang in {x for x, _ in out}:
        mine = [(" ".join(w), *row) for (x, w), row in out.items() if x == lang and (x, w) not in held]
        mine.sort(key=lambda r: (-r[5], -r[1], r[0].encode()))
        result += [(lang, n, *r) for n, r in enumerate(mine[:top], start=1)]
    return sorted(result)


def corpus(seed):
    rnd = random.Random(seed)
    fixed = ["New York City", "black coffee", "é à la carte", "a b a b a b a b", "one,two two;one"]
    rows = [(None, "en"), ("", None), (" \n\t", "en"), ("word " * 500, "en"), ("x" * 3000, "fr")]
    for _ in range(150):
        parts = [
            rnd.choice(fixed) if rnd.random() < 0.3 else rnd.choice(["the", "of", "Cat", "dog", "sat", "😀"])
            for _ in range(rnd.randrange(1, 60))
        ]
        text = rnd.choice([" ", "\t", "  "]).join(parts).replace("sat ", rnd.choice(["sat. ", "sat\n", "sat "]))
        rows.append((text, rnd.choice(["en", "fr", None])))
    return rows + rows[60:90]


@pytest.mark.parametrize("period, options", [
    (8, {}), (1, {}), (3, {"longest": 4, "least": 5, "covered": 80}), (3, {"longest": 2, "least": 3}),
    (2, {"top": 4}),
])
def test_equals_plain_counting(spark, period, options):
    rows = corpus(4)
    got = collocations.mine_collocations(frame(spark, rows), period=period, **options).collect()
    assert sorted(tuple(r) for r in got) == plain(rows, **options)


def test_equal_passages_share_chunks(spark):
    rnd = random.Random(8)
    passage = " ".join(f"w{rnd.randrange(500)}" for _ in range(400))
    rows = [(f"p{i} q{i} {passage} r{i}", "en") for i in range(40)]
    dictionary = collocations.parse(frame(spark, rows)).collect()
    # but for the chunks at the ends of the passage, each is in the dictionary once
    assert len(dictionary) < 40 * 3 + 400
    assert sum(r.freq * r.owned for r in dictionary) == 40 * 403


def summed(places):
    count = Counter()
    for r in places:
        count[r.lang, r.phrase] += r.freq
    return count


@pytest.mark.parametrize("most", [1 << 16, 1 << 27])
def test_places_of_rare_parts_are_left_out(spark, most):
    rnd = random.Random(3)
    rows = [(" ".join(rnd.choice(["a", "b", "c", f"rare{rnd.randrange(10**6)}"]) for _ in range(50)), lang)
            for lang in ("en", None) for _ in range(40)]
    dictionary = collocations.parse(frame(spark, rows)).cache()
    for size in (2, 3):
        shorter = collocations.phrase_counts(dictionary, size - 1, 10)
        every = collocations.places_of(dictionary, size).collect()
        held = collocations.places_of(dictionary, size, shorter, most).collect()
        frequent = {k: n for k, n in summed(every).items() if n >= 10}
        assert frequent and {k: n for k, n in summed(held).items() if n >= 10} == frequent
        # three words of four are frequent, so that most places of two and three hold a rare part
        known = {(r.lang, r.phrase) for r in shorter.collect()}
        parts = lambda p: (p.rsplit(" ", 1)[0], p.split(" ", 1)[1])
        certain = [r for r in every if all((r.lang, x) in known for x in parts(r.phrase))]
        assert len(certain) <= len(held) < 0.75 * len(every)
        assert len(held) < 1.05 * len(certain) + 5


@pytest.mark.parametrize("blocks", [1, 2])
def test_marks_of_a_full_map(spark, blocks):
    counted = spark.createDataFrame([("en", f"w{i} v{i}", 10) for i in range(5000)], "lang string, phrase string, f long")
    marked, slots = collocations.marks(counted, 2, blocks << 16)
    longs = [x for block in marked.first().blocks for x in block]
    assert slots == blocks << 16 and len(longs) == slots >> 6
    assert 0.9 * 5000 < sum(bin(x % 2**64).count("1") for x in longs) <= 5000


def test_empty_table(spark):
    assert collocations.mine_collocations(frame(spark, corpus(1)).limit(0)).collect() == []
