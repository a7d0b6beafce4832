"""Steps of the toxicity score against plain versions."""

import os
import random
import sys
from collections import Counter

import numpy as np
import pyarrow as pa

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from ecocline.llm import toxicity  # noqa: E402
from ecocline.sources import storage  # noqa: E402

MODEL = np.log(np.full((28, 28, 28), 1 / 28))


def scorer(weights):
    return toxicity.Scorer(MODEL, weights, np.array([0.0, 1.0, 1.0]))


def test_features_of_a_text():
    words = {"", "abc", "abcd", "abcdefghi", "abcdefghij", "lose*", "é\u00e0\u00fc\u00f6x"}
    assert toxicity.text_features(words) == {f for w in words if w for f in toxicity.features(w)}
    assert toxicity.text_features(set()) == toxicity.text_features({""}) == set()


def test_trigrams_stay_within_texts():
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("abz Aé.\n") for _ in range(rnd.randrange(9))) for _ in range(700)]
    texts += [None, "", "a", "ab", "abc" * 400_000]
    code = lambda b: b - 97 if 97 <= b < 123 else 26 if b >= 128 else 27
    plain = Counter()
    for text in texts:
        raw = [code(b) for b in (text or "").encode().lower()]
        plain.update((a * 28 + b) * 28 + c for a, b, c in zip(raw, raw[1:], raw[2:]))
    batches = [pa.RecordBatch.from_pydict({"text": texts[:300]}), pa.RecordBatch.from_pydict({"text": texts[300:]})]
    (got,) = toxicity._trigram_counts(iter(batches))
    assert dict(zip(got.column("gram").to_pylist(), got.column("n").to_pylist())) == plain


def test_openers_that_cannot_go_on_are_not_walked():
    weights = {"loser": 5.0, "losing": 1.0, "trash": 4.0, "lose*": 2.0}
    for text in ("trash annd trash, lo lo too lo trash", "lo soon, lo sallow lo soo lo"):
        of_text = scorer(weights)
        of_text.inputs(text)
        assert not of_text.finder.steps, text
    # what does go on is still found, over a letter that stands twice and over marks
    for text in ("lo ser", "lo. sser", "lo, s, er", "tra sh", "los ser", "too lo lo ser and"):
        word = "trash" if "tra" in text else "loser"
        assert scorer(weights).inputs(text)[1] == weights[word], text


def test_strongest_weights_equal_a_walk_from_every_token():
    rnd = random.Random(11)
    part = lambda n: "".join(rnd.choice("abs") for _ in range(n))
    weights = {part(rnd.randrange(1, 9)) + rnd.choice(["", "", "*"]): round(rnd.random() * 5, 3) for _ in range(60)}
    weights = {f: w for f, w in weights.items() if not f.endswith("*") or len(f) - 1 in (4, 5, 6, 8)}
    for _ in range(1500):
        text = " ".join(
            part(rnd.randrange(1, 6)) + rnd.choice(["", "", "", ",", ".", "$", "(", "&&", "-b"])
            for _ in range(rnd.randrange(1, 12))
        )
        of_text, tokens = scorer(weights), text.split()
        single = [max(map(of_text.known, of_text.restorer.token(t))) for t in set(tokens)]
        alone = {w for t in set(tokens) for w in of_text.restorer.token(t) if of_text.known(w)}
        # every token opens with its own parts, and none is left out
        opening = {t: of_text.finder.parts(t) for t in tokens}
        opening = {t: tuple((p, b or frozenset([(p, True)] if p in of_text.finder.begun else [])) for p, b in parts)
                   for t, parts in opening.items()}
        joined = of_text.restorer.spaced(tokens) | walked(of_text.finder, tokens, opening)
        expected = sorted([0.0, 0.0, *single, *(of_text.known(w) for w in joined - alone)])[:-3:-1]
        assert list(of_text.inputs(text)[1:]) == expected, text


def walked(finder, tokens, opening):
    found = set()
    for start in range(len(tokens)):
        states, last = frozenset(), ""
        for nth, token in enumerate(tokens[start:]):
            for part, begun in opening[token]:
                states = finder.walk(states, part, last) | (begun if nth == 0 else frozenset())
                found.update(s for s, _ in states & finder.goals)
                last = part[-1]
    return found


def test_known_weights():
    rnd = random.Random(2)
    part = lambda n: "".join(rnd.choice("ab") for _ in range(n))
    weights = {}
    for _ in range(80):
        word = part(rnd.randrange(1, 10))
        for f in toxicity.features(word):
            if rnd.random() < 0.3:
                weights[f] = rnd.random()
    of_word = scorer(weights)
    for _ in range(3000):
        word = part(rnd.randrange(1, 12))
        assert of_word.known(word) == max([0.0, *(weights.get(f, 0.0) for f in toxicity.features(word))])


def test_long_texts_go_to_python_few_at_a_time(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows], "mb": [batch.nbytes / 2**20]})

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    texts = spark.range(0, 2000, 1, 1).selectExpr("repeat(cast(id % 10 as string), 20000) AS text")
    short = spark.range(0, 20000, 1, 1)
    for frame, most in ((texts, 300), (short, 10000)):
        seen = storage.materialise(frame.mapInArrow(sizes, "n long, mb double"), "sizes").collect()
        assert sum(r.n for r in seen) == frame.count()
        assert max(r.mb for r in seen) < 5 and max(r.n for r in seen) <= most
    assert max(r.n for r in seen) == 10000  # short rows still go ten thousand at a time
    assert spark.conf.get(key, None) == before
