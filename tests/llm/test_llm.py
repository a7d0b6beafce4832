"""The training data operators against brute force, and on missing, empty, repeated and odd rows."""

import itertools
import os
import random
import sys
import zlib
from collections import defaultdict

import numpy as np
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

import corpus_pipeline  # noqa: E402
from ecocline.llm import jaccard, licenses, lines, mixing, packing, tokens, topk, toxicity, urls, vectors  # noqa: E402
from ecocline.llm.common import components  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
FILE = P.path("byte_bpe_50k.json")
#: Columns with the names that operators use inside.
CLASH = ["id", "place", "row", "rows", "words", "size", "part", "key", "rep", "query", "h1", "target"]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(FILE)


def documents(spark, rows):
    """(doc_id, text, source) rows with further columns of clashing names."""
    schema = "doc_id long, text string, source string, lang string, n_chars long, " + ", ".join(
        f"{c} string" for c in CLASH
    )
    return spark.createDataFrame([(*r, "en", len(r[1] or ""), *["x"] * len(CLASH)) for r in rows], schema)


ODD = [
    (None, "a text without an id", "s"), (1, None, None), (2, "", "s"), (3, " \n\t ", "t"),
    (4, "the same words here and there again", "s"), (4, "the same words here and there again", "s"),
    (5, "one", None), (6, "long " * 30_000, "t"), (7, "x" * 5_000, "u"),
    (8, "é中😀 <|endoftext|> don't 's", "u"), (9, "A\nB\nC\nD\nA\nB\nC", "s"), (10, "Z\nA\nB\nC", "s"),
]


def test_components(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(80), rnd.randrange(80)) for _ in range(60)] + [(200 + i, 201 + i) for i in range(20)]
    parent: dict[int, int] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    found = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in found} == {x: root(x) for x in parent}


def brute_groups(rows, words, percent):
    sets = {}
    for i, text, *_ in rows:
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
    component = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= percent * len(sets[a] | sets[b]) and component[a] > component[b]:
                    component[a], changed = component[b], True
    return {i: (len(sets[i]), component[i]) for i in sets}


@pytest.mark.parametrize(("words", "percent"), [(1, 80), (4, 85), (2, 60)])
def test_jaccard_join_equals_brute_force(spark, words, percent):
    rnd = random.Random(words)
    rows = []
    for group in range(12):
        base = [f"w{rnd.randrange(400)}" for _ in range(rnd.choice([3, 8, 20, 60, 150]))]
        for copy in range(7):
            text = [f"v{rnd.randrange(9)}" if rnd.random() < 0.02 * copy else w for w in base]
            rows.append((len(rows), " ".join(text), "s"))
    found = jaccard.jaccard_join(documents(spark, rows), words=words, percent=percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute_groups(rows, words, percent)


def test_one_id_with_two_texts_links_through_both(spark):
    rnd = random.Random(11)
    rows, want = [], {}
    for g in range(20):
        for text_id, size in ((3 * g, 60), (3 * g + 1, 400)):
            words = [f"w{rnd.randrange(10**6)}" for _ in range(size)]
            rows.append((3 * g + 2, " ".join(words), "s"))
            rows.append((text_id, " ".join([*words[:-1], "other"]), "s"))
        want |= {3 * g + k: 3 * g for k in range(3)}
    rnd.shuffle(rows)
    found = jaccard.jaccard_join(documents(spark, rows)).collect()
    assert len(found) == len(rows) and {r.doc_id: r.component_id for r in found} == want


def test_jaccard_join_lists_a_pair_once(spark, monkeypatch):
    """Copies just below the limit share many keys; the second round's join makes one row a pair, not one a key."""
    rnd = random.Random(5)
    base = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(24):
        own = list(base)
        for at in rnd.sample(range(400), 5):
            own[at] = f"x{i}_{at}"
        rows.append((i, " ".join(own), "s"))
    made = []
    listed = jaccard._listed
    monkeypatch.setattr(jaccard, "_listed", lambda meet: made.append(meet) or listed(meet))
    found = {r.doc_id: r.component_id for r in jaccard.jaccard_join(documents(spark, rows), words=4, percent=85).collect()}
    sets = [{tuple(t.split()[k : k + 4]) for k in range(397)} for _, t, _ in rows]
    link = lambda a, b: 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])
    root = list(range(24))
    for _ in root:
        root = [min(root[b] for b in range(24) if a == b or link(a, b)) for a in range(24)]
    assert found == dict(enumerate(root)) and len(set(root)) > 12
    rows_made, pairs = made[0].count(), listed(made[0]).count()
    assert 100 < pairs <= rows_made < 1.5 * pairs


def test_tokenizer_equals_library(library):
    rnd = random.Random(1)
    signs = [*"abstmdrevl'' \n\t\r.,!?013éñ中😀 　²_-", "<|endoftext|>", "''ll", "====", " the"]
    texts = ["".join(rnd.choice(signs) for _ in range(rnd.randrange(60))) for _ in range(800)]
    texts += [None, "", "  \n", "a" * 700, " " * 300 + "x", "ab" * 200]
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    for counter in (tokens.Counter(FILE), tokens.Counter(FILE, chunk=7, block=50)):
        assert counter(texts) == [len(w) for w in want]
    for encoder in (tokens.Encoder(FILE), tokens.Encoder(FILE, block=50, chunk=7)):
        assert [x.tolist() for x in encoder(texts)] == want


@pytest.mark.parametrize("capacity", [2048, 64])
def test_packing_is_a_round_trip_without_padding(spark, library, capacity):
    rows = [(i, f"{t} {i}", s) for i, (_, t, s) in enumerate(ODD)] + [(90 + i, "same text", "s") for i in range(40)]
    want = {i: [*library.encode(t, add_special_tokens=False).ids, 1] for i, t, _ in rows}
    pieces, places = defaultdict(list), defaultdict(list)
    for r in packing.pack(documents(spark, rows), FILE, capacity=capacity).collect():
        pieces[r.doc_id].append(r)
        places[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(want)
    for i, own in pieces.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            ids = np.array(want[i][at : at + r.length], dtype="<u4")
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(want[i]), zlib.crc32(ids.tobytes()))
            at += r.length
        assert at == len(want[i])
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at == capacity or at & (at - 1) == 0 and at < capacity


def test_fill_is_the_closest_sum():
    rnd = random.Random(5)
    for _ in range(200):
        counts = {rnd.randrange(1, 40): rnd.randrange(1, 4) for _ in range(6)}
        seed = max(counts)
        taken = packing.fill(counts, seed, 64)
        assert all(k <= counts[n] for n, k in taken.items())
        sums = {0}
        for n, c in counts.items():
            sums = {s + n * k for s in sums for k in range(c - (n == seed) + 1)}
        assert sum(n * k for n, k in taken.items()) == seed + max(s for s in sums if s <= 64 - seed)


def test_near_vectors_recall(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((40, 32))
    x = np.vstack([c + 0.25 * rng.standard_normal((8, 32)) for c in centres])
    x = np.vstack([x, x[:5], np.zeros((1, 32))])
    unit = x / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None]
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    frame = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(x)], "vec_id long, embedding array<double>, rep string")
    for block in (1024, 16):
        found = {r.vec_id: r for r in vectors.near_vectors(frame, block=block).collect()}
        links = sum(r.n_links for r in found.values())
        assert 0.9 * near.sum() <= links <= near.sum()
        assert not found[len(x) - 1].n_links and found[len(x) - 1].kept


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(-6, 7, (300, 8))
    frame = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(x)], "vec_id long, embedding array<long>, id string")
    found = defaultdict(list)
    for r in topk.top_k(frame, "vec_id % 10 = 0", k=7, block=64, pivots=5).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.score, r.vec_id))
    for q in range(0, 300, 10):
        best = sorted(((int(x[q] @ x[c]), c) for c in range(300) if c != q), key=lambda s: (-s[0], s[1]))
        assert found[q] == best[:7]


def test_urls(spark):
    pages = spark.createDataFrame(
        [(1, "http://WWW.Example.org/es/a?x", "x"), (2, None, "x"), (3, "no scheme/es/", "x"),
         (4, "http://example.org", "x"), (5, "http://myexample.org/es/", "x"), (6, "http://a.com#/de/", "x")],
        "page_id long, url string, host string",
    )
    rules = spark.createDataFrame(
        [("org", "/", "allow"), ("example.org", "/es/", "block"), ("com", "/de/", "block")],
        "host string, path string, verdict string",
    )
    found = {r.page_id: tuple(r)[1:] for r in urls.judge_urls(pages, rules).collect()}
    assert found == {
        1: ("www.example.org", "/es/a", "example.org/es/", "block"), 2: ("", "", None, "allow"),
        3: ("", "", None, "allow"), 4: ("example.org", "", None, "allow"),
        5: ("myexample.org", "/es/", "org/", "allow"), 6: ("a.com", "", None, "allow"),
    }
    assert urls.judge_urls(pages.limit(0), rules).count() == 0
    assert urls.judge_urls(pages, rules.limit(0)).filter("rule is null").count() == 6


def test_decoding_restores_hidden_words(spark):
    texts = spark.read.parquet(f"{FOLDER}/documents.parquet").select("text")
    words = "loser moron pathetic trash disgusting clown"
    model = toxicity.character_model(texts.union(spark.createDataFrame([(f"{words} " * 50,)], "text string")))
    for hidden in ("l0ser", "m0r0n", "p4thetic", "looooser", "7rash", "d1sgust1ng", "lo.s.er", "cl0wn"):
        assert toxicity.decode(hidden, model) in words.split()
    assert "loser" in toxicity.Restorer(model).words("you l o s e r there")


def test_words_across_blanks_and_in_long_tokens():
    """Blanks and marks are nothing or borders, in runs and tokens of any length."""
    model = np.log(np.full((28, 28, 28), 1 / 28))
    words = ["loser", "moron", "pathetic"]
    scorer = toxicity.Scorer(model, dict.fromkeys(words, 2.0), None)
    filler = " ".join("xyz" * 30)
    for text, want in {
        "a l o s e r": 1, "you l o s e r m o r o n there": 2, "lo ser": 1, "pa th et ic": 1, "l 0 s e r": 1,
        f"{filler} l o s e r {filler}": 1, f"{' '.join('x' * 37)} p a t h e t i c": 1,
        "l" + " o" * 90 + " s e r": 1, "l" + "o" * 90 + "ser": 1, f"{'x' * 60}/l0ser-{'y' * 60}": 1,
        "low ser": 0, "a clean line": 0, "x y z": 0,
    }.items():
        assert sum(x == 2.0 for x in scorer.inputs(text)) == want, text


def test_finder_equals_every_way_to_join():
    """Plain tokens: every word that whole neighbouring tokens spell, by brute force."""
    rnd = random.Random(7)
    for _ in range(300):
        words = {"".join(rnd.choice("abc") for _ in range(rnd.randrange(3, 7))) for _ in range(6)}
        words = {w for w in words if all(a != b for a, b in zip(w, w[1:], strict=False))}
        tokens = ["".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 4))) for _ in range(20)]
        joined = {"".join(tokens[i:j]) for i in range(20) for j in range(i + 1, 21)}
        spelt = {w for t in joined for w in words if w == t}
        finder = toxicity.Finder(words)
        opening = {t: finder.parts(t) for t in tokens if any(b for _, b in finder.parts(t))}
        found = finder(tokens, opening)
        assert spelt <= found
        # A repeated letter may stand for nothing: no other way leads to a word.
        once = {"".join(c for c, _ in itertools.groupby(t)) for t in joined}
        assert found <= {w for w in words if w in once}


def test_words_that_cannot_change_a_score_need_not_be_found():
    """The two strongest weights, against those of all words that a text holds on any path."""
    rnd = random.Random(11)
    signs = "abc" * 4 + "@0.-"
    for _ in range(300):
        words = {"".join(rnd.choice("abco") for _ in range(rnd.randrange(3, 6))) for _ in range(12)}
        weights = {w: rnd.choice([0.2, 0.5, 1.0, 2.0]) for w in words}
        weights |= {f"{w[:4]}*": rnd.random() * 3 for w in sorted(words)[:3] if len(w) > 3}
        scorer = toxicity.Scorer(np.zeros((28, 28, 28)), weights, None)
        tokens = ["".join(rnd.choice(signs) for _ in range(rnd.randrange(1, 5))) for _ in range(25)]
        held = {t: scorer.learnt(t) for t in set(tokens)}
        own = {w for t in tokens for w in scorer.restorer.token(t) if scorer.known(w)}
        opening = {t: scorer.finder.parts(t) for t in tokens}
        beside = scorer.restorer.spaced(tokens) | scorer.finder(tokens, opening)
        every = [e[0] for e in held.values()] + [scorer.known(w) for w in beside - own]
        assert scorer.inputs(" ".join(tokens)) == (1.0, *sorted([0.0, 0.0, *every], reverse=True)[:2])


def test_beginnings_of_weak_words_are_not_followed():
    """What cannot beat the second strongest weight is dropped at the next token, and letters that only stand
    for themselves are filed without states of the lattice."""
    weights = {"loser": 2.0, "thesis": 0.3, "theme": 0.3, "pathetic": 5.0, "moron": 4.0, "idiot": 4.0}
    scorer = toxicity.Scorer(np.zeros((28, 28, 28)), weights, None)
    assert scorer.learnt("the")[2:] == ("the", ()) and scorer.learnt("Moron,")[2:] == ("moron", "moron")
    assert scorer.learnt("l0")[2] == (("l0", frozenset({("lo", True)})),)
    # Tokens of letters, one of them twice, are settled without the lattice, and as the lattice has it.
    for token in ("losser", "patthetic", "Patt", "mmoron", "ll", "zz", "los"):
        entry = toxicity.Scorer(np.zeros((28, 28, 28)), weights, None).learnt(token)
        opens = scorer.finder.parts(token)
        assert entry[1] == scorer.finder.promise(opens) and entry[0] == max(map(scorer.known, scorer.restorer.token(token)))
        assert entry[2] == (opens if "los" != token else token) or not entry[1]
    walked = []
    walk = scorer.finder.walk
    scorer.finder.walk = lambda states, part, last: walked.append(part) or walk(states, part, last)
    opening = {"the": "the", "lo": "lo"}
    assert scorer.finder(["the", "sis", "lo", "ser"], opening) == {"thesis", "loser"}
    walked.clear()
    scorer.finder.steps.clear()
    assert scorer.finder(["the", "sis", "the", "me", "lo", "ser"], opening, 0.3) == {"loser"}
    assert walked == ["ser"]
    assert scorer.inputs("moron idiot lo ser pa the tic") == (1.0, 5.0, 4.0)


def test_toxicity_on_the_held_out_fold(spark):
    folder = "/root/testdata/sf0.1"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    scored = toxicity.score_toxicity(spark.read.parquet(f"{folder}/documents.parquet"), labels)
    rows = scored.filter("held_out").join(labels, "doc_id").select("predicted", "toxic").collect()
    hits = sum(r.predicted and r.toxic for r in rows)
    assert hits >= 0.8 * sum(r.toxic for r in rows) and hits >= 0.8 * sum(r.predicted for r in rows)


OPERATORS = {
    "jaccard": lambda d: jaccard.jaccard_join(d),
    "packing": lambda d: packing.pack(d, FILE, capacity=64).select("doc_id").distinct(),
    "licenses": lambda d: licenses.scan_licenses(d),
    "lines": lambda d: lines.drop_repeated_lines(d),
    "tokens": lambda d: tokens.count_tokens(d, FILE),
    "mixing": lambda d: mixing.mix(d),
    "toxicity": lambda d: toxicity.score_toxicity(
        d, d.sparkSession.createDataFrame([(4, 1), (5, 0), (None, 1), (9, None)], "doc_id long, toxic int")
    ),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows_and_empty_tables(spark, name):
    frame = documents(spark, ODD)
    found = OPERATORS[name](frame).collect()
    ids = [i for i, *_ in ODD]
    assert len(found) == (len(set(ids)) if name == "packing" else len(ids))
    assert OPERATORS[name](documents(spark, ODD[:1]).limit(0)).count() == 0
    by_id = {r[0]: r for r in found}
    if name == "jaccard":
        assert by_id[4].component_id == 4 and by_id[1].n_shingles == 0 and by_id[None].component_id is None
    if name == "lines":
        texts = {r.doc_id: r.text for r in found}
        assert texts[9] == "A\nB\nC\nD" and texts[10] == "Z" and texts[1] is None
    if name == "tokens":
        assert by_id[1].n_tokens == by_id[2].n_tokens == 0
    if name == "mixing":
        assert all(r.taken <= 2 * r.size for r in found)
        per_source = defaultdict(int)
        for r in found:
            per_source[(r.source_size, r.target)] += r.taken
        assert all(abs(sum_ - target) <= 1 for (_, target), sum_ in per_source.items())


def test_pipeline_keeps_every_token_of_what_it_keeps(spark, library):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, FOLDER).cache()
        assert kept.columns == docs.columns
        seen[name] = (before, kept)
    rows = {r.doc_id for r in seen["near_duplicates"][0].collect()}
    groups = jaccard.jaccard_join(seen["near_duplicates"][0]).collect()
    assert {r.doc_id for r in seen["near_duplicates"][1].collect()} == {r.component_id for r in groups} <= rows
    want = sum(len(library.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in kept.collect())
    pieces = corpus_pipeline.STAGES[-1][1](spark, kept, FOLDER)
    assert sum(r.length for r in pieces.collect()) == want


def test_near_duplicates_tell_rows_of_one_id_apart(spark):
    """A follower goes, unrelated texts of its id stay; of equal rows one stays."""
    rnd = random.Random(12)
    text = lambda n: " ".join(rnd.choice("abcdefghij") * rnd.randrange(1, 9) for _ in range(n))
    a, t, unrelated, other = text(200), text(90), text(120), text(150)
    rows = [(1, a, "s"), (5, a + " more", "s"), (5, unrelated, "t"), (9, t, "s"), (9, t, "s"), (None, a, "s"),
            (12, other, "s"), (3, None, "s"), (4, "", None)]
    frame = documents(spark, rows)
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    kept = stage(spark, frame, FOLDER)
    assert kept.columns == frame.columns
    want = [(1, a), (5, unrelated), (9, t), (None, a), (12, other), (3, None), (4, "")]
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(str, want))


def test_mixing_stage_takes_repeated_rows_one_by_one(spark):
    rnd = random.Random(13)
    rows = [(i, " ".join(f"w{rnd.randrange(99)}" for _ in range(rnd.randrange(1, 60))), rnd.choice("abc"))
            for i in range(120)] + [(7, "again and again it comes", "a")] * 5 + [(200, None, "b"), (201, "", None)]
    frame = documents(spark, rows)
    takes = mixing.mix(frame).collect()
    got = dict(corpus_pipeline.STAGES)["mixing"](spark, frame, FOLDER).collect()
    assert sum(len(r.text.split()) for r in got) == sum(r.taken for r in takes)
    per_id = defaultdict(int)
    for r in takes:
        per_id[r.doc_id] += r.taken
    for r in got:
        per_id[r.doc_id] -= len(r.text.split())
    assert not any(per_id.values())


def test_stages_on_odd_rows_and_empty_tables(spark):
    for frame in (documents(spark, ODD), documents(spark, ODD).limit(0)):
        docs = frame
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, FOLDER)
            assert name == "packing" or out.columns == frame.columns
            docs = spark.createDataFrame(out.collect(), out.schema)
        assert docs.count() or not frame.count()
