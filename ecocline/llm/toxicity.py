"""Toxicity scores on deobfuscated text (operator 9).

Writers hide words by look-alike signs (``l0ser``), spaces or dots between letters (``l o s e r``)
and repeated letters (``looooser``). Such a word is a path through a noisy channel: at every place of
its lattice a sign may stand for itself, for one of the letters it resembles, for nothing, or for one
more of the letter before, and a blank or mark for nothing or for the border of a word. The Viterbi
decoder picks the letters that a character model of the whole corpus and the channel make most likely.
Trigram counts of that model are summed over all texts. Words and runs are decoded whole, whatever
their length. Only what stands in a text can be a border: words glued together without any sign stay
one word. Three letters tell little of where a spaced-out word ends, so that a scorer also reads every
text by the lattice of the words it has weights for, blanks and marks being nothing or borders.

The restored text is scored by the words and word beginnings it holds. Their weights come from a
bounded sample of the labelled rows outside the held-out fold: the log of the ratio of their rates in
toxic and other texts, less some standard errors. A logistic fit turns a text's strongest weights into
a score; for it each half of the sample is weighed by what the other half has taught.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Collection, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ecocline.sources.storage import materialise, small_batches

#: Signs and the letters they may stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i",
}
#: Signs that may stand for nothing between letters.
FILLERS = ".-_*'~^"
_LETTERS = 28  # a to z, another letter, the border of a word
_OTHER, _EDGE = 26, 27
_SIGNS = re.escape("".join(LOOKALIKES))
#: A sign between letters, before or after some, or a letter three times.
_HIDDEN = re.compile(
    rf"[^\W\d_][{_SIGNS}{re.escape(FILLERS)}]+[^\W\d_]|(\w)\1\1|^[{_SIGNS}][^\W\d_]{{2}}|[^\W\d_]{{2}}[{_SIGNS}]$"
)
_MARKS = ".,;:?\"'()[]{}<>#%&*=/\\`~^-_"
_ENDS = ".,;:?&%#"  # marks that are no look-alikes
_PREFIXES = (4, 5, 6, 8)
_MEMO = 100_000
_DULL = 400_000  # tokens without any bearing that a task remembers
_FILED = 200_000  # tokens with some that it remembers
_ERRORS = 2.3  # standard errors taken off a weight
#: What may stand between the parts of a word besides blanks.
_APART = re.compile(rf"[^\w{_SIGNS}]+|_+")
_TWICE, _THRICE = re.compile(r"(.)\1"), re.compile(r"(.)\1\1")
_RUN, _SINGLES = re.compile(b"\1(?:\0?\1)+"), re.compile(b"\1{3,}")


def _code(char: str) -> int:
    at = ord(char) - 97
    return at if 0 <= at < 26 else _OTHER


def _values(batch: pa.RecordBatch, name: str, step: int = 256) -> Iterator:
    """A column's values, few Python objects at a time."""
    column = batch.column(name)
    for at in range(0, len(column), step):
        yield from column.slice(at, step).to_pylist()


def _trigram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigrams of letter classes of a partition's texts, words bordered by edges."""
    table = np.full(256, _EDGE, dtype=np.int32)
    table[97:123] = np.arange(26)
    table[128:] = _OTHER  # bytes of other letters
    table[255] = _LETTERS**3  # no byte of UTF-8: it stands between texts, and no trigram holds it
    totals = np.zeros(_LETTERS**3, dtype=np.int64)
    for batch in batches:
        values = _values(batch, "text")
        while texts := [(t or "").encode("utf-8", "surrogatepass").lower() for t in islice(values, 128)]:
            raw = np.frombuffer(b"\xff".join(texts), dtype=np.uint8)
            for at in range(0, len(raw), 1 << 20):
                codes = table[raw[max(at - 2, 0) : at + (1 << 20)]]
                grams = (codes[:-2] * _LETTERS + codes[1:-1]) * _LETTERS + codes[2:]
                totals += np.bincount(grams[grams < len(totals)], minlength=len(totals))
    held = np.flatnonzero(totals)
    yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(totals[held])], names=["gram", "n"])


def character_model(texts: DataFrame) -> np.ndarray:
    """log P(letter | two letters before) from all texts, with one added to every count."""
    counted = texts.select("text").mapInArrow(_trigram_counts, "gram long, n long")
    with small_batches(texts.sparkSession):
        rows = counted.groupBy("gram").agg(F.sum("n").alias("n")).collect()  # 28 ** 3 rows at most
    counts = np.ones(_LETTERS**3)
    for r in rows:
        counts[r.gram] += r.n
    counts = counts.reshape(_LETTERS, _LETTERS, _LETTERS)
    return np.log(counts / counts.sum(axis=2, keepdims=True))


def decode(word: str, model: np.ndarray) -> str:
    """The most likely letters and blanks behind a word or a run; an exact best path over (last two
    letters). A blank is nothing or the border of a word."""
    word = " ".join(word.lower().split())
    # What is written so far hangs together backwards: (what came before, letter).
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(_EDGE, _EDGE): (0.0, None)}
    last = before = ""  # the two signs before that are no blanks
    for i, sign in enumerate(word):
        options: list[tuple[str, float]] = []  # letter, blank or nothing, log of the channel
        if sign == " ":
            single = word[i - 2 : i - 1] in ("", " ") and word[i + 2 : i + 3] in ("", " ")
            options += [("", -0.5), (" ", -2.0)] if single else [("", -3.0), (" ", -0.05)]
        elif sign.isalpha():
            options.append((sign, -0.05))
            if last == sign:
                options.append(("", -0.7 if before == sign else -2.5))
        else:
            options += [(letter, -1.5) for letter in LOOKALIKES.get(sign, "")]
            if sign in FILLERS:
                options += [("", -1.0), (" ", -2.5)]
            elif not LOOKALIKES.get(sign):
                options += [("", -2.0), (" ", -0.7)]
            else:
                options.append(("", -6.0))
        after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (two, one), (score, done) in states.items():
            for letter, channel in options:
                if letter:
                    code = _EDGE if letter == " " else _code(letter)
                    key, total = (one, code), score + channel + float(model[two, one, code])
                elif one == _EDGE and sign == last:
                    continue  # a letter behind a border repeats nothing
                else:
                    key, total = (two, one), score + channel
                if key not in after or total > after[key][0]:
                    after[key] = (total, (done, letter) if letter else done)
        states = after
        if sign != " ":
            last, before = sign, last
    done = max(
        ((score + model[two, one, _EDGE], done) for (two, one), (score, done) in states.items()),
        key=lambda s: s[0],
    )[1]
    letters = []
    while done:
        done, letter = done
        letters.append(letter)
    return "".join(reversed(letters))


class Restorer:
    """The words of a text as written and, where something is hidden, as restored."""

    def __init__(self, model: np.ndarray):
        self.model = model
        self.memo: dict[str, tuple[str, ...]] = {}
        self.runs: dict[str, str] = {}

    def token(self, token: str) -> tuple[str, ...]:
        """The word of a token, and its decoded words if it hides one."""
        found = self.memo.get(token)
        if found is None:
            plain = token.strip(_MARKS).lower()
            if not (_THRICE if plain.isalpha() else _HIDDEN).search(plain):
                return (plain,)
            found = (plain, *decode(plain, self.model).split())
            if len(self.memo) < _MEMO:
                self.memo[token] = found
        return found

    def run(self, tokens: list[str]) -> set[str]:
        """The words behind neighbouring tokens, blanks being nothing or borders."""
        first, *_, last = tokens = [t.lower() for t in tokens]
        # Two different letters settle the state of the lattice: what is beyond them changes nothing.
        start = len(first) - 2 if first[-2:].isalpha() and len(set(first[-2:])) == 2 else 0
        end = 2 if last[:2].isalpha() and len(set(last[:2])) == 2 else len(last)
        key = " ".join([first[start:], *tokens[1:-1], last[:end]])
        found = self.runs.get(key)
        if found is None:
            found = decode(key, self.model)
            if len(key) <= 256 and len(self.runs) < _MEMO:
                self.runs[key] = found
        return {w.strip(_MARKS) for w in (first[:start] + found + last[end:]).split()}

    def spaced(self, tokens: list[str]) -> set[str]:
        """Words that only runs restore: two and more single signs, tokens between and beside them."""
        flags = bytes(map((1).__eq__, map(len, tokens)))
        if b"\1\1" not in flags:
            return set()
        found: set[str] = set()
        for m in _RUN.finditer(flags):
            if b"\1\1" in m.group():
                run = tokens[max(m.start() - 1, 0) : m.end() + 1]
                found.update(self.run(run).difference(*map(self.token, run)))
        for m in _SINGLES.finditer(flags):  # one word spaced out is the commonest run
            found.add(decode(" ".join(tokens[m.start() : m.end()]), self.model).replace(" ", ""))
        return found

    def words(self, text: str) -> set[str]:
        tokens = text.split()
        return {w for t in set(tokens) for w in self.token(t)} | self.spaced(tokens)


def features(word: str) -> list[str]:
    """A word, and its beginnings, marked as such."""
    return [word, *(f"{word[:n]}*" for n in _PREFIXES if len(word) >= n)]


def text_features(words: set[str]) -> set[str]:
    """The features of all words of a text."""
    words = words - {""}
    return words.union(*({w[:n] + "*" for w in words if len(w) >= n} for n in _PREFIXES))


def _counted(kind: int, counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(counts.keys(), pa.string()), pa.array([kind] * len(counts), pa.int32()),
         pa.array(counts.values(), pa.int64())],
        names=["feature", "kind", "n"],
    )


def _sample_words(model: np.ndarray):
    """Distinct features of every sampled text, counted by half and label inside the partition."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model)
        kinds: list[Counter] = [Counter() for _ in range(4)]  # by half and label
        for batch in batches:
            columns = (_values(batch, c) for c in ("text", "half", "toxic"))
            for text, half, toxic in zip(*columns, strict=True):
                counts = kinds[2 * half + toxic]
                counts.update(text_features(restorer.words(text or "")))
                counts[""] += 1
                if sum(map(len, kinds)) > _MEMO:  # partial counts; they are summed after the shuffle
                    for kind, counts in enumerate(kinds):
                        yield _counted(kind, counts)
                        counts.clear()
        for kind, counts in enumerate(kinds):
            yield _counted(kind, counts)

    return rows


_ROOT, _NONE = frozenset({("", False)}), frozenset()
_DULLY = (0.0, 0.0, (), ())  # what is learnt of a token without any bearing


class Finder:
    """Every given word that a text holds on some path of the lattice, from one border to another.

    Blanks and marks are nothing or borders, and the beginnings of words that are open at one are
    carried on to what follows, however long the run.
    """

    def __init__(self, words: Collection[str], weight: Callable[[str], float] = lambda word: 1.0):
        long = sorted((weight(w), w) for w in words if len(w) > 2)
        self.goals = frozenset((w, True) for _, w in long)
        #: Beginnings of words, each with the largest weight of a word that begins so.
        self.begun = {w[:n]: weight for weight, w in long for n in range(1, len(w) + 1)}
        #: The same for words that go on.
        self.beyond = {w[:n]: weight for weight, w in long for n in range(1, len(w))}
        self.steps: dict[tuple, frozenset] = {}
        self.heads: dict[str, str] = {}

    def head(self, token: str) -> str:
        """Up to three letters at a token's front that only stand for themselves, or nothing."""
        head = token.lower()[:3]
        while head and not head.isalpha():
            head = head[:-1]
        if head and head[0] == head[1:2] or head[1:2] and head[1:2] == head[2:]:
            head = ""
        if token[:3].isascii():  # what follows has no say in how these are lowered
            self.heads[token[:3]] = head
        return head

    def promise(self, parts: tuple) -> float:
        """The largest weight of a word that may start in one of the parts, 0 if none does."""
        return max((self.begun[s] for _, open_ in parts for s, _ in open_), default=0.0)

    def onward(self, states: frozenset, part: str, last: str) -> frozenset:
        """``walk`` in two steps: few beginnings outlive the first signs, and these steps recur."""
        first = part[:3]
        # Letters without a repetition only stand for themselves: most beginnings end here.
        if first.isalpha() and first[0] != last and first[0] != first[1:2] != first[2:]:
            begun = self.begun
            if not any([s + first in begun for s, _ in states]):
                return _NONE
        key = (states, first, last)
        found = self.steps.get(key)
        if found is None:
            found = self.walk(states, part[:3], last)
            if len(self.steps) < _MEMO:
                self.steps[key] = found
        return self.walk(found, part[3:], part[2]) if found and len(part) > 3 else found

    def walk(self, states: frozenset, part: str, last: str) -> frozenset:
        """Beginnings of words after a part; each with whether a letter stands for itself in it."""
        for sign in part:
            letters = sign if sign.isalpha() else LOOKALIKES.get(sign, "")
            after = {(s + c, own or sign == c) for s, own in states for c in letters if s + c in self.begun}
            if sign == last or sign in "!|+(¡":
                after.update(s for s in states if s[0])
            states, last = after, sign
            if not states:
                break
        return frozenset(states)

    def parts(self, token: str) -> tuple:
        """A token's parts, each with the beginnings it leaves open when a word starts with it."""
        low = token.lower()
        if low not in self.begun and low.isalpha() and not _TWICE.search(low):
            return ((low, _NONE),)  # every letter can only stand for itself
        parts = [low] if low.isalpha() else [p for p in _APART.split(low) if p]
        return tuple((p, self.onward(_ROOT, p, "")) for p in parts)

    def __call__(self, tokens: list[str], opening: dict[str, tuple | str], second: float = 0.0) -> set[str]:
        """``opening`` has the parts of the tokens that leave beginnings open: words start there alone.

        A token of letters that only stand for themselves may come as these letters in place of its parts;
        such a token alone is not reported, and it opens nothing if no longer word begins so. Words of at most ``second`` in weight may be left out.
        """
        found: set[str] = set()
        goals, done = self.goals, -1
        weight_of, beyond_of, head_of, ends = self.begun.get, self.beyond.get, self.heads.get, len(tokens) - 1
        opened = list(map(opening.get, tokens))
        starts = [
            i for i, parts in enumerate(opened) if parts is not None and (
                parts.__class__ is not str  # else mostly no beginning goes on into the next token
                or i < ends and (
                    not (head := head_of(tokens[i + 1][:3])) or head[0] == parts[-1]
                    or weight_of(parts + head, 0.0) > second
                )
            )
        ]
        live = set()  # where a beginning outlives the next token; the others' own words are found here
        for start in starts:
            parts = opened[start]
            plain = parts.__class__ is str
            if start < ends and (plain or len(parts) == 1):
                token = tokens[start + 1]
                head = head_of(token[:3])
                if head is None:
                    head = self.head(token)
                # What of the next token only stands for itself: all of it, or up to a letter that stands twice.
                after = token.lower().rstrip(_ENDS)
                if after.isalpha():
                    if twice := _TWICE.search(after):
                        after = after[: twice.start() + 1]
                else:
                    after = head
                if plain:
                    if after and weight_of(parts + after, 0.0) <= second:
                        if after[0] != parts[-1] or weight_of(parts + after[1:], 0.0) <= second:
                            continue
                elif head and head[0] != parts[0][0][-1]:
                    states = parts[0][1]
                    for s, _ in states:
                        if weight_of(s + head, 0.0) > second and weight_of(s + after, 0.0) > second:
                            break
                    else:
                        if not goals.isdisjoint(states):
                            found.update(s for s, _ in goals & states)
                        continue
            live.add(start)
        for start in sorted(live):
            if start <= done:
                continue
            states, last = _NONE, ""
            for done in range(start, len(tokens)):
                parts = opened[done]
                if parts is None:  # it opens nothing, and only goes on with what is open
                    low = tokens[done].lower()
                    parts = ((low, _NONE),) if low.isalpha() else [(p, _NONE) for p in _APART.split(low) if p]
                elif parts.__class__ is str:
                    parts = ((parts, frozenset([(parts, True)]) if done in live else _NONE),)
                elif done not in live:
                    parts = ((parts[0][0], _NONE),)
                for part, begun in parts:
                    if states and (on := self.onward(states, part, last)):
                        states = begun | on if begun else on
                    else:
                        states = begun
                    if not goals.isdisjoint(states):
                        found.update(s for s, _ in goals & states)
                    if second and states:
                        states = frozenset([x for x in states if beyond_of(x[0], 0.0) > second])
                    last = part[-1]
                if not states:
                    break
        return found


class Scorer:
    """Strongest weights of a text's words, and the fitted score."""

    def __init__(self, model: np.ndarray, weights: dict[str, float], fit: np.ndarray | None):
        self.restorer, self.weights, self.fit = Restorer(model), weights, fit
        self.begins = {f[:-1]: weight for f, weight in weights.items() if f.endswith("*")}
        #: How the features of a word of four and more letters begin: the weight of these letters, and
        #: whether no feature that begins so has more; the beginnings of five letters.
        best: dict[str, float] = {}
        for f, weight in weights.items():
            best[f[:4]] = max(weight, best.get(f[:4], 0.0))
        self.fours = {b: (self.begins.get(b, 0.0), self.begins.get(b, 0.0) == weight) for b, weight in best.items()}
        self.fives = {f[:5] for f in weights if len(f) > 4}
        self.finder = Finder([f for f in weights if not f.endswith("*")], self.known)
        #: Tokens without a weight or an open beginning, and of others what ``learnt`` says.
        self.dull: set[str] = set()
        self.filed: dict[str, tuple[float, float, tuple | str, tuple | str]] = {}

    def learnt(self, token: str) -> tuple[float, float, tuple | str, tuple | str]:
        """The strongest weight among the features of a token's words, the strongest of the words that
        may start in it, its parts where one may, and its words where one has a weight. Where letters only
        stand for themselves these are the parts and the word. The token is filed while there is room: the
        frequent ones come first, and the others are looked at again each time."""
        plain = token.strip(_MARKS).lower()
        plainly = plain.isalpha() and "(" not in token
        if plainly and len(plain) >= 4:
            # Where no feature begins so, it does not matter what letters beyond repeat one before.
            four = self.fours.get(plain[:4])
            if (four is None or not four[0] and len(plain) >= 5 and plain[:5] not in self.fives) and not _TWICE.search(
                plain, 0, 5
            ):
                if len(self.dull) < _DULL:
                    self.dull.add(token)
                return _DULLY
        twice = _TWICE.search(plain) if plainly else None
        begun = self.finder.begun
        if plainly and twice is None:
            # Nothing is hidden: the word, and the only beginning that the token may leave open.
            weight, promise = self.known(plain), self.finder.beyond.get(plain, 0.0)
            if plain == token:
                plain = token
            entry = weight, promise, plain, plain if weight else ()
        elif plainly and not _TWICE.search(plain, twice.start() + 1):
            # One letter stands twice, and the second may stand for nothing.
            at = twice.start()
            either = [w for w in (plain, plain[:at] + plain[at + 1 :]) if w in begun]
            weight, promise = self.known(plain), max([begun[w] for w in either], default=0.0)
            parts = ((plain, frozenset([(w, True) for w in either])),) if promise else ()
            entry = weight, promise, parts, plain if weight else ()
        else:
            words = self.restorer.token(token)
            parts = self.finder.parts(token)
            promise = self.finder.promise(parts)
            weight = max(map(self.known, words))
            entry = weight, promise, parts if promise else (), words if weight else ()
        if weight or promise:
            if len(self.filed) < _FILED:
                self.filed[token] = entry
        elif len(self.dull) < _DULL:
            self.dull.add(token)
        return entry

    def known(self, word: str) -> float:
        size = len(word)
        if size >= 4:
            four = self.fours.get(word[:4])
            if four is None:
                return 0.0
            if four[1] or size > 4 and word[:5] not in self.fives:
                return four[0]
        weight = self.weights.get(word, 0.0)
        for n in _PREFIXES:
            if size < n:
                break
            weight = max(weight, self.begins.get(word[:n], 0.0))
        return weight

    def apart(self, tokens: list[str], held: dict[str, tuple], second: float) -> list[float]:
        """Weights of words that tokens hold together or beside others, without those of single tokens.

        Words with a weight of at most ``second`` may be left out. A token that holds a word with a
        weight has one itself, so that only such ones are compared.
        """
        found = self.restorer.spaced(tokens)
        opening = {t: entry[2] for t, entry in held.items() if entry[1] > second}
        if opening:
            found |= self.finder(tokens, opening, second)
        weights = {w: weight for w in found if (weight := self.known(w)) > second}
        if weights:
            words = (entry[3] for entry in held.values() if entry[0] > second)
            for word in {w for one in words for w in ((one,) if one.__class__ is str else one)}.intersection(weights):
                del weights[word]
        return list(weights.values())

    def inputs(self, text: str | None) -> tuple[float, float, float]:
        """1 and the two strongest weights: sums would grow with the length of a clean text."""
        tokens = (text or "").split()
        filed, learnt = self.filed, self.learnt
        held = {t: filed[t] if t in filed else learnt(t) for t in set(tokens).difference(self.dull)}
        one, two = sorted([0.0, 0.0, *[entry[0] for entry in held.values()]])[:-3:-1]
        # Only a word with more weight than the second strongest changes what is returned.
        one, two = sorted([one, two, *self.apart(tokens, held, two)], reverse=True)[:2]
        return 1.0, one, two

    def __call__(self, text: str | None) -> float:
        z = float(np.dot(self.fit, self.inputs(text)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _sample_inputs(model: np.ndarray, weights: dict[str, float]):
    """Inputs of sampled texts under the weights of the half they are not in."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model, weights, None)
        for batch in batches:
            found = [scorer.inputs(text) for text in _values(batch, "text")]
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.float64()),
                 batch.column("toxic")],
                names=["a", "b", "toxic"],
            )

    return rows


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, steps: int = 100) -> np.ndarray:
    """Newton steps with a small ridge, halved until the loss falls, so that the fit cannot run off."""
    beta = np.zeros(x.shape[1])
    keep = np.eye(x.shape[1]) * ridge
    keep[0, 0] = 1e-3

    def loss(b: np.ndarray) -> float:
        z = x @ b
        return float(np.logaddexp(0, z).sum() - y @ z + b @ keep @ b / 2)

    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (p - y) + keep @ beta
        move = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, slope)
        step, now = 1.0, loss(beta)
        while step > 1e-9 and loss(beta - step * move) > now - 1e-4 * step * float(slope @ move):
            step /= 2
        beta = beta - step * move
        if step * np.abs(move).max() < 1e-8:
            break
    return beta


def held_out(id_column: Column, folds: int = 5) -> Column:
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % folds == 0, F.lit(False))


def learn(
    documents: DataFrame, labels: DataFrame, model: np.ndarray, *, sample: int = 30_000,
    vocabulary: int = 20_000,
) -> tuple[dict[str, float], np.ndarray]:
    """(feature weights, fitted coefficients) from at most ``sample`` labelled rows outside the fold.

    The sample is the rows with the smallest hash of their id; ``vocabulary`` bounds the weights kept.
    """
    spark = documents.sparkSession
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(
        F.max("toxic").cast("int").alias("toxic")
    )
    drawn = known.filter(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = [(r.doc_id, r.toxic) for r in drawn.collect()]  # bounded by ``sample``
    chosen = spark.createDataFrame(rows, "doc_id long, toxic int").withColumn(
        "half", (F.shiftright(F.xxhash64("doc_id"), 20) % 2 == 0).cast("int")
    )
    texts = documents.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "half", "toxic")
    # A copy tells nothing new: a text stands once, toxic if any copy is, in the half of its smallest id.
    texts = texts.groupBy("text").agg(F.min_by("half", "doc_id").alias("half"), F.max("toxic").alias("toxic"))
    texts = materialise(texts, "sample")
    counted = (
        texts.mapInArrow(_sample_words(model), "feature string, kind int, n long")
        .groupBy("feature").pivot("kind", [0, 1, 2, 3]).agg(F.sum("n")).na.fill(0)
        .toDF("feature", "clean0", "toxic0", "clean1", "toxic1")
    )
    counted = materialise(counted, "features")
    totals = counted.filter("feature = ''").first()
    n = [0, 0, 0, 0] if totals is None else list(totals)[1:]
    n0, n1 = n[0] + n[2], n[1] + n[3]
    if not n0 or not n1:
        return {}, np.array([math.log((n1 + 0.5) / (n0 + 0.5)), 0.0, 0.0])

    def weights_of(toxic: Column, clean: Column, n1: int, n0: int) -> dict[str, float]:
        if not n0 or not n1:
            return {}
        a, b = toxic + 0.5 * n1 / (n0 + n1), clean + 0.5 * n0 / (n0 + n1)
        weight = F.log(a / n1) - F.log(b / n0) - _ERRORS * F.sqrt(1 / a + 1 / b)
        strong = (
            counted.filter((F.col("feature") != "") & (toxic >= 2)).select("feature", weight.alias("w"))
            .filter("w > 0").orderBy(F.desc("w"), "feature").limit(vocabulary)
        )
        return {r.feature: float(r.w) for r in strong.collect()}  # bounded by ``vocabulary``

    c = F.col
    halves = [weights_of(c(f"toxic{h}"), c(f"clean{h}"), n[2 * h + 1], n[2 * h]) for h in (0, 1)]
    weights = weights_of(c("toxic0") + c("toxic1"), c("clean0") + c("clean1"), n1, n0)
    # A task holds the words of one half at a time.
    of = [
        texts.filter(c("half") == h).mapInArrow(_sample_inputs(model, halves[1 - h]), "a double, b double, toxic int")
        for h in (0, 1)
    ]
    with small_batches(spark):
        fitted = of[0].union(of[1]).collect()  # bounded by ``sample``
    fitted = np.array(sorted((r.a, r.b, r.toxic) for r in fitted))  # sums in one order
    return weights, fit_logistic(np.column_stack([np.ones(len(fitted)), fitted[:, :2]]), fitted[:, 2])


def score_toxicity(
    documents: DataFrame,
    labels: DataFrame,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    sample: int = 30_000,
    with_place: bool = False,
) -> DataFrame:
    """A toxicity score for every whole text, learnt from labels of other folds.

    ``labels`` has doc_id and toxic (0 or 1). Returns id_column, held_out (the crc32 of the id as
    text is divisible by 5), score (0 to 1) and predicted (1 from 0.5): one row for every input row.

    With ``with_place`` a hash of id and text comes along.

    Texts are the only input of a score. NULL and empty texts get the score of a text without strong
    words. Labels with NULLs are left out; of an id labelled twice the higher label counts. Without
    labels of both kinds every score is their rate. Repeated rows and NULL ids are scored one by one
    (a NULL id is not held out); other columns are not read, whatever their names.
    """
    source = documents.select(
        F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"),
        F.xxhash64(F.col(id_column).cast("long"), F.col(text_column)).alias("place"),
    )
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")
    model = character_model(source)
    weights, fit = learn(source, labels, model, sample=sample)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model, weights, fit)
        for batch in batches:
            scores = [scorer(t) for t in _values(batch, "text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("place"), pa.array(scores, pa.float64())],
                names=["doc_id", "place", "score"],
            )

    scored = source.mapInArrow(rows, "doc_id long, place long, score double")
    return scored.select(
        F.col("doc_id").alias(id_column), held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), *(["place"] if with_place else []),
    )
