"""Token counts and ids by a compiled finite-state tokenizer (operator 6).

A byte-level BPE vocabulary is compiled into two deterministic transducers.

The first cuts text into pieces. It reads character classes (letter, number, blank, other white
space, the rest, and the letters of contractions); where a piece starts follows from the classes of a
character and its neighbours, so it runs over whole blocks of text at once.

The second reads the bytes of a piece. Its state after a byte is the last token of the prefix's
encoding with those before it: of the tokens that end here exactly one may follow the token that
ends where it starts, and the transition's emission is the change of the token count. Two tokens may
stand side by side if no merge across their border comes before the merges that make them; that is
found by undoing their merges from the last to the first. It runs in lockstep over all new pieces
of a block; finished pieces keep their path in a table of bounded size.

A long text is cut into chunks. A chunk's state map holds what it emits whatever comes before: the
count between its first and last synchronising point (white space after other characters, where a
piece always ends) and the open ends. Maps compose associatively, in pairs, like a prefix scan.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_U = np.uint64
_LETTER, _NUMBER, _SPACE, _OTHER, _EDGE = range(5)
_BLOCK = 1 << 20  # characters handled at once
_CHUNK = 1 << 18  # characters of a chunk of a long text
_WIDE = 64  # bytes of a piece up to which pieces run in lockstep
_KEPT = 1 << 20  # pieces whose path is kept
_SYNC = regex.compile(r"\P{White_Space}(?=\p{White_Space})")


def _classes() -> np.ndarray:
    """Class of every code point; one beyond the last stands for the edge of a text."""
    out = np.full(0x110001, _OTHER, dtype=np.int8)
    points = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    text = "".join(points)
    for kind, pattern in ((_LETTER, r"\p{L}"), (_NUMBER, r"\p{N}"), (_SPACE, r"\p{White_Space}")):
        out[[ord(c) for c in regex.findall(pattern, text)]] = kind
    out[0x110000] = _EDGE
    return out


def _byte_names() -> dict[str, int]:
    """Visible characters that stand for bytes in the vocabulary: printable ones for themselves."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def _spread(pairs: np.ndarray) -> np.ndarray:
    return (pairs.astype(_U) * _U(0x9FB21C651E98DF25)) >> _U(42)


def piece_starts(points: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Where pieces start. ``points`` are code points with an edge before, between and after texts."""
    before, after = np.roll(kinds, 1), np.roll(kinds, -1)
    blank_before = np.roll(points, 1) == 0x20
    space = kinds == _SPACE
    solid = ~space & (kinds != _EDGE)
    starts = solid & (kinds != before) & ~blank_before
    # white space: at the start of a run, and its last character where other characters follow
    starts |= space & (before != _SPACE)
    starts |= space & (before == _SPACE) & (after != _SPACE) & (after != _EDGE)
    quotes = np.flatnonzero(starts & (points == 0x27))
    if len(quotes):  # 's 't 'm 'd 're 've 'll
        one, two = points[quotes + 1], points[np.minimum(quotes + 2, len(points) - 1)]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = np.zeros(len(quotes), dtype=bool)
        for a, b in ("re", "ve", "ll"):
            long |= (one == ord(a)) & (two == ord(b))
        starts[quotes[short | long] + 1] = False
        for found, size in ((quotes[short], 2), (quotes[long], 3)):
            starts[found + size] |= kinds[found + size] == _LETTER
    return starts


class Compiled:
    """The transducers of one vocabulary file, and the paths of pieces seen so far."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        names, model = _byte_names(), spec["model"]
        vocab = model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        top = max(vocab.values()) + 1
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.rank = np.full(top, -1, dtype=np.int64)
        self.left, self.right = np.arange(top), np.arange(top)
        self.base = np.zeros(256, dtype=np.int64)
        for name, byte in names.items():
            self.base[byte] = vocab[name]
        keys = np.zeros(len(merges), dtype=np.int64)
        for k, (a, b) in enumerate(merges):
            made = vocab[a + b]
            self.rank[made], self.left[made], self.right[made] = k, vocab[a], vocab[b]
            keys[k] = vocab[a] << 32 | vocab[b]
        self.pair_rank = np.argsort(keys)
        self.pairs = keys[self.pair_rank]
        rng = np.random.default_rng(5)
        base = 0x9E3779B97F4A7C15
        self.values = rng.integers(0, 1 << 64, 256, dtype=_U) | _U(1)
        self.points = rng.integers(0, 1 << 64, 0x110001, dtype=_U) | _U(1)
        self.bases = (base, pow(base, -1, 1 << 64))
        self._powers_to(_BLOCK + _BLOCK // 4)
        specials = set(self.special)
        tokens = {
            i: bytes(names[c] for c in name) for name, i in vocab.items() if name not in specials
        }
        self.size = np.zeros(top, dtype=np.int64)
        hashes, ids = [], []
        for i, raw in tokens.items():
            self.size[i] = len(raw)
            hashes.append(self._hash(np.frombuffer(raw, dtype=np.uint8)))
            ids.append(i)
        order = np.argsort(np.array(hashes, dtype=_U))
        self.token_hash, self.token_id = np.array(hashes, dtype=_U)[order], np.array(ids)[order]
        self.longest = int(self.size.max())
        # Bits that most absent keys miss, so that few are looked up in the sorted tables.
        self.maybe_token = np.zeros(1 << 22, dtype=bool)
        self.maybe_token[self.token_hash >> _U(42)] = True
        self.maybe_pair = np.zeros(1 << 22, dtype=bool)
        self.maybe_pair[_spread(self.pairs)] = True
        self.classes = _classes()
        self.cut = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self._forget()

    def _powers_to(self, n: int) -> None:
        self.up, self.down = (
            np.cumprod(np.r_[_U(1), np.full(n, b, dtype=_U)], dtype=_U) for b in self.bases
        )

    def _hash(self, raw: np.ndarray) -> int:
        return np.add.reduce(self.values[raw] * self.up[: len(raw)], dtype=_U)

    def _forget(self) -> None:
        self.known = np.zeros(0, dtype=_U)
        self.where = np.zeros(0, dtype=np.int64)  # start of a piece's ids in the pool
        self.count = np.zeros(0, dtype=np.int64)
        self.pool = np.zeros(0, dtype=np.uint32)

    def _beside(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Whether the tokens may stand side by side."""
        fine = np.ones(len(one), dtype=bool)
        at = np.arange(len(one))
        x, y = one.copy(), two.copy()
        end_x = end_y = np.full(len(one), 1 << 40)  # rank of the merge that uses them up
        while len(at):
            key = x << 32 | y
            crossed = self.maybe_pair[_spread(key)]
            ask = np.flatnonzero(crossed)
            found = np.minimum(np.searchsorted(self.pairs, key[ask]), len(self.pairs) - 1)
            rank = self.pair_rank[found]
            crossed[ask] = (
                (self.pairs[found] == key[ask]) & (rank < end_x[ask]) & (rank <= end_y[ask])
            )
            fine[at[crossed]] = False
            made_x, made_y = self.rank[x], self.rank[y]
            on = ~crossed & ((made_x >= 0) | (made_y >= 0))
            at, x, y, end_x, end_y = at[on], x[on], y[on], end_x[on], end_y[on]
            made_x, made_y = made_x[on], made_y[on]
            undo = made_x > made_y  # the later merge is undone first
            end_x, end_y = np.where(undo, made_x, end_x), np.where(undo, end_y, made_y)
            x, y = np.where(undo, self.right[x], x), np.where(undo, y, self.left[y])
        return fine

    def _paths(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces one after the other, counts), in lockstep over the pieces' bytes."""
        n = len(pieces)
        sizes = np.array([len(p) for p in pieces])
        order = np.argsort(-sizes, kind="stable")
        sizes = sizes[order]
        wide = int(sizes[0])
        raw = np.zeros((wide, n), dtype=np.uint8)
        flat = np.frombuffer(b"".join(pieces[i] for i in order), dtype=np.uint8)
        column = np.repeat(np.arange(n), sizes)
        row = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        raw[row, column] = flat
        sums = np.zeros((wide + 1, n), dtype=_U)
        np.cumsum(self.values[raw] * self.up[:wide, None], axis=0, out=sums[1:])
        last = np.zeros((wide + 1, n), dtype=np.int64)
        tokens = np.zeros((wide + 1, n), dtype=np.int32)
        for end in range(1, wide + 1):
            open_ = np.arange(np.searchsorted(-sizes, -end, side="right"))
            done = np.zeros(n, dtype=bool)
            for start in range(max(0, end - self.longest), end):
                if not len(open_):
                    break
                if end - start == 1:
                    token, held = self.base[raw[start, open_]], open_
                else:
                    hashed = (sums[end, open_] - sums[start, open_]) * self.down[start]
                    ask = np.flatnonzero(self.maybe_token[hashed >> _U(42)])
                    if not len(ask):
                        continue
                    hashed = hashed[ask]
                    at = np.minimum(np.searchsorted(self.token_hash, hashed), len(self.token_id) - 1)
                    is_token = self.token_hash[at] == hashed
                    token, held = self.token_id[at[is_token]], open_[ask[is_token]]
                if not len(held):
                    continue
                if start:
                    fits = self._beside(last[start, held], token)
                    token, held = token[fits], held[fits]
                last[end, held] = token
                tokens[end, held] = tokens[start, held] + 1
                if len(held):
                    done[held] = True
                    open_ = open_[~done[open_]]
        counts = tokens[sizes, np.arange(n)].astype(np.int64)
        ends = np.cumsum(counts)
        out = np.zeros(int(ends[-1]), dtype=np.uint32)
        at, column, place = sizes.copy(), np.arange(n), ends - 1
        while len(column):
            token = last[at, column]
            out[place] = token
            at = at - self.size[token]
            on = at > 0
            at, column, place = at[on], column[on], place[on] - 1
        back = np.argsort(order, kind="stable")
        starts = (ends - counts)[back]
        counts = counts[back]
        take = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(len(out))
        return out[take], counts

    def _long_path(self, piece: bytes) -> np.ndarray:
        """The same for one long piece, byte by byte."""
        last, ends = [0], []
        names = self._names()
        for end in range(1, len(piece) + 1):
            for start in range(max(0, end - self.longest), end):
                token = names.get(piece[start:end])
                if token is not None and (
                    not start or self._beside(np.array([last[start]]), np.array([token]))[0]
                ):
                    last.append(token)
                    break
        at = len(piece)
        while at:
            ends.append(last[at])
            at -= int(self.size[last[at]])
        return np.array(ends[::-1], dtype=np.uint32)

    def _names(self) -> dict[bytes, int]:
        if not hasattr(self, "by_bytes"):
            whole: dict[int, bytes] = {int(i): bytes([b]) for b, i in enumerate(self.base)}
            for i in np.argsort(self.rank):
                if self.rank[i] >= 0:
                    whole[int(i)] = whole[int(self.left[i])] + whole[int(self.right[i])]
            self.by_bytes = {raw: i for i, raw in whole.items()}
        return self.by_bytes

    def _learn(self, hashes: np.ndarray, pieces: list[str]) -> None:
        raw = [p.encode("utf-8") for p in pieces]
        short = [i for i, r in enumerate(raw) if len(r) <= _WIDE]
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for some, most in (
            ([i for i in short if len(raw[i]) <= 16], 160_000),
            ([i for i in short if len(raw[i]) > 16], 20_000),
        ):
            for at in range(0, len(some), most):
                ids, counts = self._paths([raw[i] for i in some[at : at + most]])
                found.append((hashes[some[at : at + most]], ids, counts))
        for i, r in enumerate(raw):
            if len(r) > _WIDE:
                ids = self._long_path(r)
                found.append((hashes[i : i + 1], ids, np.array([len(ids)])))
        counts = np.concatenate([f[2] for f in found])
        starts = len(self.pool) + np.cumsum(counts) - counts
        self.pool = np.concatenate([self.pool, *[f[1] for f in found]])
        added = np.concatenate([f[0] for f in found])
        order = np.argsort(added)
        place = np.searchsorted(self.known, added[order])
        self.known = np.insert(self.known, place, added[order])
        self.where = np.insert(self.where, place, starts[order])
        self.count = np.insert(self.count, place, counts[order])

    def _pieces(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(row of the table for every piece of the texts, pieces of each text)."""
        edge = np.array([0x110000], dtype=np.uint32)
        parts = [edge]
        for text in texts:
            parts += [np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32), edge]
        points = np.concatenate(parts)
        if len(points) > len(self.up):
            self._powers_to(2 * len(points))
        kinds = self.classes[points]
        starts = np.flatnonzero(piece_starts(points, kinds))
        edges = np.flatnonzero(kinds == _EDGE)
        per_text = np.diff(np.searchsorted(starts, edges))
        ends = np.append(starts[1:], len(points) - 1)
        last = per_text.cumsum()[per_text > 0] - 1
        ends[last] = edges[1:][per_text > 0]
        sums = np.zeros(len(points) + 1, dtype=_U)
        np.cumsum(self.points[points] * self.up[: len(points)], out=sums[1:])
        hashed, inverse = np.unique(
            (sums[ends] - sums[starts]) * self.down[starts], return_inverse=True
        )
        at = np.minimum(np.searchsorted(self.known, hashed), max(len(self.known) - 1, 0))
        new = self.known[at] != hashed if len(self.known) else np.ones(len(hashed), dtype=bool)
        if new.any():
            if len(self.known) > _KEPT:
                self._forget()
                new[:] = True
            first = np.zeros(len(hashed), dtype=np.int64)
            first[inverse] = np.arange(len(inverse))
            which = first[new]
            flat = points.tobytes()
            cut = [flat[4 * a : 4 * b].decode("utf-32-le")
                   for a, b in zip(starts[which].tolist(), ends[which].tolist(), strict=True)]
            self._learn(hashed[new], cut)
            at = np.searchsorted(self.known, hashed)
        return at[inverse], per_text

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text; texts must be whole or closed parts."""
        rows, per_text = self._pieces(texts)
        sums = np.concatenate([[0], np.cumsum(self.count[rows])])
        ends = np.cumsum(per_text)
        return sums[ends] - sums[ends - per_text]

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each text."""
        rows, per_text = self._pieces(texts)
        counts = self.count[rows]
        ends = np.cumsum(counts)
        take = np.repeat(self.where[rows] - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)
        flat = self.pool[take]
        bounds = np.concatenate([[0], ends])[np.cumsum(per_text)]
        return np.split(flat, bounds[:-1]) if len(bounds) else []


def closed_parts(text: str, chunk: int = _CHUNK) -> Iterator[str]:
    """A text cut at synchronising points, about every ``chunk`` characters."""
    at = 0
    while len(text) - at > chunk and (found := _SYNC.search(text, at + chunk)) is not None:
        yield text[at : found.end()]
        at = found.end()
    yield text[at:]


@dataclass(frozen=True)
class StateMap:
    """What a chunk emits: ``count`` tokens between its open ends; closed is False without a
    synchronising point, when the whole chunk is one open end."""

    head: str
    count: int = 0
    tail: str = ""
    closed: bool = True


def state_map(chunk: str, count) -> StateMap:
    """``count`` gives the tokens of a closed text."""
    first = _SYNC.search(chunk)
    if first is None:
        return StateMap(chunk, closed=False)
    back = _SYNC.search(chunk, max(0, len(chunk) - 4096))
    last = first
    for last in _SYNC.finditer(chunk, back.start() if back else first.start()):
        pass
    middle = chunk[first.end() : last.end()]
    return StateMap(chunk[: first.end()], count(middle) if middle else 0, chunk[last.end() :])


def compose(one: StateMap, two: StateMap, count) -> StateMap:
    """The map of two chunks that follow each other; associative."""
    if not one.closed:
        return StateMap(one.head + two.head, two.count, two.tail, two.closed)
    if not two.closed:
        return StateMap(one.head, one.count, one.tail + two.head)
    return StateMap(one.head, one.count + count(one.tail + two.head) + two.count, two.tail)


def scan(maps: list[StateMap], count) -> StateMap:
    """All maps composed, neighbours in pairs, round by round."""
    while len(maps) > 1:
        pairs = [compose(a, b, count) for a, b in zip(maps[::2], maps[1::2], strict=False)]
        maps = pairs + maps[len(maps) // 2 * 2 :]
    return maps[0]


_MACHINES: dict[str, Compiled] = {}


def compiled(path: str) -> Compiled:
    """One machine per process, with its table of pieces, where the package can be imported."""
    try:
        from ecocline.llm import tokens as home
    except ImportError:  # functions travel by value to executors without the package
        return Compiled(path)
    if path not in home._MACHINES:
        home._MACHINES[path] = home.Compiled(path)
    return home._MACHINES[path]


class Counter:
    """Token counts of whole texts of any length; special strings are one token each."""

    def __init__(self, path: str, chunk: int = _CHUNK, block: int = _BLOCK):
        self.machine, self.chunk, self.block = compiled(path), chunk, block

    def _one(self, text: str) -> int:
        return int(self.machine.counts([text])[0])

    def _long(self, text: str) -> int:
        cuts = range(0, len(text), self.chunk)
        whole = scan([state_map(text[a : a + self.chunk], self._one) for a in cuts], self._one)
        rest = [t for t in (whole.head, whole.tail) if t]
        return whole.count + sum(self._one(t) for t in rest)

    def __call__(self, texts: list[str | None]) -> list[int]:
        machine = self.machine
        total = [0] * len(texts)
        held: list[str] = []
        owner: list[int] = []
        size = 0

        def flush() -> None:
            nonlocal size
            for i, n in zip(owner, machine.counts(held).tolist() if held else [], strict=True):
                total[i] += n
            held.clear()
            owner.clear()
            size = 0

        for i, text in enumerate(texts):
            parts = [text or ""]
            if machine.cut is not None and machine.cut.search(parts[0]):
                total[i] += len(machine.cut.findall(parts[0]))
                parts = machine.cut.split(parts[0])
            for part in parts:
                if len(part) > self.chunk:
                    total[i] += self._long(part)
                elif part:
                    if size + len(part) > self.block:
                        flush()
                    held.append(part)
                    owner.append(i)
                    size += len(part) + 1
        flush()
        return total


class Encoder:
    """Token ids of whole texts of any length; special strings are their own token."""

    def __init__(self, path: str, block: int = _BLOCK, chunk: int = _CHUNK):
        self.machine, self.block, self.chunk = compiled(path), block, chunk

    def __call__(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids text by text, as unsigned 32-bit numbers; parts of a block are encoded together."""
        held: list[list[str]] = []
        size = 0
        for text in texts:
            parts = [text or ""]
            if self.machine.cut is not None and self.machine.cut.search(parts[0]):
                parts = regex.split(f"({self.machine.cut.pattern})", parts[0])
            parts = [q for p in parts for q in closed_parts(p, self.chunk)]
            if held and size + sum(map(len, parts)) > self.block:
                yield from self._together(held)
                held, size = [], 0
            held.append(parts)
            size += sum(map(len, parts)) + len(parts)
        yield from self._together(held)

    def _together(self, held: list[list[str]]) -> Iterator[np.ndarray]:
        special = self.machine.special
        flat = iter(self.machine.ids([p for parts in held for p in parts if p not in special]))
        for parts in held:
            ids = [np.array([special[p]], dtype=np.uint32) if p in special else next(flat) for p in parts]
            yield ids[0] if len(ids) == 1 else np.concatenate(ids)


def count_tokens(
    documents: DataFrame,
    vocabulary: str,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    limit: int = 512,
) -> DataFrame:
    """Tokens of every whole text under the byte-level BPE file at ``vocabulary``.

    The file must be readable at that path on every executor. Returns id_column, n_bytes (UTF-8),
    n_tokens and over_limit (more than ``limit`` tokens): one row for every input row.

    NULL and empty texts have 0 bytes and tokens. The file's special strings count one token where
    they occur; no begin or end token is added and nothing is cut off. Repeated rows and NULL ids are
    kept as they are; other columns are not read, whatever their names.
    """
    schema = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocabulary)
        for batch in batches:
            counts = counter(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("n_bytes"), pa.array(counts, pa.int64())],
                schema=schema,
            )

    text = F.coalesce(F.col(text_column), F.lit(""))
    source = documents.select(
        F.col(id_column).cast("long").alias("id"), text.alias("text"),
        F.octet_length(text).cast("long").alias("n_bytes"),
    )
    counted = source.mapInArrow(rows, "id long, n_bytes long, n_tokens long")
    return counted.select(
        F.col("id").alias(id_column), "n_bytes", "n_tokens",
        (F.col("n_tokens") > limit).alias("over_limit"),
    )
