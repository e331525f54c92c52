"""Byte-level BPE: encoding by a lazily determinised transducer, streaming decoding by a UTF-8 state machine."""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import arrow_map

STATES = 100_000
COLUMNS = 128
CACHE = 300_000
CACHE_IDS = 4_000_000
FEW = 8
FOLLOWED = 4096
PAIRS = 300_000
GROUP_CHARS = 1_500_000
DECODE_STEP = 4096
# The white space of the pattern; a chunk is an optional blank and what has no white space, or white space.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
ASCII = {r"\p{L}": "A-Za-z", r"\p{N}": "0-9", r"\s": r"\t-\r\x20"}
CHUNK = re.compile(rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


def merge_by_rank(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The definition: merge the pair of lowest rank, the leftmost first, until no pair has a rank."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
        if not found:
            break
        _, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


def grown(array: np.ndarray, size: int) -> np.ndarray:
    """``array`` with room for ``size`` values at least."""
    if size <= len(array):
        return array
    return np.concatenate([array, np.zeros(max(size - len(array), len(array) // 2), array.dtype)])


def by_key(values: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order, and their values."""
    keys, held = np.fromiter(values.keys(), np.int64, len(values)), np.fromiter(values.values(), np.int64, len(values))
    order = np.argsort(keys)
    return keys[order], held[order]


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` that begin at ``starts``, one behind the other."""
    shift = starts - (np.cumsum(lengths) - lengths)
    return flat[np.repeat(shift, lengths) + np.arange(lengths.sum())]


class Transducer:
    """The merges as a finite-state transducer from bytes to tokens, determinised only where texts lead.

    A sequence of tokens is the encoding of its bytes exactly if each token, and each neighbouring pair, encodes to
    itself; and the encoding of a prefix that ends at a border is the tokens up to it. So every prefix has one last
    token, found among the trie nodes alive at its end. A state is the set of alive trie nodes, each with the token
    before it; an arc gives out the last token of the prefix it completes. Borders older than the oldest alive node
    can no longer change, so a token is settled after at most the length of the longest token; reading back from the
    end gives the settled chain. States and arcs are made when first met and forgotten beyond ``STATES``. Many pieces
    run side by side, one byte of each at a time, through a table of the arcs; the arcs that a step lacks are made together.
    """

    NOTHING = 0xFFFFF
    NEVER = 1 << 40

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.length_of = {rank: len(token) for token, rank in ranks.items()}
        self.child: dict[int, int] = {}  # of a node and a byte
        tokens, inner = [-1], [True]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                inner[node] = True
                below = self.child.setdefault(node << 8 | byte, len(tokens))
                if below == len(tokens):
                    tokens.append(-1)
                    inner.append(False)
                node = below
            tokens[node] = rank
        self.tokens, self.token_at, self.inner = tokens, np.array(tokens), np.array(inner)
        self.child_keys, self.child_nodes = by_key(self.child)
        common = np.bincount(np.frombuffer(b"".join(ranks), np.uint8), minlength=256).argsort()[::-1][: COLUMNS - 1]
        self.column = np.full(256, COLUMNS - 1)  # the last column is never filled: arcs of rare bytes are in a dictionary
        self.column[common] = np.arange(COLUMNS - 1)
        self.sizes = np.zeros(max(self.bytes_of) + 1, np.int64)
        self.sizes[list(self.length_of)] = list(self.length_of.values())
        joined = {self.NOTHING << 20: self.NEVER}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                left, right = ranks.get(token[:k]), ranks.get(token[k:])
                if left is not None and right is not None:
                    joined[left << 20 | right] = rank
        self.joined_keys, self.joined = by_key(joined)
        self.edges: dict[int, tuple | None] = {}
        self.pairs: dict[int, bool] = {}
        # The edges of the tokens met, one behind the other: rank of the next merge, first and last symbol before it.
        self.rows, self.n_rows = np.zeros((3, 1 << 16), np.int64), 0
        self.row_at = np.full(len(self.sizes), -1)  # -1: not met, -2: merging does not give the token back
        self._reset()

    def _reset(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.rare: dict[int, int] = {}
        self.table = np.full((STATES, COLUMNS), -1, np.int32)
        self.label = np.zeros(STATES, np.int64)
        self.entries = np.zeros(4 * STATES, np.int64)  # of all states, one behind the other
        self.begins = np.zeros(STATES + 1, np.int64)
        self._numbered([self.NOTHING])

    def _room(self, states: int, entries: int) -> None:
        self.entries = grown(self.entries, entries)
        self.begins = grown(self.begins, states + 1)
        self.label = grown(self.label, states)
        if states > len(self.table):
            self.table = np.concatenate([self.table, np.full((len(self.table) // 2 + states - len(self.table), COLUMNS), -1, np.int32)])

    def _numbered(self, state: list[int]) -> int:
        """The number of a state; a new one is kept."""
        known = len(self.numbers)
        number = self.numbers.setdefault(array("q", state).tobytes(), known)
        if number == known:
            begin = int(self.begins[known])
            end = begin + len(state)
            self._room(known + 1, end)
            self.entries[begin:end], self.begins[known + 1], self.label[known] = state, end, state[-1]
        return number

    def _number(self, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """:meth:`_numbered` of many states: their entries one behind the other, and the number of entries of each."""
        known, numbers, raw = len(self.numbers), self.numbers, flat.tobytes()
        ends = np.cumsum(sizes)
        cuts = (flat.itemsize * ends).tolist()
        found = np.array([numbers.setdefault(raw[a:b], len(numbers)) for a, b in pairwise([0, *cuts])])
        if made := len(numbers) - known:
            first = np.unique(found, return_index=True)[1][-made:]
            own = gather(flat, (ends - sizes)[first], sizes[first])
            begin = int(self.begins[known])
            self._room(len(numbers), begin + len(own))
            self.entries[begin : begin + len(own)] = own
            self.begins[known + 1 : len(numbers) + 1] = begin + np.cumsum(sizes[first])
            self.label[known : len(numbers)] = flat[ends[first] - 1]
        return found

    def _edge(self, token: int) -> tuple[list[int], list[int], list[int]] | None:
        """How a token is merged: the rank of each merge, and its first and last symbol before and after each; None for
        a token that merging does not give back."""
        if token in self.edges:
            return self.edges[token]
        own, ranks = self.bytes_of[token], self.ranks
        parts = [own[i : i + 1] for i in range(len(own))]
        steps, first, last = [], [ranks[parts[0]]], [ranks[parts[-1]]]
        while len(parts) > 1:
            found = [(ranks[x + y], i) for i, (x, y) in enumerate(pairwise(parts)) if x + y in ranks]
            if not found:
                break
            rank, i = min(found)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            steps.append(rank)
            first.append(ranks[parts[0]])
            last.append(ranks[parts[-1]])
        self.edges[token] = (steps, first, last) if len(parts) == 1 else None
        return self.edges[token]

    def _fits(self, before: int, token: int) -> bool:
        """Whether ``token`` may follow: its own merges and those of the token before it run side by side, the lower rank
        first; the pair holds if no merge across the border comes up."""
        right = self._edge(token)
        if before == self.NOTHING or right is None:
            return right is not None
        key = before << 20 | token
        known = self.pairs.get(key)
        if known is None:
            (left_steps, _, ends), (right_steps, starts, _), ranks = self._edge(before), right, self.ranks
            never, i, j = len(ranks), 0, 0
            while True:
                across = ranks.get(self.bytes_of[ends[i]] + self.bytes_of[starts[j]], never)
                here = left_steps[i] if i < len(left_steps) else never
                there = right_steps[j] if j < len(right_steps) else never
                if across < here and across <= there and across < never:
                    known = False
                    break
                if here == there == never:
                    known = True
                    break
                if here <= there:
                    i += 1
                else:
                    j += 1
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            self.pairs[key] = known
        return known

    def _meet(self, tokens: np.ndarray) -> None:
        """Lay out the edges of tokens not met before."""
        for token in np.unique(tokens[self.row_at[tokens] == -1]).tolist():
            if (edge := self._edge(token)) is None:
                self.row_at[token] = -2
                continue
            steps, first, last = edge
            end = self.n_rows + len(first)
            if end > self.rows.shape[1]:
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)], 1)
            self.rows[:, self.n_rows : end] = [*steps, self.NEVER], first, last
            self.row_at[token], self.n_rows = self.n_rows, end

    def _fit(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        """:meth:`_fits` of many pairs."""
        self._meet(token)
        right = self.row_at[token]
        fits = right >= 0
        live = np.flatnonzero(fits & (before != self.NOTHING))
        self._meet(before[live])
        left, right = self.row_at[before[live]], right[live]
        (steps, first, last), keys = self.rows, self.joined_keys
        while len(live):
            key = last[left] << 20 | first[right]
            place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            across = np.where(keys[place] == key, self.joined[place], self.NEVER)
            here, there = steps[left], steps[right]
            wrong = (across < here) & (across <= there)
            fits[live[wrong]] = False
            on = ~wrong & ((here < self.NEVER) | (there < self.NEVER))
            own = here <= there
            live, left, right = live[on], (left + own)[on], (right + ~own)[on]
        return fits

    def _arc(self, number: int, byte: int) -> int:
        moved, border = [], -1
        for entry in self.entries[self.begins[number] : self.begins[number + 1]].tolist():
            child, before = self.child.get(entry >> 20 << 8 | byte), entry & 0xFFFFF
            if child is None:
                continue
            token = self.tokens[child]
            if border < 0 <= token and self._fits(before, token):
                border = token
            if self.inner[child]:
                moved.append(child << 20 | before)
        moved.append(border)  # the root of the trie behind the new border
        return self._numbered(moved)

    def _arcs(self, numbers: np.ndarray, bytes_: np.ndarray) -> np.ndarray:
        """:meth:`_arc` of many states and bytes."""
        starts, sizes = self.begins[numbers], self.begins[numbers + 1] - self.begins[numbers]
        entry, owner = gather(self.entries, starts, sizes), np.repeat(np.arange(len(numbers)), sizes)
        key = entry >> 20 << 8 | bytes_[owner]
        place = np.minimum(np.searchsorted(self.child_keys, key), len(self.child_keys) - 1)
        alive = np.flatnonzero(self.child_keys[place] == key)
        child, before, owner = self.child_nodes[place[alive]], entry[alive] & 0xFFFFF, owner[alive]
        token = self.token_at[child]
        border, open_ = np.full(len(numbers), -1), np.flatnonzero(token >= 0)
        while len(open_):  # the oldest node of each arc that is still open
            own = owner[open_]
            oldest = open_[np.flatnonzero(np.diff(own, prepend=-1))]
            fits = oldest[self._fit(before[oldest], token[oldest])]
            border[owner[fits]] = token[fits]
            tried = np.zeros(len(owner), bool)
            tried[oldest] = True
            open_ = open_[(border[own] < 0) & ~tried[open_]]
        stay = np.flatnonzero(self.inner[child])
        owner = owner[stay]
        sizes = np.bincount(owner, minlength=len(numbers)) + 1
        ends = np.cumsum(sizes)
        flat = np.empty(ends[-1], np.int64)
        flat[ends - 1] = border  # the root of the trie behind the new border
        flat[np.arange(len(stay)) + owner] = child[stay] << 20 | before[stay]
        return self._number(flat, sizes)

    def _make(self, keys: np.ndarray) -> np.ndarray:
        """Targets of arcs that the table lacks, each from a state and a byte, ``state << 8 | byte``."""
        number, byte = keys >> 8, keys & 0xFF
        seldom = self.column[byte] == COLUMNS - 1
        target = np.full(len(keys), -1)
        target[seldom] = [self.rare.get(key, -1) for key in keys[seldom].tolist()]
        new = np.flatnonzero(target < 0)
        if len(new) < FEW:
            target[new] = [self._arc(n, b) for n, b in zip(number[new].tolist(), byte[new].tolist(), strict=True)]
        else:
            target[new] = self._arcs(number[new], byte[new])
        if (self.label[target] < 0).any():
            raise ValueError("a byte that is no token")
        self.rare.update(zip(keys[seldom].tolist(), target[seldom].tolist(), strict=True))
        self.table[number[~seldom], self.column[byte[~seldom]]] = target[~seldom]
        return target

    def _follow(self, data: np.ndarray, trail: np.ndarray, begin: int, end: int, number: int) -> None:
        """The rest of a piece alone, from the state ``number``."""
        column = self.column.tolist()
        for k in range(begin, end, FOLLOWED):
            labels = []
            for byte in data[k : min(k + FOLLOWED, end)].tolist():
                target = self.table.item(number, column[byte])
                if target < 0:
                    target = int(self._make(np.array([number << 8 | byte]))[0])
                number = target
                labels.append(self.label.item(number))
            trail[k : k + len(labels)] = labels

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all pieces, none of them empty, in one array, and the number of each; one that is a token is that token."""
        whole = [self.ranks.get(piece, -1) for piece in pieces]
        todo = sorted((i for i, rank in enumerate(whole) if rank < 0), key=lambda i: -len(pieces[i]))
        if not todo:
            return np.array(whole, np.int64), np.ones(len(pieces), np.int64)
        if len(self.numbers) > STATES:
            self._reset()
        data = np.frombuffer(b"".join(pieces[i] for i in todo), np.uint8)
        lengths = np.array([len(pieces[i]) for i in todo])
        starts = np.cumsum(lengths) - lengths
        state, trail = np.zeros(len(todo), np.int64), np.empty(len(data), np.int64)
        running = np.searchsorted(-lengths, -np.arange(lengths[0]), "left")  # pieces longer than each position
        shared = int(np.searchsorted(-running, -FEW, "right"))  # positions that some pieces have
        for k, m in enumerate(running[:shared].tolist()):
            byte = data[starts[:m] + k]
            target = self.table[state[:m], self.column[byte]]
            new = np.flatnonzero(target < 0)
            if len(new):
                keys, back = np.unique(state[new] << 8 | byte[new], return_inverse=True)
                target[new] = self._make(keys)[back]
            state[:m] = target
            trail[starts[:m] + k] = self.label[target]
        for i in range(running[shared] if shared < len(running) else 0):
            self._follow(data, trail, int(starts[i]) + shared, int(starts[i] + lengths[i]), int(state[i]))
        at, live, rounds = lengths.copy(), np.arange(len(todo)), []
        count = np.zeros(len(todo), np.int64)
        while len(live):
            token = trail[starts[live] + at[live] - 1]
            rounds.append((live, token))
            count[live] += 1
            at[live] -= self.sizes[token]
            live = live[at[live] > 0]
        ends = np.cumsum(count)
        flat = np.empty(ends[-1], np.int64)
        for k, (live, token) in enumerate(rounds):
            flat[ends[live] - 1 - k] = token
        counts = np.ones(len(pieces), np.int64)
        counts[todo] = count
        starts = np.empty(len(pieces), np.int64)
        starts[todo] = ends - count
        single = np.array([i for i, rank in enumerate(whole) if rank >= 0], np.int64)
        starts[single] = len(flat) + np.arange(len(single))
        return gather(np.concatenate([flat, np.array(whole, np.int64)[single]]), starts, counts), counts


def _ascii(found: re.Match) -> str:
    """A class of the pattern by its ASCII characters."""
    own = found.group()
    if own.startswith("[^"):
        return "[^" + re.sub(r"\\p\{[LN]\}|\\s", lambda m: ASCII[m.group()], own[2:-1]) + "]"
    return f"[^{ASCII[own.lower()]}]" if own == r"\S" else f"[{ASCII[own]}]"


class Numbers(dict):
    """Numbers what is looked up in order of its first appearance."""

    def __missing__(self, key: str) -> int:
        number = self[key] = len(self)
        return number


class Encoder:
    """Ids of texts by those of their chunks; of chunks met before, up to ``CACHE`` with ``CACHE_IDS`` ids are known, the often used ones longest."""

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import regex

        self.transducer = Transducer(read_ranks(path))
        self.pieces = regex.compile(public_tokenizers.PATTERN).findall
        # The same for ASCII, where the standard library's engine is faster.
        self.plain = re.compile(re.sub(r"\[\^[^]]*\]|\\p\{[LN]\}|\\[sS]", _ascii, public_tokenizers.PATTERN)).findall
        self.known = Numbers()
        self.ids = np.zeros(0, np.int32)
        self.starts = self.counts = self.used = np.zeros(0, np.int64)

    def _forget(self) -> None:
        """Keep the half of the cache that was used most, and halve its counts, so that what is no longer met goes in time."""
        half = min(CACHE, len(self.known)) // 2
        kept = np.sort(np.argpartition(-self.used, half)[:half])
        chunks = list(self.known)
        self.known = Numbers((chunks[i], k) for k, i in enumerate(kept.tolist()))
        self.ids = gather(self.ids, self.starts[kept], self.counts[kept])
        self.counts, self.used = self.counts[kept], self.used[kept] // 2
        self.starts = np.cumsum(self.counts) - self.counts

    def learn(self, chunks: list[str]) -> None:
        split = [self.plain(chunk) if chunk.isascii() else self.pieces(chunk) for chunk in chunks]
        number = Numbers()
        order = np.fromiter(map(number.__getitem__, chain.from_iterable(split)), np.int64)
        ids, counts = self.transducer.encode([p.encode() for p in number])
        ends = np.cumsum(counts)
        first = np.cumsum([0, *map(len, split)])[:-1]
        per_chunk = np.add.reduceat(counts[order], first)
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(per_chunk) - per_chunk])
        self.counts = np.concatenate([self.counts, per_chunk])
        self.used = np.concatenate([self.used, np.zeros(len(chunks), np.int64)])
        self.ids = np.concatenate([self.ids, gather(ids, (ends - counts)[order], counts[order]).astype(np.int32)])

    def encode(self, texts: list[str]) -> pa.ListArray:
        """Ids of each text; the texts are taken in groups of bounded length, so their chunks do not add up."""
        groups, size = [[]], 0
        for text in texts:
            if size > GROUP_CHARS:
                groups.append([])
                size = 0
            groups[-1].append(text)
            size += len(text)
        return pa.concat_arrays([self._encode(group) for group in groups])

    def _encode(self, texts: list[str]) -> pa.ListArray:
        chunks = [CHUNK.findall(text) for text in texts]
        sizes = [len(own) for own in chunks]
        before = len(self.known)
        at = np.fromiter(map(self.known.__getitem__, chain.from_iterable(chunks)), np.int64, sum(sizes))
        if len(self.known) > before:
            new = list(islice(self.known, before, None))
            try:
                self.learn(new)
            except Exception:
                for chunk in new:
                    del self.known[chunk]
                raise
        self.used += np.bincount(at, minlength=len(self.used))
        counts = self.counts[at]
        ends = np.concatenate([[0], np.cumsum(counts)])[np.cumsum([0, *sizes])]
        ids = gather(self.ids, self.starts[at], counts)
        if len(self.known) > CACHE or len(self.ids) > CACHE_IDS:
            self._forget()
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))


class Utf8Stream:
    """UTF-8 that arrives in arbitrary cuts: the state is the valid beginning of a character still open."""

    def __init__(self) -> None:
        self.open = b""
        self.replaced = 0

    @staticmethod
    def _open_tail(data: bytes) -> int:
        """Bytes at the end that begin a character validly without completing it."""
        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            if 0x80 <= lead < 0xC0:
                continue
            need = 2 if 0xC2 <= lead < 0xE0 else 3 if 0xE0 <= lead < 0xF0 else 4 if 0xF0 <= lead < 0xF5 else 1
            if need <= back:
                return 0
            if back > 1:
                low = {0xE0: 0xA0, 0xF0: 0x90}.get(lead, 0x80)
                high = {0xED: 0x9F, 0xF4: 0x8F}.get(lead, 0xBF)
                if not low <= data[1 - back] <= high:
                    return 0
            return back
        return 0

    def feed(self, data: bytes, end: bool = False) -> str:
        data = self.open + data
        cut = len(data) - (0 if end else self._open_tail(data))
        self.open = data[cut:]
        try:
            return data[:cut].decode()
        except UnicodeDecodeError:
            text = data[:cut].decode(errors="replace")
            self.replaced += text.count("�") - data[:cut].count("�".encode())
            return text


class Vocabulary:
    """The bytes of all tokens in one array."""

    def __init__(self, path: str) -> None:
        held = sorted((rank, token) for token, rank in read_ranks(path).items())
        self.sizes = np.full(held[-1][0] + 1, -1, np.int64)
        self.sizes[[rank for rank, _ in held]] = [len(token) for _, token in held]
        self.starts = np.cumsum(np.maximum(self.sizes, 0)) - np.maximum(self.sizes, 0)
        self.flat = np.frombuffer(b"".join(token for _, token in held), np.uint8)

    def bytes_of(self, ids: np.ndarray) -> bytes:
        sizes = self.sizes[ids]
        if len(ids) and (ids.min() < 0 or sizes.min() < 0):
            raise ValueError("an id that is not in the vocabulary")
        return gather(self.flat, self.starts[ids], sizes).tobytes()


def stream_decode(ids: np.ndarray, vocabulary: Vocabulary, stream: Utf8Stream) -> Iterator[str]:
    """Texts of an id sequence as it arrives; a character is given out when its last byte is there."""
    for k in range(0, len(ids), DECODE_STEP):
        yield stream.feed(vocabulary.bytes_of(ids[k : k + DECODE_STEP]))
    yield stream.feed(b"", end=True)


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One for each Python worker."""
    return Encoder(path)


@lru_cache(maxsize=1)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _replaced(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    kept = {n: c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n not in columns}
    return pa.RecordBatch.from_pydict(kept | columns)


def _schema(df: DataFrame, **columns: str) -> str:
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name not in columns]
    return ", ".join([*kept, *(f"`{n}` {t}" for n, t in columns.items())])


def _encoded(texts: pa.Array, path: str) -> pa.ListArray:
    return encoder(path).encode([text or "" for text in texts.to_pylist()])


def _decoded(ids: pa.ListArray, path: str) -> dict[str, pa.Array]:
    held, texts, replaced = vocabulary(path), [], []
    flat, ends = ids.flatten().to_numpy(), np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy())
    for begin, end in zip(np.concatenate([[0], ends[:-1]]), ends, strict=True):
        stream = Utf8Stream()
        texts.append("".join(stream_decode(flat[begin:end], held, stream)))
        replaced.append(stream.replaced)
    return {"decoded": pa.array(texts, pa.string()), "n_replaced": pa.array(replaced, pa.int64())}


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """Add ``ids`` array<int>: each whole text under the ranks at ``path``, without special tokens.

    A null text is encoded as empty (no ids). All columns of ``docs`` stay, one called ids is replaced. Nulls, repeated
    rows and empty tables need no special case; no shuffle.
    """
    run = lambda batch: _replaced(batch, ids=_encoded(_column(batch, "text"), path))
    return arrow_map(docs, run, _schema(docs, ids="array<int>"))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Add ``decoded`` string and ``n_replaced`` long (bytes that were no UTF-8 give U+FFFD) from ``ids`` array<int>.

    Null ids count as none. All columns stay, those of the two names are replaced. An id that the vocabulary lacks raises.
    """
    run = lambda batch: _replaced(batch, **_decoded(_column(batch, "ids"), path))
    return arrow_map(encoded, run, _schema(encoded, decoded="string", n_replaced="long"))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """:func:`encode` and :func:`decode` in one worker, with the columns of both."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = _encoded(_column(batch, "text"), path)
        return _replaced(batch, ids=ids, **_decoded(ids, path))

    return arrow_map(docs, run, _schema(docs, ids="array<int>", decoded="string", n_replaced="long"))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Columns of ``docs`` but the text, n_tokens, and the SHA-256 of the ids and of the text they decode to."""
    return (
        round_trip(docs, path)
        .withColumns(
            {
                "n_tokens": F.size("ids").cast("long"),
                "ids_sha256": F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256),
                "decoded_sha256": F.sha2("decoded", 256),
            }
        )
        .drop("ids", "decoded", "n_replaced", "text")
    )
