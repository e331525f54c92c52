"""Token counts by rank-synchronous merging of ragged arrays."""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import arrow_map

# The white space of the pattern and its pieces.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CHUNK = re.compile(rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
CACHE, CACHE_CHARS = 400_000, 16_000_000
LONG = 400  # bytes; longer pieces are merged by lists of places
NONE = np.iinfo(np.int64).max


def byte_names() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class RankMerger:
    """Counts of tokens for many pieces at once.

    All pieces lie in one array of symbols with their offsets. A round looks up the rank of every neighbouring pair,
    takes the lowest of each piece with a segmented minimum, merges all its occurrences (from the left where they
    overlap) and closes the array up. Pieces without a pair leave. What is left of a piece are its tokens.
    """

    def __init__(self, path: str) -> None:
        import regex

        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        ids: dict[str, int] = held["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in held["model"]["merges"]]
        self.base = np.array([ids[name] for name in byte_names()], np.int64)
        self.width = max(ids.values()) + 1
        pairs = np.array([ids[a] * self.width + ids[b] for a, b in merges], np.int64)
        order = np.argsort(pairs)
        self.pairs, self.ranks = pairs[order], order
        self.made = np.array([ids[a + b] for a, b in merges], np.int64)
        self.special = [t["content"] for t in held["added_tokens"] if t["special"]]
        self.cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        # Fixed value: the pattern of byte-level pre-tokenizers.
        self.pieces = regex.compile(
            r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        ).findall
        self.rank_of = dict(zip(pairs.tolist(), range(len(pairs)), strict=True))
        self.known: dict[str, int] = {}
        self.held = 0  # characters of what is known

    def _rank(self, symbols: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Rank of the pair that starts at each symbol; NONE where there is no merge."""
        key = symbols[:-1] * self.width + symbols[1:]
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        rank = np.full(len(symbols), NONE, np.int64)
        rank[:-1] = np.where((self.pairs[at] == key) & ~last[:-1], self.ranks[at], NONE)
        return rank

    def merged(self, pieces: list[bytes]) -> np.ndarray:
        """Number of tokens of each piece."""
        sizes = np.array([len(p) for p in pieces], np.int64)
        out = sizes.copy()
        for place in np.flatnonzero(sizes > LONG).tolist():
            out[place] = self.merged_long(pieces[place])
        owner = np.flatnonzero((sizes > 1) & (sizes <= LONG))
        symbols = self.base[np.frombuffer(b"".join(pieces[i] for i in owner), np.uint8)]
        lengths = sizes[owner]
        while len(owner):
            starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
            last = np.zeros(len(symbols), bool)
            last[starts + lengths - 1] = True
            rank = self._rank(symbols, last)
            least = np.minimum.reduceat(rank, starts)
            segment = np.repeat(np.arange(len(owner)), lengths)
            hit = (rank == least[segment]) & (rank != NONE)
            hit = self._apart(hit)
            at = np.flatnonzero(hit)
            symbols[at] = self.made[rank[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            lengths = lengths - np.bincount(segment[at], minlength=len(owner))
            out[owner] = lengths
            live = (least != NONE) & (lengths > 1)
            keep &= live[segment]
            symbols, owner, lengths = symbols[keep], owner[live], lengths[live]
        return out

    def merged_long(self, piece: bytes) -> int:
        """Number of tokens of one long piece: the same rounds, lowest rank first and all its places from the left, but a round visits
        only the places of its rank, which wait in lists by rank; so the work is that of the merges and not rounds x length."""
        first = self.base[np.frombuffer(piece, np.uint8)]
        size, width, rank_of = len(first), self.width, self.rank_of.get
        last = np.zeros(size, bool)
        last[-1] = True
        ranks = self._rank(first, last)
        order = np.argsort(ranks, kind="stable")
        order = order[: int((ranks != NONE).sum())]
        names, starts = np.unique(ranks[order], return_index=True)
        waiting = dict(zip(names.tolist(), [own.tolist() for own in np.split(order, starts[1:])], strict=True)) if len(names) else {}
        heap = sorted(waiting)
        symbol, made = array("q", first.tolist()), self.made.tolist()
        after, before = array("i", range(1, size + 1)), array("i", range(-1, size - 1))

        def wait(rank: int | None, place: int) -> None:
            if rank is not None:
                if rank in waiting:
                    waiting[rank].append(place)
                else:
                    waiting[rank] = [place]
                    heappush(heap, rank)

        left = size
        while heap:
            rank = heappop(heap)
            new = made[rank]
            for i in sorted(waiting.pop(rank, ())):
                j = after[i]
                if j >= size or symbol[i] < 0 or rank_of(symbol[i] * width + symbol[j]) != rank:
                    continue  # one of the two has gone into another merge
                k = after[j]
                symbol[i], symbol[j], after[i] = new, -1, k
                left -= 1
                if k < size:
                    before[k] = i
                    wait(rank_of(new * width + symbol[k]), i)
                if before[i] >= 0:
                    wait(rank_of(symbol[before[i]] * width + new), before[i])
        return left

    @staticmethod
    def _apart(hit: np.ndarray) -> np.ndarray:
        """Of hits in a row, every second one from the first: a symbol belongs to one merge only."""
        at = np.flatnonzero(hit)
        if len(at) < 2 or not (np.diff(at) == 1).any():
            return hit
        new = np.concatenate(([True], np.diff(at) != 1))
        first = at[np.flatnonzero(new)][np.cumsum(new) - 1]
        kept = np.zeros(len(hit), bool)
        kept[at[(at - first) % 2 == 0]] = True
        return kept

    def learn(self, chunks: set[str]) -> None:
        """Count the tokens of new chunks (an optional blank and what has no white space, or white space) together."""
        split = [self.pieces(chunk) for chunk in chunks]
        unique = sorted({piece for pieces in split for piece in pieces})
        counts = dict(zip(unique, self.merged([p.encode() for p in unique]).tolist(), strict=True))
        for chunk, pieces in zip(chunks, split, strict=True):
            self.known[chunk] = sum(counts[p] for p in pieces)
            self.held += len(chunk)

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of whole texts; a special token's string is that one token."""
        specials, chunks = [], []
        for text in texts:
            parts = self.cut.split(text)
            specials.append(len(parts) - 1)
            chunks.append([chunk for part in parts for chunk in CHUNK.findall(part)])
        new = set().union(*chunks)
        if len(self.known) + len(new) > CACHE:
            self.forget()
        self.learn(new - self.known.keys())
        known = self.known.__getitem__
        out = [n + sum(map(known, own)) for n, own in zip(specials, chunks, strict=True)]
        if len(self.known) > CACHE or self.held > CACHE_CHARS:
            self.forget()
        return out

    def forget(self) -> None:
        self.known.clear()
        self.held = 0


@lru_cache(maxsize=1)
def merger(path: str) -> RankMerger:
    """One for each Python worker."""
    return RankMerger(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """Bytes and tokens of every whole text under the byte-level vocabulary at ``path`` (a path all workers have).

    A null or empty text has 0 of both. Repeated rows give repeated results, null ids stay, other columns do not
    matter, an empty table gives no rows. No shuffle: batches of texts are bounded by bytes, and what a worker
    remembers of earlier chunks is bounded by number and by characters, and a word of any length takes time in proportion to its merges. Returns doc_id, n_bytes, n_tokens, over_limit.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).to_pylist()
        counts = merger(path).count(texts)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts])],
            ["doc_id", "n_bytes", "n_tokens", "over_limit"],
        )

    text = F.coalesce(F.col("text"), F.lit(""))
    return arrow_map(
        docs.select("doc_id", text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes")),
        each,
        f"doc_id {id_type}, n_bytes long, n_tokens long, over_limit boolean",
    )
