"""Phrase collocations: the longest windows are counted, ROLLUP sums their prefixes, and phrases are scored by their weakest cut."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.llm.common import arrow_map, written

LONGEST = 4
LEADS = [f"w{k}" for k in range(1, LONGEST + 1)]
SLICE_BYTES = 8 << 20
MAX_FILTER_BITS = 1 << 26  # 8 MB
BITS_A_KEY = 16
UNKNOWN = "und"
MIX = np.uint64(0x9E3779B97F4A7C15)
# What a byte is to a text: 0 part of a word, 1 a gap between words, 2 the end of a piece.
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = 1
KIND[[ord(c) for c in ".,;:!?\n\v\f\r"]] = 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Words:
    """The words of some bytes: their distinct strings, for each word its place among them, and the pieces they stand in."""

    def __init__(self, data: np.ndarray) -> None:
        kind = KIND[data]
        inside = kind == 0
        edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
        self.starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        breaks = np.flatnonzero(kind == 2)
        self.piece = np.searchsorted(breaks, self.starts)
        offsets = np.zeros(len(self.starts) + 1, np.int64)
        np.cumsum(ends - self.starts, out=offsets[1:])
        flat = LOWER[data[inside]]
        words = pa.LargeStringArray.from_buffers(len(self.starts), pa.py_buffer(offsets), pa.py_buffer(flat))
        coded = words.dictionary_encode()
        self.distinct: pa.Array = coded.dictionary
        self.ids = coded.indices.to_numpy().astype(np.int64)
        # next_too[i]: the word behind word i stands in the same piece.
        self.next_too = np.append(self.piece[1:] == self.piece[:-1], False)[: len(self.ids)]

    def keys(self, lang: str) -> np.ndarray:
        """64-bit keys of the distinct words in their language."""
        seed = xxhash.xxh32_intdigest(lang)
        return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in self.distinct.to_pylist()), np.uint64, len(self.distinct))


    def goes_on(self, hashed: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        """For each word, and one place more, whether the pair of it and the next is in the bit set."""
        out = np.zeros(len(self.ids) + LONGEST, bool)
        at = np.flatnonzero(self.next_too)
        out[at] = holds(pairs, pair_keys(hashed[self.ids[at]], hashed[self.ids[at + 1]]))
        return out


def pair_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        mixed = (left * MIX) ^ (left >> np.uint64(31))
        mixed = (mixed + right) * np.uint64(0xBF58476D1CE4E5B9)
        return mixed ^ (mixed >> np.uint64(32))


def slices(data: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, int]]:
    """Bytes in slices cut between words, each with the next words its last windows need, and the bytes that are its own."""
    begin = 0
    while begin < len(data):
        end = begin + size
        while end < len(data) and not len(gap := np.flatnonzero(KIND[data[end : end + 4096]] > 0)):
            end += 4096
        end = end + int(gap[0]) if end < len(data) else len(data)
        ahead, step = end, 4096
        while ahead < len(data):
            ahead = min(len(data), end + step)
            closes = np.flatnonzero(np.diff((KIND[data[end:ahead]] == 0).astype(np.int8)) == -1)
            if len(closes) >= LONGEST - 1:
                ahead = end + int(closes[LONGEST - 2]) + 1
                break
            step *= 2
        yield data[begin:ahead], end - begin
        begin = end


def by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray]]:
    """The texts of each language of a batch, as bytes with a line feed between texts."""
    langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
    held: dict[str, list[str]] = {}
    for lang, text in zip(langs, texts, strict=True):
        held.setdefault(UNKNOWN if lang is None else lang, []).append(text or "")
    for lang, own in held.items():
        yield lang, np.frombuffer("\n".join(own).encode(), np.uint8)


def _key_counts(pairs: np.ndarray | None = None):
    """Hashed words and pairs of neighbours with their counts; or the triples of which both pairs are in the bit set."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        keys, counts = [], []
        for lang, data in by_lang(batch):
            for part, own in slices(data, SLICE_BYTES):
                words = Words(part)
                mine = int(np.searchsorted(words.starts, own))
                if not mine:
                    continue
                hashed, base = words.keys(lang), len(words.distinct)
                if pairs is None:
                    keys.append(hashed)
                    counts.append(np.bincount(words.ids[:mine], minlength=base))
                    at = np.flatnonzero(words.next_too[:mine])
                    found, times = np.unique(words.ids[at] * base + words.ids[at + 1], return_counts=True)
                    keys.append(pair_keys(hashed[found // base], hashed[found % base]))
                else:
                    goes_on = words.goes_on(hashed, pairs)
                    at = np.flatnonzero(goes_on[:mine] & goes_on[1 : mine + 1])
                    found, times = np.unique((words.ids[at] * base + words.ids[at + 1]) * base + words.ids[at + 2], return_counts=True)
                    front = pair_keys(hashed[found // base // base], hashed[found // base % base])
                    keys.append(pair_keys(front, hashed[found % base]))
                counts.append(times)
        if not keys:
            return None
        key, count = np.concatenate(keys).view(np.int64), np.concatenate(counts)
        some = count > 0  # a word may stand behind the slice only
        return pa.RecordBatch.from_arrays([pa.array(key[some]), pa.array(count[some])], names=["key", "n"])

    return run


def frequent_keys(docs: DataFrame, least: int, pairs: np.ndarray | None = None) -> np.ndarray:
    """A bit set of fixed greatest size over the hashed words and pairs, or triples, that occur ``least`` times: never without one of them."""
    counted = arrow_map(docs, _key_counts(pairs), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    often = written(counted.where(F.col("n") >= least).select("key"), "phrase-keys")
    bits = 1 << 10
    while bits < min(MAX_FILTER_BITS, often.count() * BITS_A_KEY):
        bits *= 2
    bit = F.expr(f"key & {bits - 1}")
    cells = often.groupBy(F.shiftright(bit, 6).alias("cell")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST(key & {bits - 1} & 63 AS INT))")).alias("bits"))
    found = cells.toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[found.column("cell").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def holds(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys & np.uint64(len(bits) * 64 - 1)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0


def _distinct(columns: list[np.ndarray], base: int) -> tuple[np.ndarray, np.ndarray]:
    """The first row of each distinct row of codes below ``base``, and how often it stands there."""
    code = columns[0] * base + columns[1]
    for column in columns[2:]:
        values, code = np.unique(code, return_inverse=True)
        code = code * base + column
    _, first, times = np.unique(code, return_index=True, return_counts=True)
    return first, times


def _windows(pairs: np.ndarray, triples: np.ndarray):
    """Batch of (lang, text) -> distinct padded windows of the longest order, with their counts.

    A window is padded ('') from the end of its piece on, and from the first word, pair or triple on that is known to be too
    rare for any phrase; so no count of a frequent phrase is touched, and every word still has one window.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        held = []
        for lang, data in by_lang(batch):
            for part, own in slices(data, SLICE_BYTES):
                words = Words(part)
                mine = int(np.searchsorted(words.starts, own))
                if not mine:
                    continue
                hashed, base = words.keys(lang), len(words.distinct)
                pad, ids = base, np.append(words.ids, [base] * LONGEST)
                goes_on = words.goes_on(hashed, pairs)
                both = np.zeros(len(ids), bool)
                at = np.flatnonzero(goes_on[:-1] & goes_on[1:])
                both[at] = holds(triples, pair_keys(pair_keys(hashed[ids[at]], hashed[ids[at + 1]]), hashed[ids[at + 2]]))
                often = np.append(holds(pairs, hashed), False)
                first = np.where(often[ids[:mine]], ids[:mine], pad)
                alive, leads = (first < pad) & goes_on[:mine], [first]
                for k in range(1, LONGEST):
                    leads.append(np.where(alive, ids[k : k + mine], pad))
                    alive = alive & both[k - 1 : k - 1 + mine]
                long = np.flatnonzero(leads[1] < pad)
                rest = np.bincount(first[leads[1] == pad], minlength=base + 1)
                alone = np.flatnonzero(rest)
                names = pa.concat_arrays([words.distinct.cast(pa.string()), pa.array([""])])
                at, times = _distinct([lead[long] for lead in leads], base + 1) if len(long) else (long, long)
                chosen = [np.concatenate([lead[long][at], alone if k == 0 else np.full(len(alone), pad)]) for k, lead in enumerate(leads)]
                columns = [pa.array([lang] * len(chosen[0])), *[names.take(pa.array(c)) for c in chosen]]
                columns.append(pa.array(np.concatenate([times, rest[alone]]).astype(np.int64)))
                held.append(pa.RecordBatch.from_arrays(columns, names=["lang", *LEADS, "n"]))
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0] if held else None

    return run


def grams(docs: DataFrame, least: int = 30, longest: int = LONGEST) -> DataFrame:
    """All runs of 1 to ``longest`` (at most four) words within a piece that occur ``least`` times or more in a language, and its words in all.

    docs has lang and text. Gives lang string, words array<string>, f long; the row with no words has the number of all
    words of the language. Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends, and those into words at
    blanks and tabs. A null text has none, a null lang is ``und``.

    Each word opens one window of the longest order, padded behind its piece. Tasks count the distinct windows of a batch,
    Spark sums them, and one ROLLUP over the lead columns sums the shorter prefixes: a phrase of k words occurs as
    often as it opens a window. Before that, hashed words and pairs, then triples of frequent pairs, are counted, and windows are
    padded from the first one on that is rarer than ``least``; a phrase with such a part cannot be frequent, so all counts stay exact.
    """
    own = docs.select(F.col("lang").cast("string").alias("lang"), "text")
    pairs = frequent_keys(own, least)
    triples = frequent_keys(own, least, pairs)
    fields = ", ".join(f"{name} string" for name in ["lang", *LEADS])
    counted = arrow_map(own, _windows(pairs, triples), f"{fields}, n long").groupBy("lang", *LEADS).agg(F.sum("n").alias("n"))
    leads = LEADS[:longest]
    summed = counted.rollup("lang", *leads).agg(F.sum("n").alias("f"))
    # What is rolled up is null, what is padded is ''; Catalyst takes this filter below the sums, so padded windows are not shuffled again.
    for lead in leads:
        summed = summed.where(F.col(lead).isNull() | (F.col(lead) != ""))
    words = F.filter(F.array(*leads), lambda w: w.isNotNull())
    kept = summed.where("lang IS NOT NULL").select("lang", words.alias("words"), "f")
    return kept.where((F.size("words") == 0) | (F.col("f") >= least))


def _exact(name: str) -> Column:
    return F.col(name).cast("decimal(20,0)")


def scored(found: DataFrame, scale: int = 2_000_000) -> DataFrame:
    """Phrases of two or more words of ``grams`` with l, r and score of their weakest cut: the least floor(scale * a / (l + r)), then the first.

    The parts of a frequent phrase are as frequent, so they are in the same table; each cut meets them by two equi joins.
    """
    phrases = found.where(F.size("words") > 1).withColumnRenamed("f", "a")
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
    cuts = cuts.select("lang", "words", "a", "k", F.slice("words", 1, F.col("k")).alias("head"), F.expr("slice(words, k + 1, size(words) - k)").alias("tail"))
    parts = found.where((F.size("words") > 0) & (F.size("words") < LONGEST))
    head = parts.select("lang", F.col("words").alias("head"), F.col("f").alias("l"))
    tail = parts.select("lang", F.col("words").alias("tail"), F.col("f").alias("r"))
    met = cuts.join(head, ["lang", "head"]).join(tail, ["lang", "tail"])
    score = (_exact("a") * F.lit(scale).cast("decimal(8,0)")).alias("up")
    met = met.select("lang", "words", "a", "l", "r", "k", score, (_exact("l") + _exact("r")).alias("down"))
    met = met.withColumn("score", F.expr("up div down"))
    best = met.groupBy("lang", "words").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("best"))
    return best.select("lang", "words", "best.a", "best.l", "best.r", "best.score")


def outermost(candidates: DataFrame, percent: int = 80) -> DataFrame:
    """Candidates (lang, words, a) without those that lie inside a longer one at least ``percent`` per cent as frequent."""
    inner = "flatten(transform(sequence(2, size(words) - 1), n -> transform(sequence(1, size(words) - n + 1), i -> slice(words, i, n))))"
    covers = candidates.where(F.size("words") > 2).select("lang", F.explode(F.expr(inner)).alias("words"), F.col("a").alias("longer"))
    covers = covers.groupBy("lang", "words").agg(F.max("longer").alias("longer"))
    covered = _exact("longer") * F.lit(100).cast("decimal(3,0)") >= _exact("a") * F.lit(percent).cast("decimal(3,0)")
    met = candidates.join(covers, ["lang", "words"], "left")
    return met.where(F.col("longer").isNull() | ~covered).drop("longer")


def mine(docs: DataFrame, least: int = 30, first: int = 2000, longest: int = LONGEST) -> DataFrame:
    """The ``first`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    By score, then count, both descending, then phrase in byte order; n is the number of all words of the language. Only
    lang and text are read: other columns, whatever their names, are left behind. Repeated rows count as often as they stand there; an
    empty table, or one without frequent phrases, gives no rows. Spark cuts each task to its first ranks before the window.
    """
    found = written(grams(docs, least, longest), "phrases")
    best = outermost(scored(found)).withColumn("phrase", F.array_join("words", " "))
    total = found.where(F.size("words") == 0).select("lang", F.col("f").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= first)
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
