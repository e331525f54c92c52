"""Toxicity by a weighted finite-state pattern grammar over clauses."""

from __future__ import annotations

import math
import re
from collections import deque
from functools import lru_cache
from itertools import product
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import arrow_map

# Closed word classes of the grammar in the corpus languages.
THREAT = """kill hurt destroy beat smash shoot stab töten umbringen schlagen vernichten tuer frapper détruire buter matar golpear
destruir""".split()
TARGET = """you your yours yourself u ur they them these those du dich dir dein ihr euch sie tu te toi ton vous votre ils tú ti
usted ustedes ellos eres""".split()
NEGATION = "not never no none neither nor isn aren don doesn didn nicht kein keine nie ne pas jamais aucun nunca jamás ningún".split()
REPORT = """said says say called calls wrote writes quoted quote claimed reported sagte sagt nannte schrieb dit dire appelé écrit
dijo dice llamó escribió""".split()

WORD = re.compile(r"[^\W\d_]+")
CUT = re.compile(r"[.!?;:,\n\r…]")
CLASSES = ("other", "insult", "threat", "target", "negation", "report")
NEGATION_REACH, TARGET_REACH = 3, 4

Pattern = tuple[str, bool, bool, bool]
# What a pattern is worth before learning, as a share of its term's weight: (plain 1, aimed more, negated or reported less).
PATTERNS: list[Pattern] = [("insult", *flags) for flags in product((False, True), repeat=3)] + [
    ("threat", True, *flags) for flags in product((False, True), repeat=2)
]


def prior(pattern: Pattern) -> float:
    kind, aimed, negated, reported = pattern
    return (1.0 if kind == "insult" else 0.6) * (1.2 if aimed else 1.0) * (0.6 if negated else 1.0) * (0.6 if reported else 1.0)


def _countdown(word_class: str, reach: int) -> dict[tuple[int, str], int]:
    """A transducer whose state is how many more tokens stand in the reach of a word of ``word_class``."""
    return {(n, c): reach if c == word_class else max(0, n - 1) for n in range(reach + 1) for c in CLASSES}


def _latch(word_class: str) -> dict[tuple[int, str], int]:
    """A transducer that stays on from the first word of ``word_class`` to the end of the clause."""
    return {(n, c): 1 if c == word_class else n for n in (0, 1) for c in CLASSES}


@lru_cache(maxsize=1)
def grammar() -> dict[tuple[int, str], tuple[int, Pattern | None]]:
    """The composition of the target, negation and report transducers with the insult and threat patterns.

    Only states that can be reached from the start of a clause (state 0) are made.
    """
    parts = (_countdown("target", TARGET_REACH), _countdown("negation", NEGATION_REACH), _latch("report"))
    numbers, table, open_states = {(0, 0, 0): 0}, {}, deque([(0, 0, 0)])
    while open_states:
        state = open_states.popleft()
        for word_class in CLASSES:
            target = tuple(part[n, word_class] for part, n in zip(parts, state, strict=True))
            if target not in numbers:
                numbers[target] = len(numbers)
                open_states.append(target)
            aimed, negated, reported = (n > 0 for n in state)
            out = None
            if word_class == "insult" or word_class == "threat" and aimed:
                out = (word_class, aimed, negated, reported)
            table[numbers[state], word_class] = (numbers[target], out)
    return table


class Model(NamedTuple):
    """``stems``: beginnings of insults (a whole word ends in $) with their weights; ``factors``: worth of each pattern;
    ``bias``: log-odds of a text without any match."""

    stems: dict[str, float]
    factors: dict[Pattern, float]
    bias: float


class Scorer:
    def __init__(self, model: Model) -> None:
        import ahocorasick

        self.model = model
        self.closed = dict.fromkeys(THREAT, "threat") | dict.fromkeys(TARGET, "target")
        self.closed |= dict.fromkeys(NEGATION, "negation") | dict.fromkeys(REPORT, "report")
        self.sizes = sorted({len(stem.rstrip("$")) for stem in model.stems})
        self.finder = ahocorasick.Automaton()
        for term in {stem.rstrip("$") for stem in model.stems} | set(THREAT):
            self.finder.add_word(term, len(term))
        self.finder.make_automaton()

    def insult(self, word: str) -> tuple[str, float] | None:
        """The insult transducer: the longest stem the word begins with, or the word itself."""
        stems = self.model.stems
        if (weight := stems.get(word + "$")) is not None:
            return word + "$", weight
        for size in reversed(self.sizes):
            if size <= len(word) and (weight := stems.get(word[:size])) is not None:
                return word[:size], weight
        return None

    def clauses(self, text: str) -> list[tuple[int, int, list[tuple[Pattern, str, float]]]]:
        """Clauses with matches: begin, end (in the lower-cased text), and each match's pattern, term and term weight."""
        text = text.lower()
        found, done, table = [], -1, grammar()
        for last, size in self.finder.iter(text):
            begin = last - size + 1
            if begin < done or begin and text[begin - 1].isalpha():
                continue
            cut = CUT.search(text, last)
            end = cut.start() if cut else len(text)
            start = max(done, max((text.rfind(mark, max(done, 0), begin) for mark in ".!?;:,\n\r…"), default=-1) + 1, 0)
            done, state, matches = end, 0, []
            for word in WORD.findall(text, start, end):
                hit = self.insult(word)
                word_class = "insult" if hit else self.closed.get(word, "other")
                state, pattern = table[state, word_class]
                if pattern:
                    term, weight = hit or (word, 1.0)
                    matches.append((pattern, term, weight))
            if matches:
                found.append((start, end, matches))
        return found

    def score(self, text: str) -> tuple[float, int, str | None]:
        """Probability that the text is toxic, number of matched clauses, and the clause that weighs most."""
        evidence, worst, shown = 0.0, 0.0, None
        found = self.clauses(text)
        for start, end, matches in found:
            own = sum(weight * self.model.factors.get(pattern, prior(pattern)) for pattern, _, weight in matches)
            evidence += own
            if own > worst:
                worst, shown = own, text.lower()[start:end].strip()
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, self.model.bias + evidence)))), len(found), shown


def fit(
    docs: DataFrame,
    labels: DataFrame,
    max_rows: int = 10_000,
    max_stems: int = 2_000,
    min_weight: float = 2.5,
    min_contexts: int = 8,
) -> Model:
    """Learn insult stems and pattern weights from docs (doc_id, text) and labels (doc_id, toxic).

    At most about ``max_rows`` labelled rows are used, those with the lowest hashes of their ids; their ids are all that is
    broadcast. A stem is a beginning of 4 to 9 letters or a whole word whose log-likelihood ratio between toxic and
    clean rows is at least ``min_weight`` and that stands behind at least ``min_contexts`` different words in toxic rows, so that
    copies of one text do not count as evidence. Of stems that begin alike the most telling stays, a shorter one beside it
    only if it covers more. At most ``max_stems``, the most telling first. Without labelled rows of both kinds: no stems.
    Null labels, ids and texts are left out.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("__toxic"))
    rows = known.count()
    share = min(1.0, max_rows / max(1, rows))
    sample = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    sample = sample.withColumnRenamed("doc_id", "__id")
    train = docs.join(F.broadcast(sample), F.col("doc_id") == F.col("__id")).select("doc_id", "text", "__toxic")
    train = train.where("text IS NOT NULL").persist()
    own = F.concat(F.array(F.lit("")), F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))
    heads = F.transform(F.sequence(F.lit(4), F.least(F.lit(9), F.length("word"))), lambda n: F.substring("word", F.lit(1), n))
    stems = F.explode(F.concat(F.array(F.concat("word", F.lit("$"))), F.when(F.length("word") >= 4, heads).otherwise(F.array())))
    per_row = (
        train.select("doc_id", "__toxic", F.explode(F.array_distinct(own)).alias("word"))
        .select("doc_id", "__toxic", stems.alias("stem"))
        .distinct()
    )
    toxic, clean = (train.where(F.col("__toxic") == value).count() for value in (1, 0))
    if not toxic or not clean:
        train.unpersist()
        return Model({}, {p: prior(p) for p in PATTERNS}, -3.0)
    least = max(min_contexts, toxic // 100)
    behind = F.transform(F.sequence(F.lit(1), F.size("own") - 1), lambda i: F.struct(F.get("own", i).alias("word"), F.get("own", i - 1).alias("before")))
    candidates = (
        train.where("__toxic = 1")
        .select(own.alias("own"))
        .where(F.size("own") > 1)
        .select(F.explode(behind).alias("w"))
        .select("w.*")
        .distinct()
        .select("before", stems.alias("stem"))
        .groupBy("stem")
        .agg(F.countDistinct("before").alias("contexts"))
        .where(F.col("contexts") >= least)
        .select("stem")
    )
    weight = F.log((F.col("pos") + 0.5) / (toxic + 1)) - F.log((F.col("neg") + 0.5) / (clean + 1))
    counts = (
        per_row.join(candidates, "stem")
        .groupBy("stem")
        .agg(F.sum("__toxic").alias("pos"), F.sum(1 - F.col("__toxic")).alias("neg"))
        .withColumn("weight", weight)
        .where(F.col("weight") >= min_weight)
        .orderBy(F.desc(F.col("pos") * F.col("weight")), "stem")
        .limit(max_stems)
    )
    held: dict[str, float] = {}
    covered: dict[str, int] = {}
    for row in sorted(counts.collect(), key=lambda r: (-round(2 * r["weight"]), len(r["stem"]), r["stem"])):
        stem = row["stem"]
        beginning = stem.rstrip("$")
        longer = [s for s in held if s.startswith(beginning)]
        shorter = [n for n in range(4, len(stem)) if stem[:n] in held]
        if not shorter and row["pos"] > 1.5 * sum(covered[s] for s in longer):
            held[stem], covered[stem] = row["weight"], row["pos"]
    first = Model(held, {p: prior(p) for p in PATTERNS}, 0.0)
    model = _fit_patterns(train, first, toxic, clean)
    train.unpersist()
    return model


def _fit_patterns(train: DataFrame, first: Model, toxic: int, clean: int) -> Model:
    """Worth of each pattern: its prior, moved by how much more or less often than any match it stands in toxic rows."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        run = scorer(first)
        at, label = [], []
        for text, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            seen = {PATTERNS.index(p) for _, _, matches in run.clauses(text) for p, _, _ in matches}
            own = [*seen, -1] if seen else [-2]
            at += own
            label += [value] * len(own)
        return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(label, pa.int32())], ["at", "toxic"])

    counted = arrow_map(train.select("text", F.col("__toxic").cast("int")), each, "at int, toxic int").groupBy("at")
    got = {r["at"]: (r["pos"], r["n"]) for r in counted.agg(F.sum("toxic").alias("pos"), F.count("*").alias("n")).collect()}
    pos, n = got.get(-1, (0, 0))
    overall = (pos + 1) / (n + 2)
    factors = {}
    for at, pattern in enumerate(PATTERNS):
        own_pos, own_n = got.get(at, (0, 0))
        precision = (own_pos + 20 * overall) / (own_n + 20)
        factors[pattern] = prior(pattern) * max(0.25, min(1.25, precision / overall))
        if own_n >= 50 and precision >= 0.9 * overall:
            factors[pattern] = max(1.0, factors[pattern])
    none_pos, none_n = got.get(-2, (0, 0))
    return first._replace(factors=factors, bias=math.log((none_pos + 0.5) / (none_n - none_pos + 0.5)))


_SCORERS: dict[int, Scorer] = {}


def scorer(model: Model) -> Scorer:
    """One for each model and Python worker."""
    key = hash((tuple(sorted(model.stems.items())), tuple(sorted(model.factors.items())), model.bias))
    if key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[key] = Scorer(model)
    return _SCORERS[key]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Add toxicity double (0 to 1), n_clauses int and worst_clause string to docs (text and any columns).

    Only the text is read. Null and empty texts have no clause and the score of a text without matches. Texts are whole,
    repeated rows score alike, columns of the three names are replaced, an empty table gives no rows. No shuffle.
    """
    new = ("toxicity", "n_clauses", "worst_clause")

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        run = scorer(model)
        texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
        scores, clauses, worst = zip(*(run.score(text or "") for text in texts), strict=True)
        kept = {n: c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n not in new}
        made = [pa.array(scores, pa.float64()), pa.array(clauses, pa.int32()), pa.array(worst, pa.string())]
        return pa.RecordBatch.from_pydict(kept | dict(zip(new, made, strict=True)))

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name not in new]
    return arrow_map(docs, each, ", ".join([*fields, "toxicity double, n_clauses int, worst_clause string"]))
