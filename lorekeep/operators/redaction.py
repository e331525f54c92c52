"""Redaction: ordered, positional replacement of rule matches.

The passes of a rule set are folded over one text inside one expression, and only over the rules whose
``needs`` the text meets. A chain of projections would do the same, but each would name its predecessor
more than once, and a filter pushed through such a chain grows with every rule. The passes see only the
lines that can hold a part of a match; the others are put back afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.functions.rules import Rule, by_told_lines, lines_told, parted, pick_rules

_FENCE = "\uffff"
_BLOCK = 1000
_FOUND = "array<struct<value:string,position:int,line:int>>"
_RECORDS = "array<struct<type:string,position:int,length:int,replacement:string>>"


def _passes(text: Column, rules: tuple[Rule, ...]) -> Column:
    """The rules that may match the text, in order."""
    known = [
        F.struct(
            F.lit(rule.name).alias("type"),
            F.lit(rule.spark_pattern).alias("pattern"),
            F.lit(rule.marker).alias("marker"),
            rule.possible(text).alias("possible"),
        )
        for rule in rules
    ]
    return F.filter(F.array(*known), lambda rule: rule["possible"])


def redacted_text(text: Column, rules: str | tuple[Rule, ...] = "redactor", types: list[str] | None = None) -> Column:
    """The text after all passes; null becomes empty."""
    chosen = pick_rules(rules, types)
    replaced = lambda text: F.aggregate(
        _passes(text, chosen), text, lambda stage, rule: F.regexp_replace(stage, rule["pattern"], rule["marker"])
    )
    whole = F.coalesce(text, F.lit(""))
    if not by_told_lines(chosen):
        return replaced(whole)
    back = lambda marked, told: let(replaced(told), lambda done: F.when(done == told, whole).otherwise(_put_back(marked, done)))
    return F.when(parted(whole), replaced(whole)).otherwise(_of_told_lines(whole, back))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _of_told_lines(text: Column, body) -> Column:
    """``body`` of the marked lines, and of the text with a number sign, which no match holds, for each that no match can touch."""
    short = lambda marked: F.array_join(F.transform(marked, lambda m: F.when(m["told"], m["line"]).otherwise("#")), "\n")
    return let(lines_told(text), lambda marked: let(short(marked), lambda told: body(marked, told)))


def _put_back(marked: Column, done: Column) -> Column:
    """The lines left out, in their places again: every line of ``done`` that is a number sign stands for the next of them."""
    rest = F.transform(F.filter(marked, lambda m: ~m["told"]), lambda m: m["line"])
    around = F.split(F.concat(F.lit("\n"), done, F.lit("\n")), "\n#(?=\n)", -1)
    both = F.zip_with(around, rest, lambda gap, line: F.coalesce(F.concat(gap, F.lit("\n"), line), gap))
    return let(F.array_join(both, ""), lambda joined: F.substring(joined, F.lit(2), F.length(joined) - 2))


def pieces(text: Column, pattern: Column) -> Column:
    """The text cut at its matches: gap, match, gap, ..., match, gap. One pass of the pattern.

    Matches are fenced with a character that texts do not use; a text that does use it is cut in two
    passes instead.
    """
    fenced = F.regexp_replace(text, pattern, F.lit(f"{_FENCE}$0{_FENCE}"))
    both = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("hit")
    )
    rest = F.flatten(
        F.transform(both, lambda p: F.when(p["hit"].isNull(), F.array(p["gap"])).otherwise(F.array(p["gap"], p["hit"])))
    )
    return F.when(F.contains(text, F.lit(_FENCE)), rest).otherwise(F.split(fenced, _FENCE, -1))


def _rejoined(cut: Column, marker: Column) -> Column:
    """The text with the marker in place of each match."""
    return F.array_join(F.transform(cut, lambda piece, i: F.when(i % 2 == 1, marker).otherwise(piece)), "")


def _hits(cut: Column) -> Column:
    return F.floor(F.size(cut) / 2).cast("int")


def _counted(text: Column, rules: tuple[Rule, ...]) -> Column:
    """Struct of the redacted text and the number of redactions."""
    whole = F.coalesce(text, F.lit(""))
    none = F.struct(whole.alias("text"), F.lit(0).alias("hits"))

    def step(state: Column, rule: Column) -> Column:
        after = lambda cut: F.when(F.size(cut) == 1, state).otherwise(
            F.struct(_rejoined(cut, rule["marker"]).alias("text"), (state["hits"] + _hits(cut)).alias("hits"))
        )
        return let(pieces(state["text"], rule["pattern"]), after)

    replaced = lambda text: F.aggregate(_passes(text, rules), F.struct(text.alias("text"), F.lit(0).alias("hits")), step)
    if not by_told_lines(rules):
        return replaced(whole)
    put_back = lambda marked, done: F.struct(_put_back(marked, done["text"]).alias("text"), done["hits"].alias("hits"))
    back = lambda marked, told: let(replaced(told), lambda done: F.when(done["hits"] == 0, none).otherwise(put_back(marked, done)))
    return F.when(parted(whole), replaced(whole)).otherwise(_of_told_lines(whole, back))


def redact(
    df: DataFrame,
    col: str = "text",
    out: str = "redacted",
    rules: str | tuple[Rule, ...] = "redactor",
    types: list[str] | None = None,
    enabled: bool = True,
    count_as: str | None = None,
) -> DataFrame:
    """Add the redacted text, and with ``count_as`` the number of redactions.

    Null becomes empty text. With ``enabled=False`` the text passes through unchanged.
    """
    if not enabled:
        plain = df.withColumn(out, F.col(col))
        return plain.withColumn(count_as, F.lit(0)) if count_as else plain
    if not count_as:
        return df.withColumn(out, redacted_text(F.col(col), rules, types))
    both = df.withColumn("__redaction", _counted(F.col(col), pick_rules(rules, types)))
    return both.withColumns(
        {out: F.col("__redaction.text"), count_as: F.col("__redaction.hits")}
    ).drop("__redaction")


def located(cut: Column) -> Column:
    """Value, 0-based offset and 1-based line of each match, from the pieces of a text.

    The matches are walked in blocks, because an array that grows by one element is copied each time: a
    text with a million matches costs a million short copies, not a million long ones.
    """
    newlines = lambda text: F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    none = F.array().cast(_FOUND)
    start = F.struct(
        F.lit(0).alias("at"), F.lit(1).alias("line"), F.array().cast(f"array<{_FOUND}>").alias("done"), none.alias("found")
    )

    def walked(cut: Column) -> Column:
        def step(state: Column, i: Column) -> Column:
            gap, value = F.get(cut, i * 2), F.get(cut, i * 2 + 1)
            at = state["at"] + F.length(gap)
            line = state["line"] + newlines(gap)
            hit = F.struct(value.alias("value"), at.alias("position"), line.alias("line"))
            return F.struct(
                (at + F.length(value)).alias("at"),
                (line + newlines(value)).alias("line"),
                state["done"].alias("done"),
                F.concat(state["found"], F.array(hit)).alias("found"),
            )

        def walk(state: Column, block: Column) -> Column:
            close = lambda inner: F.struct(
                inner["at"].alias("at"),
                inner["line"].alias("line"),
                F.concat(inner["done"], F.array(inner["found"])).alias("done"),
                none.alias("found"),
            )
            last = F.least(block * _BLOCK + _BLOCK, _hits(cut)) - 1
            return F.aggregate(F.sequence(block * _BLOCK, last), state, step, close)

        blocks = F.sequence(F.lit(0), F.floor((_hits(cut) - 1) / _BLOCK).cast("int"))
        found = F.aggregate(blocks, start, walk, lambda state: F.flatten(state["done"]))
        return F.when(F.size(cut) == 1, none).otherwise(found)

    return let(cut, walked)


def redaction_list(
    text: Column, rules: str | tuple[Rule, ...] = "redactor", types: list[str] | None = None
) -> Column:
    """Array of {type, position, length, replacement}.

    A position refers to the text as the pass of that type found it, i.e. after earlier types.
    """
    start = F.struct(
        F.coalesce(text, F.lit("")).alias("text"), F.array().cast(_RECORDS).alias("records")
    )

    def step(state: Column, rule: Column) -> Column:
        as_record = lambda hit: F.struct(
            rule["type"].alias("type"),
            hit["position"].alias("position"),
            F.length(hit["value"]).alias("length"),
            rule["marker"].alias("replacement"),
        )
        after = lambda cut: F.when(F.size(cut) == 1, state).otherwise(
            F.struct(
                _rejoined(cut, rule["marker"]).alias("text"),
                F.concat(state["records"], F.transform(located(cut), as_record)).alias("records"),
            )
        )
        return let(pieces(state["text"], rule["pattern"]), after)

    return F.aggregate(_passes(text, pick_rules(rules, types)), start, step, lambda state: state["records"])


def redaction_records(df: DataFrame, key: str, col: str = "text", **options) -> DataFrame:
    """One row per redaction."""
    found = df.select(key, F.explode(redaction_list(F.col(col), **options)).alias("record"))
    return found.select(key, "record.*")


def pii_counts(text: Column, rules: str | tuple[Rule, ...] = "redactor") -> Column:
    """Map of type to hits on the raw text, only types that occur; overlapping types all count."""
    chosen = pick_rules(rules)
    counts = [F.when(rule.possible(text), rule.count(text)).otherwise(0) for rule in chosen]
    named = F.map_from_arrays(F.array(*[F.lit(rule.name) for rule in chosen]), F.array(*counts))
    return F.map_filter(F.when(text.isNull(), F.create_map().cast("map<string,int>")).otherwise(named),
                        lambda _, hits: hits > 0)


def anonymize(df: DataFrame, col: str = "text", out: str = "anonymized") -> DataFrame:
    """The eleven scan types, ignoring case, replaced one after another."""
    return redact(df, col, out, rules="scanner")
