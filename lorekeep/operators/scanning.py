"""Scan for personal data and secrets, and the go / no-go gates built on it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorekeep.functions.rules import CRITICAL_TYPES, Rule, pick_rules, told_lines
from lorekeep.operators.redaction import let, located, pieces, redact

# Texts of the scan report.
APPROVED = "APPROVED for embeddings"
REJECTED = "REJECTED - Remove critical PII before proceeding"
WARNING = "Found {n} critical PII matches that must be removed"
MASK_CHARS = 10
MASK_TAIL = "..."

_HIT = "array<struct<type:string,value:string,line_number:int>>"


def _as_hit(rule: Rule):
    return lambda hit: F.struct(
        F.lit(rule.name).alias("type"), hit["value"].alias("value"), hit["line"].alias("line_number")
    )


def text_hits(text: Column, rules: str | tuple[Rule, ...] = "scanner") -> Column:
    """Every match of every rule in one text as an array; rules are independent of each other."""
    none = F.array().cast(_HIT)

    def found(whole: Column, told: Column) -> Column:
        per_rule = []
        for rule in pick_rules(rules):
            own = told if rule.by_lines else whole
            hits = F.transform(located(pieces(own, F.lit(rule.spark_pattern))), _as_hit(rule))
            per_rule.append(rule.if_possible(own, hits, none))
        return F.concat(*per_rule)

    return let(text, lambda whole: let(told_lines(whole), lambda told: found(whole, told)))


def string_leaves(schema: T.StructType, names: Sequence[str] | None = None) -> Column:
    """Array of {path, value} for every string inside nested columns, built from the schema."""
    empty = F.array().cast("array<struct<path:string,value:string>>")

    def walk(value: Column, kind: T.DataType, path: Column) -> Column:
        if isinstance(kind, T.StringType):
            leaf = F.array(F.struct(path.alias("path"), value.alias("value")))
            return F.when(value.isNotNull(), leaf).otherwise(empty)
        if isinstance(kind, T.StructType):
            parts = [
                walk(value[field.name], field.dataType, F.concat(path, F.lit(f".{field.name}")))
                for field in kind.fields
            ]
            return F.concat(*parts) if parts else empty
        if isinstance(kind, T.ArrayType):
            inner = lambda item, i: walk(
                item, kind.elementType, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))
            )
            return F.coalesce(F.flatten(F.transform(value, inner)), empty)
        if isinstance(kind, T.MapType):
            inner = lambda entry: walk(
                entry["value"], kind.valueType, F.concat(path, F.lit("."), entry["key"].cast("string"))
            )
            return F.coalesce(F.flatten(F.transform(F.map_entries(value), inner)), empty)
        return empty

    fields = [f for f in schema.fields if names is None or f.name in names]
    return F.concat(empty, *[walk(F.col(f.name), f.dataType, F.lit(f.name)) for f in fields])


def leaf_items(schema: T.StructType, names: Sequence[str] | None = None) -> Column:
    """Compat item count of one row: list lengths plus every leaf that is neither text nor container."""

    def walk(value: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StringType):
            return value.isNull().cast("bigint")
        if isinstance(kind, T.StructType):
            inside = sum((walk(value[f.name], f.dataType) for f in kind.fields), F.lit(0).cast("bigint"))
            return F.when(value.isNull(), F.lit(1).cast("bigint")).otherwise(inside)
        if isinstance(kind, T.ArrayType):
            items = F.aggregate(
                value, F.lit(0).cast("bigint"), lambda acc, item: acc + walk(item, kind.elementType)
            )
            return F.when(value.isNull(), F.lit(1).cast("bigint")).otherwise(F.size(value) + items)
        if isinstance(kind, T.MapType):
            items = F.aggregate(
                F.map_values(value),
                F.lit(0).cast("bigint"),
                lambda acc, item: acc + walk(item, kind.valueType),
            )
            return F.when(value.isNull(), F.lit(1).cast("bigint")).otherwise(items)
        return F.lit(1).cast("bigint")

    fields = [f for f in schema.fields if names is None or f.name in names]
    return sum((walk(F.col(f.name), f.dataType) for f in fields), F.lit(0).cast("bigint"))


def scan_nested(
    df: DataFrame,
    key: str,
    source: str = "unknown",
    cols: Sequence[str] | None = None,
    rules: str | tuple[Rule, ...] = "scanner",
) -> DataFrame:
    """One row per match in any string of the row, with context ``source:[key].path[index]``."""
    chosen = [name for name in (cols or df.columns)]
    leaves = df.select(F.col(key), F.explode(string_leaves(df.schema, chosen)).alias("leaf"))
    hits = leaves.select(
        key, F.col("leaf.path").alias("path"), F.explode(text_hits(F.col("leaf.value"), rules)).alias("hit")
    )
    context = F.concat(F.lit(f"{source}:["), F.col(key).cast("string"), F.lit("]."), F.col("path"))
    return hits.select(key, "hit.type", "hit.value", context.alias("context"), "hit.line_number")


def scan_pii(
    df: DataFrame,
    key: str,
    cols: Sequence[str] = ("text",),
    source: str = "unknown",
    rules: str | tuple[Rule, ...] = "scanner",
) -> DataFrame:
    """One row per match in flat text columns."""
    return scan_nested(df, key, source, cols, rules)


def scan_counts(df: DataFrame, col: str = "text", rules: str | tuple[Rule, ...] = "scanner") -> DataFrame:
    """Add one ``n_<type>`` column per rule: hits in the text, without building the matches."""
    text, told = F.col(col), F.col("__told")
    return df.withColumn("__told", told_lines(text)).withColumns(
        {
            f"n_{rule.name}": rule.if_possible(told if rule.by_lines else text, rule.count(told if rule.by_lines else text), F.lit(0))
            for rule in pick_rules(rules)
        }
    ).drop("__told")


def matches_by_type(matches: DataFrame) -> DataFrame:
    return matches.groupBy("type").agg(F.count(F.lit(1)).alias("matches"))


def critical(matches: DataFrame) -> DataFrame:
    return matches.where(F.col("type").isin(*CRITICAL_TYPES))


def masked(matches: DataFrame) -> DataFrame:
    """Report form: the first ten characters (compat) and a hash of the value instead of the value."""
    return matches.select(
        "*",
        F.concat(F.substring("value", 1, MASK_CHARS), F.lit(MASK_TAIL)).alias("masked_value"),
        F.sha2("value", 256).alias("value_sha256"),
    ).drop("value")


def items_scanned(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Plain row count, and the compat count in which numbers and nulls count as items."""
    return df.agg(
        F.count(F.lit(1)).alias("rows_scanned"),
        (F.count(F.lit(1)) + F.coalesce(F.sum(leaf_items(df.schema, cols)), F.lit(0))).alias(
            "items_scanned_compat"
        ),
    )


def _gate(grouped, chosen: tuple[Rule, ...]) -> DataFrame:
    total = lambda name: F.coalesce(F.sum(f"n_{name}"), F.lit(0)).cast("bigint")
    per_type = [total(rule.name).alias(f"t_{rule.name}") for rule in chosen]
    return grouped.agg(F.count(F.lit(1)).alias("rows_scanned"), *per_type)


def _verdict(totals: DataFrame, chosen: tuple[Rule, ...]) -> DataFrame:
    names = [rule.name for rule in chosen]
    total = lambda kept: sum((F.col(f"t_{name}") for name in kept), F.lit(0).cast("bigint"))
    by_type = F.map_filter(
        F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[F.col(f"t_{name}") for name in names])),
        lambda _, n: n > 0,
    )
    judged = totals.withColumns(
        {
            "pii_matches": total(names),
            "critical_matches": total([name for name in names if name in CRITICAL_TYPES]),
            "matches_by_type": by_type,
        }
    )
    passed = F.col("critical_matches") == 0
    warning = F.concat(
        F.lit(WARNING.split("{n}")[0]), F.col("critical_matches").cast("string"), F.lit(WARNING.split("{n}")[1])
    )
    return judged.withColumns(
        {
            "pii_types": F.array_sort(F.map_keys("matches_by_type")),
            "passed": passed,
            "warning": F.when(~passed, warning),
            "recommendation": F.when(passed, APPROVED).otherwise(REJECTED),
        }
    ).drop(*[f"t_{name}" for name in names])


def pii_gate(df: DataFrame, col: str = "text", rules: str | tuple[Rule, ...] = "scanner") -> DataFrame:
    """One row: totals, types, counts by type, critical count, passed, warning, recommendation.

    Only counts leave a task, so the shuffle carries one row per task whatever the matches.
    """
    chosen = pick_rules(rules)
    return _verdict(_gate(scan_counts(df, col, rules), chosen), chosen)


def pii_gate_by(
    df: DataFrame, by: str, col: str = "text", rules: str | tuple[Rule, ...] = "scanner"
) -> DataFrame:
    """The gate per source, and a row with a null source for all of them together."""
    chosen = pick_rules(rules)
    per_source = _gate(scan_counts(df, col, rules).groupBy(by), chosen)
    sums = [F.sum(name).alias(name) for name in per_source.columns if name != by]
    return _verdict(per_source.rollup(by).agg(*sums), chosen)


def count_by_type(df: DataFrame, col: str = "text", rules: str | tuple[Rule, ...] = "scanner") -> DataFrame:
    """Hits per type straight from the texts, without building the matches; absent types are left out."""
    chosen = pick_rules(rules)
    totals = scan_counts(df, col, rules).agg(
        *[F.coalesce(F.sum(f"n_{rule.name}"), F.lit(0)).cast("bigint").alias(rule.name) for rule in chosen]
    )
    pairs = ", ".join(f"'{rule.name}', {rule.name}" for rule in chosen)
    return totals.select(F.expr(f"stack({len(chosen)}, {pairs}) as (type, matches)")).where("matches > 0")


def gap_audit(df: DataFrame, col: str = "text", rules: str = "redactor") -> DataFrame:
    """Scanner hits that survive redaction, per type; types without survivors are left out."""
    clean = redact(df, col, "__clean", rules=rules)
    return count_by_type(clean, "__clean").withColumnRenamed("matches", "remaining")
