"""URL filters: fixed rules first, then association rules mined from labelled pages."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence
from itertools import product
from math import prod
from typing import NamedTuple

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import arrow_map, written

BLOCK = "label=block"
BROADCAST_TOKENS = 100_000


class HostRule(NamedTuple):
    """Fits the host and its subdomains where the path starts with ``path``."""

    host: str
    path: str
    verdict: str


class Mined(NamedTuple):
    tokens: tuple[str, ...]
    confidence: float
    support: float


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def tokens_of(url: Column) -> Column:
    """The distinct tokens of a URL: scheme, host labels, last two labels, path pieces and query keys, digits as ``0``."""
    text = F.lower(F.coalesce(url, F.lit("")))
    rest = F.regexp_extract(text, r"(?s)^.*?://[^/?#]*(.*)$", 1)
    tagged = lambda tag, parts: F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.concat(F.lit(tag), p))
    keys = F.transform(
        F.split(F.regexp_extract(rest, r"\?([^#]*)", 1), "&"), lambda part: F.split_part(part, F.lit("="), F.lit(1))
    )
    pieces = F.split(F.regexp_replace(path_of(text), r"\d+", "0"), r"[/._\-]+")
    return F.array_distinct(
        F.concat(
            tagged("scheme=", F.array(F.regexp_extract(text, r"^([a-z][a-z0-9+.\-]*)://", 1))),
            tagged("host=", F.split(F.regexp_replace(host_of(text), r"\d+", "0"), r"[.\-]+")),
            tagged("site=", F.array(F.regexp_extract(host_of(text), r"([^.]+\.[^.]+)$", 1))),
            tagged("path=", pieces),
            tagged("key=", keys),
        )
    )


def fixed_rule(host: Column, path: Column, rules: Sequence[HostRule]) -> Column:
    """The longest rule that fits, as struct(rule, verdict), or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: len(r.host + r.path)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        result = F.struct(F.lit(rule.host + rule.path).alias("rule"), F.lit(rule.verdict).alias("verdict"))
        found = F.when(fits, result).otherwise(found)
    return found


def mine(
    pages: DataFrame,
    labels: DataFrame,
    min_count: int = 20,
    min_confidence: float = 0.6,
    max_rules: int = 20_000,
) -> list[Mined]:
    """Token combinations that speak for blocking, from pages (page_id, url) and labels (page_id, block boolean).

    FP-growth runs over the tokens of all labelled pages with the label as one more token. Rules that end in the label are
    kept from ``min_confidence`` on, if no rule over fewer of their tokens is as confident. At least ``min_count`` pages
    must bear a rule out, however many are labelled. Tokens that occur in exactly the same labelled pages are one item of
    FP-growth, and each of them stands in the rules over it, and tokens of blocked pages alone are rules by themselves and no items,
    so copies and variants of a long URL do not list all subsets of its tokens.
    More than ``max_rules`` that are left raise, because the rules are sent to every task; none are dropped.
    """
    labelled = (
        pages.join(labels.where("page_id IS NOT NULL").groupBy("page_id").agg(F.max("block").alias("__block")), "page_id")
        .select(F.coalesce("__block", F.lit(False)).alias("__block"), tokens_of(F.col("url")).alias("__tokens"))
        .where(F.size("__tokens") > 0)
        .withColumn("__page", F.monotonically_increasing_id())
    )
    labelled = written(labelled, "url-tokens")
    rows = labelled.count()
    if not rows:
        return []
    # The same pages: as many, and the same sums of two hashes of them.
    each = labelled.select("__page", "__block", F.explode("__tokens").alias("__token"))
    summed = [F.sum(F.xxhash64("__page", F.lit(salt)).cast("decimal(38,0)")).alias(f"__sum{salt}") for salt in (0, 1)]
    tokens = written(
        each.groupBy("__token").agg(F.count("*").alias("__n"), F.count_if("__block").alias("__b"), *summed).where(F.col("__b") >= min_count), "url-counts"
    )
    # A token of blocked pages alone is a rule that no longer rule can be surer than; what shares it is not combined.
    sure = tokens.where("__n = __b").select("__token", "__b").limit(max_rules + 1).collect()
    if len(sure) > max_rules:
        raise ValueError(f"more than {max_rules} rules: raise min_count or min_confidence")
    certain = [Mined((r["__token"],), 1.0, r["__b"] / rows) for r in sure]
    ordered = lambda rules: sorted(rules, key=lambda r: (-r.confidence, len(r.tokens), r.tokens))
    groups = tokens.where("__n > __b").groupBy("__n", "__sum0", "__sum1").agg(F.min("__token").alias("__item"), F.collect_list("__token").alias("__same"))
    groups = written(groups.select("__item", "__same"), "url-items")
    # One token of a group stands for it; the others are dropped, and with them what no rule can hold.
    wanted = groups.select(F.col("__item").alias("__token"))
    few = F.broadcast if groups.count() <= BROADCAST_TOKENS else (lambda frame: frame)
    merged = each.join(few(wanted), "__token").groupBy("__page").agg(F.first("__block").alias("__block"), F.collect_list("__token").alias("__items"))
    items = F.when(F.col("__block"), F.array_append("__items", F.lit(BLOCK))).otherwise(F.col("__items"))
    merged = written(merged.select(items.alias("items")), "url-merged")
    held = merged.count()
    if not held:
        return ordered(certain)
    support = min(1.0, (min_count - 0.5) / held)  # half a page less, as FP-growth rounds the product up
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=min_confidence).fit(merged)
    found = model.associationRules.where(F.col("consequent") == F.array(F.lit(BLOCK))).select(
        F.array_sort("antecedent").alias("tokens"), "confidence", (F.col("support") * held / rows).alias("support")
    )
    found = written(found, "url-rules")
    kept, size = [], 0
    while (size := found.agg(F.min(F.size("tokens"))).first()[0]) is not None:
        least = found.where(F.size("tokens") == size)
        kept += least.limit(max_rules + 1 - len(kept)).collect()
        if len(kept) > max_rules:
            raise ValueError(f"more than {max_rules} rules: raise min_count or min_confidence")
        shorter = least.select(F.col("tokens")[0].alias("__first"), F.col("tokens").alias("__short"), F.col("confidence").alias("__as"))
        longer = found.where(F.size("tokens") > size).withColumn("__first", F.explode("tokens"))
        idle = longer.join(F.broadcast(shorter), "__first").where((F.col("__as") >= F.col("confidence")) & (F.size(F.array_except("__short", "tokens")) == 0))
        rest = found.where(F.size("tokens") > size).join(idle.select("tokens").distinct(), "tokens", "left_anti")
        found = written(rest, "url-rules")
    if not kept:
        return ordered(certain)
    used = pages.sparkSession.createDataFrame([(t,) for t in {t for r in kept for t in r["tokens"]}], "__item string")
    same = {r["__item"]: sorted(r["__same"]) for r in groups.join(F.broadcast(used), "__item").collect()}
    if len(certain) + sum(prod(len(same[t]) for t in r["tokens"]) for r in kept) > max_rules:
        raise ValueError(f"more than {max_rules} rules: raise min_count or min_confidence")
    rules = [Mined(tuple(sorted(one)), r["confidence"], r["support"]) for r in kept for one in product(*[same[t] for t in r["tokens"]])]
    return ordered(certain + rules)


def judge(pages: DataFrame, rules: Sequence[HostRule], mined: Sequence[Mined]) -> DataFrame:
    """Add host, path, rule, verdict, fired (the mined rule, else null) and confidence to pages (url and any columns).

    A fixed rule that fits decides. Else the page is blocked if a mined rule's tokens are all in its URL, the most
    confident one naming the reason; else allowed. The mined rules lie in an inverted index under one token each, the rarest
    among the rules, so a page only looks at rules under its own tokens. Null and broken URLs have empty host and
    path, fit no rule and are allowed. Columns of the same names are replaced. No shuffle.
    """
    spread: dict[str, int] = defaultdict(int)
    for rule in mined:
        for token in rule.tokens:
            spread[token] += 1
    index: dict[str, list[Mined]] = defaultdict(list)
    for rule in mined:
        index[min(rule.tokens, key=lambda t: (spread[t], t))].append(rule)
    index = dict(index)

    def match(batch: pa.RecordBatch) -> pa.RecordBatch:
        fired, confidence = [], []
        for tokens in batch.column(batch.schema.get_field_index("__tokens")).to_pylist():
            own = set(tokens)
            hits = [rule for t in tokens for rule in index.get(t, ()) if own.issuperset(rule.tokens)]
            best = min(hits, key=lambda r: (-r.confidence, -r.support, r.tokens), default=None)
            fired.append(" ".join(best.tokens) if best else None)
            confidence.append(best.confidence if best else None)
        kept = {n: c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n not in new and n != "__tokens"}
        return pa.RecordBatch.from_pydict(
            kept | {"fired": pa.array(fired, pa.string()), "confidence": pa.array(confidence, pa.float64())}
        )

    new = {"fired", "confidence"}
    ready = pages.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url")), "__tokens": tokens_of(F.col("url"))})
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in ready.schema if f.name not in {*new, "__tokens"}]
    matched = arrow_map(ready, match, ", ".join([*fields, "fired string, confidence double"]))
    fixed = fixed_rule(F.col("host"), F.col("path"), rules)
    return (
        matched.withColumn("__fixed", fixed)
        .withColumn("rule", F.col("__fixed.rule"))
        .withColumn(
            "verdict",
            F.coalesce(F.col("__fixed.verdict"), F.when(F.col("fired").isNotNull(), "block").otherwise("allow")),
        )
        .drop("__fixed")
    )
