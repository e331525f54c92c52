"""The queries of this subpackage, each over its whole table, with their SQL twins where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from lorekeep.llm import bpe, conversations, lm, mixing, near, neighbours, phrases, private, quality, shards, token_counts, toxicity, urls
from lorekeep.llm.common import fold, load

Query = Callable[[SparkSession, str], DataFrame]


# The rules that op2 judges by before its own.
URL_RULES = [
    urls.HostRule("com", "/", "allow"),
    urls.HostRule("example.com", "/en/", "block"),
    urls.HostRule("www.example.com", "/en/", "allow"),
    urls.HostRule("net", "/es/", "block"),
    urls.HostRule("net", "/fr/", "block"),
]


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "source", "block", "slot", "position")


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = load(spark, sf_dir, "pages").select("page_id", "url")
    labels = load(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("page_id"), ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("block")
    )
    judged = urls.judge(pages, URL_RULES, urls.mine(pages, labels)).drop("url")
    first = ["page_id", "host", "path", "rule", "verdict"]
    return judged.select(*first, *[c for c in judged.columns if c not in first])


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    labels = load(spark, sf_dir, "labels").where(fold(F.col("doc_id")) != 0)
    return toxicity.score(docs, toxicity.fit(docs, labels)).select(
        "doc_id",
        (fold(F.col("doc_id")) == 0).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
        "n_clauses",
        "worst_clause",
    )


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    trusted = load(spark, sf_dir, "labels").where("quality = 1 AND toxic = 0").select("doc_id")
    return quality.judge(docs, quality.fit(docs, trusted)).drop("text")


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", (fold(F.col("doc_id")) == 1).alias("held_out"))
    return lm.score(docs.withColumn("trained", ~F.col("held_out")))


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard(load(spark, sf_dir, "documents"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near.near_duplicates(load(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "n_copies", "n_links")


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.digests(conversations.damaged(load(spark, sf_dir, "conversations")))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(load(spark, sf_dir, "documents").select("lang", "text"))


def op13_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return private.digests(private.find(docs, private.fit(docs)))


QUERIES: dict[str, Query] = {
    run.__name__: run
    for run in (
        op1_mixing,
        op2_url_filters,
        op3_toxicity,
        op4_quality_rules,
        op5_nearest,
        op6_token_counts,
        op7_byte_bpe,
        op8_lm_scores,
        op9_shards,
        op10_jaccard_join,
        op11_conversations,
        op12_phrases,
        op13_private,
    )
}
# The schedule is a recursion over the slots of one period; places follow from it by windows over blocks and rows.
MIXING_SQL = """WITH RECURSIVE counted AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
sources AS (SELECT source, n, CAST(greatest(1, round(1000 * pow(n, 0.5) / sum(pow(n, 0.5)) OVER ())) AS BIGINT) AS share,
  row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i FROM counted),
plan AS (SELECT list(share ORDER BY i) AS shares, CAST(sum(share) AS BIGINT) AS period FROM sources),
schedule AS (
  SELECT CAST(-1 AS BIGINT) AS slot, list_transform(shares, lambda s: CAST(0 AS BIGINT)) AS taken, CAST(-1 AS BIGINT) AS i FROM plan
  UNION ALL
  SELECT slot + 1, list_transform(taken, lambda n, k: n + CASE WHEN k = chosen + 1 THEN 1 ELSE 0 END), chosen FROM (
    SELECT slot, taken, period, list_min(list_transform(shares, lambda s, k: CASE WHEN taken[k] * period // s <= slot + 1
      THEN (((taken[k] + 1) * period + s - 1) // s) * 100000 + k - 1 END)) % 100000 AS chosen
    FROM schedule, plan) WHERE slot < period - 1),
picked AS (SELECT i, slot, row_number() OVER (PARTITION BY i ORDER BY slot) - 1 AS k FROM schedule WHERE slot >= 0),
blocks AS (SELECT source, i, share, n, unnest(range(0, (n + 63) // 64)) AS block FROM sources),
placed AS (SELECT source, block, least(64, n - block * 64) AS size, (block // share) * period + p.slot AS due
  FROM blocks b JOIN picked p ON p.i = b.i AND p.k = b.block % b.share, plan),
ordered AS (SELECT source, block, row_number() OVER (ORDER BY due) - 1 AS slot, sum(size) OVER (ORDER BY due) - size AS start FROM placed),
numbered AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source
  ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, ''))) - 1 AS number FROM documents)
SELECT doc_id, n.source, block, slot, CAST(start + number % 64 AS BIGINT) AS position
FROM numbered n JOIN ordered o ON n.source IS NOT DISTINCT FROM o.source AND n.number // 64 = o.block"""

# All pairs that share a shingle, and the classes by reachability.
JACCARD_SQL = r"""WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
shingles AS (SELECT doc_id, unnest(CASE WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END) AS shingle FROM split),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b
  ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
linked AS (SELECT x, y, c = p.n AND c = q.n AS same FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE c >= 0.8 * (p.n + q.n - c) - 1e-9),
ways AS (SELECT x, y, same FROM linked UNION ALL SELECT y, x, same FROM linked),
reached AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, b.y FROM reached r JOIN ways b ON b.x = r.y),
classes AS (SELECT x, min(y) AS class_id FROM reached GROUP BY x),
counted AS (SELECT x, count(*) AS links, count(*) FILTER (WHERE same) AS copies FROM ways GROUP BY x)
SELECT doc_id, class_id, 1 + coalesce(copies, 0) AS n_copies, coalesce(links, 0) AS n_links
FROM documents JOIN classes c ON c.x = doc_id LEFT JOIN counted n ON n.x = doc_id"""

# Every run of one to four words by its own explosion; products in 128 bits.
PHRASES_SQL = r"""WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS ws FROM (
    SELECT lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
runs AS (SELECT lang, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: ws[i:i + k - 1])) AS ws
  FROM pieces, (VALUES (1), (2), (3), (4)) t(k) WHERE len(ws) >= k),
f AS (SELECT lang, ws, count(*) AS f FROM runs GROUP BY ALL),
total AS (SELECT lang, sum(f) AS n FROM f WHERE len(ws) = 1 GROUP BY lang),
phrases AS (SELECT lang, ws, f AS a FROM f WHERE len(ws) > 1 AND f >= 30),
cuts AS (SELECT lang, ws, a, unnest(range(1, len(ws))) AS k FROM phrases),
met AS (SELECT c.lang, c.ws, a, k, h.f AS l, t.f AS r, CAST(2000000 AS HUGEINT) * a // (CAST(h.f AS HUGEINT) + t.f) AS score
  FROM cuts c JOIN f h ON h.lang = c.lang AND h.ws = c.ws[1:k] JOIN f t ON t.lang = c.lang AND t.ws = c.ws[k + 1:]),
best AS (SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, k) = 1),
inside AS (SELECT DISTINCT lang, ws[i:i + n - 1] AS ws, a FROM phrases, (VALUES (2), (3)) t(n), (VALUES (1), (2), (3)) u(i)
  WHERE n < len(ws) AND i + n - 1 <= len(ws)),
covers AS (SELECT lang, ws, max(a) AS longer FROM inside GROUP BY ALL),
kept AS (SELECT b.lang, array_to_string(b.ws, ' ') AS phrase, a, l, r, score FROM best b LEFT JOIN covers c
  ON c.lang = b.lang AND c.ws = b.ws WHERE longer IS NULL OR CAST(100 AS HUGEINT) * longer < CAST(80 AS HUGEINT) * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r,
  CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM kept JOIN total USING (lang) QUALIFY rank <= 2000"""

ORACLES: dict[str, str] = {"op1_mixing": MIXING_SQL, "op10_jaccard_join": JACCARD_SQL, "op12_phrases": PHRASES_SQL}
