"""Queries over scans, gates, volume, cost and budgets."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep.functions.rules import CRITICAL_TYPES, REDACTOR, SCANNER
from lorekeep.operators import budget as bg
from lorekeep.operators import governance as gv
from lorekeep.operators import redaction as rd
from lorekeep.operators import running as rn
from lorekeep.operators import scanning as sc
from lorekeep.operators import volume as vl
from lorekeep.plans import bindings as b
from lorekeep.plans.registry import query


def _match_rows(source, key, text):
    return " UNION ALL ".join(b.sql_located(source, key, text, rule) for rule in SCANNER)


@query(
    "pii_scan_matches",
    f"""WITH {b.PLANTED}, found AS ({_match_rows('planted', 'doc_id', 'text')})
SELECT doc_id, type, 'documents:[' || CAST(doc_id AS VARCHAR) || '].text' AS context, line_number,
  substr(value, 1, 10) || '...' AS masked_value, sha256(value) AS value_sha256 FROM found""",
)
def pii_scan_matches(spark, sf_dir):
    matches = sc.masked(sc.scan_pii(b.planted(spark, sf_dir), "doc_id", source="documents"))
    return matches.withColumn("line_number", F.col("line_number").cast("bigint"))


@query(
    "pii_scan_nested",
    f"""WITH {b.PLANTED}, lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM planted),
found AS ({_match_rows('lines', 'doc_id, n', 'line')})
SELECT doc_id, type, 'documents:[' || CAST(doc_id AS VARCHAR) || '].body.lines[' || CAST(n AS VARCHAR) || ']' AS context,
  line_number, sha256(value) AS value_sha256 FROM found""",
)
def pii_scan_nested(spark, sf_dir):
    docs = b.planted(spark, sf_dir).select(
        "doc_id",
        F.struct("author", F.split("text", "\n", -1).alias("lines")).alias("body"),
        F.create_map(F.lit("url"), "url").alias("links"),
    )
    matches = sc.masked(sc.scan_nested(docs, "doc_id", "documents", ["body", "links"]))
    return matches.drop("masked_value").withColumn("line_number", F.col("line_number").cast("bigint"))


_TOTALS = ", ".join(f"CAST(sum({b.sql_count('text', rule)}) AS BIGINT) AS {rule.name}" for rule in SCANNER)
_UNPIVOT = " UNION ALL ".join(f"SELECT '{r.name}' AS type, {r.name} AS matches FROM totals" for r in SCANNER)
_CRITICAL = ", ".join(b.text_literal(name) for name in CRITICAL_TYPES)


@query(
    "pii_matches_by_type",
    f"WITH {b.PLANTED}, totals AS (SELECT {_TOTALS} FROM planted), t AS ({_UNPIVOT}) SELECT * FROM t WHERE matches > 0",
)
def pii_matches_by_type(spark, sf_dir):
    return sc.count_by_type(b.planted(spark, sf_dir))


@query(
    "critical_only",
    f"""WITH {b.PLANTED}, totals AS (SELECT doc_id, {_TOTALS} FROM planted GROUP BY doc_id),
t AS ({_UNPIVOT.replace("SELECT '", "SELECT doc_id, '")})
SELECT doc_id, type, matches FROM t WHERE matches > 0 AND type IN ({_CRITICAL})""",
)
def critical_only(spark, sf_dir):
    matches = sc.critical(sc.scan_pii(b.planted(spark, sf_dir), "doc_id"))
    return matches.groupBy("doc_id", "type").agg(F.count(F.lit(1)).alias("matches"))


@query(
    "pii_items_scanned",
    """SELECT count(*) AS rows_scanned,
  CAST(count(*) + sum(1 + 1 + len(string_split(text, chr(10)))) AS BIGINT) AS items_scanned_compat FROM documents""",
)
def pii_items_scanned(spark, sf_dir):
    docs = b.table(spark, sf_dir, "documents").select(
        "doc_id", "source", F.struct("lang", "n_chars", F.split("text", "\n", -1).alias("lines")).alias("body")
    )
    return sc.items_scanned(docs).select(
        "rows_scanned", F.col("items_scanned_compat").cast("bigint").alias("items_scanned_compat")
    )


def _sum_of(names):
    return " + ".join(names)


_ALL = [r.name for r in SCANNER]
_TYPES = "array_to_string(list_sort(list_filter([" + ", ".join(
    f"CASE WHEN {n} > 0 THEN '{n}' END" for n in _ALL
) + "], lambda x: x IS NOT NULL)), ',')"
_BY_TYPE = "array_to_string(list_sort(list_filter([" + ", ".join(
    f"CASE WHEN {n} > 0 THEN '{n}=' || CAST({n} AS VARCHAR) END" for n in _ALL
) + "], lambda x: x IS NOT NULL)), ',')"
_VERDICT = f"""rows_scanned, {_sum_of(_ALL)} AS pii_matches, {_sum_of(CRITICAL_TYPES)} AS critical_matches,
  {_TYPES} AS pii_types, {_BY_TYPE} AS matches_by_type, {_sum_of(CRITICAL_TYPES)} = 0 AS passed,
  CASE WHEN {_sum_of(CRITICAL_TYPES)} > 0 THEN 'Found ' || CAST({_sum_of(CRITICAL_TYPES)} AS VARCHAR)
    || ' critical PII matches that must be removed' END AS warning,
  CASE WHEN {_sum_of(CRITICAL_TYPES)} = 0 THEN 'APPROVED for embeddings'
    ELSE 'REJECTED - Remove critical PII before proceeding' END AS recommendation"""


def _flat_gate(gate, *keys):
    by_type = F.transform(F.map_entries("matches_by_type"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return gate.select(
        *keys,
        "rows_scanned",
        "pii_matches",
        "critical_matches",
        F.array_join("pii_types", ",").alias("pii_types"),
        F.array_join(F.array_sort(by_type), ",").alias("matches_by_type"),
        "passed",
        "warning",
        "recommendation",
    )


@query(
    "pii_gate",
    f"WITH totals AS (SELECT count(*) AS rows_scanned, {_TOTALS} FROM documents) SELECT {_VERDICT} FROM totals",
)
def pii_gate(spark, sf_dir):
    return _flat_gate(sc.pii_gate(b.table(spark, sf_dir, "documents", "doc_id")))


_CLEAN_TOTALS = _TOTALS.replace("regexp_extract_all(text,", "regexp_extract_all(clean,")


@query(
    "pii_gate_by_source",
    f"""WITH {b.PLANTED}, mixed AS (
  SELECT source, CASE WHEN source = 'drive' THEN {b.sql_redact('text', SCANNER)} ELSE text END AS clean FROM planted),
totals AS (SELECT source, count(*) AS rows_scanned, {_CLEAN_TOTALS} FROM mixed GROUP BY ROLLUP (source))
SELECT coalesce(source, 'all') AS source, {_VERDICT} FROM totals""",
)
def pii_gate_by_source(spark, sf_dir):
    clean = rd.anonymize(b.planted(spark, sf_dir))
    mixed = clean.withColumn("text", F.when(F.col("source") == "drive", F.col("anonymized")).otherwise(F.col("text")))
    gate = sc.pii_gate_by(mixed.select("source", "text"), "source")
    return _flat_gate(gate, F.coalesce("source", F.lit("all")).alias("source"))


@query(
    "redaction_gap_audit",
    f"""WITH {b.PLANTED}, cleaned AS (SELECT {b.sql_redact('text', REDACTOR)} AS clean FROM planted),
totals AS (SELECT {_CLEAN_TOTALS} FROM cleaned), t AS ({_UNPIVOT})
SELECT type, matches AS remaining FROM t WHERE matches > 0""",
)
def redaction_gap_audit(spark, sf_dir):
    return sc.gap_audit(b.planted(spark, sf_dir))


_TOKENS = f"len({b.sql_tokens('text')})"
_STATS = f"""stats AS (SELECT count(*) AS total_items, CAST(sum({_TOKENS}) AS BIGINT) AS total_tokens,
  sum({_TOKENS}) / count(*) AS avg_tokens FROM documents)"""


def _stats(spark, sf_dir):
    return vl.sample_stats(b.table(spark, sf_dir, "documents", "doc_id").select("text"))


@query(
    "volume_sample_stats",
    f"WITH {_STATS} SELECT total_items, total_tokens, round(avg_tokens, 2) AS avg_tokens_per_item FROM stats",
)
def volume_sample_stats(spark, sf_dir):
    return _stats(spark, sf_dir).withColumn("avg_tokens_per_item", F.round("avg_tokens_per_item", 2))


_PROJECTED = f"""{_STATS}, projected AS (SELECT *, avg_tokens * 1000 AS weekly_tokens,
  avg_tokens * 1000 * 4.33::DOUBLE AS monthly_tokens FROM stats)"""


@query(
    "volume_projection",
    f"""WITH {_PROJECTED} SELECT total_items, total_tokens, 1000 AS weekly_items, round(weekly_tokens, 2) AS weekly_tokens,
  4330.0::DOUBLE AS monthly_items, round(monthly_tokens, 2) AS monthly_tokens FROM projected""",
)
def volume_projection(spark, sf_dir):
    return vl.project(_stats(spark, sf_dir)).select(
        "total_items",
        "total_tokens",
        "weekly_items",
        F.round("weekly_tokens", 2).alias("weekly_tokens"),
        "monthly_items",
        F.round("monthly_tokens", 2).alias("monthly_tokens"),
    )


_COSTED = f"""{_PROJECTED}, parts AS (SELECT *, monthly_tokens / 1000000.0::DOUBLE AS m FROM projected),
rounded AS (SELECT *, round(m * 0.1::DOUBLE, 2) AS embedding_cost_usd, round(m * 3.0::DOUBLE, 2) AS input_cost_usd,
  round(m * 0.2::DOUBLE * 15.0::DOUBLE, 2) AS output_cost_usd,
  round(m * 3.0::DOUBLE + m * 0.2::DOUBLE * 15.0::DOUBLE, 2) AS summary_cost_usd FROM parts),
costed AS (SELECT *, round(embedding_cost_usd + summary_cost_usd, 2) AS total_monthly_usd FROM rounded)"""
_COST_COLUMNS = ("embedding_cost_usd", "input_cost_usd", "output_cost_usd", "summary_cost_usd", "total_monthly_usd")


def _costed(spark, sf_dir):
    return vl.project_cost(vl.project(_stats(spark, sf_dir)))


@query("cost_projection", f"WITH {_COSTED} SELECT {', '.join(_COST_COLUMNS)} FROM costed")
def cost_projection(spark, sf_dir):
    return _costed(spark, sf_dir).select(*_COST_COLUMNS)


_CHECKED = f"""{_COSTED}, checked AS (SELECT *, 50.0::DOUBLE AS budget_limit_usd,
  round(total_monthly_usd / 50.0 * 100, 2) AS utilization_percent, total_monthly_usd <= 50.0 AS within_budget,
  round(50.0 - total_monthly_usd, 2) AS remaining_budget_usd FROM costed)"""


@query(
    "budget_compliance",
    f"""WITH {_CHECKED} SELECT total_monthly_usd, budget_limit_usd, utilization_percent, within_budget, remaining_budget_usd,
  CASE WHEN within_budget THEN '{vl.WITHIN}' ELSE '{vl.OVER}' END AS status FROM checked""",
)
def budget_compliance(spark, sf_dir):
    return vl.budget_check(_costed(spark, sf_dir)).select(
        "total_monthly_usd", "budget_limit_usd", "utilization_percent", "within_budget", "remaining_budget_usd", "status"
    )


@query(
    "volume_recommendations",
    f"""WITH {_COSTED}, advice AS (
  SELECT unnest([CASE WHEN total_monthly_usd > 5.0 THEN '{vl.ADVICE_OVER}' END,
    CASE WHEN round(monthly_tokens, 2) > 10000000 THEN '{vl.ADVICE_VOLUME}' END,
    '{vl.ADVICE_ALWAYS[0]}', '{vl.ADVICE_ALWAYS[1]}']) AS advice FROM costed)
SELECT advice FROM advice WHERE advice IS NOT NULL""",
)
def volume_recommendations(spark, sf_dir):
    checked = vl.budget_check(_costed(spark, sf_dir), budget=5.0)
    return vl.recommend(checked).select(F.explode("recommendations").alias("advice"))


@query(
    "go_no_go",
    f"""WITH {_CHECKED}, totals AS (SELECT {_TOTALS} FROM documents),
d AS (SELECT {_sum_of(CRITICAL_TYPES)} = 0 AS pii_check, within_budget AS budget_check FROM totals, checked)
SELECT pii_check, budget_check, pii_check AND budget_check AS ready_for_pilot,
  CASE WHEN pii_check AND budget_check THEN '{vl.GO}' ELSE '{vl.NO_GO}' END AS overall_status,
  CASE WHEN pii_check THEN 'PASSED' ELSE 'FAILED' END AS pii_status,
  CASE WHEN pii_check THEN 'Approved for embeddings' ELSE 'Remove PII before proceeding' END AS pii_recommendation,
  CASE WHEN budget_check THEN 'WITHIN BUDGET' ELSE 'OVER BUDGET' END AS budget_status,
  CASE WHEN budget_check THEN 'Approved for pilot' ELSE 'Reduce scope or increase budget' END AS budget_recommendation
FROM d""",
)
def go_no_go(spark, sf_dir):
    docs = b.table(spark, sf_dir, "documents", "doc_id")
    return vl.go_no_go(sc.pii_gate(docs), vl.budget_check(_costed(spark, sf_dir)))


@query(
    "embedding_cost_summary",
    f"""WITH {b.LEDGER_SQL}
SELECT month, model, CAST(sum(tokens) AS BIGINT) AS total_tokens, round(sum(cost_usd), 4) AS total_cost_usd,
  100.0::DOUBLE AS monthly_budget_usd, round(sum(cost_usd) / 100.0 * 100, 2) AS budget_used_percent
FROM ledger GROUP BY month, model""",
)
def embedding_cost_summary(spark, sf_dir):
    return bg.cost_summary(b.ledger(spark, sf_dir))


@query(
    "running_budget_gate",
    f"""WITH {b.LEDGER_SQL}, nanos AS (
  SELECT event_id, month, sum(CAST(round(cost_usd * 1e9) AS BIGINT)) OVER (
    PARTITION BY month ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM ledger)
SELECT event_id, month, round(n / 1e9, 9) AS running_cost_usd, n / 1e9 <= 2.0 AS accepted,
  CASE WHEN n / 1e9 > 2.0 THEN 'halted' WHEN n / 1e9 >= 1.5 THEN 'alert' ELSE 'ok' END AS state FROM nanos""",
)
def running_budget_gate(spark, sf_dir):
    gated = bg.budget_gate(b.ledger(spark, sf_dir), ["ts", "event_id"], cap=2.0)
    return gated.select("event_id", "month", F.round("running_cost_usd", 9).alias("running_cost_usd"), "accepted", "state")


@query(
    "batch_budget_gate",
    f"""WITH {b.LEDGER_SQL}, batches AS (SELECT day, round(sum(cost_usd), 9) AS batch_cost_usd FROM ledger GROUP BY day),
mean AS (SELECT day, batch_cost_usd, batch_cost_usd + 1.9 <= 2.03 AS accepted FROM batches)
SELECT event_id, m.day, round(batch_cost_usd, 6) AS batch_cost_usd, accepted FROM ledger l JOIN mean m ON l.day = m.day""",
)
def batch_budget_gate(spark, sf_dir):
    gated = bg.batch_gate(b.ledger(spark, sf_dir), cap=2.03, already_spent=1.9, by=["day"])
    return gated.select("event_id", "day", F.round("batch_cost_usd", 6).alias("batch_cost_usd"), "accepted")


@query(
    "embed_batches",
    f"""WITH {b.CHUNK_INDEX_SQL}
SELECT id, namespace, (row_number() OVER (PARTITION BY namespace ORDER BY id) - 1) // 100 AS batch FROM chunk_index""",
)
def embed_batches(spark, sf_dir):
    chunks = b.chunk_index(spark, sf_dir).select("namespace", "id")
    return rn.with_batch(chunks, ["id"], ["namespace"])


@query(
    "even_cost_allocation",
    f"""WITH {b.CHUNK_INDEX_SQL}, batched AS (
  SELECT id, namespace, token_count, (row_number() OVER (PARTITION BY namespace ORDER BY id) - 1) // 100 AS batch
  FROM chunk_index), summed AS (
  SELECT *, sum(token_count) OVER (PARTITION BY namespace, batch) AS t, count(*) OVER (PARTITION BY namespace, batch) AS n
  FROM batched)
SELECT id, batch, CAST(t // n AS BIGINT) AS allocated_tokens, round(t * (0.02::DOUBLE / 1000000.0) / n, 10) AS allocated_cost_usd
FROM summed""",
)
def even_cost_allocation(spark, sf_dir):
    chunks = b.chunk_index(spark, sf_dir).select("namespace", "id", F.col("token_count").alias("tokens"))
    spread = bg.even_allocation(chunks, ["id"], ["namespace"])
    return spread.select("id", "batch", "allocated_tokens", F.round("allocated_cost_usd", 10).alias("allocated_cost_usd"))


@query(
    "budget_alerts",
    f"""WITH {b.LEDGER_SQL}, daily AS (SELECT month, day, sum(cost_usd) AS c FROM ledger GROUP BY month, day),
so_far AS (SELECT month, day, c, sum(c) OVER (PARTITION BY month ORDER BY day) AS r FROM daily)
SELECT month, day, round(c, 6) AS day_cost_usd, round(r, 6) AS running_cost_usd,
  CASE WHEN round(r, 9) > 2.0 THEN 'halted' WHEN round(r, 9) >= 1.6 THEN 'alert' ELSE 'ok' END AS state FROM so_far""",
)
def budget_alerts(spark, sf_dir):
    alerts = bg.budget_alerts(b.ledger(spark, sf_dir), budget=2.0, alert=0.8)
    return alerts.select(
        "month",
        "day",
        F.round("day_cost_usd", 6).alias("day_cost_usd"),
        F.round("running_cost_usd", 6).alias("running_cost_usd"),
        "state",
    )


@query(
    "api_failure_rate",
    f"""WITH {b.CALLS_SQL}, hourly AS (
  SELECT date_trunc('hour', ts) AS w, count(*) AS calls, count(*) FILTER (WHERE failed) AS failures FROM calls GROUP BY 1)
SELECT {b.sql_stamp('w')} AS window_start, calls, failures, round(failures / calls, 6) AS failure_rate,
  CASE WHEN failures / calls > 0.1 THEN 'batch' ELSE 'streaming' END AS mode FROM hourly""",
)
def api_failure_rate(spark, sf_dir):
    rates = gv.failure_rate(b.calls(spark, sf_dir))
    return rates.select(
        b.stamp("window_start").alias("window_start"), "calls", "failures", F.round("failure_rate", 6).alias("failure_rate"), "mode"
    )


@query(
    "embed_endpoint_batch",
    f"""WITH t AS (SELECT doc_id, len({b.sql_tokens('text')}) AS token_count FROM documents),
costed AS (SELECT *, token_count * (0.02::DOUBLE / 1000000.0) AS cost FROM t),
summary AS (SELECT CAST(sum(token_count) AS BIGINT) AS total_tokens, round(sum(cost), 4) AS total_cost_usd,
  100.0::DOUBLE AS monthly_budget_usd, round(sum(cost) / 100.0 * 100, 2) AS budget_used_percent FROM costed)
SELECT doc_id, CAST(token_count AS BIGINT) AS token_count, round(cost, 9) AS cost_usd,
  CASE WHEN token_count > 0 THEN 256 END AS dimension, 'text-embedding-3-small' AS model, summary.* FROM costed, summary""",
)
def embed_endpoint_batch(spark, sf_dir):
    """Every text embedded, and with it what the whole call has cost."""
    from lorekeep.operators.embedding import embed_endpoint

    rows = embed_endpoint(b.table(spark, sf_dir, "documents", "doc_id"), "text")
    return rows.select(
        "doc_id",
        F.col("token_count").cast("bigint").alias("token_count"),
        F.round("cost_usd", 9).alias("cost_usd"),
        F.size("values").alias("dimension"),
        "model",
        F.col("total_tokens").cast("bigint").alias("total_tokens"),
        "total_cost_usd",
        "monthly_budget_usd",
        "budget_used_percent",
    )
