"""Queries over text: tokens, chunks, redaction, small columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep.functions import identity as idn
from lorekeep.functions.rules import EXTENDED, REDACTOR, pick_rules
from lorekeep.functions.tokens import token_count as count_tokens
from lorekeep.operators import chunking as ck
from lorekeep.operators import context as cx
from lorekeep.operators import redaction as rd
from lorekeep.operators.budget import with_cost
from lorekeep.operators.volume import extract_text
from lorekeep.plans import bindings as b
from lorekeep.plans.registry import query


@query(
    "token_count",
    f"""SELECT doc_id, CAST(len({b.sql_tokens('text')}) AS BIGINT) AS ws_tokens,
  CAST(ceil(length(text) / 4.0) AS BIGINT) AS chars4_tokens FROM documents""",
)
def token_count(spark, sf_dir):
    return b.table(spark, sf_dir, "documents", "doc_id").select(
        "doc_id",
        count_tokens(F.col("text")).cast("bigint").alias("ws_tokens"),
        count_tokens(F.col("text"), "chars4").cast("bigint").alias("chars4_tokens"),
    )


_CHUNK_COLUMNS = """chunk_index, total_chunks, CAST(start_token AS BIGINT) AS start_token,
  CAST(end_token AS BIGINT) AS end_token, CAST(token_count AS BIGINT) AS token_count, md5(content) AS content_md5"""


def _chunk_columns(chunks, *first):
    return chunks.select(
        *first,
        *[F.col(n).cast("bigint").alias(n) for n in ("chunk_index", "total_chunks", "start_token", "end_token", "token_count")],
        F.md5("content").alias("content_md5"),
    )


@query(
    "chunk_text",
    f"WITH {b.sql_chunks('documents', 'text', 'doc_id')} SELECT doc_id, {_CHUNK_COLUMNS} FROM chunks",
)
def chunk_text(spark, sf_dir):
    docs = b.table(spark, sf_dir, "documents", "doc_id").select("doc_id", "text")
    return _chunk_columns(ck.chunk(docs), "doc_id")


@query(
    "chunk_document",
    f"""WITH {b.CORPUS}, given AS (
  SELECT *, CASE WHEN lang = 'fr' THEN 'editor' ELSE author END AS real_author FROM corpus),
{b.sql_chunks('given', 'text', 'source, source_id, real_author, url, ts, lang')}
SELECT source, source_id, real_author AS author, url, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp, lang, {_CHUNK_COLUMNS} FROM chunks""",
)
def chunk_document(spark, sf_dir):
    docs = b.corpus(spark, sf_dir).select(
        F.col("text").alias("content"),
        "source",
        "source_id",
        "author",
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        "url",
        F.create_map(
            F.lit("lang"), "lang", F.lit("author"), F.when(F.col("lang") == "fr", "editor")
        ).alias("extra"),
    )
    chunks = ck.chunk_documents(docs)
    return _chunk_columns(
        chunks, "source", "source_id", "author", "url", "timestamp", F.element_at("extra", "lang").alias("lang")
    )


@query(
    "chunk_stats",
    f"""WITH {b.sql_chunks('documents', 'text', 'doc_id')}
SELECT doc_id, CAST(max(end_token) AS BIGINT) AS total_tokens, count(*) AS num_chunks,
  round(max(end_token) / count(*), 4) AS avg_chunk_size FROM chunks GROUP BY doc_id""",
)
def chunk_stats(spark, sf_dir):
    docs = b.table(spark, sf_dir, "documents", "doc_id").select("doc_id", "text")
    stats = ck.chunk_stats(ck.chunk(docs), "doc_id")
    return stats.select(
        "doc_id",
        F.col("total_tokens").cast("bigint").alias("total_tokens"),
        "num_chunks",
        F.round("avg_chunk_size", 4).alias("avg_chunk_size"),
    )


@query(
    "blank_filter",
    r"""WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, count(*) AS lines, CAST(sum(length(line)) AS BIGINT) AS chars FROM lines
WHERE NOT regexp_full_match(line, '\s*') GROUP BY doc_id""",
)
def blank_filter(spark, sf_dir):
    docs = b.table(spark, sf_dir, "documents", "doc_id")
    lines = docs.select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line"))
    kept = ck.drop_blank(lines, "line")
    return kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("line")).alias("chars"))


def _redaction_query(name, rules, types=None):
    chosen = pick_rules(rules, types)
    sql = f"""WITH {b.PLANTED}
SELECT doc_id, md5({b.sql_redact('text', chosen)}) AS redacted_md5 FROM planted"""

    @query(name, sql)
    def run(spark, sf_dir):
        redacted = rd.redact(b.planted(spark, sf_dir), rules=rules, types=types)
        return redacted.select("doc_id", F.md5("redacted").alias("redacted_md5"))


# One rule each, over texts that hold a hit and near misses of every rule.
for _name, _type in {
    "redact_email": "email",
    "redact_phone": "phone",
    "redact_api_key": "api_key",
    "redact_aws_key": "aws_key",
    "redact_credit_card": "credit_card",
    "redact_ssn": "ssn",
    "redact_ip": "ip_address",
    "redact_bearer": "bearer_token",
}.items():
    _redaction_query(_name, "redactor", [_type])
_redaction_query("redact_all", "redactor")
_redaction_query("redact_extended", "extended")
_redaction_query("anonymize_text", "scanner")


@query(
    "redact_pages",
    f"""SELECT page_id, md5({b.sql_redact('html', REDACTOR)}) AS redacted_md5,
  md5({b.sql_redact('html', EXTENDED)}) AS extended_md5 FROM pages""",
)
def redact_pages(spark, sf_dir):
    pages = b.table(spark, sf_dir, "pages", "page_id")
    both = rd.redact(rd.redact(pages, "html"), "html", "extended", rules="extended")
    return both.select("page_id", F.md5("redacted").alias("redacted_md5"), F.md5("extended").alias("extended_md5"))


_RECORD_ROWS = " UNION ALL ".join(
    b.sql_located("planted", "doc_id", b.sql_redact("text", REDACTOR[:i]), rule) for i, rule in enumerate(REDACTOR)
)


@query(
    "redaction_records",
    f"""WITH {b.PLANTED}, records AS ({_RECORD_ROWS})
SELECT doc_id, type, position, CAST(length(value) AS BIGINT) AS length, marker AS replacement FROM records""",
)
def redaction_records(spark, sf_dir):
    records = rd.redaction_records(b.planted(spark, sf_dir), "doc_id")
    return records.select(
        "doc_id",
        "type",
        F.col("position").cast("bigint").alias("position"),
        F.col("length").cast("bigint").alias("length"),
        "replacement",
    )


_STAGE_COUNTS = " + ".join(b.sql_count(b.sql_redact("text", REDACTOR[:i]), rule) for i, rule in enumerate(REDACTOR))


@query(
    "redaction_count",
    f"WITH {b.PLANTED} SELECT doc_id, {_STAGE_COUNTS} AS redaction_count FROM planted",
)
def redaction_count(spark, sf_dir):
    counted = rd.redact(b.planted(spark, sf_dir), count_as="redaction_count")
    return counted.select("doc_id", F.col("redaction_count").cast("bigint").alias("redaction_count"))


_COUNT_ROWS = " UNION ALL ".join(
    f"SELECT doc_id, '{rule.name}' AS type, {b.sql_count('text', rule)} AS hits FROM planted" for rule in REDACTOR
)


@query("pii_counts_map", f"WITH {b.PLANTED}, counts AS ({_COUNT_ROWS}) SELECT * FROM counts WHERE hits > 0")
def pii_counts_map(spark, sf_dir):
    counted = b.planted(spark, sf_dir).select("doc_id", F.explode(rd.pii_counts(F.col("text"))).alias("type", "hits"))
    return counted.select("doc_id", "type", F.col("hits").cast("bigint").alias("hits"))


@query("anonymize_author", f"WITH {b.CORPUS} SELECT doc_id, sha256('pepper' || author) AS person FROM corpus")
def anonymize_author(spark, sf_dir):
    return b.corpus(spark, sf_dir).select("doc_id", idn.pseudonymise(F.col("author"), "pepper").alias("person"))


@query("content_preview", "SELECT doc_id, substr(text, 1, 1000) AS preview FROM documents")
def content_preview(spark, sf_dir):
    return b.table(spark, sf_dir, "documents").select("doc_id", idn.preview(F.col("text")).alias("preview"))


@query("vector_id", f"WITH {b.CHUNK_INDEX_SQL} SELECT id, doc_id FROM chunk_index")
def vector_id(spark, sf_dir):
    return b.chunk_index(spark, sf_dir).select("id", "doc_id")


@query(
    "namespace_route",
    f"""WITH {b.CORPUS}, routed AS (SELECT CASE WHEN lang = 'de' THEN author ELSE source END AS source FROM corpus)
SELECT source, CASE WHEN source IN ('slack', 'notion', 'drive') THEN source || '/' ELSE 'default' END AS namespace,
  count(*) AS docs FROM routed GROUP BY ALL""",
)
def namespace_route(spark, sf_dir):
    source = F.when(F.col("lang") == "de", F.col("author")).otherwise(F.col("source"))
    routed = b.corpus(spark, sf_dir).select(source.alias("source"))
    return routed.groupBy("source", idn.namespace_of(F.col("source")).alias("namespace")).agg(
        F.count(F.lit(1)).alias("docs")
    )


@query(
    "extract_text_fields",
    f"""WITH {b.RAW_DRIVE_SQL}
SELECT file_id, md5(concat_ws(' ', CASE WHEN mime_type = 'text/plain' THEN content END, 'summary',
  'title', substr(content, 1, 500), name)) AS text_md5 FROM raw_drive""",
)
def extract_text_fields(spark, sf_dir):
    files = b.raw_drive(spark, sf_dir).select(
        "file_id",
        "name",
        F.when(F.col("mime_type") == "text/plain", F.col("content")).alias("body"),
        F.lit("summary").alias("summary"),
        F.lit("title").alias("title"),
        F.substring("content", 1, 500).alias("content_preview"),
    )
    return files.select("file_id", F.md5(extract_text(files)).alias("text_md5"))


@query(
    "cost_estimate",
    f"""WITH priced AS (
  SELECT doc_id, len({b.sql_tokens('text')}) AS tokens, CASE lang WHEN 'en' THEN 'text-embedding-3-small'
    WHEN 'fr' THEN 'text-embedding-3-large' WHEN 'de' THEN 'text-embedding-ada-002' ELSE 'other-model' END AS model
  FROM documents)
SELECT doc_id, model, CAST(tokens AS BIGINT) AS tokens, round(tokens * ({b.sql_price('model')} / 1000000.0::DOUBLE), 9) AS cost_usd
FROM priced""",
)
def cost_estimate(spark, sf_dir):
    lang = F.col("lang")
    model = (
        F.when(lang == "en", "text-embedding-3-small")
        .when(lang == "fr", "text-embedding-3-large")
        .when(lang == "de", "text-embedding-ada-002")
        .otherwise("other-model")
    )
    docs = b.table(spark, sf_dir, "documents", "doc_id").select(
        "doc_id", model.alias("model"), count_tokens(F.col("text")).cast("bigint").alias("tokens")
    )
    costed = with_cost(docs, F.col("model"))
    return costed.select("doc_id", "model", "tokens", F.round("cost_usd", 9).alias("cost_usd"))


@query(
    "citation_line",
    f"""WITH {b.CORPUS}
SELECT doc_id, CAST(doc_id AS VARCHAR) || '. ' || upper(substr(source, 1, 1)) || substr(source, 2)
  || CASE WHEN lang = 'es' THEN '' ELSE ' - <' || url || '|Link>' END
  || CASE WHEN lang = 'fr' THEN '' ELSE ' (' || strftime(ts, '%Y-%m-%d') || ')' END AS line FROM corpus""",
)
def citation_line(spark, sf_dir):
    docs = b.corpus(spark, sf_dir)
    url = F.when(F.col("lang") != "es", F.col("url"))
    when = F.when(F.col("lang") != "fr", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    return docs.select("doc_id", cx.citation(F.col("doc_id"), F.col("source"), url, when).alias("line"))


