"""Queries from hits to contexts, summaries, answers and digests, for the whole table of text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep.operators import context as cx
from lorekeep.operators import search as sr
from lorekeep.plans import bindings as b
from lorekeep.plans.index_queries import TEXT_HITS_SQL
from lorekeep.plans.registry import query

_AS_OF = "2024-02-15 00:00:00"
CARRIED = ("content", "url", "ts")


def text_hits(spark, sf_dir, k=5, **options):
    """k hits per query and namespace with their content."""
    index = b.chunk_index(spark, sf_dir)
    vectors = sr.embed_hash(index)
    asked = sr.embed_hash(b.text_queries(spark, sf_dir), "text")
    return sr.top_k_all(asked, vectors, k, carry=CARRIED, **options)


_HITS_SQL = f"""{TEXT_HITS_SQL},
by_namespace AS (SELECT *, row_number() OVER (PARTITION BY query_id, namespace ORDER BY score DESC, id) AS r FROM scored),
hits AS (SELECT h.query_id, h.namespace, h.id, h.score, c.content, c.url, c.ts FROM by_namespace h JOIN chunk_index c ON h.id = c.id WHERE r <= 5),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM hits WHERE content <> '')"""

_CONTEXT_SQL = f"""{_HITS_SQL}, contexts AS (
  SELECT query_id, string_agg('Source: ' || rtrim(namespace, '/') || chr(10) || 'Content: ' || substr(content, 1, 500),
    chr(10) || chr(10) ORDER BY rank) AS context, count(*) AS hits_used
  FROM ranked WHERE rank <= 5 GROUP BY query_id)"""


@query("nonempty_context", f"WITH {_HITS_SQL} SELECT query_id, id, md5(content) AS content_md5 FROM hits WHERE content <> ''")
def nonempty_context(spark, sf_dir):
    hits = cx.nonempty_context(text_hits(spark, sf_dir))
    return hits.select("query_id", "id", F.md5("content").alias("content_md5"))


@query("answer_context", f"WITH {_CONTEXT_SQL} SELECT * FROM contexts")
def answer_context(spark, sf_dir):
    return cx.answer_context(text_hits(spark, sf_dir))


@query(
    "search_response",
    f"""WITH {_HITS_SQL}, asked AS (SELECT query_id, CAST(len({b.sql_tokens('text')}) AS BIGINT) AS token_count FROM text_queries),
lists AS (SELECT query_id, rtrim(namespace, '/') AS source,
  string_agg(CAST(r AS VARCHAR) || ':' || id, ',' ORDER BY r) AS hits FROM by_namespace WHERE r <= 5 GROUP BY ALL)
SELECT a.query_id, token_count, source, hits FROM asked a JOIN lists l ON a.query_id = l.query_id""",
)
def search_response(spark, sf_dir):
    response = cx.search_response(b.text_queries(spark, sf_dir), text_hits(spark, sf_dir))
    listed = F.transform("hits", lambda hit: F.concat(hit["rank"].cast("string"), F.lit(":"), hit["id"]))
    return response.select(
        "query_id", F.col("token_count").cast("bigint").alias("token_count"), F.explode("results").alias("source", "hits")
    ).withColumn("hits", F.array_join(listed, ","))


_SUMMARY_SQL = rf"""{_CONTEXT_SQL}, asked AS (
  SELECT query_id, text, list_distinct({b.sql_tokens('lower(text)')}) AS asked FROM text_queries),
sentences AS (
  SELECT a.query_id, a.text, a.asked, unnest(regexp_split_to_array(coalesce(context, ''), '[.!?\n]+\s*')) AS s,
    generate_subscripts(regexp_split_to_array(coalesce(context, ''), '[.!?\n]+\s*'), 1) AS place
  FROM asked a LEFT JOIN contexts c ON a.query_id = c.query_id),
overlap AS (
  SELECT query_id, s, place, len(list_intersect(list_distinct({b.sql_tokens('lower(s)')}), asked)) AS n FROM sentences),
chosen AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, place) AS r FROM overlap WHERE n > 0),
built AS (SELECT query_id, string_agg(trim(s), '. ' ORDER BY place) || '.' AS summary FROM chosen WHERE r <= 3 GROUP BY query_id),
summaries AS (SELECT a.query_id, a.text, coalesce(summary, '{cx.NO_INFORMATION}') AS summary
  FROM asked a LEFT JOIN built b ON a.query_id = b.query_id)"""


@query("extractive_summary", f"WITH {_SUMMARY_SQL} SELECT query_id, summary FROM summaries")
def extractive_summary(spark, sf_dir):
    contexts = cx.answer_context(text_hits(spark, sf_dir))
    return cx.extractive_summary(b.text_queries(spark, sf_dir), contexts).select("query_id", "summary")


@query(
    "answer_render",
    f"""WITH {_SUMMARY_SQL}, cited AS (
  SELECT query_id, string_agg(CAST(rank AS VARCHAR) || '. ' || upper(namespace[1]) || substr(rtrim(namespace, '/'), 2) ||
    ' - <' || url || '|Link> (' || strftime(ts, '%Y-%m-%d') || ')', chr(10) ORDER BY rank) AS lines
  FROM ranked WHERE rank <= 3 GROUP BY query_id)
SELECT s.query_id, '📚 *Knowledge Base Results for:* _' || text || '_' || chr(10) || chr(10) || summary || chr(10) || chr(10) || '*Sources:*'
  || coalesce(chr(10) || lines, '') AS answer FROM summaries s LEFT JOIN cited c ON s.query_id = c.query_id""",
)
def answer_render(spark, sf_dir):
    hits = text_hits(spark, sf_dir)
    summaries = cx.extractive_summary(b.text_queries(spark, sf_dir), cx.answer_context(hits))
    dated = hits.withColumn("timestamp", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    return cx.answer_render(summaries, cx.citations(dated))


@query(
    "model_summary",
    rf"""WITH {_CONTEXT_SQL}, words AS (SELECT query_id, unnest({b.sql_tokens('context')}) AS word FROM contexts),
ordered AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY length(word) DESC, word DESC) AS r FROM words),
longest AS (SELECT query_id, word FROM ordered WHERE r = 1)
SELECT q.query_id, CASE WHEN context IS NULL THEN '{cx.NO_INFORMATION}'
  WHEN NOT regexp_matches(context, '[0-9]') THEN '{cx.FAILED_SUMMARY}' ELSE word END AS summary
FROM text_queries q LEFT JOIN contexts c ON q.query_id = c.query_id LEFT JOIN longest l ON q.query_id = l.query_id""",
)
def model_summary(spark, sf_dir):
    """A stand-in model that names the longest word of the context and fails on contexts without a digit."""

    def load():
        def model(text, context):
            if not any(c.isdigit() for c in context):
                raise RuntimeError("refused")
            return max(context.split(), key=lambda w: (len(w), w))

        return model

    contexts = cx.answer_context(text_hits(spark, sf_dir))
    asked = b.text_queries(spark, sf_dir).join(contexts, "query_id", "left").select("query_id", "text", "context")
    return cx.model_summary(asked, load).select("query_id", "summary")


# ---------------------------------------------------------------- digest


def _digest_hits(spark, sf_dir):
    """All chunks scored against one profile query, the mean of the hashed terms of all text queries."""
    asked = sr.embed_hash(b.text_queries(spark, sf_dir), "text")
    parts = asked.select(F.posexplode("values").alias("dim", "x")).groupBy("dim").agg(F.round(F.avg("x"), 6).alias("x"))
    profile = parts.agg(F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("v")).select(
        F.lit("digest").alias("query_id"), F.transform("v", lambda p: p["x"]).alias("values")
    )
    return profile, sr.embed_hash(b.chunk_index(spark, sf_dir))


def digest_items(spark, sf_dir, days):
    profile, vectors = _digest_hits(spark, sf_dir)
    as_of = b.at(_AS_OF)
    inside = (F.col("ts") > as_of - F.make_dt_interval(F.lit(days))) & (F.col("ts") <= as_of)
    hits = sr.top_k_all(profile, vectors, cx.DIGEST_PER_NAMESPACE, where=inside, carry=CARRIED)
    return cx.digest(hits, as_of, days)


def _digest_sql(days):
    return f"""{b.CHUNK_INDEX_SQL}, {b.TEXT_QUERIES_SQL},
{b.sql_hash_terms('chunk_index', 'id', 'content', 'vec')},
{b.sql_hash_terms('text_queries', 'query_id', 'text', 'ask')},
asking AS (SELECT count(DISTINCT query_id) AS n FROM ask),
profile AS (SELECT bucket, round(sum(value) / (SELECT n FROM asking), 6) AS value FROM ask GROUP BY bucket),
unit AS (SELECT bucket, value / sqrt(sum(value * value) OVER ()) AS value FROM profile),
scored AS (SELECT id, round(sum(u.value * v.value), 6) AS score FROM vec v JOIN unit u ON u.bucket = v.bucket GROUP BY id),
inside AS (SELECT c.namespace, c.id, c.ts, c.content, s.score,
    row_number() OVER (PARTITION BY c.namespace ORDER BY s.score DESC, c.id) AS r
  FROM scored s JOIN chunk_index c ON c.id = s.id
  WHERE ts > TIMESTAMP '{_AS_OF}' - INTERVAL {days} DAY AND ts <= TIMESTAMP '{_AS_OF}'),
items AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS position FROM inside WHERE r <= 5),
digest AS (SELECT * FROM items WHERE position <= 10)"""


_DIGEST_ROWS = f"SELECT position, namespace, id, score, {b.sql_stamp('ts')} AS ts FROM digest"


def _digest_rows(items):
    return items.select(
        F.col("position").cast("bigint").alias("position"), "namespace", "id", "score", b.stamp("ts").alias("ts")
    )


@query("digest_top_items", f"WITH {_digest_sql(7)} {_DIGEST_ROWS}")
def digest_top_items(spark, sf_dir):
    return _digest_rows(digest_items(spark, sf_dir, 7))


@query("digest_timeframe", f"WITH {_digest_sql(1)} {_DIGEST_ROWS}")
def digest_timeframe(spark, sf_dir):
    return _digest_rows(digest_items(spark, sf_dir, 1))


@query(
    "digest_context",
    f"""WITH {_digest_sql(7)} SELECT string_agg('Source: ' || rtrim(namespace, '/') || chr(10) || 'Date: ' ||
  strftime(ts, '%Y-%m-%dT%H:%M:%S') || chr(10) || 'Content: ' || substr(content, 1, 300), chr(10) || chr(10) ORDER BY position)
  AS context, count(*) AS items FROM digest""",
)
def digest_context(spark, sf_dir):
    return cx.digest_context(digest_items(spark, sf_dir, 7))


@query(
    "digest_render",
    f"""WITH {_digest_sql(7)}, body AS (SELECT string_agg('- ' || id, chr(10) ORDER BY position) AS digest FROM digest),
total AS (SELECT count(*) AS n FROM chunk_index)
SELECT '📊 *Weekly Knowledge Digest* | Feb 08 - Feb 15, 2024' || chr(10) || chr(10) || digest || chr(10) || chr(10) ||
  '_Knowledge Base Stats:_' || chr(10) || '• Total Documents: ' || format('{{:,}}', n) || chr(10) ||
  '• Sources: Slack, Notion, Google Drive' || chr(10) || chr(10) ||
  '💡 Use `/summarize [your question]` to search the knowledge base anytime!' || chr(10) AS message FROM body, total""",
)
def digest_render(spark, sf_dir):
    items = digest_items(spark, sf_dir, 7)
    lines = F.array_sort(F.collect_list(F.struct("position", F.concat(F.lit("- "), "id").alias("line"))))
    body = items.agg(F.array_join(F.transform(lines, lambda i: i["line"]), "\n").alias("digest"))
    total = b.chunk_index(spark, sf_dir).agg(F.count(F.lit(1)).alias("total_vector_count"))
    return cx.render_digest(body, total, b.at(_AS_OF))
