"""Queries over messages joined, vectors searched, and the vector table maintained."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep.functions.identity import content_hash, namespace_of, vector_id
from lorekeep.functions.rules import REDACTOR
from lorekeep.operators import embedding as em
from lorekeep.operators import index as ix
from lorekeep.operators import ivf
from lorekeep.operators import messages as ms
from lorekeep.operators import postings as ps
from lorekeep.operators import redaction as rd
from lorekeep.operators import search as sr
from lorekeep.plans import bindings as b
from lorekeep.plans.registry import query
from lorekeep.session import scratch_path

_INDEXED_AT = "2024-02-01 00:00:00"


@query(
    "public_only",
    f"""WITH {b.CHANNELS_SQL} SELECT m.channel_id, message_id FROM messages m JOIN channels c ON m.channel_id = c.channel_id
WHERE c.type = 'public_channel'""",
)
def public_only(spark, sf_dir):
    typed = b.messages(spark, sf_dir).join(b.channels(spark, sf_dir).select("channel_id", "type"), "channel_id")
    return ms.public_only(typed).select("channel_id", "message_id")


@query(
    "thread_replies",
    f"""WITH {b.MESSAGES_SQL}
SELECT channel_id, {b.sql_stamp('thread_ts')} AS thread, message_id,
  count(*) OVER (PARTITION BY channel_id, thread_ts) AS thread_size,
  row_number() OVER (PARTITION BY channel_id, thread_ts ORDER BY ts, message_id) - 1 AS reply_index,
  md5(text) AS text_md5 FROM messages""",
)
def thread_replies(spark, sf_dir):
    return ms.threads(b.messages(spark, sf_dir)).select(
        "channel_id",
        b.stamp("thread_ts").alias("thread"),
        "message_id",
        "thread_size",
        "reply_index",
        F.md5("text").alias("text_md5"),
    )


@query(
    "user_enrich",
    f"""WITH {b.MESSAGES_SQL}, {b.USERS_SQL}
SELECT message_id, m.user_id, user_name FROM messages m LEFT JOIN users u ON m.user_id = u.user_id""",
)
def user_enrich(spark, sf_dir):
    joined = ms.with_users(b.messages(spark, sf_dir), b.users(spark, sf_dir))
    return joined.select("message_id", "user_id", "user_name")


def embedded(spark, sf_dir, chunks=None):
    return em.embed_hash(b.chunk_index(spark, sf_dir) if chunks is None else chunks)


@query(
    "embed_hash",
    f"""WITH {b.CHUNK_INDEX_SQL}, {b.sql_hash_terms('chunk_index', 'id', 'content', 'vec')}
SELECT id, bucket, round(value, 6) AS value FROM vec""",
)
def embed_hash(spark, sf_dir):
    parts = embedded(spark, sf_dir).select("id", F.posexplode("values").alias("bucket", "value"))
    return parts.where(F.col("value") != 0).select(
        "id", F.col("bucket").cast("bigint").alias("bucket"), F.round("value", 6).alias("value")
    )


@query(
    "embed_model",
    r"""SELECT doc_id, CASE WHEN NOT regexp_matches(text, '\b4[0-9]{15}\b') THEN
  CAST(length(text) AS VARCHAR) || '.0,' || CAST(length(text) - length(replace(text, ' ', '')) AS VARCHAR) || '.0,' ||
  CAST(length(text) - length(replace(text, chr(10), '')) AS VARCHAR) || '.0' END AS features FROM documents""",
)
def embed_model(spark, sf_dir):
    """A stand-in model of three text features; it fails on calls that hold a text with a card number."""

    def load():
        import re

        def model(texts):
            if any(re.search(r"\b4[0-9]{15}\b", text) for text in texts):
                raise RuntimeError("refused")
            return [[len(t), t.count(" "), t.count("\n")] for t in texts]

        return model

    docs = b.table(spark, sf_dir, "documents", "doc_id").select("doc_id", "text")
    made = em.embed_model(docs, load, "text", batch=1)
    return made.select("doc_id", F.array_join("values", ",").alias("features"))


@query(
    "chunk_embedding_zip",
    f"""WITH {b.CHUNK_INDEX_SQL}, {b.sql_hash_terms('chunk_index', 'id', 'content', 'vec')},
norms AS (SELECT id, count(*) AS used FROM vec GROUP BY id)
SELECT c.id, c.chunk_index, md5(c.content) AS content_md5, used FROM chunk_index c JOIN norms v ON c.id = v.id""",
)
def chunk_embedding_zip(spark, sf_dir):
    chunks = b.chunk_index(spark, sf_dir)
    vectors = embedded(spark, sf_dir).select("doc_id", "chunk_index", "namespace", "values")
    paired = chunks.join(vectors.where(F.col("values").isNotNull()), ["namespace", "doc_id", "chunk_index"])
    used = F.size(F.filter("values", lambda x: x != 0)).cast("bigint")
    return paired.select(
        "id", F.col("chunk_index").cast("bigint").alias("chunk_index"), F.md5("content").alias("content_md5"), used.alias("used")
    )


# ---------------------------------------------------------------- vector search

_SCORES = {
    "cosine": ("round(list_cosine_similarity(v.values, q.values), 6)", "DESC"),
    "dotproduct": ("round(list_dot_product(v.values, q.values), 6)", "DESC"),
    "euclidean": ("round(list_distance(v.values, q.values), 6)", "ASC"),
}


def _top_k_sql(metric="cosine", where="TRUE", per_namespace=False, k=5):
    score, order = _SCORES[metric]
    groups = "query_id, namespace" if per_namespace else "query_id"
    return f"""WITH {b.VECTORS_SQL}, {b.LABEL_QUERIES_SQL}, scored AS (
  SELECT q.query_id, v.namespace, v.id, {score} AS score FROM queries q, vectors v WHERE {where}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY {groups} ORDER BY score {order}, id) AS rank FROM scored)
SELECT query_id, namespace, id, score, rank FROM ranked WHERE rank <= {k}"""


def _hits(df):
    return df.select("query_id", "namespace", "id", "score", F.col("rank").cast("bigint").alias("rank"))


@query("vector_top_k_cosine", _top_k_sql(where="namespace = 'slack/'"))
def vector_top_k_cosine(spark, sf_dir):
    return _hits(sr.top_k(b.label_queries(spark, sf_dir), b.vectors(spark, sf_dir), namespace="slack"))


@query("vector_top_k_euclidean", _top_k_sql("euclidean"))
def vector_top_k_euclidean(spark, sf_dir):
    return _hits(sr.top_k(b.label_queries(spark, sf_dir), b.vectors(spark, sf_dir), metric="euclidean"))


@query("vector_top_k_dot", _top_k_sql("dotproduct"))
def vector_top_k_dot(spark, sf_dir):
    return _hits(sr.top_k(b.label_queries(spark, sf_dir), b.vectors(spark, sf_dir), metric="dotproduct"))


@query("vector_top_k_all", _top_k_sql(per_namespace=True))
def vector_top_k_all(spark, sf_dir):
    return _hits(sr.top_k_all(b.label_queries(spark, sf_dir), b.vectors(spark, sf_dir)))


@query("metadata_filter", _top_k_sql(where="label IN (1, 4, 7, 8)"))
def metadata_filter(spark, sf_dir):
    wanted = sr.metadata_where({"label": {"$in": [1, 4, 7, 8]}})
    return _hits(sr.top_k(b.label_queries(spark, sf_dir), b.vectors(spark, sf_dir), where=wanted))


@query(
    "query_vector_cross",
    f"""WITH {b.VECTORS_SQL}, scored AS (
  SELECT q.id AS query_id, v.namespace, v.id, round(list_cosine_similarity(v.values, q.values), 6) AS score
  FROM vectors q, vectors v),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored)
SELECT query_id, namespace, id, score, rank FROM ranked WHERE rank <= 3""",
)
def query_vector_cross(spark, sf_dir):
    """Every vector asks the whole table. The bound is set low, so the blocked form for many queries runs."""
    vectors = b.vectors(spark, sf_dir)
    asked = vectors.select(F.col("id").alias("query_id"), "values")
    return _hits(sr.top_k(asked, vectors, k=3, resident=128))


@query("vector_ann")
def vector_ann(spark, sf_dir):
    """Over an inverted file, as many cells as it found to hold 0.95 of the neighbours."""
    path = ivf.build(b.vectors(spark, sf_dir), scratch_path(spark, "ivf"))
    return _hits(ivf.top_k(spark, path, b.label_queries(spark, sf_dir)))


@query("vector_ann_all_cells", _top_k_sql())
def vector_ann_all_cells(spark, sf_dir):
    """The same index with every cell probed, which has to give the exact answer."""
    vectors = b.vectors(spark, sf_dir)
    path = ivf.build(vectors, scratch_path(spark, "ivf"))
    return _hits(ivf.top_k(spark, path, b.label_queries(spark, sf_dir), probes=1 << 30))


@query(
    "global_rerank",
    f"""WITH per_namespace AS ({_top_k_sql(per_namespace=True, k=10)}),
ranked AS (SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM per_namespace)
SELECT query_id, namespace, id, score, rank FROM ranked WHERE rank <= 5""",
)
def global_rerank(spark, sf_dir):
    hits = sr.top_k_all(b.label_queries(spark, sf_dir), b.vectors(spark, sf_dir), k=10)
    return _hits(sr.rerank(hits, 5))


def _text_hits_sql(dims: int = 256) -> str:
    return f"""{b.CHUNK_INDEX_SQL}, {b.TEXT_QUERIES_SQL},
{b.sql_hash_terms('chunk_index', 'id', 'content', 'vec', dims)},
{b.sql_hash_terms('text_queries', 'query_id', 'text', 'ask', dims)},
pairs AS (SELECT query_id, id, sum(a.value * v.value) AS dot FROM ask a JOIN vec v ON a.bucket = v.bucket GROUP BY ALL),
owners AS (SELECT DISTINCT id FROM vec), askers AS (SELECT DISTINCT query_id FROM ask),
scored AS (SELECT k.query_id, c.namespace, c.id, round(coalesce(dot, 0), 6) AS score
  FROM askers k CROSS JOIN owners o JOIN chunk_index c ON c.id = o.id
  LEFT JOIN pairs p ON p.query_id = k.query_id AND p.id = o.id)"""


TEXT_HITS_SQL = _text_hits_sql()


@query(
    "sparse_text_match",
    f"""WITH {TEXT_HITS_SQL},
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored)
SELECT query_id, namespace, id, score, rank FROM ranked WHERE rank <= 5""",
)
def sparse_text_match(spark, sf_dir):
    return _hits(sr.search_text(b.text_queries(spark, sf_dir), b.chunk_index(spark, sf_dir)))


@query(
    "sparse_postings_match",
    f"""WITH {_text_hits_sql(ps.DIMS)},
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored WHERE score > 0)
SELECT query_id, namespace, id, score, rank FROM ranked WHERE rank <= 5""",
)
def sparse_postings_match(spark, sf_dir):
    """The whole chunk index as postings, and every benchmark item asked over them."""
    path = ps.build(b.chunk_index(spark, sf_dir), scratch_path(spark, "postings"))
    return _hits(ps.search(spark, path, b.text_queries(spark, sf_dir)))


# ---------------------------------------------------------------- the vector table


@query(
    "delete_by_id",
    f"""WITH {b.CHUNK_INDEX_SQL}, {b.TOXIC_SQL}
SELECT id, namespace FROM chunk_index WHERE NOT (chunk_index = 0 AND CAST(doc_id AS BIGINT) IN (SELECT doc_id FROM toxic_docs))""",
)
def delete_by_id(spark, sf_dir):
    index = b.chunk_index(spark, sf_dir)
    doomed = b.corpus(spark, sf_dir).join(b.toxic_docs(spark, sf_dir), "doc_id", "left_semi")
    ids = doomed.select(
        namespace_of(F.col("source")).alias("namespace"),
        vector_id(F.col("source"), F.col("source_id"), F.lit(0)).alias("id"),
    )
    return ix.delete(index, ids).select("id", "namespace")


@query(
    "replace_document",
    f"""WITH {b.CHUNK_INDEX_SQL}, {b.TOXIC_SQL}
SELECT id, CASE WHEN CAST(doc_id AS BIGINT) IN (SELECT doc_id FROM toxic_docs) THEN 'new' ELSE 'old' END AS version
FROM chunk_index WHERE chunk_index = 0 OR CAST(doc_id AS BIGINT) NOT IN (SELECT doc_id FROM toxic_docs)""",
)
def replace_document(spark, sf_dir):
    """Toxic documents come back cut to their first chunk; their old tail chunks must go."""
    index = b.chunk_index(spark, sf_dir).withColumn("version", F.lit("old"))
    toxic = b.toxic_docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("doc_id"))
    again = index.where(F.col("chunk_index") == 0).join(toxic, "doc_id", "left_semi")
    return ix.replace_docs(index, again.withColumn("version", F.lit("new"))).select("id", "version")


@query(
    "source_delete_sync",
    f"""WITH {b.CHUNK_INDEX_SQL}, {b.TOXIC_SQL}
SELECT id FROM chunk_index WHERE CAST(doc_id AS BIGINT) NOT IN (SELECT doc_id FROM toxic_docs)""",
)
def source_delete_sync(spark, sf_dir):
    gone = b.toxic_docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("doc_id"))
    return ix.sync_deletes(b.chunk_index(spark, sf_dir), gone).select("id")


@query(
    "index_stats",
    f"""WITH {b.VECTORS_SQL} SELECT coalesce(namespace, 'total') AS namespace, count(*) AS vector_count,
  CAST(max(len(values)) AS BIGINT) AS dimension, CAST(min(len(values)) AS BIGINT) AS least_dimension FROM vectors GROUP BY ROLLUP (namespace)""",
)
def index_stats(spark, sf_dir):
    stats = ix.index_stats(b.vectors(spark, sf_dir))
    return stats.select(
        F.coalesce("namespace", F.lit("total")).alias("namespace"),
        "vector_count",
        F.col("dimension").cast("bigint").alias("dimension"),
        F.col("least_dimension").cast("bigint").alias("least_dimension"),
    )


@query(
    "upsert_latest",
    f"""WITH writes AS (SELECT event_type AS namespace, CAST(user_id AS VARCHAR) AS id, value, ts, event_id FROM events),
first_half AS (SELECT *, row_number() OVER (PARTITION BY namespace, id ORDER BY ts, event_id) AS r FROM writes
  WHERE ts < TIMESTAMP '2024-01-16 00:00:00'),
second_half AS (SELECT *, row_number() OVER (PARTITION BY namespace, id ORDER BY ts DESC, event_id DESC) AS r FROM writes
  WHERE ts >= TIMESTAMP '2024-01-16 00:00:00'),
old AS (SELECT namespace, id, value, event_id FROM first_half WHERE r = 1),
fresh AS (SELECT namespace, id, value, event_id FROM second_half WHERE r = 1)
SELECT namespace, id, value, event_id, '{_INDEXED_AT}' AS indexed_at FROM fresh
UNION ALL SELECT namespace, id, value, event_id, '{b.START}' FROM old o
WHERE NOT EXISTS (SELECT 1 FROM fresh f WHERE f.namespace = o.namespace AND f.id = o.id)""",
)
def upsert_latest(spark, sf_dir):
    """Events as writes: the first of each key in the first half is the table, the second half is upserted."""
    writes = b.events(spark, sf_dir).select(
        F.col("event_type").alias("namespace"), F.col("user_id").cast("string").alias("id"), "value", "ts", "event_id"
    )
    split = b.at("2024-01-16 00:00:00")
    early = writes.where(F.col("ts") < split)
    first = early.groupBy("namespace", "id").agg(F.min_by(F.struct("value", "ts", "event_id"), F.struct("ts", "event_id")).alias("w"))
    table = first.select("namespace", "id", "w.*").withColumn("indexed_at", b.at(b.START))
    late = writes.where(F.col("ts") >= split)
    merged = ix.upsert(table, late, b.at(_INDEXED_AT), newest=["ts", "event_id"])
    return merged.select("namespace", "id", "value", "event_id", b.stamp("indexed_at").alias("indexed_at"))


@query(
    "exact_dedup",
    """WITH rows AS (SELECT doc_id, text FROM documents
  UNION ALL SELECT CASE WHEN doc_id % 11 > 0 THEN doc_id // 3 END, CASE WHEN doc_id % 13 > 0 THEN text || '!' END FROM documents
  UNION ALL SELECT doc_id, text FROM documents WHERE doc_id % 5 = 0)
SELECT min(doc_id) AS doc_id, sha256(text) AS content_sha256 FROM rows GROUP BY text""",
)
def exact_dedup(spark, sf_dir):
    """The documents; again with repeated and null ids over other contents and null texts; and a fifth of the rows once more."""
    docs = b.table(spark, sf_dir, "documents", "doc_id").select("doc_id", "text")
    other = docs.select(
        F.expr("IF(doc_id % 11 > 0, doc_id DIV 3, NULL)").alias("doc_id"), F.expr("IF(doc_id % 13 > 0, text || '!', NULL)").alias("text")
    )
    rows = docs.unionByName(other).unionByName(docs.where("doc_id % 5 = 0"))
    return ix.dedup(rows).select("doc_id", content_hash(F.col("text")).alias("content_sha256"))


@query(
    "content_copies",
    "SELECT min(doc_id) AS doc_id, sha256(text) AS content_sha256, count(*) AS copies FROM documents GROUP BY sha256(text)",
)
def content_copies(spark, sf_dir):
    return ix.first_copies(b.table(spark, sf_dir, "documents", "doc_id")).select("doc_id", "content_sha256", "copies")


@query(
    "change_detect",
    f"""WITH old AS (SELECT doc_id, text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)),
new AS (SELECT d.doc_id, {b.sql_redact('d.text', REDACTOR)} AS text FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
  WHERE coalesce(l.toxic, 0) = 0)
SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'new' WHEN n.doc_id IS NULL THEN 'deleted'
  WHEN o.text = n.text THEN 'unchanged' ELSE 'changed' END AS status
FROM old o FULL OUTER JOIN new n ON o.doc_id = n.doc_id""",
)
def change_detect(spark, sf_dir):
    """Last snapshot: the labelled documents. This one: all that are not toxic, redacted."""
    docs = b.table(spark, sf_dir, "documents", "doc_id").select("doc_id", "text")
    labels = b.table(spark, sf_dir, "labels")
    old = docs.join(labels, "doc_id", "left_semi")
    clean = rd.redact(docs.join(b.toxic_docs(spark, sf_dir), "doc_id", "left_anti"))
    new = clean.select("doc_id", F.col("redacted").alias("text"))
    return ix.change_detect(old, new).select("doc_id", "status")


@query(
    "coverage_ratio",
    f"""WITH {b.CORPUS}, {b.TOXIC_SQL}, flagged AS (
  SELECT source, CASE WHEN doc_id IN (SELECT doc_id FROM toxic_docs) THEN 0 ELSE 1 END AS there FROM corpus)
SELECT source, count(*) AS items, CAST(sum(there) AS BIGINT) AS indexed, round(avg(there), 6) AS coverage
FROM flagged GROUP BY source""",
)
def coverage_ratio(spark, sf_dir):
    gone = b.toxic_docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("doc_id"))
    index = ix.sync_deletes(b.chunk_index(spark, sf_dir), gone)
    source = b.corpus(spark, sf_dir).select(F.col("source_id").alias("doc_id"), "source")
    return ix.coverage(source, index).select("source", "items", "indexed", F.round("coverage", 6).alias("coverage"))
