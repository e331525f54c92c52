"""The test tables in the engine's schemas, as DataFrames and as SQL fragments.

Every binding covers its whole table. Facts the tables do not hold (authors, channels, secrets, deletions)
are derived from their columns with the same expression in both languages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions.identity import namespace_of
from lorekeep.functions.prices import EMBEDDING_PRICES, token_cost
from lorekeep.functions.rules import Rule
from lorekeep.sources.exports import PAGES

START = "2024-01-01 00:00:00"
AS_OF = "2024-01-20 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str, key: str | None = None) -> DataFrame:
    """A table; one with fewer splits than cores is spread by its key, large ones are left as read."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if key and df.rdd.getNumPartitions() < cores:
        return df.repartition(cores, key)
    return df


def at(text: str) -> Column:
    return F.lit(text).cast("timestamp")


def stamp(ts: Column | str) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def sql_stamp(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%d %H:%M:%S')"


def text_literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# ---------------------------------------------------------------- corpus


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.substring("source", 4, 10).cast("int") % 3
    return table(spark, sf_dir, "documents", "doc_id").select(
        "doc_id",
        "text",
        "lang",
        F.when(kind == 0, "slack").when(kind == 1, "notion").otherwise("drive").alias("source"),
        F.col("doc_id").cast("string").alias("source_id"),
        F.col("source").alias("author"),
        F.concat(F.lit("https://example.org/d/"), F.col("doc_id").cast("string")).alias("url"),
        (at(START) + F.make_dt_interval((F.col("doc_id") % 120).cast("int"))).alias("ts"),
    )


CORPUS = """corpus AS (
  SELECT doc_id, text, lang,
    CASE CAST(substr(source, 4) AS INTEGER) % 3 WHEN 0 THEN 'slack' WHEN 1 THEN 'notion' ELSE 'drive' END AS source,
    CAST(doc_id AS VARCHAR) AS source_id, source AS author,
    'https://example.org/d/' || CAST(doc_id AS VARCHAR) AS url,
    TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(doc_id % 120 AS INTEGER)) AS ts
  FROM documents)"""

# What the corpus lacks: after every text a line with one hit and some near misses of each rule, made
# from the md5 and the number of the document. {h} is the hash, {n4} and {n7} zero-padded numbers.
_PLANTED = (
    "mail u{n7}@example.org, call 555-010-{n4} not 555 010 {n4}; key sk-{h} not sk-{h19}; "
    "cloud AKIA{H16}; ssn 000-12-{n4}; auth Bearer {h}== ; host 10.0.{n4}.1 and 10.9.8.7; "
    "card 4000000000{n4}00 not 4000 0000 00{n4}; za 08 2123 {n4} ; api_key = \"{h}\" ; "
    "bot xoxb-1234567{n7}-1234567{n7}-{h}; model sk-{h}{h16}; other sk-ant-{h}{h}{h}; "
    "person 19900101{n7} and 900101{n7}; jwt eyJ{h}.eyJ{h}.{h} ; token = \"{h}\" ; intl +1 (555) 010-{n4}"
)


def _planted_parts() -> list[str]:
    """The template as alternating literals and placeholder names."""
    import re

    return [part for part in re.split(r"(\{\w+\})", _PLANTED) if part]


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("doc_id").cast("string")
    values = {
        "{h}": F.col("__h"),
        "{h16}": F.substring("__h", 1, 16),
        "{h19}": F.substring("__h", 1, 19),
        "{H16}": F.upper(F.substring("__h", 1, 16)),
        "{n4}": F.lpad((F.col("doc_id") % 10000).cast("string"), 4, "0"),
        "{n7}": F.lpad((F.col("doc_id") % 10000000).cast("string"), 7, "0"),
    }
    pieces = [values[p] if p in values else F.lit(p) for p in _planted_parts()]
    hashed = corpus(spark, sf_dir).withColumn("__h", F.md5(number))
    return hashed.withColumn("text", F.concat("text", F.lit("\n"), *pieces)).drop("__h")


def _planted_sql() -> str:
    h, n = "md5(CAST(doc_id AS VARCHAR))", "CAST(doc_id % {} AS VARCHAR)"
    values = {
        "{h}": h,
        "{h16}": f"substr({h}, 1, 16)",
        "{h19}": f"substr({h}, 1, 19)",
        "{H16}": f"upper(substr({h}, 1, 16))",
        "{n4}": f"lpad({n.format(10000)}, 4, '0')",
        "{n7}": f"lpad({n.format(10000000)}, 7, '0')",
    }
    pieces = [values.get(p, text_literal(p)) for p in _planted_parts()]
    return f"planted AS (SELECT * REPLACE (text || chr(10) || {' || '.join(pieces)} AS text) FROM corpus)"


PLANTED = f"{CORPUS}, {_planted_sql()}"


def sql_redact(text: str, rules: tuple[Rule, ...]) -> str:
    for rule in rules:
        text = f"regexp_replace({text}, {text_literal(rule.pattern)}, {text_literal(rule.marker)}, 'g')"
    return text


def sql_count(text: str, rule: Rule) -> str:
    return f"CAST(len(regexp_extract_all({text}, {text_literal(rule.pattern)})) AS BIGINT)"


def sql_located(source: str, key: str, text: str, rule: Rule) -> str:
    """Rows of key, type, value, position, line_number, marker: every match of one rule."""
    pattern = text_literal(rule.pattern)
    before = lambda size: (
        f"coalesce(list_sum(list_transform(gaps[1:i], lambda x: {size('x')})), 0)"
        f" + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: {size('x')})), 0)"
    )
    chars = lambda x: f"length({x})"
    lines = lambda x: f"(length({x}) - length(replace({x}, chr(10), '')))"
    return f"""SELECT {key}, '{rule.name}' AS type, hits[i] AS value, CAST({before(chars)} AS BIGINT) AS position,
  CAST(1 + {before(lines)} AS BIGINT) AS line_number, {text_literal(rule.marker)} AS marker
FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM (
  SELECT {key}, regexp_extract_all({text}, {pattern}) AS hits, regexp_split_to_array({text}, {pattern}) AS gaps FROM {source}))"""


# ---------------------------------------------------------------- tokens and chunks in SQL


def sql_tokens(text: str) -> str:
    return rf"list_filter(regexp_split_to_array({text}, '\s+'), lambda x: x <> '')"


def sql_chunks(source: str, text: str, keep: str, size: int = 500, overlap: int = 50, name: str = "chunks") -> str:
    """CTEs that end in ``name``: kept columns, content, token_count, chunk_index, total_chunks, start, end."""
    stride = size - overlap
    return f"""tokenised AS (
  SELECT {keep}, {text} AS whole, {sql_tokens(text)} AS toks FROM {source}
  WHERE NOT regexp_full_match({text}, '\\s*')),
sized AS (
  SELECT *, len(toks) AS n, CAST(CASE WHEN len(toks) <= {size} THEN 1
    ELSE ceil((len(toks) - {overlap}) / {stride}.0) END AS BIGINT) AS total_chunks FROM tokenised),
numbered AS (SELECT *, unnest(range(0, total_chunks)) AS chunk_index FROM sized),
{name} AS (
  SELECT {keep}, chunk_index, total_chunks,
    chunk_index * {stride} AS start_token,
    least(chunk_index * {stride} + {size}, n) AS end_token,
    least(chunk_index * {stride} + {size}, n) - chunk_index * {stride} AS token_count,
    CASE WHEN total_chunks = 1 THEN whole ELSE
      array_to_string(toks[chunk_index * {stride} + 1 : least(chunk_index * {stride} + {size}, n)], ' ') END AS content
  FROM numbered)"""


def sql_hash_terms(source: str, key: str, content: str, name: str, dims: int = 256) -> str:
    """CTEs that end in ``name``: key, bucket, value of the unit term-hash vector."""
    return f"""{name}_terms AS (
  SELECT {key}, unnest({sql_tokens(f'lower({content})')}) AS term FROM {source}),
{name}_counts AS (
  SELECT {key}, CAST('0x' || substr(md5(term), 1, 8) AS BIGINT) % {dims} AS bucket,
    sum(CASE WHEN substr(md5(term), 9, 1) < '8' THEN 1.0 ELSE -1.0 END)::DOUBLE AS c
  FROM {name}_terms GROUP BY ALL),
{name} AS (
  SELECT {key}, bucket, c / sqrt(sum(c * c) OVER (PARTITION BY {key})) AS value
  FROM {name}_counts WHERE c <> 0)"""


# ---------------------------------------------------------------- messages


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    opened = at(START) + F.make_dt_interval(F.lit(0), F.col("conv_id").cast("int"))
    return table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") % 10).cast("string").alias("channel_id"),
        F.format_string("%012d-%06d", "conv_id", "turn").alias("message_id"),
        (opened + F.make_dt_interval(F.lit(0), F.lit(0), F.col("turn").cast("int"))).alias("ts"),
        opened.alias("thread_ts"),
        "text",
        F.col("role").alias("user_id"),
    )


MESSAGES_SQL = """messages AS (
  SELECT CAST(conv_id % 10 AS VARCHAR) AS channel_id,
    lpad(CAST(conv_id AS VARCHAR), 12, '0') || '-' || lpad(CAST(turn AS VARCHAR), 6, '0') AS message_id,
    TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(conv_id AS INTEGER)) + to_minutes(CAST(turn AS INTEGER)) AS ts,
    TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(conv_id AS INTEGER)) AS thread_ts,
    text, role AS user_id
  FROM conversations)"""


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    roles = table(spark, sf_dir, "conversations").where(F.col("role") != "system").select("role").distinct()
    return roles.select(F.col("role").alias("user_id"), F.initcap("role").alias("user_name"))


USERS_SQL = """users AS (
  SELECT DISTINCT role AS user_id, upper(substr(role, 1, 1)) || substr(role, 2) AS user_name
  FROM conversations WHERE role <> 'system')"""


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("channel_id").cast("int")
    return messages(spark, sf_dir).select("channel_id").distinct().select(
        "channel_id",
        F.concat(F.lit("channel-"), "channel_id").alias("channel_name"),
        (number % 4 == 0).alias("is_archived"),
        F.when(number % 2 == 0, "public_channel").otherwise("private_channel").alias("type"),
    )


CHANNELS_SQL = f"""{MESSAGES_SQL}, channels AS (
  SELECT DISTINCT channel_id, 'channel-' || channel_id AS channel_name,
    CAST(channel_id AS INTEGER) % 4 = 0 AS is_archived,
    CASE WHEN CAST(channel_id AS INTEGER) % 2 = 0 THEN 'public_channel' ELSE 'private_channel' END AS type
  FROM messages)"""


# ---------------------------------------------------------------- pages and drive files


def raw_pages_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as page objects: a block per line, alternately a paragraph and code, then a divider."""
    as_block = lambda line, i: F.struct(
        F.when(i % 2 == 0, "paragraph").otherwise("code").alias("type"),
        F.when(
            i % 2 == 0, F.struct(F.array(F.struct(line.alias("plain_text"))).alias("rich_text"))
        ).alias("paragraph"),
        F.when(i % 2 == 1, F.struct(line.alias("text"))).alias("code"),
    )
    divider = F.array(
        F.struct(
            F.lit("divider").alias("type"),
            F.lit(None).cast("struct<rich_text:array<struct<plain_text:string>>>").alias("paragraph"),
            F.lit(None).cast("struct<text:string>").alias("code"),
        )
    )
    title = F.struct(
        F.lit("title").alias("type"),
        F.array(F.struct(F.substring("text", 1, 20).alias("plain_text"))).alias("title"),
    )
    name = F.element_at(F.array(*map(F.lit, ("Name", "Title", "title", "name", "Status"))), (F.col("doc_id") % 5 + 1).cast("int"))
    status = F.struct(
        F.lit("select").alias("type"), F.lit(None).cast("array<struct<plain_text:string>>").alias("title")
    )
    return table(spark, sf_dir, "documents", "doc_id").select(
        F.col("doc_id").cast("string").alias("page_id"),
        F.lit("2024-01-01T00:00:00").alias("created_time"),
        F.lit("2024-01-02T00:00:00").alias("last_edited_time"),
        F.col("source").alias("database_id"),
        F.when(F.col("lang") == "es", "database").otherwise("page").alias("object"),
        F.create_map(name, F.when(name == "Status", status).otherwise(title)).alias("properties"),
        F.concat(F.transform(F.split("text", "\n", -1), as_block), divider).alias("blocks"),
    )


def raw_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as the JSON reader would give them."""
    packed = raw_pages_json(spark, sf_dir)
    return packed.select(F.from_json(F.to_json(F.struct(*packed.columns)), PAGES).alias("page")).select("page.*")


RAW_PAGES_SQL = r"""raw_pages AS (
  SELECT CAST(doc_id AS VARCHAR) AS page_id, source AS database_id,
    CASE WHEN lang = 'es' THEN 'database' ELSE 'page' END AS object,
    CASE WHEN doc_id % 5 = 4 THEN 'Untitled' ELSE substr(text, 1, 20) END AS title,
    text AS text_content, CAST(len(string_split(text, chr(10))) + 1 AS BIGINT) AS block_count
  FROM documents)"""

MIMES = (
    "application/vnd.google-apps.document",
    "application/vnd.google-apps.spreadsheet",
    "application/pdf",
    "text/plain",
)


def raw_drive(spark: SparkSession, sf_dir: str) -> DataFrame:
    mime = F.element_at(F.array(*map(F.lit, MIMES)), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "documents", "doc_id").select(
        F.col("doc_id").cast("string").alias("file_id"),
        F.substring("text", 1, 20).alias("name"),
        mime.alias("mime_type"),
        F.lit("2024-01-01T00:00:00").alias("created_time"),
        F.lit("2024-01-02T00:00:00").alias("modified_time"),
        F.col("n_chars").cast("string").alias("size"),
        F.array(F.concat(F.lit("f"), (F.col("doc_id") % 5).cast("string"))).alias("parents"),
        F.col("text").alias("content"),
    )


RAW_DRIVE_SQL = f"""raw_drive AS (
  SELECT CAST(doc_id AS VARCHAR) AS file_id, substr(text, 1, 20) AS name,
    ([{', '.join(map(text_literal, MIMES))}])[doc_id % 4 + 1] AS mime_type,
    n_chars AS size, 'f' || CAST(doc_id % 5 AS VARCHAR) AS folder, text AS content
  FROM documents)"""


# ---------------------------------------------------------------- vectors and queries


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("label") % 3
    return table(spark, sf_dir, "embeddings").select(
        F.when(kind == 0, "slack/").when(kind == 1, "notion/").otherwise("drive/").alias("namespace"),
        F.col("vec_id").cast("string").alias("id"),
        F.col("embedding").alias("values"),
        "label",
    )


VECTORS_SQL = """vectors AS (
  SELECT CASE label % 3 WHEN 0 THEN 'slack/' WHEN 1 THEN 'notion/' ELSE 'drive/' END AS namespace,
    CAST(vec_id AS VARCHAR) AS id, embedding::DOUBLE[] AS values, label
  FROM embeddings)"""


def label_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query per label: the mean of all its vectors. There are as many queries as labels."""
    parts = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("dim", "x"))
    means = parts.groupBy("label", "dim").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("x"))
    packed = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("v"))
    return packed.select(
        F.concat(F.lit("label-"), F.col("label").cast("string")).alias("query_id"),
        F.transform("v", lambda p: p["x"]).alias("values"),
    )


LABEL_QUERIES_SQL = """label_parts AS (
  SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings),
label_means AS (SELECT label, dim, round(avg(x), 6) AS x FROM label_parts GROUP BY ALL),
queries AS (
  SELECT 'label-' || CAST(label AS VARCHAR) AS query_id, list(x ORDER BY dim) AS values
  FROM label_means GROUP BY label)"""


def text_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("q"), F.col("item_id").cast("string")).alias("query_id"), "text"
    )


TEXT_QUERIES_SQL = "text_queries AS (SELECT 'q' || CAST(item_id AS VARCHAR) AS query_id, text FROM benchmark)"


def chunk_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of the whole corpus with namespace and id, not embedded yet."""
    from lorekeep.functions.identity import vector_id
    from lorekeep.operators.chunking import chunk

    chunks = chunk(corpus(spark, sf_dir), keep=["source", "source_id", "author", "url", "ts"])
    return chunks.select(
        namespace_of(F.col("source")).alias("namespace"),
        vector_id(F.col("source"), F.col("source_id"), F.col("chunk_index")).alias("id"),
        F.col("source_id").alias("doc_id"),
        "chunk_index",
        "author",
        "url",
        "ts",
        "content",
        "token_count",
    )


CHUNK_INDEX_SQL = f"""{CORPUS}, {sql_chunks('corpus', 'text', 'source, source_id, author, url, ts', name='doc_chunks')},
chunk_index AS (
  SELECT source || '/' AS namespace, source || '-' || source_id || '-' || CAST(chunk_index AS VARCHAR) AS id,
    source_id AS doc_id, chunk_index, author, url, ts, content, token_count
  FROM doc_chunks)"""


# ---------------------------------------------------------------- events


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "events")
    return raw.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        "user_id",
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )


EVENTS_SQL = """bound_events AS (
  SELECT event_id, ts, user_id, event_type, value,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
  FROM events)"""

_MODELS = list(EMBEDDING_PRICES)


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = F.element_at(F.array(*map(F.lit, _MODELS)), (F.col("user_id") % 3 + 1).cast("int"))
    rows = events(spark, sf_dir).select(
        "event_id",
        "ts",
        F.date_format("ts", "yyyy-MM").alias("month"),
        F.date_format("ts", "yyyy-MM-dd").alias("day"),
        model.alias("model"),
        (F.col("k") * 100).alias("tokens"),
    )
    return rows.withColumn("cost_usd", token_cost(F.col("tokens"), F.col("model")))


def sql_price(model: str) -> str:
    cases = " ".join(f"WHEN {text_literal(m)} THEN {usd}::DOUBLE" for m, usd in EMBEDDING_PRICES.items())
    return f"(CASE {model} {cases} ELSE 0.02::DOUBLE END)"


LEDGER_SQL = f"""{EVENTS_SQL}, ledger_rows AS (
  SELECT event_id, ts, strftime(ts, '%Y-%m') AS month, strftime(ts, '%Y-%m-%d') AS day,
    ([{', '.join(map(text_literal, _MODELS))}])[user_id % 3 + 1] AS model, k * 100 AS tokens
  FROM bound_events),
ledger AS (SELECT *, tokens * ({sql_price('model')} / 1000000.0::DOUBLE) AS cost_usd FROM ledger_rows)"""


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("ts", (F.col("event_type") == "error").alias("failed"))


CALLS_SQL = "calls AS (SELECT ts, event_type = 'error' AS failed FROM events)"


def cache_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes to the cache: a key per event type and user, so keys are written many times."""
    return events(spark, sf_dir).select(
        F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("key"),
        F.concat(F.lit('{"value": '), F.col("event_id").cast("string"), F.lit("}")).alias("value"),
        F.col("ts").alias("created_at"),
        F.when(F.col("k") % 10 == 0, F.lit(None)).otherwise(F.col("k") * 3600).cast("bigint").alias("ttl_seconds"),
    )


CACHE_ROWS_SQL = f"""{EVENTS_SQL}, cache_rows AS (
  SELECT event_type || ':' || CAST(user_id AS VARCHAR) AS key,
    '{{"value": ' || CAST(event_id AS VARCHAR) || '}}' AS value, ts AS created_at,
    ts + to_seconds(CASE WHEN k % 10 = 0 THEN 604800 ELSE k * 3600 END) AS expires_at
  FROM bound_events),
cache AS (
  SELECT * EXCLUDE (r) FROM (
    SELECT sha256(key) AS key_hash, *, row_number() OVER (PARTITION BY key ORDER BY created_at DESC, value DESC) AS r
    FROM cache_rows) WHERE r = 1)"""


def leavers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with fewer events than the average user."""
    counts = events(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    mean = counts.agg(F.avg("n").alias("mean")).scalar()
    return counts.where(F.col("n") < mean).select("user_id")


LEAVERS_SQL = """user_counts AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id),
leavers AS (SELECT user_id FROM user_counts WHERE n < (SELECT avg(n) FROM user_counts))"""


def toxic_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents labelled toxic stand for those deleted at their source."""
    return table(spark, sf_dir, "labels").where(F.col("toxic") == 1).select("doc_id")


TOXIC_SQL = "toxic_docs AS (SELECT doc_id FROM labels WHERE toxic = 1)"


def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus as ingest events; those of four authors come broken, each in its own way."""
    docs = corpus(spark, sf_dir)
    body = lambda source, source_id: F.to_json(
        F.struct(
            source.alias("source"),
            F.col("text").alias("content"),
            F.struct(
                source_id.alias("id"),
                F.col("author"),
                F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
                F.col("url"),
                F.col("lang"),
            ).alias("metadata"),
        )
    )
    nothing = F.lit(None).cast("string")
    good = body(F.col("source"), F.col("source_id"))
    author = F.col("author")
    data = (
        F.when(author == "src0", F.concat(F.lit("%%%"), F.base64(F.encode(good, "utf-8"))))
        .when(author == "src1", F.base64(F.encode(F.concat(F.lit("{"), good), "utf-8")))
        .when(author == "src2", F.base64(F.encode(body(F.col("source"), nothing), "utf-8")))
        .when(author == "src3", F.base64(F.encode(body(nothing, F.col("source_id")), "utf-8")))
        .otherwise(F.base64(F.encode(good, "utf-8")))
    )
    return docs.select(data.alias("data"))


REASON_SQL = """CASE author WHEN 'src0' THEN 'bad base64' WHEN 'src1' THEN 'bad json'
  WHEN 'src2' THEN 'missing id' WHEN 'src3' THEN 'missing source' END"""
