"""The shortest whole path: redact, chunk, count."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions.identity import namespace_of
from lorekeep.functions.rules import REDACTOR
from lorekeep.operators.chunking import chunk
from lorekeep.operators.redaction import redact
from lorekeep.plans import bindings as b
from lorekeep.plans.registry import query

_COUNTS = " + ".join(b.sql_count(b.sql_redact("text", REDACTOR[:i]), rule) for i, rule in enumerate(REDACTOR))


@query(
    "redact_and_chunk",
    f"""WITH {b.CORPUS}, clean AS (
  SELECT source, doc_id, {b.sql_redact('text', REDACTOR)} AS body, {_COUNTS} AS redactions FROM corpus),
{b.sql_chunks('clean', 'body', 'source, doc_id, redactions')}
SELECT source || '/' AS namespace, count(*) AS chunks, CAST(sum(token_count) AS BIGINT) AS tokens,
  CAST(sum(CASE WHEN chunk_index = 0 THEN redactions ELSE 0 END) AS BIGINT) AS redactions FROM chunks GROUP BY source""",
)
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = redact(b.corpus(spark, sf_dir), out="body", count_as="redactions")
    chunks = chunk(clean.select("source", "body", "redactions"), "body")
    once = F.when(F.col("chunk_index") == 0, F.col("redactions")).otherwise(0)
    return chunks.groupBy(namespace_of(F.col("source")).alias("namespace")).agg(
        F.count(F.lit(1)).alias("chunks"), F.sum("token_count").alias("tokens"), F.sum(once).alias("redactions")
    )
