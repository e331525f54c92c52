"""Typed rows from message, page and drive exports (JSON)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Defaults, names and sizes of the exports.
UNKNOWN = "unknown"
UNTITLED = "Untitled"
TITLE_PROPERTIES = ("Name", "Title", "title", "name")
DRIVE_PREVIEW_CHARS = 500

MESSAGES = (
    "channel_id string, channel_name string, timestamp string, text string, thread_ts string, user_id string"
)
# Nested objects are kept as JSON text, because their keys depend on the value of ``type``.
PAGES = (
    "page_id string, created_time string, last_edited_time string, database_id string, object string, "
    "properties map<string,string>, blocks array<map<string,string>>"
)
DRIVE = (
    "file_id string, name string, mime_type string, created_time string, modified_time string, "
    "size string, parents array<string>, content string"
)


def _json(spark: SparkSession, path: str, schema: str, multi_line: bool) -> DataFrame:
    """JSON lines can be split over tasks; a file holding one JSON array (``multi_line``) cannot."""
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)


def epoch_timestamp(seconds: Column) -> Column:
    """Timestamp of an epoch text such as ``1704067200.000100``; null if it is not a number."""
    return F.timestamp_micros((seconds.try_cast("decimal(20,6)") * 1_000_000).cast("bigint"))


def message_rows(raw: DataFrame) -> DataFrame:
    return raw.select(
        "channel_id",
        F.coalesce("channel_name", F.lit(UNKNOWN)).alias("channel_name"),
        "timestamp",
        epoch_timestamp(F.col("timestamp")).alias("ts"),
        F.coalesce("text", F.lit("")).alias("text"),
        "thread_ts",
        F.coalesce("user_id", F.lit(UNKNOWN)).alias("user_id"),
    )


def read_messages(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    return message_rows(_json(spark, path, MESSAGES, multi_line))


def page_title(properties: Column) -> Column:
    """First property of the four names that is of type title and has a text, else ``Untitled``."""
    candidates = []
    for name in TITLE_PROPERTIES:
        value = F.try_element_at(properties, F.lit(name))
        first = F.get_json_object(value, "$.title[0]")
        usable = (F.get_json_object(value, "$.type") == "title") & first.isNotNull()
        text = F.coalesce(F.get_json_object(first, "$.plain_text"), F.lit(UNTITLED))
        candidates.append(F.when(usable, text))
    return F.coalesce(*candidates, F.lit(UNTITLED))


def blocks_to_text(blocks: Column) -> Column:
    """Rich-text parts of every block, or its ``text``, joined by newlines; untyped blocks are skipped."""

    def parts(block: Column) -> Column:
        body = F.try_element_at(block, F.try_element_at(block, F.lit("type")))
        rich = F.get_json_object(body, "$.rich_text")
        pieces = F.transform(
            F.from_json(rich, "array<struct<plain_text:string>>"),
            lambda piece: F.coalesce(piece["plain_text"], F.lit("")),
        )
        plain = F.get_json_object(body, "$.text")
        return (
            F.when(rich.isNotNull(), pieces)
            .when(plain.isNotNull(), F.array(plain))
            .otherwise(F.array().cast("array<string>"))
        )

    return F.coalesce(F.array_join(F.flatten(F.transform(blocks, parts)), "\n"), F.lit(""))


def page_rows(raw: DataFrame) -> DataFrame:
    return raw.select(
        "page_id",
        page_title(F.col("properties")).alias("title"),
        "created_time",
        "last_edited_time",
        blocks_to_text(F.col("blocks")).alias("text_content"),
        F.coalesce(F.size("blocks"), F.lit(0)).alias("block_count"),
        "database_id",
        "object",
    )


def read_pages(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    return page_rows(_json(spark, path, PAGES, multi_line))


def drive_rows(raw: DataFrame) -> DataFrame:
    """Files with content, whole; the preview is its first 500 characters."""
    return raw.where(F.coalesce("content", F.lit("")) != "").select(
        "file_id",
        "name",
        "mime_type",
        "created_time",
        "modified_time",
        F.col("size").try_cast("bigint").alias("size"),
        F.substring("content", 1, DRIVE_PREVIEW_CHARS).alias("content_preview"),
        F.length("content").alias("content_length"),
        "content",
    )


def read_drive(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    return drive_rows(_json(spark, path, DRIVE, multi_line))


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return bool(hadoop_path.getFileSystem(conf).globStatus(hadoop_path))


READERS = {"slack": read_messages, "notion": read_pages, "drive": read_drive}


def read_corpus(spark: SparkSession, paths: Mapping[str, str], multi_line: bool = False) -> DataFrame:
    """Any of the three exports by source name, as one frame; missing files are skipped."""
    frames = [
        READERS[source](spark, path, multi_line).withColumn("source", F.lit(source))
        for source, path in paths.items()
        if _exists(spark, path)
    ]
    if not frames:
        raise FileNotFoundError(f"none of the exports exist: {sorted(paths.values())}")
    union = frames[0]
    for frame in frames[1:]:
        union = union.unionByName(frame, allowMissingColumns=True)
    return union


def search_pages(pages: DataFrame, query: str = "", n: int | None = None) -> DataFrame:
    """Objects of kind page whose title contains the query, ignoring case: all, or the first n by id."""
    title = F.lower(page_title(F.col("properties")))
    found = pages.where((F.col("object") == "page") & F.contains(title, F.lit(query.lower())))
    return found if n is None else found.orderBy("page_id").limit(n)


def pages_in(pages: DataFrame, database_id: str, n: int | None = None) -> DataFrame:
    if not database_id:
        raise ValueError("a database id is needed")
    found = pages.where(F.col("database_id") == database_id)
    return found if n is None else found.orderBy("page_id").limit(n)


def list_files(
    files: DataFrame, folder: str | None = None, mimes: list[str] | None = None, n: int | None = None
) -> DataFrame:
    """Files in a folder and of one of the types; either condition may be left out."""
    found = files
    if folder:
        found = found.where(F.array_contains("parents", folder))
    if mimes:
        found = found.where(F.col("mime_type").isin(*mimes))
    return found if n is None else found.orderBy("file_id").limit(n)


def search_files(files: DataFrame, query: str, n: int | None = None) -> DataFrame:
    """Files whose name or whole text contains the query."""
    word = F.lit(query)
    found = files.where(F.contains(F.col("name"), word) | F.contains(F.col("content"), word))
    return found if n is None else found.orderBy("file_id").limit(n)
