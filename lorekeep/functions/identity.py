"""Identity, routing and small text columns."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Namespace of each source; any other source goes to DEFAULT_NAMESPACE.
NAMESPACES = {"slack": "slack/", "notion": "notion/", "drive": "drive/"}
DEFAULT_NAMESPACE = "default"
PREVIEW_CHARS = 1000


def namespace_of(source: Column) -> Column:
    routes = F.create_map(*[F.lit(x) for x in chain(*NAMESPACES.items())])
    return F.coalesce(F.try_element_at(routes, source), F.lit(DEFAULT_NAMESPACE))


def source_of(namespace: Column) -> Column:
    return F.regexp_replace(namespace, "/$", "")


def vector_id(source: Column, source_id: Column, chunk_index: Column) -> Column:
    """``source-id-index``; null when any part is null, so the row can be rejected."""
    return F.concat(source, F.lit("-"), source_id, F.lit("-"), chunk_index.cast("string"))


def pseudonymise(person: Column, salt: str) -> Column:
    return F.sha2(F.concat(F.lit(salt), person), 256)


def preview(text: Column, chars: int = PREVIEW_CHARS) -> Column:
    return F.substring(text, 1, chars)


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)
