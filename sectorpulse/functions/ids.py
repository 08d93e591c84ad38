"""Hash identities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The columns that identify a stored row, and hash lengths.
ID_COLUMNS = ("news_type", "sector", "event_category", "link", "title", "keyword")
LINK_HASH_CHARS = 16
STREAM_HASH_CHARS = 12


def row_key() -> Column:
    """Identity of a stored row: sha-256 over six columns joined by '|'."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("")) for c in ID_COLUMNS]), 256)


def link_hash(link: Column) -> Column:
    """Fingerprint of a link in the alert history."""
    return F.substring(F.sha1(F.coalesce(link, F.lit(""))), 1, LINK_HASH_CHARS)


def stream_link(base_link: Column, title: Column, publish_time: Column) -> Column:
    """A link for feed items that have none: list page plus a content fingerprint."""
    digest = F.sha1(F.concat(title, F.lit("|"), publish_time))
    return F.concat(base_link, F.lit("#"), F.substring(digest, 1, STREAM_HASH_CHARS))


def validation_key(
    category: Column,
    title: Column,
    link: Column,
    content: Column,
    provider: str = "custom",
    model: str = "unknown",
    prompt_version: str = "unknown",
    rule_version: str = "unknown",
) -> Column:
    """Identity of one verdict request: the verifier's versions plus what it is shown."""
    payload = F.to_json(
        F.struct(
            category.alias("category"),
            F.trim(content).alias("content"),
            F.trim(link).alias("link"),
            F.lit(model or "unknown").alias("model"),
            F.lit(prompt_version or "unknown").alias("prompt_version"),
            F.lit(provider or "custom").alias("provider"),
            F.lit(rule_version or "unknown").alias("rule_version"),
            F.trim(title).alias("title"),
        )
    )
    return F.sha2(payload, 256)

