"""Identity hashes of articles, versions, duplicate groups and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronoweft.functions.text import casefold

HASH_PATTERN = r"^[0-9a-f]{64}$"


def _lines(*parts: Column | str) -> Column:
    columns = [F.lit(p) if isinstance(p, str) else p for p in parts]
    return F.sha2(F.concat_ws("\n", *columns), 256)


def sorted_json(fields: dict[str, Column]) -> Column:
    """Compact JSON with keys in sorted order and explicit nulls."""
    return F.to_json(
        F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"}
    )


def article_id(provider: Column, provider_article_id: Column, canonical: Column) -> Column:
    """Provider id where there is one, else the canonical URL; null without either."""
    return (
        F.when(F.coalesce(provider_article_id, F.lit("")) != "",
               _lines("article-id-v1", provider, provider_article_id))
        .when(F.coalesce(canonical, F.lit("")) != "",
              _lines("article-url-v1", provider, canonical))
    )


def content_hash(asset: Column, content: Column, language: Column, source: Column,
                 title: Column) -> Column:
    """Digest of exactly what a scorer would be given."""
    return F.sha2(sorted_json({
        "asset": asset, "content": content, "language": language,
        "serialization_version": F.lit("sentiment-input-v1"), "source": source, "title": title,
    }), 256)


def version_fingerprint(article: Column, content_digest: Column, content: Column,
                        language: Column, provider: Column, source: Column,
                        title: Column) -> Column:
    """Digest that changes whenever an article's observable text changes."""
    return F.sha2(sorted_json({
        "article_id": article, "content": content, "content_hash": content_digest,
        "language": language, "provider": provider,
        "serialization_version": F.lit("article-version-fingerprint-v1"), "source": source,
        "title": title,
    }), 256)


def article_version_id(article: Column, first_seen: Column, language: Column,
                       content_digest: Column) -> Column:
    """Identity of one immutable version."""
    return _lines("article-version-v1", article, first_seen, language, content_digest)


def duplicate_group_id(anchor: Column) -> Column:
    """Identity of a duplicate group, from its anchor article."""
    return _lines("duplicate-group-v1", anchor)


def dedup_fingerprint(title: Column, language: Column) -> Column:
    """Digest equal for articles that carry the same title in any case."""
    return F.sha2(sorted_json({
        "content": F.lit(""), "language": language,
        "serialization_version": F.lit("dedup-fingerprint-v1"),
        "title_casefold": casefold(title),
    }), 256)


def score_id(content_digest: Column, asset: Column, model: Column, version: Column,
             prompt: Column, config: Column) -> Column:
    """Cache key of a score."""
    return F.sha2(sorted_json({
        "asset": asset, "content_hash": content_digest, "prompt_version": prompt,
        "scoring_config_hash": config, "sentiment_model_id": model,
        "sentiment_model_version": version,
    }), 256)


def observation_id(prefix: Column, minute: Column, raw_sha: Column, line: Column,
                   side: Column) -> Column:
    """Deterministic identity of one endpoint of one snapshot line."""
    return F.concat_ws(":", prefix, minute, raw_sha, line.cast("string"), side)


def parse_observation_id(value: Column) -> Column:
    """Struct ``(minute, raw_sha256, line, side)``; null where the text is malformed."""
    shape = r"^[^:]+:(.+Z):([0-9a-f]{64}):(\d+):(from|to)$"
    return F.when(value.rlike(shape), F.struct(
        F.regexp_extract(value, shape, 1).alias("minute"),
        F.regexp_extract(value, shape, 2).alias("raw_sha256"),
        F.regexp_extract(value, shape, 3).cast("bigint").alias("line"),
        F.regexp_extract(value, shape, 4).alias("side"),
    ))
