"""Observations to candidates, versions, links, exclusions and articles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweft import settings
from chronoweft.functions import identity as idy
from chronoweft.functions.text import language_code, normalize_title, selects_title
from chronoweft.functions.timefns import (
    provider_timestamp, timestamp_to_utc_text, utc_text_to_timestamp,
)
from chronoweft.functions.urls import canonical_url, url_host
from chronoweft.operators.dedup import causal_groups
from chronoweft.session import materialise

_RANK = {reason: i for i, reason in enumerate(settings.EXCLUSION_REASONS)}


def failure(reason: str, detail: str, when: Column) -> Column:
    """A failure entry where the condition holds."""
    return F.when(F.coalesce(when, F.lit(False)), F.struct(
        F.lit(_RANK[reason]).alias("rank"), F.lit(reason).alias("reason"),
        F.lit(detail).alias("detail")))


def failures(*entries: Column) -> Column:
    """All failures of a row, in rank order."""
    return F.array_sort(F.array_compact(F.array(*entries)))


def primary_reason(entries: Column) -> Column:
    """The reason with the highest precedence."""
    return F.get(entries, F.lit(0))["reason"]


def diagnostics(entries: Column) -> Column:
    """Every failure as ``reason:detail``, in rank order."""
    return F.array_join(
        F.transform(entries, lambda e: F.concat(e["reason"], F.lit(":"), e["detail"])), "; "
    )


def is_blocked(entries: Column) -> Column:
    """True where a failure leaves no usable candidate."""
    return F.exists(entries, lambda e: e["reason"].isin(*settings.BLOCKING_REASONS))


def rights_flag(observations: DataFrame, approvals: DataFrame, *, provider: str, scope: str,
                config: str) -> DataFrame:
    """Add ``rights_ok``: an approval covers provider, scope and configuration.

    Synthetic input also needs its file digest on the approval's list; approvals for provider
    responses must not carry a list. ``approvals``: ``(approval_kind, approved,
    network_access_authorized, provider, scope, protocol_config_sha256,
    authorized_sha256 array)``.
    """
    valid = approvals.filter(
        F.col("approved") & ~F.col("network_access_authorized") & (F.col("provider") == provider)
        & (F.col("scope") == scope) & (F.col("protocol_config_sha256") == config)
    )
    listed = valid.filter(F.col("approval_kind") == "synthetic_fixture_only").select(
        F.lit("synthetic_fixture").alias("input_class"),
        F.explode("authorized_sha256").alias("raw_snapshot_sha256"),
    ).distinct().withColumn("_listed", F.lit(True))
    general = valid.filter(
        (F.col("approval_kind") == "provider_rights") & (F.size("authorized_sha256") <= 0)
    ).agg((F.count(F.lit(1)) > 0).alias("_general"))
    return (
        observations.join(listed, ["input_class", "raw_snapshot_sha256"], "left")
        .crossJoin(F.broadcast(general))
        .withColumn("rights_ok", F.coalesce(F.col("_listed"), F.lit(False)) | (
            F.col("_general") & (F.col("input_class") == "provider_response")))
        .drop("_listed", "_general")
    )


def candidates(observations: DataFrame, *, provider: str = settings.NEWS_PROVIDER,
               asset: str = settings.NEWS_ASSET, include: str = settings.INCLUDE_TITLES,
               exclude: str = settings.EXCLUDE_TITLES,
               languages: dict[str, str] | None = None) -> DataFrame:
    """Raw observations to normalised candidates with their failures: one projection, no shuffle.

    Needs ``rights_ok``. Identity columns are null where a failure blocks the candidate.
    """
    raw_url, raw_title = F.col("raw_url"), F.col("raw_title")
    published = utc_text_to_timestamp(F.col("raw_published_at"))
    ingested = utc_text_to_timestamp(F.col("ingested_at"))
    provider_seen = provider_timestamp(F.col("raw_provider_first_seen_at"))
    step = observations.withColumns({
        "canonical_url": canonical_url(raw_url),
        "title": normalize_title(raw_title),
        "language": language_code(F.col("raw_language"), languages),
        "first_seen": published,
        "provider_first_seen_at": timestamp_to_utc_text(provider_seen),
    })
    blank_url = raw_url.isNull() | (F.trim(raw_url) == "")
    listed = failures(
        failure("historical_backfill_without_availability", "historical input is audit-only",
                F.col("collection_mode") == "historical_backfill"),
        failure("invalid_timestamp", "publication time is invalid or precedes ingestion",
                published.isNull() | ingested.isNull() | (published < ingested)),
        failure("invalid_url_or_identifier", "endpoint URL is missing", blank_url),
        failure("invalid_url_or_identifier", "URL is not an acceptable absolute HTTP(S) URL",
                ~blank_url & F.col("canonical_url").isNull()),
        failure("missing_title_and_content", "endpoint title is missing", raw_title.isNull()),
        failure("missing_title_and_content", "normalized title is blank",
                F.col("title") == ""),
        failure("unsupported_language", "language is missing or not supported",
                F.col("language").isNull()),
        failure("invalid_timestamp", "provider first-seen value is invalid",
                F.col("raw_date_malformed") | (
                    F.col("raw_provider_first_seen_at").isNotNull() & provider_seen.isNull())),
        failure("asset_mismatch", "title does not match the selector",
                (F.col("title") != "") & ~selects_title(F.col("title"), include, exclude)),
        failure("license_restricted", "no valid rights approval applies", ~F.col("rights_ok")),
    )
    step = step.withColumn("failures", listed).withColumn("blocked", is_blocked(F.col("failures")))
    none = F.lit(None).cast("string")
    lit_p, lit_a = F.lit(provider), F.lit(asset)
    step = step.withColumns({
        "provider": lit_p, "asset": lit_a,
        "source": F.when(~F.col("blocked"), url_host(F.col("canonical_url"))),
        "first_seen_at": timestamp_to_utc_text(F.col("first_seen")),
        "article_id": F.when(
            ~F.col("blocked"), idy.article_id(lit_p, none, F.col("canonical_url"))),
    })
    step = step.withColumn("content_hash", F.when(~F.col("blocked"), idy.content_hash(
        lit_a, none, F.col("language"), F.col("source"), F.col("title"))))
    return step.withColumn("version_fingerprint", F.when(
        ~F.col("blocked"), idy.version_fingerprint(
            F.col("article_id"), F.col("content_hash"), none, F.col("language"), lit_p,
            F.col("source"), F.col("title"))))


def written_candidates(observations: DataFrame, **options) -> DataFrame:
    """Candidates as a written table, without the raw text they came from."""
    return materialise(candidates(observations, **options).drop(
        "raw_url", "raw_title", "raw_language", "raw_provider_first_seen_at"), "candidates")


def mark_conflicts(cands: DataFrame) -> DataFrame:
    """Add the failure of every candidate whose article shows two texts at one instant.

    Only minimum and maximum fingerprint travel, so a hot article is pre-aggregated. The clashes are
    written first: where they are few they are broadcast, and the texts are not shuffled to meet them.
    """
    usable = cands.filter(~F.col("blocked"))
    clash = usable.groupBy("article_id", "first_seen_at").agg(
        F.min("version_fingerprint").alias("_lo"), F.max("version_fingerprint").alias("_hi")
    ).filter("_lo <> _hi").select("article_id", "first_seen_at", F.lit(True).alias("_clash"))
    clash = materialise(clash, "clashes")
    entry = failure("revision_time_unknown", "conflicting texts at the same instant",
                    F.col("_clash"))
    return (
        cands.join(clash, ["article_id", "first_seen_at"], "left")
        .withColumn("failures", F.array_sort(F.array_compact(F.concat(
            F.col("failures"), F.array(entry)))))
        .drop("_clash")
    )


def exclusions(cands: DataFrame) -> DataFrame:
    """One row per refused observation: primary reason and all diagnostics."""
    return cands.filter(F.size("failures") > 0).select(
        "provider_observation_id", primary_reason(F.col("failures")).alias("reason"),
        diagnostics(F.col("failures")).alias("diagnostic"), "raw_snapshot_sha256", "input_class",
    )


_CARRIED = ["provider_observation_id", "first_seen", "first_seen_at", "canonical_url", "source",
            "title", "language", "provider_first_seen_at", "ingested_at", "content_hash",
            "raw_snapshot_sha256", "provider", "asset"]


def representatives(cands: DataFrame) -> DataFrame:
    """First observation of every version: by time, then observation id."""
    accepted = cands.filter(F.size("failures") == 0)
    order = F.struct("first_seen", "provider_observation_id")
    return accepted.groupBy("article_id", "version_fingerprint").agg(
        F.min_by(F.struct(*_CARRIED), order).alias("_r"),
        F.count(F.lit(1)).alias("observations"),
    ).select("article_id", "version_fingerprint", "observations",
             *[F.col("_r")[c].alias(c) for c in _CARRIED])


def initial_versions(reps: DataFrame) -> DataFrame:
    """Earliest version of every logical article, from its versions or from all accepted candidates.

    Digests travel, titles do not; the result is written, so that each title is folded once.
    """
    order = F.struct("first_seen", "version_fingerprint")
    return materialise(reps.select(
        "article_id", "first_seen", "version_fingerprint",
        idy.dedup_fingerprint(F.col("title"), F.col("language")).alias("_digest"),
    ).groupBy("article_id").agg(
        F.min("first_seen").alias("first_seen_at"),
        F.min_by("_digest", order).alias("dedup_fingerprint")), "firsts")


def article_table(reps: DataFrame, groups: DataFrame) -> DataFrame:
    """The 21-column version table."""
    none = F.lit(None).cast("string")
    joined = reps.join(groups.select("article_id", "duplicate_group_id"), "article_id")
    return joined.select(
        "article_id",
        idy.article_version_id(F.col("article_id"), F.col("first_seen_at"), F.col("language"),
                               F.col("content_hash")).alias("article_version_id"),
        "provider", none.alias("provider_article_id"), "provider_observation_id", "source",
        "canonical_url", "title", none.alias("content"), "language", none.alias("published_at"),
        "provider_first_seen_at", "first_seen_at", "ingested_at",
        none.alias("provider_updated_at"), "asset", "content_hash", "raw_snapshot_sha256",
        F.lit(True).alias("point_in_time_eligible"), none.alias("exclusion_reason"),
        "duplicate_group_id",
    )


def observation_links(cands: DataFrame, reps: DataFrame) -> DataFrame:
    """Accepted observations and the version they belong to; ``reused`` for all but the first."""
    accepted = cands.filter(F.size("failures") == 0).select(
        "article_id", "version_fingerprint", "provider_observation_id", "raw_snapshot_sha256",
        "input_class")
    versions = reps.select(
        "article_id", "version_fingerprint",
        F.col("provider_observation_id").alias("_first"),
        idy.article_version_id(F.col("article_id"), F.col("first_seen_at"), F.col("language"),
                               F.col("content_hash")).alias("article_version_id"))
    return accepted.join(versions, ["article_id", "version_fingerprint"]).select(
        "provider_observation_id", "article_version_id",
        (F.col("provider_observation_id") != F.col("_first")).alias("reused_existing_version"),
        "raw_snapshot_sha256", "input_class",
    )


def normalise(observations: DataFrame, **options) -> dict[str, DataFrame]:
    """One batch without earlier state: candidates, exclusions, links, groups and articles.

    Candidates and versions feed several outputs each, so both are written once and read back;
    the text and hash work is not repeated per output.
    """
    cands = mark_conflicts(written_candidates(observations, **options))
    reps = materialise(representatives(cands), "versions")
    groups = causal_groups(initial_versions(reps))
    return {
        "candidates": cands, "exclusions": exclusions(cands),
        "links": observation_links(cands, reps), "groups": groups,
        "articles": article_table(reps, groups),
    }


def state_conflicts(cands: DataFrame, stored: DataFrame) -> DataFrame:
    """Reasons to refuse a whole batch because it contradicts stored versions.

    ``stored`` holds ``(article_id, version_fingerprint, first_seen_at)`` of committed versions.
    """
    usable = cands.filter(~F.col("blocked"))
    same_time = usable.join(
        stored.select("article_id", "first_seen_at",
                      F.col("version_fingerprint").alias("_known")),
        ["article_id", "first_seen_at"],
    ).groupBy("article_id", "first_seen_at", "version_fingerprint").agg(
        F.max(F.col("_known") == F.col("version_fingerprint")).alias("_same")
    ).filter(~F.col("_same")).select(
        F.lit("same_time_revision").alias("check"), "article_id", "first_seen_at")
    earlier = usable.filter(F.size("failures") == 0).groupBy(
        "article_id", "version_fingerprint"
    ).agg(F.min("first_seen_at").alias("first_seen_at")).join(
        stored.select("article_id", "version_fingerprint",
                      F.col("first_seen_at").alias("_stored")),
        ["article_id", "version_fingerprint"],
    ).filter(
        utc_text_to_timestamp(F.col("first_seen_at")) < utc_text_to_timestamp(F.col("_stored"))
    ).select(F.lit("earlier_repeat").alias("check"), "article_id", "first_seen_at")
    return same_time.unionByName(earlier)


def batch_summary(articles: DataFrame, excluded: DataFrame, links: DataFrame) -> DataFrame:
    """Counts published with a batch."""
    def count(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("part"), "rows")

    reasons = excluded.groupBy("reason").agg(F.count(F.lit(1)).alias("rows")).select(
        F.concat(F.lit("exclusion:"), F.col("reason")).alias("part"), "rows")
    return count(articles, "articles").unionByName(count(excluded, "exclusions")).unionByName(
        count(links, "observation_links")).unionByName(reasons)


def publish(batch: dict[str, DataFrame], coverage: DataFrame, root: str, batch_id: str) -> None:
    """Write one terminal batch; pending or unresolved intervals refuse the publication."""
    from chronoweft.operators.quality import require_empty

    require_empty(
        coverage.filter("pending_intervals > 0 or unresolved_intervals > 0"),
        "coverage is not terminal",
    )
    for name in ("articles", "exclusions", "links"):
        batch[name].write.mode("errorifexists").parquet(f"{root}/{name}/batch_id={batch_id}")
    batch_summary(batch["articles"], batch["exclusions"], batch["links"]).write.mode(
        "errorifexists").parquet(f"{root}/summary/batch_id={batch_id}")


def touched_versions(articles: DataFrame, links: DataFrame) -> DataFrame:
    """Stored versions a batch refers to."""
    return articles.join(links.select("article_version_id"), "article_version_id", "left_semi")


def canonical_order(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Total order at the sink."""
    return df.orderBy(*columns)
