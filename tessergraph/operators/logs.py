"""The event log and audit tables: lookups, deduplication, runs, pages, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessergraph.functions.text import duration_ms


def by_id(events: DataFrame, event_id: str) -> DataFrame:
    return events.where(F.col("id") == event_id)


def by_source(events: DataFrame, source_type: str, external_id: str) -> DataFrame:
    return events.where((F.col("source_type") == source_type) & (F.col("source_external_id") == external_id))


def by_hash(events: DataFrame, content_hash: str) -> DataFrame:
    """More than one row means that the content was logged twice."""
    return events.where(F.col("content_hash") == content_hash)


def by_type(events: DataFrame, source_type: str) -> DataFrame:
    return events.where(F.col("source_type") == source_type).orderBy("created_at", "id")


def by_time(events: DataFrame) -> DataFrame:
    return events.orderBy("created_at", "id")


def since(events: DataFrame, when: str) -> DataFrame:
    return events.where(F.col("created_at") >= F.lit(when).cast("timestamp_ntz")).orderBy("created_at", "id")


def hash_duplicates(events: DataFrame) -> DataFrame:
    return events.groupBy("content_hash").agg(F.count("*").alias("n_events"), F.min("id").alias("first_id")).where("n_events > 1")


def deduplicated(events: DataFrame, keys: tuple[str, ...] = ("content_hash",)) -> DataFrame:
    """The first event of each key, by time and id."""
    return events.groupBy(*keys).agg(F.min_by("id", F.struct("created_at", "id")).alias("id"))


def embedding_of(vectors: DataFrame, event_id: str) -> DataFrame:
    return vectors.where(F.col("event_id") == event_id)


def unembedded(events: DataFrame, vectors: DataFrame) -> DataFrame:
    """Events without a vector, oldest first where their order is asked for by `by_time`."""
    return events.join(vectors.select(F.col("event_id").alias("id")), "id", "left_anti")


def latest_runs(runs: DataFrame) -> DataFrame:
    """The last run of each event, by its start."""
    last = runs.groupBy("event_id").agg(F.max_by(F.struct(*runs.columns), F.struct("started_at", "id")).alias("r"))
    return last.select("r.*")


def runs_page(runs: DataFrame, limit: int, before: str | None = None) -> DataFrame:
    """A page of runs, newest first, before a cursor; ``next_cursor`` is the last row's start if there are more."""
    found = runs if before is None else runs.where(F.col("started_at") < F.lit(before).cast("timestamp_ntz"))
    ahead = found.orderBy(F.desc("started_at"), "id").limit(limit + 1)
    page = ahead.orderBy(F.desc("started_at"), "id").limit(limit)
    bounds = ahead.agg(F.count("*").alias("n")).scalar()
    end = page.agg(F.min("started_at").alias("m")).scalar()
    return page.withColumn("next_cursor", F.when(bounds > limit, end))


def decisions_page(decisions: DataFrame, offset: int, limit: int, tier: int | None = None, decision: str | None = None, label: str | None = None) -> DataFrame:
    """A page of audit rows, newest first, with the number of all that match."""
    found = decisions
    for name, value in (("tier", tier), ("decision", decision), ("label", label)):
        if value is not None:
            found = found.where(F.col(name) == value)
    page = found.orderBy(F.desc("created_at"), "id").offset(offset).limit(limit)
    return page.withColumn("total_count", found.agg(F.count("*").alias("n")).scalar())


def count_since(decisions: DataFrame, when: str) -> DataFrame:
    return decisions.where(F.col("created_at") >= F.lit(when).cast("timestamp_ntz")).agg(F.count("*").alias("n"))


def percentiles(samples: DataFrame, group: str, value: str) -> DataFrame:
    """p50 and p95 with linear interpolation, greatest, mean and total."""
    return samples.groupBy(group).agg(*_spread(value))


def percentiles_overall(samples: DataFrame, group: str, value: str) -> DataFrame:
    """The same with one more row, ``overall``, for all groups together; its group is null."""
    return samples.rollup(group).agg((F.grouping(group) == 1).alias("overall"), *_spread(value))


def _spread(value: str) -> list[Column]:
    return [
        F.round(F.percentile(value, F.lit(0.5)), 6).alias("p50"), F.round(F.percentile(value, F.lit(0.95)), 6).alias("p95"),
        F.round(F.max(value), 6).alias("greatest"), F.round(F.avg(value), 6).alias("mean"), F.round(F.sum(value), 1).alias("total"),
    ]


def upper_median(samples: DataFrame, group: str, value: str) -> DataFrame:
    """The element at n div 2 of the sorted values, which first-token latency uses; not interpolated."""
    # Of the descending order, the first value with half of all at or before it; values are counted before they are dealt.
    return samples.groupBy(group).agg(F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{value}` DESC)").alias("p50"))


def latency_report(rows: DataFrame) -> DataFrame:
    """Over all questions: (first_token_ms, null where no answer was written; total_ms) -> how many, mean and upper median to the first token, mean in all."""
    return rows.agg(
        F.count("*").alias("n"), F.round(F.avg("first_token_ms"), 1).alias("mean_first_token_ms"),
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY first_token_ms DESC)").alias("p50_first_token_ms"), F.round(F.avg("total_ms"), 1).alias("mean_total_ms"),
    )


def counters(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"))


def with_durations(runs: DataFrame) -> DataFrame:
    return runs.withColumn("duration_ms", duration_ms(F.col("started_at"), F.col("completed_at")))
