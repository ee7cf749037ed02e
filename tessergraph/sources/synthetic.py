"""A deterministic event log of any size, with planted aliases, supersessions and contradictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds of events in the order in which they take turns, with the words they are told in.
KINDS = {
    "ownership": ("doc", "Team {team} owns {service} since this week."),
    "dependency": ("doc", "{service} depends on {other} for its requests."),
    "decision": ("doc", "{decision}: {service} moves to {system}."),
    "supersession": ("doc", "{decision} supersedes {older} for {service}."),
    "opposition": ("slack_message", "{person}: actually we should keep {service} where it is, not {decision}."),
    "talk": ("slack_message", "{person}: {service} looks fine today."),
}


def event_log(spark: SparkSession, n: int, teams: int = 5, services: int = 12, people: int = 13, systems: int = 5) -> DataFrame:
    """n events, drawn from their number alone: the same everywhere and in any partitioning."""

    def draw(salt: int, most: int) -> Column:
        return F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(most))

    def named(prefix: str, salt: int, most: int) -> Column:
        return F.concat(F.lit(prefix), draw(salt, most).cast("string"))

    decision = F.concat(F.lit("D-"), F.lpad((F.col("id") % 9000).cast("string"), 4, "0"))
    older = F.concat(F.lit("D-"), F.lpad(F.greatest(F.col("id") % 9000 - 1 - draw(7, 5), F.lit(0)).cast("string"), 4, "0"))
    service = named("svc-", 1, services)
    parts = {
        "team": named("team-", 2, teams), "service": F.when(draw(3, 10) == 0, F.upper(service)).otherwise(service), "other": named("svc-", 4, services), "system": named("sys-", 5, systems),
        "person": named("@person", 6, people), "decision": decision, "older": older,
    }
    content, source = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, (kind, words) in enumerate(KINDS.values()):
        told = F.lit(words)
        for name, value in parts.items():
            if "{" + name + "}" in words:
                told = F.replace(told, F.lit("{" + name + "}"), value)
        turn = F.col("id") % len(KINDS) == i
        content, source = F.when(turn, told).otherwise(content), F.when(turn, kind).otherwise(source)
    at = F.timestamp_add("MINUTE", F.col("id") * 30 + draw(8, 20), F.lit("2026-01-01").cast("timestamp_ntz"))
    key = F.format_string("synthetic-%08d", F.col("id"))
    return spark.range(n).select(key.alias("id"), source.alias("source_type"), key.alias("source_external_id"), content.alias("content"), at.alias("created_at"))
