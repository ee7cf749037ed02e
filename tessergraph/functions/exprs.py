"""Column builders for nodes, edges and events. Everything stays an expression Catalyst can see."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LABELS = ("Person", "Team", "Service", "System", "Decision", "Message")
MERGE = "MERGE_INTO"
#: The name field of each label, and which labels each edge type may join.
KEY_FIELDS = {
    "Person": "canonical_id", "Team": "canonical_name", "Service": "canonical_name", "System": "canonical_name", "Decision": "id", "Message": "id",
}
ENDPOINTS = {
    "DEPENDS_ON": (("Service",), ("Service", "System")),
    "OWNED_BY": (("Service", "System"), ("Person", "Team")),
    "MEMBER_OF": (("Person",), ("Team",)),
    "DEPRECATES": (("Decision",), ("System",)),
    "ABOUT": (("Decision",), ("System", "Service")),
    "APPROVED_BY": (("Decision",), ("Person",)),
    "AUTHORED": (("Person",), ("Decision",)),
    "MENTIONS": (("Person",), ("Service", "System", "Team", "Decision", "Person")),
    "CONTRADICTS": (("Person", "Message"), ("Decision",)),
    "SUPERSEDES": (("Decision",), ("Decision",)),
}


def at(alias: str | None, name: str) -> Column:
    return F.col(f"{alias}.{name}" if alias else name)


def effective_status(alias: str | None = None) -> Column:
    return F.coalesce(at(alias, "status"), F.lit("active"))


def resolved(alias: str | None = None) -> Column:
    """The node is not merged into another."""
    return effective_status(alias) != "merged"


def status_mode(mode: str, alias: str | None = None) -> Column:
    """active: anything not merged, deprecated or superseded; deprecated: these two; all: anything not merged."""
    status = effective_status(alias)
    if mode == "active":
        return ~status.isin("merged", "deprecated", "superseded")
    if mode == "deprecated":
        return status.isin("deprecated", "superseded")
    if mode == "all":
        return status != "merged"
    raise ValueError(f"status mode {mode!r}")


def display_name(alias: str | None = None) -> Column:
    return F.coalesce(*(at(alias, c) for c in ("canonical_name", "canonical_id", "title", "id")))


def identities(alias: str | None = None) -> Column:
    """Lower-case names a node answers to."""
    return F.array_compact(F.array(*(F.lower(at(alias, c)) for c in ("canonical_id", "canonical_name", "id", "handle"))))


def answers_to(name: str, alias: str | None = None) -> Column:
    return F.array_contains(identities(alias), name.lower())


def in_window(when: Column, as_of: str, days: int) -> Column:
    """Inclusive at both ends; as_of is a timestamp without zone."""
    end = F.lit(as_of).cast("timestamp_ntz")
    return when.between(end - F.expr(f"interval {int(days)} days"), end)


def view_label(alias: str | None = None) -> Column:
    """What a drawing of the graph shows at a node."""
    content = at(alias, "content")
    short = F.when(F.length(content) > 48, F.concat(F.substring(content, 1, 48), F.lit("…"))).otherwise(content)
    label = at(alias, "label")
    return (
        F.when(label == "Decision", F.coalesce(at(alias, "title"), at(alias, "id")))
        .when(label == "Person", F.coalesce(at(alias, "display_name"), at(alias, "canonical_id")))
        .when(label.isin("Service", "System", "Team"), at(alias, "canonical_name"))
        .otherwise(short)
    )


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two arrays in double; 0 if one has no length; within -1 and 1."""
    a, b = (F.transform(F.col(x) if isinstance(x, str) else x, lambda v: v.cast("double")) for x in (a, b))

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / norm))).otherwise(F.lit(0.0))


def graph_signal(count: Column) -> Column:
    """About 1 at nine entities; not clamped."""
    return F.log1p(count.cast("double")) / F.log(F.lit(10.0))


def blended(similarity: Column, signal: Column, vector_weight: float = 0.7, graph_weight: float = 0.3) -> Column:
    score = F.lit(vector_weight) * similarity + F.lit(graph_weight) * signal
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 6)


def stamp(when: Column) -> Column:
    return F.date_format(when, "yyyy-MM-dd HH:mm:ss")


def iso(when: Column) -> Column:
    """ISO 8601 with microseconds where there are any; without a zone, as the column has none."""
    plain = F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(F.date_format(when, "SSSSSS") == "000000", plain).otherwise(F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def jsonable(*columns: str) -> Column:
    """A JSON object of the columns, without nulls; times in ISO 8601."""
    return F.to_json(F.struct(*columns), {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]XXX"})


def joined(values: Column) -> Column:
    """Sorted distinct values as one string."""
    return F.array_join(F.sort_array(F.collect_set(values)), ",")
