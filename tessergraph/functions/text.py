"""Text rules: names, snippets, citations, tags in texts, JSON verdicts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Substrings of a lower-case text that mark it as opposing something.
OPPOSITION_CUES = (
    "not ", "n't", "should not", "stale", "deprecated", "stop ", "no longer",
    "instead", "contradic", "disagree", "shouldn", "don't", "won't",
)
#: Properties that extractors can't set.
RESERVED = ("id", "canonical_name", "canonical_id", "source_event_ids", "created_at")
#: Patterns of a decision's formal id, of what a text says is superseded, and of a citation.
FORMAL_ID = r"^D-\d{3,4}$"
SUPERSEDED = r"(?i)supersed\w*\s+(?:the\s+)?(D-\d{3,4})"
CITATION = r"\[evt:\s*([^\]]+?)\s*\]"


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def normalized(text: Column) -> Column:
    """Lower case, without leading @, other characters than a-z and 0-9 as single dashes, none at the ends; may be empty."""
    bare = F.regexp_replace(F.lower(strip(text)), "^@+", "")
    return F.regexp_replace(F.regexp_replace(bare, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def slug(text: Column) -> Column:
    name = normalized(text)
    return F.when(name == "", "unknown").otherwise(name)


def key_value(label: Column, name: Column) -> Column:
    return F.when(label == "Person", slug(name)).otherwise(name)


def snippet(text: Column, size: int = 200) -> Column:
    return F.substring(text, 1, size)


def audit_snippet(text: Column, size: int = 140) -> Column:
    """One line, trimmed, with an ellipsis if cut."""
    line = strip(F.translate(text, "\n", " "))
    return F.when(F.length(line) > size, F.concat(F.rtrim(F.substring(line, 1, size)), F.lit("…"))).otherwise(line)


def content_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def fallback_external_id(text: Column) -> Column:
    return F.concat(F.lit("ingest-"), F.substring(content_hash(text), 1, 24))


def message_id(source: Column, external: Column) -> Column:
    return F.concat_ws(":", source, external)


def supersedes_target(text: Column, own_id: Column) -> Column:
    """The first decision id that the text says is superseded, other than its own; null if none."""
    found = F.regexp_extract_all(text, F.lit(SUPERSEDED), F.lit(1))
    return F.try_element_at(F.filter(found, lambda x: x != own_id), F.lit(1))


def is_formal_id(name: Column) -> Column:
    return name.rlike(FORMAL_ID)


def has_opposition_cue(text: Column) -> Column:
    low = F.lower(text)
    hit = F.lit(False)
    for cue in OPPOSITION_CUES:
        hit = hit | low.contains(cue)
    return hit


def mentions(text: Column, name: Column) -> Column:
    """The name as a whole word, in its own case."""
    return F.regexp_like(text, F.concat(F.lit(r"\b"), F.regexp_replace(name, r"([^\w])", r"\\$1"), F.lit(r"\b")))


def inline_citations(text: Column) -> Column:
    """Cited event ids in order, each once."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(CITATION), F.lit(1)))


def without_fences(text: Column) -> Column:
    """A reply's content without a code fence around it."""
    return strip(F.regexp_replace(strip(text), r"(?s)^```(?:json)?\s*(.*?)\s*```$", "$1"))


def verdict(raw: Column, flag: str) -> Column:
    """{flag, confidence, reasoning} of a JSON reply; what can't be read is a refusal of confidence 0."""
    read = F.from_json(without_fences(raw), f"{flag} boolean, confidence double, reasoning string")
    good = read[flag].isNotNull() & read["confidence"].between(0, 1)
    return F.struct(
        F.when(good, read[flag]).otherwise(False).alias(flag),
        F.when(good, read["confidence"]).otherwise(0.0).alias("confidence"),
        F.when(good, F.coalesce(read["reasoning"], F.lit(""))).otherwise("unreadable reply").alias("reasoning"),
    )


def safe_properties(props: Column, reserved: tuple[str, ...] = RESERVED) -> Column:
    """A string map without reserved names and null values."""
    return F.map_filter(props, lambda k, v: ~k.isin(*reserved) & v.isNotNull())


def properties_block(props: Column, hidden: tuple[str, ...] = ("source_event_ids", "created_at")) -> Column:
    """Sorted ``k='v'`` list."""
    shown = F.map_entries(F.map_filter(props, lambda k, v: ~k.isin(*hidden)))
    listed = F.array_join(F.array_sort(F.transform(shown, lambda e: F.concat(e["key"], F.lit("='"), e["value"], F.lit("'")))), ", ")
    return F.when(F.size(shown) > 0, listed).otherwise("(none)")


def embedding_input(label: Column, more: tuple[str, ...] = ()) -> Column:
    """Text by which a node is compared: its label's fields, joined by |, without empty ones.

    more: which of the optional columns email and aliases (an array) there are.
    """

    def filled(column: Column) -> Column:
        return F.nullif(column, F.lit(""))

    def parts(*columns: Column) -> Column:
        return F.concat_ws("|", *(filled(c) for c in columns))

    def named(name: str) -> Column:
        return F.coalesce(filled(F.col(name)), F.col("id"))

    email = [F.col("email")] if "email" in more else []
    aliases = [F.array_join("aliases", " ")] if "aliases" in more else []
    return (
        F.when(label == "Person", parts(named("display_name"), F.col("handle"), *email))
        .when(label.isin("Service", "System"), parts(named("canonical_name"), *aliases))
        .when(label == "Team", parts(named("canonical_name"), F.col("display_name")))
        .otherwise(parts(F.col("id"), F.col("title")))
    )


def decision_text(title: Column, body: Column, key: Column) -> Column:
    """What a decision says, for comparing contents: title and body, or else its id."""
    said = strip(F.concat_ws(" ", title, body))
    return F.when(said != "", said).otherwise(key)


def duration_ms(started: Column, completed: Column) -> Column:
    """Milliseconds with one decimal; null while it runs."""
    return F.round(F.timestamp_diff("MICROSECOND", started, completed) / 1000.0, 1)


def handle_at_age(handle: Column, former: Column, age_days: Column) -> Column:
    """The former handle in texts of at least 120 days ago."""
    return F.when((age_days >= 120) & former.isNotNull(), former).otherwise(handle)


def prompt_fingerprint(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\u001f", *parts).cast("binary"), 256)
