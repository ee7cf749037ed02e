"""Evaluation: set and ranking metrics, calibration, error taxonomy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessergraph.operators import pairs as blocks


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def _prf(counts: DataFrame, *by: str) -> DataFrame:
    precision, recall = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(F.lit(0.0))
    return counts.select(*by, "tp", "fp", "fn", F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(f1, 6).alias("f1"))


def _sides(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    a = expected.select(*keys).distinct().withColumn("e", F.lit(1))
    b = found.select(*keys).distinct().withColumn("f", F.lit(1))
    return a.join(b, keys, "full").fillna(0, ["e", "f"])


def _counts() -> list[Column]:
    return [F.coalesce(F.sum(x), F.lit(0)).cast("long").alias(n) for x, n in ((F.expr("e * f"), "tp"), (F.expr("(1 - e) * f"), "fp"), (F.expr("e * (1 - f)"), "fn"))]


def prf(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Precision, recall and F1 of sets; of empty sets 0."""
    return _prf(_sides(expected, found, keys).agg(*_counts()))


def prf_by(expected: DataFrame, found: DataFrame, keys: list[str], group: str) -> DataFrame:
    """The same for every group that either side has; ``group`` is one of the keys."""
    return _prf(_sides(expected, found, keys).groupBy(group).agg(*_counts()), group)


def recall_mrr(ranked: DataFrame, expected: DataFrame, k: int = 10) -> DataFrame:
    """recall@k and reciprocal rank per question. ranked: (question, item, place from 1); expected: (question, item), null item where nothing is expected, which recalls 1."""
    asked = expected.groupBy("question").agg(F.count("item").alias("wanted"))
    hits = ranked.where(F.col("place") <= k).join(expected.where("item IS NOT NULL"), ["question", "item"])
    return _recalled(asked, hits)


def recall_mrr_by_group(ranked: DataFrame, questions: DataFrame, items: DataFrame, k: int = 10, own: bool = False) -> DataFrame:
    """The same where right are all items of the question's group, which are counted, not listed. questions: (question, group), null group where nothing is expected; items: (item, group).

    own: each question is an item of its group, too, and not to be found.
    """
    sizes = items.groupBy("group").agg((F.count("item") - int(own)).alias("size"))
    asked = questions.join(sizes, "group", "left").select("question", F.coalesce("size", F.lit(0)).alias("wanted"))
    hits = ranked.where(F.col("place") <= k).join(questions, "question").join(items, ["item", "group"])
    return _recalled(asked, hits)


def _recalled(asked: DataFrame, hits: DataFrame) -> DataFrame:
    met = asked.join(hits.groupBy("question").agg(F.count("*").alias("hits"), F.min("place").alias("best")), "question", "left")
    return met.select(
        "question",
        F.round(F.when(F.col("wanted") == 0, 1.0).otherwise(F.coalesce("hits", F.lit(0)) / F.col("wanted")), 6).alias("recall"),
        F.round(F.coalesce(1.0 / F.col("best"), F.lit(0.0)), 6).alias("reciprocal_rank"),
    )


def search_report(per_question: DataFrame, least_recall: float = 0.7, least_mrr: float = 0.5) -> DataFrame:
    means = per_question.agg(F.round(F.avg("recall"), 6).alias("mean_recall"), F.round(F.avg("reciprocal_rank"), 6).alias("mrr"))
    return means.withColumn("passed", (F.col("mean_recall") >= least_recall) & (F.col("mrr") >= least_mrr))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; of two empty ones 1."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def calibration(rated: DataFrame) -> DataFrame:
    """Mean confidence of right and wrong rows (confidence, correct); miscalibrated if the wrong are no less confident."""
    out = rated.agg(
        F.round(F.avg(F.when(F.col("correct"), F.col("confidence"))), 6).alias("mean_correct"),
        F.round(F.avg(F.when(~F.col("correct"), F.col("confidence"))), 6).alias("mean_incorrect"),
    )
    return out.withColumn("miscalibrated", F.coalesce(F.col("mean_incorrect") >= F.col("mean_correct"), F.lit(False)))


def failure_modes(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(mode, n, examples): expected and found have (kind, key, type). Keys of either that the other lacks, or has under another type; at most three examples."""
    e = expected.groupBy("kind", "key").agg(F.sort_array(F.collect_set("type")).alias("et"))
    f = found.groupBy("kind", "key").agg(F.sort_array(F.collect_set("type")).alias("ft"))
    met = e.join(f, ["kind", "key"], "full")
    mode = (
        F.when(F.col("ft").isNull(), F.concat(F.lit("missed_"), "kind"))
        .when(F.col("et").isNull(), F.concat(F.lit("invented_"), "kind"))
        .when(F.col("et") != F.col("ft"), F.concat(F.lit("mistyped_"), "kind"))
    )
    wrong = met.select("key", mode.alias("mode")).where("mode IS NOT NULL")
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("mode").orderBy("key"))
    examples = wrong.withColumn("place", place).where("place <= 3").groupBy("mode").agg(F.array_join(F.sort_array(F.collect_list("key")), ",").alias("examples"))
    return wrong.groupBy("mode").agg(F.count("*").alias("n")).join(examples, "mode")


#: The modes' names by kind.
MODES = {
    "entity": ("missed_entity", "spurious_entity", "wrong_entity_type"),
    "relationship": ("missed_relationship", "spurious_relationship", "wrong_relationship_type"),
}


def failure_report(expected: DataFrame, found: DataFrame, aliases: DataFrame) -> DataFrame:
    """(mode, n): what an extraction missed, made up or mistyped, and aliases that were not merged.

    expected and found: (kind, key, type), kind as in MODES. aliases: (canonical,
    surface) of the mentions found; a canonical name under several surfaces
    counts once as alias_not_merged.
    """
    e = expected.groupBy("kind", "key").agg(F.sort_array(F.collect_set("type")).alias("et"))
    f = found.groupBy("kind", "key").agg(F.sort_array(F.collect_set("type")).alias("ft"))
    met, mode = e.join(f, ["kind", "key"], "full"), F.lit(None).cast("string")
    for kind, (missed, spurious, wrong) in MODES.items():
        named = F.when(F.col("ft").isNull(), missed).when(F.col("et").isNull(), spurious).when(F.col("et") != F.col("ft"), wrong)
        mode = F.when(F.col("kind") == kind, named).otherwise(mode)
    apart = aliases.groupBy("canonical").agg(F.countDistinct("surface").alias("n")).where("n > 1").select(F.lit("alias_not_merged").alias("mode"))
    return met.select(mode.alias("mode")).where("mode IS NOT NULL").union(apart).groupBy("mode").agg(F.count("*").alias("n"))


STRUCTURAL_ROUTES = ("get_entity", "neighbors", "enumerate", "aggregate")


def agent_summary(rows: DataFrame) -> DataFrame:
    """Over all questions: (expected_route, actual_route, synthesized, first_try, overlap, cost, latency_ms).

    Refusals count among questions that should be refused, first tries among
    answers that were written, overlap where it is known, and structural
    accuracy among the structural routes; of nothing each is 0.
    """
    right = (F.col("expected_route") == F.col("actual_route")).cast("double")

    def mean(value: Column, where: Column | None = None) -> Column:
        return F.round(F.coalesce(F.avg(value if where is None else F.when(where, value)), F.lit(0.0)), 6)

    return rows.agg(
        F.count("*").alias("n"), mean(right).alias("route_accuracy"), mean(right, F.col("expected_route").isin(*STRUCTURAL_ROUTES)).alias("structural_accuracy"),
        mean(right, F.col("expected_route") == "unknown").alias("refusal_correctness"), mean(F.col("first_try").cast("double"), F.col("synthesized")).alias("first_try_rate"),
        mean(F.col("overlap")).alias("mean_overlap"), mean(F.col("cost")).alias("mean_cost"), F.round(F.coalesce(F.avg("latency_ms"), F.lit(0.0)), 1).alias("mean_latency_ms"),
    )


def agent_report(rows: DataFrame) -> DataFrame:
    """By route: rows (route, chosen, refused, should_refuse, first_try, cost, latency_ms)."""
    return rows.groupBy("route").agg(
        F.count("*").alias("n"),
        F.round(F.avg((F.col("route") == F.col("chosen")).cast("double")), 6).alias("route_accuracy"),
        F.round(F.avg((F.col("refused") == F.col("should_refuse")).cast("double")), 6).alias("refusal_correctness"),
        F.round(F.avg(F.col("first_try").cast("double")), 6).alias("first_try_rate"),
        F.round(F.avg("cost"), 6).alias("mean_cost"), F.round(F.avg("latency_ms"), 1).alias("mean_latency_ms"),
    )


def ingest_report(rows: DataFrame) -> DataFrame:
    """rows: (ok, passed, latency_ms, cost)."""
    return rows.agg(
        F.count("*").alias("n"), F.round(F.avg(F.col("ok").cast("double")), 6).alias("success_rate"), F.round(F.avg(F.col("passed").cast("double")), 6).alias("pass_rate"),
        F.round(F.avg("latency_ms"), 1).alias("mean_latency_ms"), F.round(F.avg("cost"), 6).alias("mean_cost"),
    )


def truth_pairs(groups: DataFrame) -> DataFrame:
    """All pairs a < b of each alias group (group, member), once each.

    Members meet in blocks of a group. A pair of several groups counts in the
    least one that both have, so the pairs themselves are neither shuffled nor
    held to be told apart.
    """
    known = groups.where("group IS NOT NULL AND member IS NOT NULL").groupBy("member").agg(F.collect_set("group").alias("_all"))
    pairs = blocks.met(known.select("member", "_all", F.explode("_all").alias("group")), ["group"], "member")
    least = F.array_min(F.array_intersect("a._all", "b._all")) == F.col("a.group")
    alone = (F.size("a._all") == 1) | (F.size("b._all") == 1)
    return pairs.where(F.when(alone, True).otherwise(least)).select(F.col("a.member").alias("a"), F.col("b.member").alias("b"))
