"""Preference weights from scored feedback.

A step moves a weight from w to w + a (1 - w). So 1 - w is a product of factors 1 - a, which doesn't depend on their
order: the fold is a sum of logarithms, added up before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIMENSIONS = ("topics", "knowledge_types", "application_forms")


def feedback_tags(entries: DataFrame) -> DataFrame:
    """(entry_id, score, reason, dimension, tag) for each tag of the distinct scored entries."""
    scored = entries.select("entry_id", "feedback.score", "feedback.reason", "tags").filter("score is not null").distinct()

    def of(dimension: str) -> Column:
        return F.transform(F.array_distinct(F.coalesce(F.col(f"tags.{dimension}"), F.array())), lambda t: F.struct(F.lit(dimension).alias("dimension"), t.alias("tag")))

    tags = F.concat(*map(of, DIMENSIONS))
    return scored.select("entry_id", "score", "reason", F.explode(tags).alias("x")).select("entry_id", "score", "reason", "x.*")


def affinities(tags: DataFrame, alpha: float = 0.3, lukewarm: float = 0.1) -> DataFrame:
    """(dimension, tag, weight): relevant entries (4, 5) step by alpha, lukewarm ones (3) by a part of it."""
    step = F.when(F.col("score") >= 4, F.lit(alpha)).when(F.col("score") == 3, F.lit(alpha * lukewarm))
    return tags.withColumn("step", step).filter("step is not null").groupBy("dimension", "tag").agg((1 - F.exp(F.sum(F.log(1 - F.col("step"))))).alias("weight"))


def novelty_seeds(entries: DataFrame) -> DataFrame:
    """(tag, at): forms of new links in entries rated relevant (4, 5) that no earlier or equal rating had weighed, with
    their place in the order of ratings. entries: entry_id, feedback, tags, application_links."""
    rated = entries.select("entry_id", "feedback.score", F.struct("feedback.scored_at", "entry_id").alias("at"), "tags", "application_links").filter("score is not null").distinct()
    weighed = rated.filter("score >= 3").select(F.explode(F.coalesce("tags.application_forms", F.array().cast("array<string>"))).alias("tag"), "at").groupBy("tag").agg(F.min("at").alias("first"))
    new = rated.filter("score >= 4").select(F.explode("application_links").alias("x"), "at").filter("x.novelty_flag").select(F.col("x.application_form").alias("tag"), "at").filter("tag is not null").groupBy("tag").agg(F.min("at").alias("at"))
    return new.join(weighed, "tag", "left").filter(F.col("first").isNull() | (F.col("at") < F.col("first"))).select("tag", "at")


def seeded_affinities(tags: DataFrame, seeds: DataFrame, alpha: float = 0.3, lukewarm: float = 0.1) -> DataFrame:
    """``affinities`` with one step more for each form that a new link brought in before any rating weighed it."""
    more = seeds.select(F.lit("application_forms").alias("dimension"), "tag").distinct().withColumn("seed", F.lit(alpha))
    both = affinities(tags, alpha, lukewarm).join(more, ["dimension", "tag"], "full")
    weight = F.coalesce("weight", F.lit(0.0))
    return both.select("dimension", "tag", (weight + F.coalesce("seed", F.lit(0.0)) * (1 - weight)).alias("weight"))


def reason_counts(tags: DataFrame) -> DataFrame:
    """(dimension, tag, reasons MAP): how often each reason was given with a low score, of those that are held against
    a tag."""
    low = tags.filter("score <= 2 and reason = 'wrong_for_me'").groupBy("dimension", "tag", "reason").agg(F.count(F.lit(1)).alias("n"))
    return low.groupBy("dimension", "tag").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("reasons"))


def aversions(tags: DataFrame, alpha: float = 0.3) -> DataFrame:
    """(dimension, tag, weight, n): low scores for the reason 'wrong_for_me', with how often."""
    bad = tags.filter("score <= 2 and reason = 'wrong_for_me'")
    return bad.groupBy("dimension", "tag").agg((1 - F.pow(F.lit(1 - alpha), F.count(F.lit(1)))).alias("weight"), F.count(F.lit(1)).alias("n"))


def known_topics(tags: DataFrame) -> DataFrame:
    return tags.filter("score <= 2 and reason = 'already_knew' and dimension = 'topics'").select(F.col("tag").alias("topic")).distinct()


def confidence_by_month(entries: DataFrame, full: int = 30) -> DataFrame:
    """(month, n_entries, confidence): the confidence after each month, a part of one for every entry, never falling."""
    month = F.substring("meta.created_at", 1, 7)
    by = entries.select("entry_id", month.alias("month")).distinct().groupBy("month").agg(F.count(F.lit(1)).alias("n_entries"))
    # One row a month: the window runs over months, not over entries.
    total = F.sum("n_entries").over(Window.orderBy("month").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return by.withColumn("confidence", F.least(F.lit(1.0), total / F.lit(float(full)))).select("month", "n_entries", "confidence")
