"""Canonical groups: what answers decide about items becomes memberships and new groups, the same run after run.

A run takes the memberships of its entries back, reads the decisions on their items, and files matches and new groups.
All entries of a run are taken together: groups that one of them makes are offered to later runs only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.jsonx import answer_items, relation_of
from millrace.functions.text import slugify, strip, title_key
from millrace.operators.knowledge import decided
from millrace.plans.session import cut_lineage

#: The relations between entries and between groups.
ENTRY_RELATIONS = ("supports", "contradicts", "same_principle", "extends", "prerequisite_of")
GROUP_RELATIONS = ("contrasts_with", "builds_on", "related")
_DECISION = "item_id string, decision string, concept_id string, title string"


def decisions(answers: DataFrame, items: DataFrame, offered: DataFrame) -> DataFrame:
    """Decisions on items: (entry_id, item_id, action, group_id, title).

    answers: entry_id, response, the raw answer with an array of decisions; items: entry_id, item_id; offered: entry_id,
    item_id, group_id STRING. Decisions on unknown items are dropped, the first on an item counts, an unknown one and a
    match with a group that wasn't offered is a rejection. An answer that can't be read decides nothing.
    """
    read = answers.select("entry_id", F.posexplode(answer_items(F.col("response"))["items"]).alias("seq", "json"))
    rows = read.select("entry_id", "seq", F.from_json("json", _DECISION).alias("x")).filter("x.item_id is not null")
    known = rows.select("entry_id", "seq", "x.*").join(items.select("entry_id", "item_id").distinct(), ["entry_id", "item_id"], "left_semi")
    key = F.struct("entry_id", "item_id").alias("item_key")
    of_item = known.select(key, "seq", F.col("decision").alias("action"), F.col("concept_id").alias("group_id"), "title")
    return decided(of_item, offered.select(key, "group_id")).select("item_key.entry_id", "item_key.item_id", "action", "group_id", "title")


def free_slugs(wanted: DataFrame, taken: DataFrame) -> DataFrame:
    """(key, slug): a slug for each key, none of them taken and no two alike.

    wanted: key, base STRING, place (orderable); taken: slug. In order of place the first of a base gets the base itself,
    the others -2, -3 and so on, leaving out what is taken. Where bases end in numbers themselves ("top", "top-2"), the
    later of two equal slugs is given out again, until no two are equal.
    """
    given = None
    open_ = wanted.select("key", "base", "place")
    while True:
        used = taken.select("slug") if given is None else taken.select("slug").unionAll(given.select("slug"))
        counted = open_.groupBy("base").agg(F.count(F.lit(1)).alias("n"))
        # "top-2" takes number 1 of "top-2" and number 2 of "top".
        number = F.regexp_extract("slug", r"^(.*)-(\d{1,9})$", 2).try_cast("long")
        both = used.distinct().select(F.col("slug").alias("base"), F.lit(1).cast("long").alias("number")).unionAll(used.distinct().select(F.regexp_extract("slug", r"^(.*)-(\d{1,9})$", 1).alias("base"), number.alias("number")).filter("number >= 2"))
        blocked = both.groupBy("base").agg(F.collect_set("number").alias("blocked"))
        room = counted.join(blocked, "base", "left").withColumn("blocked", F.coalesce("blocked", F.array().cast("array<long>")))
        numbers = F.array_except(F.sequence(F.lit(1).cast("long"), F.col("n") + F.size("blocked")), F.col("blocked"))
        free = room.select("base", F.posexplode(numbers).alias("k", "number"))
        ranked = open_.withColumn("k", F.row_number().over(Window.partitionBy("base").orderBy("place")) - 1)
        slug = F.when(F.col("number") == 1, F.col("base")).otherwise(F.concat_ws("-", "base", "number"))
        made = cut_lineage(ranked.join(free, ["base", "k"]).select("key", "base", "place", slug.alias("slug")))
        nth = made.withColumn("nth", F.row_number().over(Window.partitionBy("slug").orderBy("place", "base")))
        fine = nth.filter("nth = 1").select("key", "slug")
        given = fine if given is None else given.unionAll(fine)
        open_ = nth.filter("nth > 1").select("key", "base", "place")
        if open_.isEmpty():
            return given


def canonicalized(groups: DataFrame, members: DataFrame, entries: DataFrame, decided_items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(groups, members, touched) after a run.

    groups: group_id STRING, title; members: group_id, entry_id, item_id; entries of the run: entry_id, place (their
    order); decided_items as ``decisions`` gives them, of these entries, optionally with a kind inside which titles meet.
    The entries' old memberships are taken back and groups without a member are gone; matches join groups that are
    left; new titles of one entry that are equal but for signs and case are one new group, whose id is the slug of the
    title. touched: group_id, entry_id.
    """
    # Both are read several times.
    decided_items = cut_lineage(decided_items)
    kept = cut_lineage(members.join(entries.select("entry_id").distinct(), "entry_id", "left_anti").select("group_id", "entry_id", "item_id"))
    left = groups.join(kept.select("group_id").distinct(), "group_id", "left_semi").select("group_id", "title")
    matched = decided_items.filter("action = 'match'").join(left.select("group_id"), "group_id", "left_semi").select("group_id", "entry_id", "item_id")
    kind = F.col("kind") if "kind" in decided_items.columns else F.lit("")
    named = decided_items.filter("action = 'new'").select("entry_id", "item_id", kind.alias("kind"), strip(F.col("title")).alias("title")).filter("title <> ''").withColumn("key", title_key(F.col("title")))
    made = named.groupBy("entry_id", "kind", "key").agg(F.min_by("title", "item_id").alias("title")).join(entries.select("entry_id", "place"), "entry_id")
    base = F.coalesce(F.nullif(slugify(F.col("title")), F.lit("")), F.lit("group"))
    ids = free_slugs(made.select(F.struct("entry_id", "kind", "key").alias("key"), base.alias("base"), F.struct("place", "entry_id", "kind", "key").alias("place")), left.select(F.col("group_id").alias("slug")))
    new = made.join(ids.select("key.*", F.col("slug").alias("group_id")), ["entry_id", "kind", "key"])
    filed = named.select("entry_id", "item_id", "kind", "key").join(new.select("entry_id", "kind", "key", "group_id"), ["entry_id", "kind", "key"]).select("group_id", "entry_id", "item_id")
    after = kept.unionAll(matched).unionAll(filed).distinct()
    return left.unionAll(new.select("group_id", "title")), after, matched.unionAll(filed).select("group_id", "entry_id").distinct()


def labelled(candidates: DataFrame, answers: DataFrame, relations: tuple[str, ...]) -> DataFrame:
    """(source, target, relation): candidate pairs with the relation that the raw answer on them names; a pair without an
    answer or with another relation is dropped. candidates: source, target; answers: source, target, response."""
    read = answers.select("source", "target", relation_of(F.col("response")).alias("relation"))
    return candidates.select("source", "target").distinct().join(read, ["source", "target"]).filter(F.col("relation").isin(*relations)).distinct()


def replaced_edges(edges: DataFrame, new: DataFrame, ready: DataFrame, groups: DataFrame) -> DataFrame:
    """Edges with those of the ready sources replaced as a whole by the new ones, and none to or from a group that is
    gone. edges, new: source, target, relation; ready (not pending), groups: group_id."""
    sources, there = ready.select(F.col("group_id").alias("source")).distinct(), groups.select("group_id").distinct()
    both = edges.join(sources, "source", "left_anti").select("source", "target", "relation").unionAll(new.join(sources, "source", "left_semi").select("source", "target", "relation")).distinct()
    for side in ("source", "target"):
        both = both.join(there.withColumnRenamed("group_id", side), side, "left_semi")
    return both.select("source", "target", "relation")


def delete_cascade(gone: DataFrame, tables: dict[str, DataFrame], members: DataFrame, groups: DataFrame) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    """(tables, members, groups) without the given entries (entry_id): their rows in every table, their memberships, and
    the groups that this leaves without a member. Groups that had none before stay."""
    keys = gone.select("entry_id").distinct()
    left = members.join(keys, "entry_id", "left_anti")
    emptied = members.select("group_id").distinct().join(left.select("group_id").distinct(), "group_id", "left_anti")
    return {name: t.join(keys, "entry_id", "left_anti") for name, t in tables.items()}, left, groups.join(emptied, "group_id", "left_anti")


def split_citations(cited: Column, retrieved: Column) -> tuple[Column, Column]:
    """(grounded, ungrounded) citations: those that were retrieved and those that weren't, in order and with repeats."""
    known = F.coalesce(retrieved, F.array().cast("array<string>"))
    of = F.coalesce(cited, F.array().cast("array<string>"))
    return F.filter(of, lambda c: F.array_contains(known, c)), F.filter(of, lambda c: ~F.array_contains(known, c))
