"""Concepts, entities and their edges; decisions on candidates; grounding of notes and claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import ascii_tokens, first_words, strip, title_key, topics_capped
from millrace.operators.retrieval import top_k

SIM_FLOOR, EMBED_POOL, MAX_CANDIDATES, MAX_EDGES = 0.55, 8, 5, 3


def valid_ids(ids: Column, valid: Column) -> Column:
    """The ids that are valid, each once, in order."""
    return F.array_distinct(F.filter(F.coalesce(ids, F.array()), lambda i: F.array_contains(valid, i)))


def candidates(queries: DataFrame, groups: DataFrame, floor: float = SIM_FLOOR, pool: int = EMBED_POOL, most: int = MAX_CANDIDATES) -> DataFrame:
    """Candidate groups of each query: (query_id, group_id, similarity, rank).

    queries: id, vector, text; groups: group_id BIGINT, vector, text. The best ``pool`` groups at or above the floor and
    all that share an ASCII token with the query make the pool, of which the best ``most`` stay. A group that shares a
    token is among the best ``most`` of the pool only if it is among the best ``most`` that do, so both searches hand on
    a few rows for each query, however common a token is.
    """
    tokens = F.transform(ascii_tokens(F.col("text")), lambda t: F.xxhash64(t)).alias("tokens")
    rows = groups.select(F.col("group_id").alias("id"), "vector", tokens)
    # A query's own id is no group's id: the queries are moved out of the way.
    away = F.lit(1 << 40)
    moved = queries.select((F.col("id") + away).alias("id"), "vector", tokens)
    both = top_k(moved.drop("tokens"), rows, pool, floor).unionAll(top_k(moved, rows, most))
    once = both.groupBy((F.col("query_id") - away).alias("query_id"), F.col("id").alias("group_id")).agg(F.max("similarity").alias("similarity"))
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "group_id")
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def group_edges(group_vectors: DataFrame, floor: float = SIM_FLOOR, most: int = MAX_EDGES, touched: DataFrame | None = None) -> DataFrame:
    """The most similar other groups of each group above the floor: (source, target, similarity, rank).

    group_vectors: group_id BIGINT, vector; a group without a vector has no edges. ``touched`` (group_id) limits the
    sources to the groups that changed; they are searched for in blocks against all groups.
    """
    rows = group_vectors.filter("vector is not null and size(vector) > 0").select(F.col("group_id").alias("id"), "vector")
    sources = rows if touched is None else rows.join(touched.select(F.col("group_id").alias("id")).distinct(), "id", "left_semi")
    return top_k(sources, rows, most, floor).select(F.col("query_id").alias("source"), F.col("id").alias("target"), "similarity", "rank")


def decided(answers: DataFrame, offered: DataFrame) -> DataFrame:
    """Decisions on items: (item_key, action, group_id, title).

    answers: item_key, seq, action, group_id, title; offered: item_key, group_id. The first answer for an item counts;
    an action that isn't known, and a match with a group that wasn't offered, is a rejection.
    """
    first = answers.groupBy("item_key").agg(F.min_by(F.struct("action", "group_id", "title"), "seq").alias("x")).select("item_key", "x.*")
    known = F.when(F.lower("action").isin("match", "new", "reject"), F.lower("action")).otherwise("reject")
    checked = first.withColumn("action", known).join(offered.select("item_key", "group_id").distinct().withColumn("ok", F.lit(True)), ["item_key", "group_id"], "left")
    action = F.when((F.col("action") == "match") & F.col("ok").isNull(), "reject").otherwise(F.col("action"))
    return checked.select("item_key", action.alias("action"), F.when(action == "match", F.col("group_id")).alias("group_id"), F.when(action == "new", F.col("title")).alias("title"))


def new_groups(named: DataFrame) -> DataFrame:
    """New names met by (kind, title without case and extra blanks): (kind, key, title, entry_id, n_members, n_entries).

    named: kind, title, entry_id, pos. The title is that of the first member in order of (entry_id, pos). Names without a
    letter or digit are left out.
    """
    rows = named.withColumn("key", title_key(F.col("title"))).filter("key <> ''")
    return rows.groupBy("kind", "key").agg(
        F.min_by("title", F.struct("entry_id", "pos", "title")).alias("title"), F.min("entry_id").alias("entry_id"), F.count(F.lit(1)).alias("n_members"), F.countDistinct("entry_id").alias("n_entries")
    )


def entity_mentions(items: DataFrame, kinds: tuple[str, ...] = ("tool", "person", "organization"), most_words: int = 14) -> DataFrame:
    """(entry_id, item_id, pos STRUCT<item_pos, mention_pos>, kind, name, quote): mentions with a known kind, a name and
    a quote of at most ``most_words`` words, of longer ones the first."""
    each = items.select("entry_id", "item_id", F.col("pos").alias("item_pos"), F.posexplode("entity_mentions").alias("pos", "m"))
    good = F.col("m.kind").isin(*kinds) & (strip(F.coalesce("m.name", F.lit(""))) != "") & (strip(F.coalesce("m.quote", F.lit(""))) != "")
    return each.filter(good).select("entry_id", "item_id", F.struct("item_pos", F.col("pos").alias("mention_pos")).alias("pos"), "m.kind", strip(F.col("m.name")).alias("name"), first_words(strip(F.col("m.quote")), most_words).alias("quote"))


def sharing_tags(queries: DataFrame, entries: DataFrame, most: int = 3) -> DataFrame:
    """Entries that share a tag with each query entry, newest first: (query_id, entry_id, shared, rank).

    queries, entries: entry_id unique, tags ARRAY, created TIMESTAMP. Whoever is among the newest of a query is among the
    newest of the tag they share, so a tag stands for its ``most`` newest entries and one more, for the query itself,
    however many have it. The shared tags are counted for those that are ranked.
    """
    tagged = entries.select("entry_id", "created", F.explode(F.array_distinct("tags")).alias("tag"))
    newest = tagged.withColumn("r", F.row_number().over(Window.partitionBy("tag").orderBy(F.desc("created"), "entry_id"))).filter(F.col("r") <= most + 1)
    q = queries.select(F.col("entry_id").alias("query_id"), "tags", F.explode(F.array_distinct("tags")).alias("tag"))
    pairs = q.join(newest, "tag").filter("entry_id <> query_id").groupBy("query_id", "entry_id").agg(F.first("created").alias("created"), F.first("tags").alias("tags"))
    order = Window.partitionBy("query_id").orderBy(F.desc("created"), "entry_id")
    best = pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    counted = best.join(entries.select("entry_id", F.col("tags").alias("own")), "entry_id")
    return counted.select("query_id", "entry_id", F.size(F.array_intersect("tags", "own")).cast("long").alias("shared"), "rank")


def contradictions(found: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, source, target): contradicting entries that a query found both. found: query_id, entry_id."""
    seen = found.select("query_id", "entry_id").distinct()
    against = edges.filter("relation = 'contradicts'").select("source", "target").distinct()
    left = seen.join(against, seen.entry_id == against.source).select("query_id", "source", "target")
    return left.join(seen.withColumnRenamed("entry_id", "target"), ["query_id", "target"], "left_semi").select("query_id", "source", "target").distinct()


def note_parts(entries: DataFrame) -> DataFrame:
    """Sections of the notes: (entry_id, section, pos, text, item_ids)."""
    one = entries.select("entry_id", "distilled_note").filter("distilled_note is not null").distinct()
    n = "distilled_note."

    def of(section: str, text: str) -> Column:
        return F.transform(F.coalesce(F.col(n + section), F.array()), lambda x: F.struct(F.lit(section).alias("section"), x[text].alias("text"), x["item_ids"].alias("item_ids")))

    plain = [of(s, "text") for s in ("key_points", "why_it_matters", "how_to_apply", "caveats")]
    questions = of("review_questions", "question")
    core = F.array(F.struct(F.lit("core_takeaway").alias("section"), F.col(n + "core_takeaway.text").alias("text"), F.col(n + "core_takeaway.item_ids").alias("item_ids")))
    return one.select("entry_id", F.posexplode(F.concat(core, *plain, questions)).alias("pos", "x")).select("entry_id", "x.section", "pos", "x.text", "x.item_ids")


def grounded_parts(parts: DataFrame, items: DataFrame) -> DataFrame:
    """Parts with the ids that exist in their entry: (entry_id, section, pos, text, item_ids, dropped, all_valid). A part
    without text or without any valid id is left out; a claim needs ``all_valid``."""
    known = items.groupBy("entry_id").agg(F.collect_set("item_id").alias("known"))
    none = F.expr("cast(array() as array<string>)")
    kept = parts.join(known, "entry_id", "left").withColumn("valid", valid_ids(F.col("item_ids"), F.coalesce("known", none)))
    text = strip(F.col("text"))
    return kept.filter((text != "") & (F.size("valid") > 0)).select(
        "entry_id", "section", "pos", text.alias("text"), F.col("valid").alias("item_ids"),
        (F.size(F.array_distinct("item_ids")) - F.size("valid")).alias("dropped"), F.forall("item_ids", lambda i: F.array_contains("known", i)).alias("all_valid"),
    )


def item_contexts(parts: DataFrame) -> DataFrame:
    """(entry_id, item_id, context): the distinct texts of the parts that cite an item, in order, as one text."""
    each = parts.select("entry_id", "pos", strip(F.col("text")).alias("text"), F.explode(F.array_distinct("item_ids")).alias("item_id")).filter("text <> ''")
    once = each.groupBy("entry_id", "item_id", "text").agg(F.min("pos").alias("pos"))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"])
    return once.groupBy("entry_id", "item_id").agg(F.array_join(texts, " ").alias("context"))


def stance_conflicts(parts: DataFrame, items: DataFrame) -> DataFrame:
    """Parts whose cited items take different stances: (entry_id, pos, n_stances, stances)."""
    cited = parts.select("entry_id", "pos", F.explode(F.array_distinct("item_ids")).alias("item_id"))
    stances = cited.join(items.select("entry_id", "item_id", "stance"), ["entry_id", "item_id"]).groupBy("entry_id", "pos").agg(F.sort_array(F.collect_set("stance")).alias("stances"))
    return stances.filter(F.size("stances") > 1).select("entry_id", "pos", F.size("stances").alias("n_stances"), F.array_join("stances", ",").alias("stances"))


def entry_topics(entries: DataFrame, most: int = 8) -> DataFrame:
    """(entry_id, topics): first-seen distinct topic keys of each distinct entry, capped."""
    return entries.select("entry_id", topics_capped(F.coalesce(F.col("tags.topics"), F.array()), most).alias("topics")).distinct()


def dominant_types(entries: DataFrame) -> DataFrame:
    """(entry_id, dominant): the type with the largest share, the first of equal ones, 'conceptual' where there is none."""
    shares = F.transform(F.coalesce(F.col("triage.knowledge_types_present"), F.array()), lambda x, i: F.struct(x["share"].alias("share"), (-i).alias("order"), x["type"].alias("type")))
    return entries.select("entry_id", F.coalesce(F.array_max(shares)["type"], F.lit("conceptual")).alias("dominant")).distinct()


def novelty_flags(links: DataFrame, ratio: float = 0.2) -> DataFrame:
    """Links with the reserved share flagged as new: (entry_id, pos, link_id, novelty).

    links: entry_id, pos, link_id, novelty_flag. Of n links max(1, round(n * ratio)) are flagged; where the flags fall
    short, every step-th link that has none is flagged in order. A ratio of 0 clears all flags.
    """
    if ratio <= 0:
        return links.select("entry_id", "pos", "link_id", F.lit(False).alias("novelty"))
    per = Window.partitionBy("entry_id")
    had = F.coalesce(F.col("novelty_flag"), F.lit(False))
    rows = links.withColumn("had", had).withColumn("n", F.count(F.lit(1)).over(per)).withColumn("already", F.sum(had.cast("int")).over(per))
    rows = rows.withColumn("target", F.greatest(F.lit(1), F.bround(F.col("n") * F.lit(ratio), 0).cast("int")))
    step = F.greatest(F.lit(1), F.floor(F.col("n") / F.col("target")))
    rows = rows.withColumn("offer", (~F.col("had")) & (F.col("pos") % step == 0))
    nth = F.sum(F.col("offer").cast("int")).over(per.orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("nth", nth).select("entry_id", "pos", "link_id", (F.col("had") | (F.col("offer") & (F.col("nth") <= F.col("target") - F.col("already")))).alias("novelty"))


def retracted(members: DataFrame, removed: DataFrame) -> DataFrame:
    """Members without those of the removed ids; what loses all its members is gone. members: group_id, id, ..."""
    return members.join(removed.select("id").distinct(), "id", "left_anti")
