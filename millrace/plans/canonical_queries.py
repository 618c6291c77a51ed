"""Queries of canonical groups, their edges, deletions and citations, with their SQL.

The test tables hold no groups and no answers about them. The groups are the topics, and one group for each entry; a
run files the entries of the last year again, and its answers are made by a stated rule from the position of the items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.jsonx import answer_object, rewritten
from millrace.functions.times import utc_timestamp
from millrace.operators import canonical as C  # noqa: N812
from millrace.operators import items as I  # noqa: N812
from millrace.operators import knowledge as K  # noqa: N812
from millrace.operators import retrieval as S  # noqa: N812
from millrace.plans.knowledge_queries import shared_tags
from millrace.plans.search_queries import _vectors
from millrace.plans.session import load


def _items(spark: SparkSession, d: str) -> DataFrame:
    """Items with the topics and the year of their entry."""
    entries = load(spark, d, "entries").select("entry_id", F.col("tags.topics").alias("topics"), utc_timestamp(F.col("meta.created_at")).alias("place"), F.substring("meta.created_at", 1, 4).alias("year")).distinct()
    return I.flat_items(load(spark, d, "entries")).select("entry_id", "pos", "item_id", "type").join(entries, "entry_id")


def _own(entry: str = "entry_id") -> F.Column:
    return F.concat(F.lit("only-"), entry)


def _members(items: DataFrame) -> DataFrame:
    """What was filed before: each topic has the item at its own position, and the first item is a group of its own."""
    topics = items.select(F.get("topics", F.col("pos")).alias("group_id"), "entry_id", "item_id").filter("group_id is not null")
    return topics.unionAll(items.filter("pos = 0").select(_own(), "entry_id", "item_id"))


def _run(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    items = _items(spark, d)
    members = _members(items)
    groups = members.select("group_id", F.col("group_id").alias("title")).distinct()
    of_run = items.join(items.agg(F.max("year").alias("year")), "year", "left_semi")
    offered = of_run.select("entry_id", "item_id", F.explode(F.slice("topics", 1, F.size("topics") - 1)).alias("group_id"))
    p = F.col("pos")
    decision = F.struct(
        "item_id", F.when(p % 4 == 1, "new").when(p % 4 == 2, "maybe").otherwise("match").alias("decision"),
        F.when(p % 4 == 0, F.get("topics", F.pmod(p / 4, F.size("topics")).cast("int"))).when(p % 4 == 3, _own()).alias("concept_id"), F.when(p % 4 == 1, F.col("type")).alias("title"),
    )
    first = F.array_sort(F.collect_list(F.struct("pos", decision.alias("d"))))
    late = F.array(F.struct(F.lit("k_zz").alias("item_id"), F.lit("new").alias("decision"), F.lit(None).cast("string").alias("concept_id"), F.lit("Unknown").alias("title")))
    all_ = F.concat(F.transform(first, lambda x: x["d"]), F.transform(first, lambda x: F.struct(x["d"]["item_id"].alias("item_id"), F.lit("new").alias("decision"), F.lit(None).cast("string").alias("concept_id"), F.lit("Late").alias("title"))), late)
    answers = of_run.groupBy("entry_id").agg(F.concat(F.lit("Here they are:\n```json\n"), F.to_json(all_), F.lit("\n```")).alias("response"))
    return C.canonicalized(groups, members, of_run.select("entry_id", "place").distinct(), C.decisions(answers, of_run, offered))


def canonical_members(spark: SparkSession, d: str) -> DataFrame:
    return _run(spark, d)[1]


def canonical_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups after the run, with their members and whether the run touched them."""
    groups, members, touched = _run(spark, d)
    sizes = members.groupBy("group_id").agg(F.count(F.lit(1)).alias("n_members"), F.countDistinct("entry_id").alias("n_entries"))
    return groups.join(sizes, "group_id").join(touched.select("group_id").distinct().withColumn("touched", F.lit(True)), "group_id", "left").select("group_id", "title", "n_members", "n_entries", F.coalesce("touched", F.lit(False)).alias("touched"))


def entry_edges(spark: SparkSession, d: str) -> DataFrame:
    """Labelled edges from entries to the newest that share a tag with them."""
    pairs = shared_tags(spark, d).select(F.col("query_id").alias("source"), F.col("entry_id").alias("target"), "rank")
    says = F.when(F.col("rank") == 1, '{"relation": "supports"}').when(F.col("rank") == 2, 'I would say "relation" : "extends" here').otherwise('```json\n{"relation": "resembles"}\n```')
    return C.labelled(pairs, pairs.withColumn("response", says), C.ENTRY_RELATIONS)


def concept_edges_replaced(spark: SparkSession, d: str) -> DataFrame:
    """Edges of the concepts with an even id are replaced, those of the others wait; edges to concepts that are gone go."""
    vectors = S.centroids(_vectors(spark, d))
    near = K.group_edges(vectors, 0.05).select("source", "target")
    name = F.element_at(F.array(*(F.lit(x) for x in ("builds_on", "related", "contrasts_with", "same"))), (F.pmod(F.col("source") + F.col("target"), F.lit(4)) + 1).cast("int"))
    new = C.labelled(near, near.withColumn("response", F.concat(F.lit('```json\n{"relation": "'), name, F.lit('"}\n```'))), C.GROUP_RELATIONS)
    old = spark.range(12).select(F.col("id").alias("source"), F.explode(F.array((F.col("id") + 1) % 12, (F.col("id") + 5) % 12)).alias("target"), F.lit("related").alias("relation"))
    return C.replaced_edges(old, new, vectors.filter("group_id % 2 = 0"), vectors)


def delete_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Rows left in each table after the deletions; what was filed again isn't gone."""
    entries = load(spark, d, "entries").select("entry_id").distinct()
    gone = load(spark, d, "entry_deletions").select("entry_id").join(entries, "entry_id", "left_anti")
    # Groups from before the deletions: the topics of the index, and one for each of its rows.
    rows = load(spark, d, "entry_index").select("entry_id", "topics").distinct()
    members = rows.select(F.explode("topics").alias("group_id"), "entry_id", F.lit("k").alias("item_id")).unionAll(rows.select(_own(), "entry_id", F.lit("k")))
    vectors, jobs = load(spark, d, "item_vectors").select("entry_id", "item_id").distinct(), load(spark, d, "jobs").select("entry_id", "job_id").filter("entry_id is not null").distinct()
    tables, left, groups = C.delete_cascade(gone, {"entry_index": rows, "item_vectors": vectors, "jobs": jobs}, members.distinct(), members.select("group_id").distinct())
    counts = [t.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n")) for name, t in [*tables.items(), ("members", left), ("groups", groups)]]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionAll(c)
    return out


def citations_split(spark: SparkSession, d: str) -> DataFrame:
    """Citations of each question's answer (here: of all its retrievals, and one invented) that are among its best six."""
    rows = load(spark, d, "retrieved_items").select("question_id", "retrieval_id", F.concat_ws("/", "entry_id", "item_id").alias("key"), "score")
    listed = rows.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("retrieval_id", "key"))).alias("all"), F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "retrieval_id", "key"))).alias("ranked"))
    cited = F.concat(F.transform("all", lambda x: x["key"]), F.array(F.lit("e-none/k_zz")))
    grounded, ungrounded = C.split_citations(cited, F.transform(F.slice("ranked", 1, 6), lambda x: x["key"]))
    return listed.select("question_id", F.array_join(grounded, ",").alias("grounded"), F.array_join(ungrounded, ",").alias("ungrounded"))


def rewritten_items(spark: SparkSession, d: str) -> DataFrame:
    """Statements rewritten as JSON: a rewrite that changes anything but the text is refused (every third changes the id)."""
    rows = load(spark, d, "retrieved_items").select("retrieval_id", F.to_json(F.struct("item_id", "statement")).alias("before"), F.to_json(F.struct(F.when(F.col("retrieval_id") % 3 == 0, F.lit("k_zz")).otherwise(F.col("item_id")).alias("item_id"), F.lower("statement").alias("statement"))).alias("after"))
    value = F.from_json(answer_object(F.concat(F.lit("So: "), rewritten(F.col("before"), F.concat(F.lit("```json\n"), "after", F.lit("\n```")), ("statement",)))), "item_id string, statement string")
    return rows.select("retrieval_id", value.alias("x")).select("retrieval_id", "x.item_id", "x.statement")


_G = """en AS (SELECT DISTINCT entry_id, knowledge_items, tags.topics AS topics, CASE WHEN regexp_matches(meta.created_at, '(Z|[+-]\\d{2}:\\d{2})$') THEN meta.created_at ELSE meta.created_at || 'Z' END::TIMESTAMPTZ AS place, left(meta.created_at, 4) AS year FROM entries),
it AS (SELECT entry_id, topics, place, year, generate_subscripts(knowledge_items, 1) - 1 AS pos, unnest(knowledge_items) AS i FROM en),
m0 AS (SELECT topics[pos + 1] AS group_id, entry_id, i.item_id AS item_id FROM it WHERE pos < len(topics) UNION ALL SELECT 'only-' || entry_id, entry_id, i.item_id FROM it WHERE pos = 0),
run AS (SELECT * FROM it WHERE year = (SELECT max(year) FROM it)), kept AS (SELECT * FROM m0 WHERE entry_id NOT IN (SELECT entry_id FROM run)),
hit AS (SELECT topics[(pos // 4) % len(topics) + 1] AS group_id, entry_id, i.item_id AS item_id, topics FROM run WHERE pos % 4 = 0),
matched AS (SELECT group_id, entry_id, item_id FROM hit WHERE list_contains(topics[1:len(topics) - 1], group_id) AND group_id IN (SELECT group_id FROM kept)),
named AS (SELECT DISTINCT entry_id, place, i.type AS type FROM run WHERE pos % 4 = 1), nth AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY place, entry_id) AS n FROM named),
new AS (SELECT entry_id, type, CASE WHEN n = 1 THEN type ELSE type || '-' || n END AS group_id FROM nth),
filed AS (SELECT new.group_id, run.entry_id, run.i.item_id AS item_id FROM run JOIN new ON new.entry_id = run.entry_id AND new.type = run.i.type WHERE pos % 4 = 1),
after AS (SELECT * FROM kept UNION SELECT * FROM matched UNION SELECT * FROM filed)"""


def queries() -> dict:
    return {f.__name__: f for f in (canonical_members, canonical_groups, entry_edges, concept_edges_replaced, delete_cascade, citations_split, rewritten_items)}


def oracle_sql() -> dict[str, str]:
    from millrace.plans.knowledge_queries import oracle_sql as knowledge
    from millrace.plans.search_queries import _C, _Q

    gone = "gone AS (SELECT entry_id FROM entry_deletions WHERE entry_id NOT IN (SELECT entry_id FROM entries))"
    return {
        "canonical_members": "WITH " + _G + " SELECT * FROM after",
        "canonical_groups": "WITH " + _G + """, t AS (SELECT group_id FROM matched UNION SELECT group_id FROM filed)
SELECT group_id, coalesce((SELECT type FROM new WHERE new.group_id = after.group_id), group_id) AS title, count(*) AS n_members, count(DISTINCT entry_id) AS n_entries, group_id IN (SELECT group_id FROM t) AS touched FROM after GROUP BY group_id""",
        "entry_edges": "SELECT query_id AS source, entry_id AS target, CASE rank WHEN 1 THEN 'supports' ELSE 'extends' END AS relation FROM (" + knowledge()["shared_tags"] + ") WHERE rank <= 2",
        "concept_edges_replaced": _Q + _C + """, e AS (SELECT a.group_id AS source, b.group_id AS target, list_cosine_similarity(a.vector, b.vector) AS sim FROM c a JOIN c b ON a.group_id <> b.group_id), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY sim DESC, target) AS rank FROM e WHERE sim >= 0.05),
n AS (SELECT source, target, ['builds_on', 'related', 'contrasts_with'][((source + target) % 4 + 1)::INT] AS relation FROM r WHERE rank <= 3 AND (source + target) % 4 < 3), o AS (SELECT i AS source, unnest([(i + 1) % 12, (i + 5) % 12]) AS target, 'related' AS relation FROM range(12) t(i)),
b AS (SELECT * FROM o WHERE NOT (source % 2 = 0 AND source IN (SELECT group_id FROM c)) UNION SELECT * FROM n WHERE source % 2 = 0) SELECT * FROM b WHERE source IN (SELECT group_id FROM c) AND target IN (SELECT group_id FROM c)""",
        "delete_cascade": "WITH " + gone + """, i AS (SELECT DISTINCT entry_id, topics FROM entry_index), m AS (SELECT DISTINCT unnest(topics) AS g, entry_id FROM i UNION SELECT 'only-' || entry_id, entry_id FROM i), l AS (SELECT * FROM m WHERE entry_id NOT IN (SELECT * FROM gone))
SELECT 'entry_index' AS name, count(*) AS n FROM i WHERE entry_id NOT IN (SELECT * FROM gone) UNION ALL SELECT 'item_vectors', count(*) FROM (SELECT DISTINCT entry_id, item_id FROM item_vectors) WHERE entry_id NOT IN (SELECT * FROM gone)
UNION ALL SELECT 'jobs', count(*) FROM (SELECT DISTINCT entry_id, job_id FROM jobs) WHERE entry_id IS NOT NULL AND entry_id NOT IN (SELECT * FROM gone) UNION ALL SELECT 'members', count(*) FROM l UNION ALL SELECT 'groups', count(DISTINCT g) FROM l""",
        "citations_split": """WITH r AS (SELECT question_id, retrieval_id, entry_id || '/' || item_id AS key, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, retrieval_id) AS rank FROM retrieved_items),
a AS (SELECT question_id, list(key ORDER BY retrieval_id) || ['e-none/k_zz'] AS cited, list(key) FILTER (rank <= 6) AS known FROM r GROUP BY question_id)
SELECT question_id, array_to_string(list_filter(cited, lambda c: list_contains(known, c)), ',') AS grounded, array_to_string(list_filter(cited, lambda c: NOT list_contains(known, c)), ',') AS ungrounded FROM a""",
        "rewritten_items": "SELECT retrieval_id, item_id, CASE WHEN retrieval_id % 3 = 0 THEN statement ELSE lower(statement) END AS statement FROM retrieved_items",
    }
