"""Queries over entries, their items, notes and feedback, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import humanize_tag, normalize_text
from millrace.functions.times import utc_timestamp
from millrace.operators import items as I  # noqa: N812
from millrace.operators import knowledge as K  # noqa: N812
from millrace.operators import pages as P  # noqa: N812
from millrace.operators import preferences as R  # noqa: N812
from millrace.plans.session import load


def _entries(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "entries")


def _items(spark: SparkSession, d: str) -> DataFrame:
    return I.flat_items(_entries(spark, d))


def _parts(spark: SparkSession, d: str) -> DataFrame:
    return K.note_parts(_entries(spark, d))


def knowledge_items(spark: SparkSession, d: str) -> DataFrame:
    return _items(spark, d).select("entry_id", F.col("pos").cast("long").alias("pos"), "item_id", "type", "statement", "stance", F.col("provenance.quote").alias("quote"))


def faithful_quotes(spark: SparkSession, d: str) -> DataFrame:
    return I.faithful(_items(spark, d), load(spark, d, "segments"))


def provenance_backfill(spark: SparkSession, d: str) -> DataFrame:
    return I.backfilled(_items(spark, d), load(spark, d, "segments")).select("entry_id", "item_id", "locator", "ts", F.col("no").alias("line_no"))


def quote_truncate(spark: SparkSession, d: str) -> DataFrame:
    return I.short_quotes(_items(spark, d), 8).select("entry_id", "item_id", "quote", F.col("n_words").cast("long").alias("n_words"))


def word_floor(spark: SparkSession, d: str) -> DataFrame:
    return I.transcript_sizes(load(spark, d, "segments"))


def _joined(merged: DataFrame, *keys: str) -> DataFrame:
    return merged.select(*keys, "item_id", "rationale", "scope", *(F.array_join(c, "|").alias(c) for c in ("gotchas", "preconditions", "mentions")), "n")


def exact_dedup_merge(spark: SparkSession, d: str) -> DataFrame:
    """Repeats inside an entry, among the items whose quote stands in the transcript, folded into the first."""
    items = _items(spark, d)
    kept = items.join(I.faithful(items, load(spark, d, "segments")).filter("faithful").select("entry_id", "item_id").distinct(), ["entry_id", "item_id"], "left_semi")
    return _joined(I.merged_repeats(kept), "entry_id", "key")


def fuzzy_dedup(spark: SparkSession, d: str) -> DataFrame:
    rows = _items(spark, d).select(F.col("entry_id").alias("group_id"), "pos", "statement")
    return I.fuzzy_leaders(rows).select(F.col("group_id").alias("entry_id"), "pos", "leader")


def fuzzy_merge(spark: SparkSession, d: str) -> DataFrame:
    """Restatements inside an entry folded into the item that leads them."""
    items = _items(spark, d)
    leaders = I.fuzzy_leaders(items.select(F.col("entry_id").alias("group_id"), "pos", "statement")).withColumnRenamed("group_id", "entry_id")
    return _joined(I.merged_restatements(items, leaders), "entry_id", "leader")


def note_grounding(spark: SparkSession, d: str) -> DataFrame:
    g = K.grounded_parts(_parts(spark, d), _items(spark, d))
    return g.select("entry_id", "section", F.col("pos").cast("long").alias("pos"), F.array_join("item_ids", ",").alias("item_ids"), F.col("dropped").cast("long").alias("dropped"), "all_valid")


def note_context(spark: SparkSession, d: str) -> DataFrame:
    return K.item_contexts(_parts(spark, d))


def stance_conflicts(spark: SparkSession, d: str) -> DataFrame:
    # Key points are claims of one entry; a wider claim is what one topic's items say across entries.
    return K.stance_conflicts(_parts(spark, d), _items(spark, d)).select("entry_id", F.col("pos").cast("long").alias("pos"), F.col("n_stances").cast("long").alias("n_stances"), "stances")


def topic_stances(spark: SparkSession, d: str) -> DataFrame:
    """Topics on which the items of an entry type take different stances: counts of each."""
    tags = _entries(spark, d).select("entry_id", F.explode(F.array_distinct("tags.topics")).alias("topic")).distinct()
    return _items(spark, d).join(tags, "entry_id").groupBy("topic").agg(F.countDistinct("stance").alias("n_stances"), F.count(F.lit(1)).alias("n_items"), F.countDistinct("entry_id").alias("n_entries"))


def topics_capped(spark: SparkSession, d: str) -> DataFrame:
    return K.entry_topics(_entries(spark, d)).select("entry_id", F.array_join("topics", ",").alias("topics"))


def humanized_tags(spark: SparkSession, d: str) -> DataFrame:
    return _entries(spark, d).select(F.explode("tags.topics").alias("tag")).distinct().select("tag", humanize_tag(F.col("tag")).alias("label"))


def tag_listing(spark: SparkSession, d: str) -> DataFrame:
    return _entries(spark, d).select("entry_id", F.explode("tags.topics").alias("tag")).groupBy("tag").agg(F.countDistinct("entry_id").alias("n_entries"))


def dominant_type(spark: SparkSession, d: str) -> DataFrame:
    return K.dominant_types(_entries(spark, d))


def novelty_flags(spark: SparkSession, d: str) -> DataFrame:
    one = _entries(spark, d).select("entry_id", "application_links").distinct()
    links = one.select("entry_id", F.posexplode("application_links").alias("pos", "x")).select("entry_id", F.col("pos").cast("long").alias("pos"), "x.link_id", "x.novelty_flag")
    return K.novelty_flags(links, 0.5)


def goal_links(spark: SparkSession, d: str) -> DataFrame:
    """Links whose goal is one of the stated goals (here: those that at least a tenth as many links as the most used
    goal name), and whose items all exist in the entry."""
    one = _entries(spark, d).select("entry_id", "application_links").distinct()
    links = one.select("entry_id", F.explode("application_links").alias("x")).select("entry_id", "x.*")
    used = links.filter("linked_goal_id is not null").groupBy("linked_goal_id").agg(F.count(F.lit(1)).alias("n"))
    goals = used.crossJoin(used.agg(F.max("n").alias("most"))).filter("10 * n >= most").select("linked_goal_id")
    named = links.select("entry_id", F.explode("knowledge_item_ids").alias("item_id")).distinct()
    missing = named.join(_items(spark, d).select("entry_id", "item_id"), ["entry_id", "item_id"], "left_anti").groupBy("entry_id").agg(F.collect_set("item_id").alias("missing"))
    whole = links.join(missing, "entry_id", "left").filter(F.col("missing").isNull() | ~F.coalesce(F.arrays_overlap("knowledge_item_ids", "missing"), F.lit(False)))
    return whole.join(goals, "linked_goal_id", "left_semi").select("entry_id", "link_id", "linked_goal_id", F.col("application_form").alias("form"))


def entity_groups(spark: SparkSession, d: str) -> DataFrame:
    named = K.entity_mentions(_items(spark, d)).select("kind", F.col("name").alias("title"), "entry_id", "pos")
    return K.new_groups(named).select("kind", "key", "title", "entry_id", "n_members", "n_entries")


def shared_tags(spark: SparkSession, d: str) -> DataFrame:
    entries = _entries(spark, d).select("entry_id", F.col("tags.topics").alias("tags"), utc_timestamp(F.col("meta.created_at")).alias("created")).distinct()
    # The query set: every entry whose hexadecimal id is divisible by 20.
    queries = entries.filter(F.pmod(F.conv(F.substring("entry_id", 3, 8), 16, 10).cast("long"), F.lit(20)) == 0)
    return K.sharing_tags(queries, entries).select("query_id", "entry_id", "shared", F.col("rank").cast("long").alias("rank"))


def contradictions(spark: SparkSession, d: str) -> DataFrame:
    found = load(spark, d, "retrieved_items").select(F.col("question_id").alias("query_id"), "entry_id")
    edges = _entries(spark, d).select(F.col("entry_id").alias("source"), F.explode("related_entries").alias("r")).select("source", "r.target", "r.relation")
    return K.contradictions(found, edges)


def dangling_edges(spark: SparkSession, d: str) -> DataFrame:
    edges = _entries(spark, d).select("entry_id", F.explode("related_entries").alias("r")).select("entry_id", "r.target", "r.relation").distinct()
    return edges.join(_entries(spark, d).select(F.col("entry_id").alias("target")).distinct(), "target", "left_anti").select("entry_id", "target", "relation")


def profile_affinities(spark: SparkSession, d: str) -> DataFrame:
    return R.affinities(R.feedback_tags(_entries(spark, d))).withColumn("weight", F.round("weight", 5))


def profile_seeded(spark: SparkSession, d: str) -> DataFrame:
    """Affinities with the forms that new links brought in."""
    e = _entries(spark, d)
    return R.seeded_affinities(R.feedback_tags(e), R.novelty_seeds(e)).withColumn("weight", F.round("weight", 5))


def profile_reasons(spark: SparkSession, d: str) -> DataFrame:
    return R.reason_counts(R.feedback_tags(_entries(spark, d))).select("dimension", "tag", F.explode("reasons").alias("reason", "n"))


def profile_aversions(spark: SparkSession, d: str) -> DataFrame:
    return R.aversions(R.feedback_tags(_entries(spark, d))).withColumn("weight", F.round("weight", 5))


def profile_known_topics(spark: SparkSession, d: str) -> DataFrame:
    return R.known_topics(R.feedback_tags(_entries(spark, d)))


def profile_confidence(spark: SparkSession, d: str) -> DataFrame:
    return R.confidence_by_month(_entries(spark, d)).withColumn("confidence", F.round("confidence", 6))


def top_affinities(spark: SparkSession, d: str) -> DataFrame:
    """The five strongest topics, a hint for later links."""
    best = R.affinities(R.feedback_tags(_entries(spark, d))).filter("dimension = 'topics'").withColumn("weight", F.round("weight", 5))
    return best.orderBy(F.desc("weight"), "tag").limit(5).select("tag", "weight")


def entry_slugs(spark: SparkSession, d: str) -> DataFrame:
    return P.entry_slugs(_entries(spark, d))


def source_pages(spark: SparkSession, d: str) -> DataFrame:
    return P.source_pages(_entries(spark, d))


def index_lines(spark: SparkSession, d: str) -> DataFrame:
    return P.index_lines(P.source_pages(_entries(spark, d))).select("slug", "line")


def page_lint(spark: SparkSession, d: str) -> DataFrame:
    pages = P.source_pages(_entries(spark, d))
    listed = load(spark, d, "entry_index").select("entry_id").distinct().join(P.entry_slugs(_entries(spark, d)), "entry_id").select(F.lit("sources").alias("dir"), "slug")
    return P.lint(pages, listed)


def citations(spark: SparkSession, d: str) -> DataFrame:
    entries = _entries(spark, d)
    return P.rendered_citations(_parts(spark, d).filter("section = 'key_points'"), _items(spark, d), P.entry_slugs(entries)).select("entry_id", F.col("pos").cast("long").alias("pos"), "text")


def index_parity(spark: SparkSession, d: str) -> DataFrame:
    return P.parity(_entries(spark, d), load(spark, d, "entry_index"), "entry_id")


def reindex_needed(spark: SparkSession, d: str, model: str = "embed-base") -> DataFrame:
    """Items without a vector of the current model."""
    vectors = load(spark, d, "item_vectors").filter(F.col("embedding_model") == model).select("entry_id", "item_id")
    return _items(spark, d).select("entry_id", "item_id").distinct().join(vectors, ["entry_id", "item_id"], "left_anti")


def library_search(spark: SparkSession, d: str, term: str = "the", tag: str = "budgeting", least: int = 3) -> DataFrame:
    """Index rows with the term in title, id or tags, the tag and at least the score, newest first: a page of 30."""
    rows = load(spark, d, "entry_index").distinct()
    text = F.lower(F.concat_ws(" ", "title", "entry_id", "topics", "knowledge_types"))
    hit = F.contains(text, F.lit(term)) & F.array_contains("topics", tag) & (F.col("score") >= least)
    return rows.filter(hit).select("entry_id", "title", F.col("score").cast("long").alias("score"), "created_at").orderBy(F.desc(utc_timestamp(F.col("created_at"))), "entry_id").limit(30)


_PUNCT = r"[^\p{L}\p{N}_\s]+"


def _norm(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower({x}), '{_PUNCT}', ' ', 'g'), '\s+', ' ', 'g'))"


_ITEMS = "en AS (SELECT DISTINCT * FROM entries), it AS (SELECT entry_id, generate_subscripts(knowledge_items, 1) - 1 AS pos, unnest(knowledge_items) AS i FROM en)"
_LINES = r"ln AS (SELECT entry_id, regexp_extract(locator, '(\d+)\s*$', 1)::BIGINT AS no, min_by(struct_pack(t := coalesce(text, ''), ts := ts, loc := locator), segment_id) AS r FROM segments GROUP BY ALL)"
_PARTS = """pt AS (SELECT entry_id, generate_subscripts(p, 1) - 1 AS pos, unnest(p) AS x FROM (SELECT entry_id, [struct_pack(section := 'core_takeaway', text := distilled_note.core_takeaway.text, item_ids := distilled_note.core_takeaway.item_ids)]
 || list_transform(coalesce(distilled_note.key_points, []), lambda x: struct_pack(section := 'key_points', text := x.text, item_ids := x.item_ids))
 || list_transform(coalesce(distilled_note.why_it_matters, []), lambda x: struct_pack(section := 'why_it_matters', text := x.text, item_ids := x.item_ids))
 || list_transform(coalesce(distilled_note.how_to_apply, []), lambda x: struct_pack(section := 'how_to_apply', text := x.text, item_ids := x.item_ids))
 || list_transform(coalesce(distilled_note.caveats, []), lambda x: struct_pack(section := 'caveats', text := x.text, item_ids := x.item_ids))
 || list_transform(coalesce(distilled_note.review_questions, []), lambda x: struct_pack(section := 'review_questions', text := x.question, item_ids := x.item_ids)) AS p
 FROM en WHERE distilled_note IS NOT NULL))"""
_TAGS = """tg AS (SELECT entry_id, feedback.score AS score, feedback.reason AS reason, 'topics' AS dimension, unnest(list_distinct(tags.topics)) AS tag FROM en WHERE feedback.score IS NOT NULL
 UNION ALL SELECT entry_id, feedback.score, feedback.reason, 'knowledge_types', unnest(list_distinct(tags.knowledge_types)) FROM en WHERE feedback.score IS NOT NULL
 UNION ALL SELECT entry_id, feedback.score, feedback.reason, 'application_forms', unnest(list_distinct(tags.application_forms)) FROM en WHERE feedback.score IS NOT NULL)"""
_UTC = r"CASE WHEN regexp_matches({0}, '(Z|[+-]\d{{2}}:\d{{2}})$') THEN {0} ELSE {0} || 'Z' END::TIMESTAMPTZ"
_SLUGS = """sl0 AS (SELECT DISTINCT entry_id, coalesce(nullif(trim(regexp_replace(lower(trim(source.title)), '[^a-z0-9]+', '-', 'g'), '-'), ''), entry_id) AS base, meta.created_at AS c FROM entries),
sl1 AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY c, entry_id) AS nth FROM sl0),
sl2 AS (SELECT *, CASE WHEN nth = 1 THEN base ELSE base || '-' || trim(regexp_replace(lower(right(entry_id, 6)), '[^a-z0-9]+', '-', 'g'), '-') END AS short FROM sl1),
sl3 AS (SELECT *, row_number() OVER (PARTITION BY short ORDER BY nth, entry_id) AS k FROM sl2),
sl AS (SELECT entry_id, CASE WHEN k = 1 THEN short ELSE base || '-' || trim(regexp_replace(lower(right(entry_id, (6 + (k - 1) * 2)::INT)), '[^a-z0-9]+', '-', 'g'), '-') END AS slug FROM sl3)"""
_PAGES = """rel AS (SELECT entry_id, list(line ORDER BY pos) AS lines FROM (SELECT r.entry_id, r.pos, '- ' || r.x.relation || ': [' || r.x.target || '](' || coalesce(sl.slug, r.x.target) || '.md)' AS line
 FROM (SELECT entry_id, generate_subscripts(related_entries, 1) AS pos, unnest(related_entries) AS x FROM en) r LEFT JOIN sl ON sl.entry_id = r.x.target) GROUP BY entry_id),
pg AS (SELECT sl.slug, array_to_string(['---', 'type: source', 'title: "' || replace(replace(coalesce(e.source.title, ''), '\\', '\\\\'), '"', '\\"') || '"', 'entry_id: ' || e.entry_id,
 'topics: [' || coalesce(array_to_string(e.tags.topics, ', '), '') || ']', 'date: ' || left(e.meta.created_at, 10), '---', '', '# ' || coalesce(e.source.title, ''), '',
 coalesce(CASE WHEN len(e.distilled_note.core_takeaway.item_ids) > 0 THEN e.distilled_note.core_takeaway.text || ' (' || array_to_string(list_transform(e.distilled_note.core_takeaway.item_ids, lambda i: '`' || i || '`'), ', ') || ')' ELSE e.distilled_note.core_takeaway.text END, ''), '', '## Key points', '']
 || list_transform(coalesce(e.distilled_note.key_points, []), lambda p: '- ' || CASE WHEN len(p.item_ids) > 0 THEN p.text || ' (' || array_to_string(list_transform(p.item_ids, lambda i: '`' || i || '`'), ', ') || ')' ELSE p.text END)
 || CASE WHEN rel.lines IS NULL THEN [] ELSE ['', '## Related', ''] || rel.lines END, chr(10)) || chr(10) AS body, e.source.title AS title
 FROM en e JOIN sl ON sl.entry_id = e.entry_id LEFT JOIN rel ON rel.entry_id = e.entry_id)"""


def queries() -> dict:
    return {f.__name__: f for f in (
        knowledge_items, faithful_quotes, provenance_backfill, quote_truncate, word_floor, exact_dedup_merge, fuzzy_dedup, fuzzy_merge, note_grounding, note_context, stance_conflicts, topic_stances,
        topics_capped, humanized_tags, tag_listing, dominant_type, novelty_flags, goal_links, entity_groups, shared_tags, contradictions, dangling_edges, profile_affinities, profile_seeded, profile_reasons, profile_aversions,
        profile_known_topics, profile_confidence, top_affinities, entry_slugs, source_pages, index_lines, page_lint, citations, index_parity, reindex_needed, library_search,
    )}


def oracle_sql() -> dict[str, str]:
    w = "WITH "
    return {
        "knowledge_items": w + _ITEMS + " SELECT entry_id, pos, i.item_id AS item_id, i.type AS type, i.statement AS statement, i.stance AS stance, i.provenance.quote AS quote FROM it",
        "faithful_quotes": w + _ITEMS + ", " + _LINES + f""", full_text AS (SELECT entry_id, {_norm("string_agg(r.t, chr(10) ORDER BY no)")} AS t FROM ln GROUP BY entry_id)
SELECT it.entry_id, i.item_id AS item_id, i.provenance.quote AS quote, coalesce({_norm("coalesce(i.provenance.quote, '')")} <> '' AND contains(t, {_norm("coalesce(i.provenance.quote, '')")}), false) AS faithful FROM it LEFT JOIN full_text f ON f.entry_id = it.entry_id""",
        "provenance_backfill": w + _ITEMS + ", " + _LINES + f""", q AS (SELECT entry_id, i.item_id AS item_id, i.provenance.locator AS l, i.provenance.timestamp AS s, {_norm("coalesce(i.provenance.quote, '')")} AS q FROM it),
h AS (SELECT q.entry_id, q.item_id, min_by(struct_pack(no := ln.no, loc := r.loc, ts := r.ts), ln.no) AS f FROM q JOIN ln ON ln.entry_id = q.entry_id AND q.q <> '' AND contains({_norm("r.t")}, q.q) GROUP BY ALL)
SELECT q.entry_id, q.item_id, coalesce(l, f.loc) AS locator, coalesce(s, f.ts) AS ts, f.no AS line_no FROM q LEFT JOIN h ON h.entry_id = q.entry_id AND h.item_id = q.item_id""",
        "quote_truncate": w + _ITEMS + r""", q AS (SELECT entry_id, i.item_id AS item_id, i.provenance.quote AS q, list_filter(regexp_split_to_array(trim(i.provenance.quote), '[\s\x{00A0}\x{2007}\x{2009}\x{202F}]+'), lambda x: x <> '') AS w FROM it)
SELECT entry_id, item_id, CASE WHEN len(w) <= 8 THEN q ELSE array_to_string(w[1:8], ' ') END AS quote, least(len(w), 8) AS n_words FROM q""",
        "word_floor": w + _LINES + r""", c AS (SELECT entry_id, sum(len(list_filter(regexp_split_to_array(r.t, '[\s\x{00A0}\x{2007}\x{2009}\x{202F}]+'), lambda x: x <> '')))::BIGINT AS n_words FROM ln GROUP BY entry_id)
SELECT entry_id, n_words, CASE WHEN n_words < 50 THEN 'rejected' WHEN n_words < 500 THEN 'thin' ELSE 'ok' END AS status FROM c""",
        "exact_dedup_merge": w + _ITEMS + ", " + _LINES + f""", full_text AS (SELECT entry_id, {_norm("string_agg(r.t, chr(10) ORDER BY no)")} AS t FROM ln GROUP BY entry_id),
k AS (SELECT coalesce({_norm("i.statement")}, '') AS key, entry_id, pos, i FROM it JOIN full_text f USING (entry_id) WHERE {_norm("coalesce(i.provenance.quote, '')")} <> '' AND contains(t, {_norm("coalesce(i.provenance.quote, '')")})),
b AS (SELECT entry_id, key, arg_min(i.item_id, pos) AS item_id, arg_min(i.rationale, pos) FILTER (i.rationale IS NOT NULL) AS rationale, arg_min(i.scope, pos) FILTER (i.scope IS NOT NULL) AS scope, count(*) AS n FROM k GROUP BY ALL),
v AS (SELECT entry_id, key, pos, 'g' AS c, generate_subscripts(i.gotchas, 1) AS k, unnest(i.gotchas) AS v FROM k UNION ALL SELECT entry_id, key, pos, 'p', generate_subscripts(i.preconditions, 1), unnest(i.preconditions) FROM k
 UNION ALL SELECT entry_id, key, pos, 'm', generate_subscripts(i.entity_mentions, 1), unnest(list_transform(i.entity_mentions, lambda m: m.kind || ':' || m.name)) FROM k),
o AS (SELECT entry_id, key, c, v, min(struct_pack(p := pos, k := k)) AS m FROM v GROUP BY ALL),
a AS (SELECT entry_id, key, c, string_agg(v, '|' ORDER BY m) AS v FROM o GROUP BY ALL), w AS (SELECT entry_id, key, max(v) FILTER (c = 'g') AS g, max(v) FILTER (c = 'p') AS p, max(v) FILTER (c = 'm') AS m FROM a GROUP BY ALL)
SELECT entry_id, key, item_id, rationale, scope, coalesce(g, '') AS gotchas, coalesce(p, '') AS preconditions, coalesce(m, '') AS mentions, n FROM b LEFT JOIN w USING (entry_id, key)""",
        "note_grounding": w + _ITEMS + ", " + _PARTS + """, kn AS (SELECT entry_id, list(DISTINCT i.item_id) AS known FROM it GROUP BY entry_id),
v AS (SELECT pt.*, known, list_filter(x.item_ids, lambda i: list_contains(known, i)) AS ok FROM pt LEFT JOIN kn USING (entry_id))
SELECT entry_id, x.section AS section, pos, array_to_string(list_filter(ok, lambda i, n: list_position(ok, i) = n), ',') AS item_ids, (len(list_distinct(x.item_ids)) - len(list_distinct(ok)))::BIGINT AS dropped, len(ok) = len(x.item_ids) AS all_valid FROM v WHERE trim(x.text) <> '' AND len(ok) > 0""",
        "note_context": w + _ITEMS.split(", it AS")[0] + ", " + _PARTS + """, e AS (SELECT DISTINCT entry_id, pos, trim(x.text) AS t, unnest(x.item_ids) AS item_id FROM pt), o AS (SELECT entry_id, item_id, t, min(pos) AS pos FROM e WHERE t <> '' GROUP BY ALL)
SELECT entry_id, item_id, string_agg(t, ' ' ORDER BY pos) AS context FROM o GROUP BY ALL""",
        "stance_conflicts": w + _ITEMS + ", " + _PARTS + """, c AS (SELECT entry_id, pos, unnest(list_distinct(x.item_ids)) AS item_id FROM pt), s AS (SELECT c.entry_id, c.pos, list_sort(list(DISTINCT i.stance)) AS s FROM c JOIN it ON it.entry_id = c.entry_id AND i.item_id = c.item_id GROUP BY ALL)
SELECT entry_id, pos, len(s) AS n_stances, array_to_string(s, ',') AS stances FROM s WHERE len(s) > 1""",
        "topic_stances": w + _ITEMS + ", t AS (SELECT DISTINCT entry_id, unnest(tags.topics) AS topic FROM en) SELECT topic, count(DISTINCT i.stance) AS n_stances, count(*) AS n_items, count(DISTINCT it.entry_id) AS n_entries FROM it JOIN t USING (entry_id) GROUP BY topic",
        "topics_capped": r"""WITH t AS (SELECT DISTINCT entry_id, list_filter(list_transform(tags.topics, lambda x: trim(regexp_replace(regexp_replace(lower(trim(x)), '\s+', '_', 'g'), '[^a-z0-9_-]', '', 'g'), '_-')), lambda x: x <> '') AS l FROM entries)
SELECT entry_id, array_to_string(list_filter(l, lambda i, n: list_position(l, i) = n)[1:8], ',') AS topics FROM t""",
        "humanized_tags": r"""WITH t AS (SELECT DISTINCT unnest(tags.topics) AS tag FROM entries) SELECT tag, array_to_string(list_transform(list_filter(regexp_split_to_array(replace(replace(tag, '_', ' '), '-', ' '), '\s+'), lambda x: x <> ''),
 lambda x: CASE WHEN lower(x) IN ('ai', 'api', 'cli', 'db', 'kb', 'llm', 'ui', 'ux') THEN upper(x) ELSE upper(x[1:1]) || lower(x[2:]) END), ' ') AS label FROM t""",
        "tag_listing": "SELECT tag, count(DISTINCT entry_id) AS n_entries FROM (SELECT entry_id, unnest(tags.topics) AS tag FROM entries) GROUP BY tag",
        "dominant_type": """WITH t AS (SELECT DISTINCT entry_id, triage.knowledge_types_present AS l FROM entries) SELECT entry_id, coalesce(l[list_position(list_transform(l, lambda x: x.share), list_max(list_transform(l, lambda x: x.share)))].type, 'conceptual') AS dominant FROM t""",
        "novelty_flags": """WITH en AS (SELECT DISTINCT entry_id, application_links FROM entries), l AS (SELECT entry_id, generate_subscripts(application_links, 1) - 1 AS pos, unnest(application_links) AS x FROM en),
c AS (SELECT *, coalesce(x.novelty_flag, false) AS had, count(*) OVER p AS n, sum(coalesce(x.novelty_flag, false)::INT) OVER p AS already FROM l WINDOW p AS (PARTITION BY entry_id)),
t AS (SELECT *, greatest(1, round_even(n * 0.5, 0)::INT) AS target FROM c), o AS (SELECT *, NOT had AND pos % greatest(1, n // target) = 0 AS offer FROM t),
r AS (SELECT *, sum(offer::INT) OVER (PARTITION BY entry_id ORDER BY pos) AS nth FROM o) SELECT entry_id, pos, x.link_id AS link_id, had OR (offer AND nth <= target - already) AS novelty FROM r""",
        "goal_links": """WITH en AS (SELECT DISTINCT entry_id, application_links, knowledge_items FROM entries), l AS (SELECT entry_id, list_transform(knowledge_items, lambda k: k.item_id) AS known, unnest(application_links) AS x FROM en),
u AS (SELECT x.linked_goal_id AS g, count(*) AS n FROM l WHERE x.linked_goal_id IS NOT NULL GROUP BY 1), g AS (SELECT g FROM u WHERE 10 * n >= (SELECT max(n) FROM u))
SELECT entry_id, x.link_id AS link_id, x.linked_goal_id AS linked_goal_id, x.application_form AS form FROM l WHERE x.linked_goal_id IN (SELECT g FROM g) AND coalesce(list_has_all(known, x.knowledge_item_ids), true)""",
        "entity_groups": w + _ITEMS + r""", m AS (SELECT entry_id, pos, generate_subscripts(i.entity_mentions, 1) AS k, unnest(i.entity_mentions) AS m FROM it), n AS (SELECT m.kind AS kind, trim(m.name) AS title, trim(regexp_replace(lower(m.name), '[^a-z0-9]+', ' ', 'g')) AS key, entry_id, struct_pack(i := pos, m := k) AS pos FROM m
 WHERE m.kind IN ('tool', 'person', 'organization') AND trim(coalesce(m.name, '')) <> '' AND trim(coalesce(m.quote, '')) <> '')
SELECT kind, key, arg_min(title, struct_pack(e := entry_id, p := pos, t := title)) AS title, min(entry_id) AS entry_id, count(*) AS n_members, count(DISTINCT entry_id) AS n_entries FROM n WHERE key <> '' GROUP BY kind, key""",
        "shared_tags": "WITH e AS (SELECT DISTINCT entry_id, tags.topics AS t, " + _UTC.format("meta.created_at") + """ AS c FROM entries), x AS (SELECT DISTINCT entry_id, c, unnest(t) AS tag FROM e),
q AS (SELECT entry_id AS query_id, tag FROM x WHERE ('0x' || substr(entry_id, 3, 8))::BIGINT % 20 = 0), p AS (SELECT query_id, entry_id, count(*) AS shared, max(c) AS c FROM x JOIN q USING (tag) WHERE entry_id <> query_id GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, entry_id) AS rank FROM p) SELECT query_id, entry_id, shared, rank FROM r WHERE rank <= 3""",
        "contradictions": """WITH f AS (SELECT DISTINCT question_id AS query_id, entry_id FROM retrieved_items), e AS (SELECT DISTINCT entry_id AS source, r.target AS target FROM (SELECT entry_id, unnest(related_entries) AS r FROM entries) WHERE r.relation = 'contradicts')
SELECT DISTINCT a.query_id, source, target FROM e JOIN f a ON a.entry_id = source JOIN f b ON b.entry_id = target AND b.query_id = a.query_id""",
        "dangling_edges": "SELECT DISTINCT entry_id, r.target AS target, r.relation AS relation FROM (SELECT entry_id, unnest(related_entries) AS r FROM entries) WHERE r.target NOT IN (SELECT entry_id FROM entries)",
        "profile_affinities": w + "en AS (SELECT DISTINCT * FROM entries), " + _TAGS + " SELECT dimension, tag, round(1 - exp(sum(ln(1 - CASE WHEN score >= 4 THEN 0.3 ELSE 0.03 END))), 5) AS weight FROM tg WHERE score >= 3 GROUP BY dimension, tag",
        "profile_seeded": w + "en AS (SELECT DISTINCT * FROM entries), " + _TAGS + """, a AS (SELECT dimension, tag, 1 - exp(sum(ln(1 - CASE WHEN score >= 4 THEN 0.3 ELSE 0.03 END))) AS weight FROM tg WHERE score >= 3 GROUP BY dimension, tag),
f AS (SELECT tag, min(struct_pack(s := feedback.scored_at, e := entry_id)) AS first FROM (SELECT entry_id, feedback, unnest(tags.application_forms) AS tag FROM en WHERE feedback.score >= 3) GROUP BY tag),
s AS (SELECT x.application_form AS tag, min(struct_pack(s := feedback.scored_at, e := entry_id)) AS seeded FROM (SELECT entry_id, feedback, unnest(application_links) AS x FROM en WHERE feedback.score >= 4) WHERE x.novelty_flag AND x.application_form IS NOT NULL GROUP BY 1),
d AS (SELECT 'application_forms' AS dimension, s.tag FROM s LEFT JOIN f USING (tag) WHERE first IS NULL OR seeded < first)
SELECT coalesce(a.dimension, d.dimension) AS dimension, coalesce(a.tag, d.tag) AS tag, round(coalesce(weight, 0) + CASE WHEN d.tag IS NULL THEN 0 ELSE 0.3 END * (1 - coalesce(weight, 0)), 5) AS weight FROM a FULL JOIN d ON a.dimension = d.dimension AND a.tag = d.tag""",
        "profile_reasons": w + "en AS (SELECT DISTINCT * FROM entries), " + _TAGS + " SELECT dimension, tag, reason, count(*) AS n FROM tg WHERE score <= 2 AND reason = 'wrong_for_me' GROUP BY ALL",
        "profile_aversions": w + "en AS (SELECT DISTINCT * FROM entries), " + _TAGS + " SELECT dimension, tag, round(1 - pow(0.7, count(*)), 5) AS weight, count(*) AS n FROM tg WHERE score <= 2 AND reason = 'wrong_for_me' GROUP BY dimension, tag",
        "profile_known_topics": w + "en AS (SELECT DISTINCT * FROM entries), " + _TAGS + " SELECT DISTINCT tag AS topic FROM tg WHERE score <= 2 AND reason = 'already_knew' AND dimension = 'topics'",
        "profile_confidence": "WITH m AS (SELECT left(c, 7) AS month, count(*) AS n_entries FROM (SELECT DISTINCT entry_id, meta.created_at AS c FROM entries) GROUP BY 1) SELECT month, n_entries, round(least(1.0, sum(n_entries) OVER (ORDER BY month) / 30.0), 6) AS confidence FROM m",
        "top_affinities": w + "en AS (SELECT DISTINCT * FROM entries), " + _TAGS + " SELECT tag, round(1 - exp(sum(ln(1 - CASE WHEN score >= 4 THEN 0.3 ELSE 0.03 END))), 5) AS weight FROM tg WHERE score >= 3 AND dimension = 'topics' GROUP BY tag ORDER BY weight DESC, tag LIMIT 5",
        "entry_slugs": w + _SLUGS + " SELECT entry_id, slug FROM sl",
        "source_pages": w + "en AS (SELECT DISTINCT * FROM entries), " + _SLUGS + ", " + _PAGES.replace("\\\\", "\\") + " SELECT 'sources' AS dir, slug, body FROM pg",
        "index_lines": w + _SLUGS + " SELECT slug, '- [' || coalesce(nullif(e.t, ''), slug) || '](' || slug || '.md)' AS line FROM sl JOIN (SELECT DISTINCT entry_id, source.title AS t FROM entries) e USING (entry_id)",
        "page_lint": w + _SLUGS + """ SELECT DISTINCT 'E4' AS code, 'sources/' || slug AS page, '' AS detail FROM sl UNION ALL SELECT DISTINCT 'E3', 'sources/' || slug, '' FROM sl WHERE entry_id NOT IN (SELECT entry_id FROM entry_index)
UNION ALL SELECT DISTINCT 'E2', 'sources/' || slug, r.target || '.md' FROM (SELECT entry_id, unnest(related_entries) AS r FROM entries) JOIN sl USING (entry_id) WHERE r.target NOT IN (SELECT entry_id FROM entries)""",
        "citations": w + _ITEMS + ", " + _PARTS + ", " + _SLUGS + """, c AS (SELECT entry_id, pos, x.text AS t, x.item_ids AS ids FROM pt WHERE x.section = 'key_points'), u AS (SELECT entry_id, pos, t, generate_subscripts(ids, 1) AS k, unnest(ids) AS item_id FROM c),
d AS (SELECT entry_id, pos, t, item_id, min(k) AS k FROM u GROUP BY ALL) SELECT d.entry_id, d.pos, trim(t) || ' ' || string_agg('[' || slug || coalesce(' @ ' || i.provenance.timestamp, '') || ']', '' ORDER BY k) AS text
FROM d JOIN it ON it.entry_id = d.entry_id AND i.item_id = d.item_id JOIN sl ON sl.entry_id = d.entry_id GROUP BY d.entry_id, d.pos, t""",
        "index_parity": "SELECT DISTINCT entry_id, 'left only' AS side FROM entries WHERE entry_id NOT IN (SELECT entry_id FROM entry_index) UNION ALL SELECT DISTINCT entry_id, 'right only' FROM entry_index WHERE entry_id NOT IN (SELECT entry_id FROM entries)",
        "reindex_needed": w + _ITEMS + " SELECT DISTINCT it.entry_id, i.item_id AS item_id FROM it WHERE NOT EXISTS (SELECT 1 FROM item_vectors v WHERE v.entry_id = it.entry_id AND v.item_id = i.item_id AND v.embedding_model = 'embed-base')",
        "library_search": "SELECT entry_id, title, score::BIGINT AS score, created_at FROM (SELECT DISTINCT * FROM entry_index) WHERE contains(lower(concat_ws(' ', title, entry_id, array_to_string(topics, ' '), array_to_string(knowledge_types, ' '))), 'the') AND list_contains(topics, 'budgeting') AND score >= 3 ORDER BY " + _UTC.format("created_at") + " DESC, entry_id LIMIT 30",
    }
