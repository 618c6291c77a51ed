"""Queries over pages, listings and reports derived from entries, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.errors import error_class, error_line
from millrace.functions.text import slugify
from millrace.functions.times import utc_timestamp
from millrace.operators import items as I  # noqa: N812
from millrace.operators import knowledge as K  # noqa: N812
from millrace.operators import pages as P  # noqa: N812
from millrace.plans.session import load
from millrace.sources.transcripts import recovered_raw


def _mentions(spark: SparkSession, d: str) -> DataFrame:
    items = I.flat_items(load(spark, d, "entries"))
    return K.entity_mentions(items).join(items.select("entry_id", "item_id", "statement"), ["entry_id", "item_id"])


def first_quotes(spark: SparkSession, d: str) -> DataFrame:
    """The first quote of every entity in each entry."""
    m = _mentions(spark, d).withColumn("key", F.lower("name"))
    return m.groupBy("kind", "key", "entry_id").agg(F.min_by("quote", F.struct("pos", "quote")).alias("quote"))


def entity_evidence(spark: SparkSession, d: str) -> DataFrame:
    """All statements that name an entity, each once and in order, as one text."""
    m = _mentions(spark, d).select("kind", F.lower("name").alias("key"), "entry_id", "pos", "statement")
    once = m.groupBy("kind", "key", "statement").agg(F.min(F.struct("entry_id", "pos")).alias("at"))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("at", "statement"))), lambda x: x["statement"])
    return once.groupBy("kind", "key").agg(F.array_join(texts, " ").alias("evidence"), F.count(F.lit(1)).alias("n_statements"))


def pending_entities(spark: SparkSession, d: str) -> DataFrame:
    """Entities by number of mentions: the first five of a kind are written out, the others wait."""
    groups = K.new_groups(K.entity_mentions(I.flat_items(load(spark, d, "entries"))).select("kind", F.col("name").alias("title"), "entry_id", "pos"))
    # Ranked among the best of each kind only, so that the window holds no whole kind.
    order = Window.partitionBy("kind").orderBy(F.desc("n_members"), "key")
    best = groups.withColumn("r", F.row_number().over(order)).filter("r <= 5").select("kind", "key", F.lit("written").alias("state"))
    rest = groups.join(best, ["kind", "key"], "left_anti").select("kind", "key", F.lit("pending").alias("state"))
    return best.unionAll(rest)


def covering_entities(spark: SparkSession, d: str) -> DataFrame:
    """The entities of each entry in order of their names."""
    m = K.entity_mentions(I.flat_items(load(spark, d, "entries"))).select("entry_id", F.lower("name").alias("name")).distinct()
    return m.groupBy("entry_id").agg(F.array_join(F.sort_array(F.collect_list("name")), ", ").alias("entities"))


def numbered_items(spark: SparkSession, d: str) -> DataFrame:
    """Item ids made from the position: with the run's number in front where an entry has several runs."""
    runs = load(spark, d, "extraction_runs").select("entry_id", "run_id", "item_count").filter("entry_id is not null")
    of_entry = Window.partitionBy("entry_id")
    numbered = runs.withColumn("c", F.row_number().over(of_entry.orderBy("run_id")) - 1).withColumn("n", F.count(F.lit(1)).over(of_entry))
    each = numbered.filter("item_count > 0").select("entry_id", "run_id", "c", "n", F.explode(F.sequence(F.lit(1), F.col("item_count"))).alias("k"))
    name = F.format_string("k_%02d", "k")
    return each.select("run_id", F.col("k").cast("long").alias("k"), F.when(F.col("n") > 1, F.concat(F.format_string("k_c%02d_", "c"), name)).otherwise(name).alias("item_id"))


def error_classes(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "jobs").filter("error is not null").groupBy(error_line(F.col("error")).alias("line"), error_class(F.col("error")).alias("class")).agg(F.countDistinct("job_id").alias("n_jobs"))


def summary_floor(spark: SparkSession, d: str) -> DataFrame:
    """Summaries that are short for their entry's transcript: under 8 % of its characters or under 40."""
    lines = I.transcript_lines(load(spark, d, "segments"))
    size = lines.groupBy("entry_id").agg((F.sum(F.length(F.coalesce("text", F.lit("")))) + F.count(F.lit(1)) - 1).alias("n_chars"))
    floor = F.greatest(F.lit(40), F.floor(F.col("n_chars") * F.lit(0.08))).cast("long")
    rows = load(spark, d, "narrative_summaries").filter("text is not null").select("summary_id", "entry_id", F.length("text").cast("long").alias("n"))
    return rows.join(size.select("entry_id", floor.alias("least")), "entry_id").filter("n < least").select("summary_id", "n", "least")


def reconcile_report(spark: SparkSession, d: str) -> DataFrame:
    """What is left of entries that are gone: index rows and vectors, and entries without an index row."""
    entries = load(spark, d, "entries").select("entry_id").distinct()
    index = load(spark, d, "entry_index").select("entry_id").distinct()
    vectors = load(spark, d, "item_vectors").filter("entry_id is not null").groupBy("entry_id").agg(F.count(F.lit(1)).alias("n_rows"))
    stale = index.join(entries, "entry_id", "left_anti").select("entry_id", F.lit("index row").alias("what"), F.lit(1).cast("long").alias("n_rows"))
    unlisted = entries.join(index, "entry_id", "left_anti").select("entry_id", F.lit("not in the index"), F.lit(1).cast("long"))
    return stale.unionAll(unlisted).unionAll(vectors.join(entries, "entry_id", "left_anti").select("entry_id", F.lit("vectors"), "n_rows"))


def newest_entries(spark: SparkSession, d: str) -> DataFrame:
    """The index newest first, without rows whose entry is gone: a page of 30."""
    rows = load(spark, d, "entry_index").distinct().join(load(spark, d, "entries").select("entry_id").distinct(), "entry_id", "left_semi")
    return rows.orderBy(F.desc(utc_timestamp(F.col("created_at"))), "entry_id").limit(30).select("entry_id", "title", "created_at")


def raw_pages_recovered(spark: SparkSession, d: str) -> DataFrame:
    """Transcript lines written as raw page lines and read back: lines and characters of each entry."""
    lines = I.transcript_lines(load(spark, d, "segments")).filter("text is not null and trim(text) <> ''")
    label = F.coalesce("ts", "locator")
    section = F.floor(F.col("no") / I.SECTION_LINES)
    line = F.concat(F.lit("**["), label, F.lit("]** "), F.regexp_replace("text", "\n", " "))
    pages = lines.groupBy("entry_id", section.alias("section")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", line.alias("line")))), lambda x: x["line"]), "\n\n").alias("body"))
    back = recovered_raw(pages.select(F.struct("entry_id", "section").alias("slug"), F.concat(F.lit("## Transcript\n\n"), "body", F.lit("\n")).alias("body")))
    return back.groupBy("slug.entry_id").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("text")).alias("n_chars"))


def answer_payloads(spark: SparkSession, d: str) -> DataFrame:
    """The three best retrievals of each question as a JSON payload; answered if one of them clears the gate."""
    rows = load(spark, d, "retrieved_items").select("question_id", "retrieval_id", "entry_id", "item_id", "score", "similarity")
    best = rows.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score"), "retrieval_id"))).filter("rank <= 3")
    sources = F.transform(F.array_sort(F.collect_list(F.struct("rank", "entry_id", "item_id"))), lambda x: F.struct(x["entry_id"].alias("entry"), x["item_id"].alias("item")))
    return best.groupBy("question_id").agg(F.to_json(F.struct(F.coalesce(F.max(F.col("similarity") >= 0.45), F.lit(False)).alias("answered"), sources.alias("sources"))).alias("payload"))


def user_liveness(spark: SparkSession, d: str, stale_seconds: int = 300) -> DataFrame:
    """Users seen in the last five minutes of the table."""
    events = load(spark, d, "events")
    now = events.agg(F.max("ts")).scalar()
    late = F.timestamp_diff("SECOND", F.col("last"), now)
    return events.groupBy("user_id").agg(F.max("ts").alias("last")).select("user_id", F.when(late > stale_seconds, "stale").otherwise("live").alias("state"))


def entity_pages(spark: SparkSession, d: str) -> DataFrame:
    """A page for each entity: its name, kind, the entries that name it and the first quotes."""
    quotes = first_quotes(spark, d).join(P.entry_slugs(load(spark, d, "entries")), "entry_id")
    line = F.concat(F.lit("- [source](../sources/"), "slug", F.lit('.md): "'), "quote", F.lit('"'))
    each = quotes.groupBy("kind", "key").agg(F.array_sort(F.collect_list(F.struct("slug", line.alias("line")))).alias("l"))
    head = F.concat(F.lit("---\ntype: entity\nkind: "), "kind", F.lit("\nvideos: ["), F.array_join(F.transform("l", lambda x: x["slug"]), ", "), F.lit("]\n---\n\n# "), "key", F.lit("\n\n## Sources\n\n"))
    return each.select("kind", "key", F.concat(head, F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit("\n")).alias("body"))


def _bundle(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(pages, listed) of all directories, as tables that don't agree give them.

    Concepts are the topics of the index, whose rows may be stale, and sources cover the topics of their entry. A topic
    of two words has no type, one that starts with a vowel another; organizations have another type than entities;
    persons name a source that isn't there, and sources don't cover them. Listed are topics of several entries and what
    isn't a tool.
    """
    entries = load(spark, d, "entries")
    slugs = P.entry_slugs(entries)
    index = load(spark, d, "entry_index").select("entry_id", F.explode("topics").alias("topic")).distinct().join(slugs, "entry_id", "left")
    kind = F.when(F.contains("topic", F.lit("-")), F.lit(None)).when(F.col("topic").rlike("^[aeiou]"), "topic").otherwise("concept")
    concepts = index.select(F.col("topic").alias("slug"), F.col("topic").alias("title"), kind.alias("type"), F.coalesce("slug", "entry_id").alias("source"), F.lit(None).cast("string").alias("quote"), F.lit(True).alias("listed"))
    named = first_quotes(spark, d).join(slugs, "entry_id").select(slugify(F.concat_ws(" ", "kind", "key")).alias("target"), F.col("key").alias("title"), "kind", "slug", "quote")
    entity = F.when(F.col("kind") == "organization", "organization").otherwise("entity")
    entities = named.select(F.col("target").alias("slug"), "title", entity.alias("type"), F.col("slug").alias("source"), "quote", F.lit(True).alias("listed"))
    stray = named.filter("kind = 'person'").select("target", "title", F.lit("entity"), F.lit("gone-source"), F.lit(None).cast("string"), F.lit(False)).distinct()
    covered = entries.select("entry_id", F.explode("tags.topics").alias("target")).join(slugs, "entry_id").select("slug", F.lit("concepts").alias("dir"), "target").unionAll(named.filter("kind <> 'person'").select("slug", F.lit("entities"), "target"))
    raw = slugs.join(load(spark, d, "segments").select("entry_id").distinct(), "entry_id", "left_semi")
    pages = P.with_backlinks(P.source_pages(entries), covered).unionAll(P.group_pages(concepts, "concepts")).unionAll(P.group_pages(entities.unionAll(stray), "entities")).unionAll(P.raw_heads(raw))
    listed = load(spark, d, "entry_index").select("entry_id").distinct().join(slugs, "entry_id").select(F.lit("sources").alias("dir"), "slug")
    listed = listed.unionAll(index.groupBy("topic").agg(F.countDistinct("entry_id").alias("n")).filter("n > 1").select(F.lit("concepts"), "topic")).unionAll(named.filter("kind <> 'tool'").select(F.lit("entities"), "target").distinct())
    return pages, listed


def bundle_pages(spark: SparkSession, d: str) -> DataFrame:
    """All pages without those of deleted entries: their number and length by directory."""
    gone = load(spark, d, "entry_deletions").select("entry_id").join(P.entry_slugs(load(spark, d, "entries")), "entry_id").select(F.explode(F.array(F.lit("sources"), F.lit("raw"))).alias("dir"), "slug")
    left = P.without_pages(_bundle(spark, d)[0], gone)
    return left.groupBy("dir").agg(F.count(F.lit(1)).alias("n"))


def bundle_lint(spark: SparkSession, d: str) -> DataFrame:
    return P.lint(*_bundle(spark, d))


def bundle_index(spark: SparkSession, d: str) -> DataFrame:
    return P.bundle_index(_bundle(spark, d)[0]).withColumn("nth", F.col("nth").cast("long"))


def teaching_notes(spark: SparkSession, d: str) -> DataFrame:
    entries = load(spark, d, "entries")
    return P.note_markdown(K.note_parts(entries), entries.select("entry_id", F.col("distilled_note.title").alias("title")).distinct())


_UTC = r"CASE WHEN regexp_matches({0}, '(Z|[+-]\d{{2}}:\d{{2}})$') THEN {0} ELSE {0} || 'Z' END::TIMESTAMPTZ"
_M = """WITH it AS (SELECT entry_id, generate_subscripts(knowledge_items, 1) - 1 AS ip, unnest(knowledge_items) AS i FROM (SELECT DISTINCT entry_id, knowledge_items FROM entries)),
m0 AS (SELECT entry_id, i.item_id AS item_id, i.statement AS statement, struct_pack(i := ip, m := generate_subscripts(i.entity_mentions, 1) - 1) AS pos, unnest(i.entity_mentions) AS m FROM it),
m AS (SELECT entry_id, item_id, statement, pos, m.kind AS kind, lower(trim(m.name)) AS key, CASE WHEN len(regexp_split_to_array(trim(m.quote), '\\s+')) > 14 THEN array_to_string(regexp_split_to_array(trim(m.quote), '\\s+')[1:14], ' ') ELSE trim(m.quote) END AS quote FROM m0 WHERE m.kind IN ('tool', 'person', 'organization') AND trim(coalesce(m.name, '')) <> '' AND trim(coalesce(m.quote, '')) <> '')"""
_LINES = r"WITH k AS (SELECT entry_id, regexp_extract(locator, '(\d+)\s*$', 1)::BIGINT AS no, arg_min(struct_pack(t := text, ts := ts, loc := locator), segment_id) AS r FROM segments GROUP BY ALL)"


def queries() -> dict:
    return {f.__name__: f for f in (
        first_quotes, entity_evidence, pending_entities, covering_entities, numbered_items, error_classes, summary_floor, reconcile_report, newest_entries, raw_pages_recovered, answer_payloads, user_liveness, entity_pages, bundle_pages, bundle_lint, bundle_index, teaching_notes,
    )}


def oracle_sql() -> dict[str, str]:
    from millrace.plans.knowledge_queries import _PARTS, _SLUGS

    quotes = "fq AS (SELECT kind, key, entry_id, arg_min(quote, struct_pack(p := pos, q := quote)) AS quote FROM m GROUP BY ALL)"
    bundle = _M + ", " + quotes + ", " + _SLUGS + r""", ix AS (SELECT DISTINCT entry_id, unnest(topics) AS t FROM entry_index), cv AS (SELECT DISTINCT t, coalesce(slug, entry_id) AS v, entry_id FROM ix LEFT JOIN sl USING (entry_id)),
st AS (SELECT DISTINCT slug AS v, t FROM (SELECT entry_id, unnest(tags.topics) AS t FROM entries) JOIN sl USING (entry_id)),
ev AS (SELECT DISTINCT trim(regexp_replace(lower(kind || ' ' || key), '[^a-z0-9]+', '-', 'g'), '-') AS e, kind, key, slug AS v FROM fq JOIN sl USING (entry_id)), rw AS (SELECT slug FROM sl WHERE entry_id IN (SELECT entry_id FROM segments))"""
    return {
        "bundle_pages": bundle + """, dl AS (SELECT slug FROM sl WHERE entry_id IN (SELECT entry_id FROM entry_deletions))
SELECT 'sources' AS dir, count(*) AS n FROM sl WHERE slug NOT IN (SELECT * FROM dl) UNION ALL SELECT 'raw', count(*) FROM rw WHERE slug NOT IN (SELECT * FROM dl) UNION ALL SELECT 'concepts', count(DISTINCT t) FROM cv UNION ALL SELECT 'entities', count(DISTINCT e) FROM ev""",
        "bundle_lint": bundle + """, typed AS (SELECT DISTINCT t, contains(t, '-') AS none, contains(t, '-') OR left(t, 1) IN ('a', 'e', 'i', 'o', 'u') AS other FROM cv)
SELECT 'E1' AS code, 'concepts/' || t AS page, '' AS detail FROM typed WHERE none UNION SELECT 'E5b', 'concepts/' || t, '' FROM typed WHERE other UNION SELECT 'E9b', 'entities/' || e, '' FROM ev WHERE kind = 'organization'
UNION SELECT 'E2', 'sources/' || slug, r.target || '.md' FROM (SELECT entry_id, unnest(related_entries) AS r FROM entries) JOIN sl USING (entry_id) WHERE r.target NOT IN (SELECT entry_id FROM entries)
UNION SELECT 'E2', 'sources/' || v, '../concepts/' || t || '.md' FROM st WHERE t NOT IN (SELECT t FROM cv) UNION SELECT 'E2', 'concepts/' || t, '../sources/' || v || '.md' FROM cv WHERE v NOT IN (SELECT slug FROM sl)
UNION SELECT 'E3', 'sources/' || slug, '' FROM sl WHERE entry_id NOT IN (SELECT entry_id FROM entry_index) UNION SELECT 'E4', 'sources/' || slug, '' FROM sl WHERE slug NOT IN (SELECT slug FROM rw)
UNION SELECT 'E5', 'concepts/' || t, '' FROM cv GROUP BY t HAVING count(DISTINCT entry_id) < 2 UNION SELECT 'E9', 'entities/' || e, '' FROM ev WHERE kind = 'tool'
UNION SELECT 'E6', 'concepts/' || t, 'video ' || v FROM cv WHERE v NOT IN (SELECT slug FROM sl) UNION SELECT 'E10', 'entities/' || e, 'video gone-source' FROM ev WHERE kind = 'person'
UNION SELECT 'E7', 'concepts/' || t, 'no link back from ' || v FROM cv WHERE (t, v) NOT IN (SELECT (t, v) FROM st) UNION SELECT 'E7', 'concepts/' || t, 'doesn''t cite back ' || v FROM st WHERE (t, v) NOT IN (SELECT (t, v) FROM cv)
UNION SELECT 'E11', 'entities/' || e, 'no link back from ' || v FROM ev WHERE kind = 'person' UNION SELECT 'E8', 'concepts/' || t, '' FROM cv WHERE t NOT IN (SELECT t FROM st) UNION SELECT 'E12', 'entities/' || e, '' FROM ev WHERE kind = 'person'""",
        "bundle_index": bundle + """, pg AS (SELECT 'sources' AS dir, slug, coalesce(nullif(t, ''), slug) AS title FROM sl JOIN (SELECT DISTINCT entry_id, source.title AS t FROM entries) USING (entry_id) UNION ALL SELECT DISTINCT 'concepts', t, t FROM cv UNION ALL SELECT 'entities', e, min(key) FROM ev GROUP BY e)
SELECT dir, row_number() OVER (PARTITION BY dir ORDER BY CASE dir WHEN 'sources' THEN slug ELSE lower(title) END, slug) AS nth, '- [' || title || '](' || slug || '.md)' AS line FROM pg
UNION ALL SELECT '', row_number() OVER (ORDER BY dir), '- [' || dir || '](' || dir || '/index.md) (' || n || ')' FROM (SELECT dir, count(*) AS n FROM pg GROUP BY dir)""",
        "teaching_notes": "WITH en AS (SELECT DISTINCT entry_id, distilled_note FROM entries), " + _PARTS + """, p AS (SELECT entry_id, x.section AS s, pos, trim(x.text) AS t FROM pt WHERE trim(coalesce(x.text, '')) <> ''),
s AS (SELECT entry_id, s, list_position(['core_takeaway', 'key_points', 'why_it_matters', 'how_to_apply', 'caveats', 'review_questions'], s) AS r, string_agg(CASE s WHEN 'core_takeaway' THEN t ELSE '- ' || t END, chr(10) ORDER BY pos) AS l FROM p GROUP BY ALL),
b AS (SELECT entry_id, string_agg('## ' || ['Core takeaway', 'Key points', 'Why it matters', 'How to apply', 'Caveats', 'Review questions'][r] || chr(10) || chr(10) || l, chr(10) || chr(10) ORDER BY r) AS l FROM s GROUP BY entry_id)
SELECT entry_id, '# ' || coalesce(distilled_note.title, 'Untitled') || chr(10) || chr(10) || l || chr(10) AS body FROM b JOIN en USING (entry_id)""",
        "first_quotes": _M + ", " + quotes + " SELECT * FROM fq",
        "entity_evidence": _M + """, o AS (SELECT kind, key, statement, min(struct_pack(e := entry_id, p := pos)) AS a FROM m GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY kind, key ORDER BY a, statement) AS r FROM o)
SELECT kind, key, string_agg(statement, ' ' ORDER BY r) AS evidence, count(*) AS n_statements FROM r GROUP BY ALL""",
        "pending_entities": _M + r", g AS (SELECT kind, trim(regexp_replace(key, '[^a-z0-9]+', ' ', 'g')) AS key, count(*) AS n FROM m GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, key) AS r FROM g) SELECT kind, key, CASE WHEN r <= 5 THEN 'written' ELSE 'pending' END AS state FROM r",
        "covering_entities": _M + " SELECT entry_id, string_agg(key, ', ' ORDER BY key) AS entities FROM (SELECT DISTINCT entry_id, key FROM m) GROUP BY entry_id",
        "numbered_items": """WITH r AS (SELECT run_id, item_count, row_number() OVER (PARTITION BY entry_id ORDER BY run_id) - 1 AS c, count(*) OVER (PARTITION BY entry_id) AS n FROM extraction_runs WHERE entry_id IS NOT NULL), e AS (SELECT *, unnest(range(1, item_count + 1)) AS k FROM r WHERE item_count > 0)
SELECT run_id, k, CASE WHEN n > 1 THEN printf('k_c%02d_', c) ELSE '' END || printf('k_%02d', k) AS item_id FROM e""",
        "error_classes": r"""SELECT error AS line, CASE WHEN regexp_matches(error, '(?i)not a (ro)?bot|sign in to confirm|captcha') THEN 'robot check' WHEN regexp_matches(error, '(?i)time(d)?[ -]?out|temporar|connection (reset|refused|aborted)|unavailable|too many requests|\b(429|5\d\d)\b') THEN 'passing' ELSE 'lasting' END AS class,
count(DISTINCT job_id) AS n_jobs FROM jobs WHERE error IS NOT NULL GROUP BY ALL""",
        "summary_floor": _LINES + ", s AS (SELECT entry_id, sum(length(coalesce(r.t, ''))) + count(*) - 1 AS n FROM k GROUP BY entry_id), f AS (SELECT entry_id, greatest(40, floor(n * 0.08))::BIGINT AS least FROM s) SELECT summary_id, length(text) AS n, least FROM narrative_summaries JOIN f USING (entry_id) WHERE length(text) < least",
        "reconcile_report": "WITH e AS (SELECT DISTINCT entry_id FROM entries), i AS (SELECT DISTINCT entry_id FROM entry_index) SELECT entry_id, 'index row' AS what, 1::BIGINT AS n_rows FROM i WHERE entry_id NOT IN (SELECT * FROM e) UNION ALL SELECT entry_id, 'not in the index', 1 FROM e WHERE entry_id NOT IN (SELECT * FROM i) UNION ALL SELECT entry_id, 'vectors', count(*) FROM item_vectors WHERE entry_id NOT IN (SELECT * FROM e) GROUP BY entry_id",
        "newest_entries": "SELECT entry_id, title, created_at FROM (SELECT DISTINCT * FROM entry_index) WHERE entry_id IN (SELECT entry_id FROM entries) ORDER BY " + _UTC.format("created_at") + " DESC, entry_id LIMIT 30",
        "raw_pages_recovered": _LINES + " SELECT entry_id, count(*) AS n_lines, sum(length(r.t))::BIGINT AS n_chars FROM k WHERE trim(r.t) <> '' GROUP BY entry_id",
        "answer_payloads": """WITH r AS (SELECT question_id, entry_id, item_id, similarity, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, retrieval_id) AS rank FROM retrieved_items)
SELECT question_id, '{"answered":' || coalesce(bool_or(similarity >= 0.45), false) || ',"sources":[' || string_agg('{"entry":"' || entry_id || '","item":"' || item_id || '"}', ',' ORDER BY rank) || ']}' AS payload FROM r WHERE rank <= 3 GROUP BY question_id""",
        "user_liveness": "SELECT user_id, CASE WHEN date_sub('second', max(ts), (SELECT max(ts) FROM events)) > 300 THEN 'stale' ELSE 'live' END AS state FROM events GROUP BY user_id",
        "entity_pages": _M + ", " + quotes + ", " + _SLUGS + """ SELECT kind, key, '---' || chr(10) || 'type: entity' || chr(10) || 'kind: ' || kind || chr(10) || 'videos: [' || string_agg(slug, ', ' ORDER BY slug) || ']' || chr(10) || '---' || chr(10) || chr(10) || '# ' || key || chr(10) || chr(10) || '## Sources' || chr(10) || chr(10)
 || string_agg('- [source](../sources/' || slug || '.md): "' || quote || '"', chr(10) ORDER BY slug) || chr(10) AS body FROM fq JOIN sl USING (entry_id) GROUP BY kind, key""",
    }
