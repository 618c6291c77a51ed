"""Queries over documents, transcripts, model answers, jobs and events, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as T  # noqa: N812
from millrace.functions.jsonx import answer_items
from millrace.functions.times import clock, padded_clock, spoken_duration, utc_timestamp
from millrace.functions.urls import is_allowed_host, playlist_id, video_id, watch_url
from millrace.operators import items as I  # noqa: N812
from millrace.plans.session import load
from millrace.sources.tables import deleted, latest, upserted
from millrace.sources.transcripts import parsed_documents, staged, unstaged

#: Hosts of the source addresses in the test tables.
HOSTS = ("video.example", "www.video.example")


def normalized_texts(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", T.normalize_text(F.col("text")).alias("normalized"))


def document_words(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", T.word_count(F.col("text")).cast("long").alias("n_words"), F.size(T.ascii_tokens(F.col("text"))).cast("long").alias("n_tokens"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"))


def exact_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose normalised texts are equal: the first one, how many there are, and the first known title."""
    rows = load(spark, d, "documents").filter("text is not null").withColumn("key", F.md5(T.normalize_text(F.col("text"))))
    groups = rows.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"), F.min_by("title", F.when(F.col("title").isNotNull(), F.col("doc_id"))).alias("title"), F.countDistinct("source").alias("n_sources"))
    return groups.filter((F.col("n") > 1) & (F.col("key") != F.md5(F.lit("")))).select("doc_id", "n", "title", "n_sources")


def chunk_documents(spark: SparkSession, d: str, target: int = 1_000) -> DataFrame:
    return I.greedy_chunks(load(spark, d, "documents"), "doc_id", T.sentences(F.col("text")), target).select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.col("text").alias("chunk_text"))


def chunk_context(spark: SparkSession, d: str) -> DataFrame:
    chunks = I.greedy_chunks(load(spark, d, "documents"), "doc_id", T.sentences(F.col("text")), 1_000)
    return I.chunk_contexts(chunks, "doc_id", 120).select("doc_id", F.col("chunk").cast("long").alias("chunk"), "context")


def parsed_transcripts(spark: SparkSession, d: str) -> DataFrame:
    segments, _ = parsed_documents(load(spark, d, "documents"), "doc_id")
    return segments.select("doc_id", "format", F.col("no").cast("long").alias("no"), "locator", "ts", "text")


def rejected_transcripts(spark: SparkSession, d: str) -> DataFrame:
    _, rejects = parsed_documents(load(spark, d, "documents"), "doc_id")
    return rejects.select("doc_id", "format", F.col("n_words").cast("long").alias("n_words"), "reason")


def parsed_subtitles(spark: SparkSession, d: str) -> DataFrame:
    """Every transcript of the segments with a time written as SRT text and parsed back: cues per entry."""
    lines = I.transcript_lines(load(spark, d, "segments")).filter("text is not null and trim(text) <> '' and ts is not null")
    time = F.regexp_replace(F.when(F.length("ts") == 5, F.concat(F.lit("00:"), "ts")).otherwise(F.col("ts")), ",.*$", "")
    cue = F.concat(F.col("no").cast("string"), F.lit("\n"), time, F.lit(",000 --> "), time, F.lit(",500\n"), F.regexp_replace(F.trim("text"), r"\n\s*", " "))
    block = F.floor(F.col("no") / I.SECTION_LINES)
    texts = lines.groupBy("entry_id", block.alias("block")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", cue.alias("cue")))), lambda x: x["cue"]), "\n\n").alias("text"))
    segments, _ = parsed_documents(texts.select(F.struct("entry_id", "block").alias("id"), "text", F.lit("srt").alias("kind")), "id", "kind", 0)
    return segments.groupBy("id.entry_id").agg(F.count(F.lit(1)).alias("n_cues"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def staged_transcripts(spark: SparkSession, d: str) -> DataFrame:
    """Transcripts staged as JSON and read again: lines and characters of each."""
    back = unstaged(staged(I.transcript_lines(load(spark, d, "segments"))))
    return back.groupBy("entry_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count("text").alias("n_texts"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("n_chars"), F.count("ts").alias("n_times"))


def segment_clocks(spark: SparkSession, d: str) -> DataFrame:
    """Times of the segments in one spelling."""
    parts = F.split(F.regexp_replace("ts", r"[.,]\d+$", ""), ":")
    seconds = F.when(F.size(parts) == 2, parts[0].cast("long") * 60 + parts[1].cast("long")).otherwise(F.get(parts, F.lit(0)).cast("long") * 3600 + F.get(parts, F.lit(1)).cast("long") * 60 + F.get(parts, F.lit(2)).cast("long"))
    rows = load(spark, d, "segments").filter("ts is not null").select("segment_id", seconds.alias("seconds"))
    return rows.select("segment_id", clock(F.col("seconds")).alias("hms"), padded_clock(F.regexp_replace(spoken_duration(F.col("seconds")), "^0:", "0:")).alias("padded"), spoken_duration(F.col("seconds")).alias("spoken"))


def entity_listing(spark: SparkSession, d: str) -> DataFrame:
    mentions = load(spark, d, "entries").select("entry_id", F.explode("knowledge_items").alias("i")).select("entry_id", F.explode("i.entity_mentions").alias("m"))
    return mentions.groupBy("m.kind", F.lower("m.name").alias("name")).agg(F.count(F.lit(1)).alias("n_mentions"), F.countDistinct("entry_id").alias("n_entries"))


def answer_arrays(spark: SparkSession, d: str) -> DataFrame:
    """Items of each raw answer, with whether a broken array was salvaged."""
    rows = load(spark, d, "extraction_runs").select("run_id", "item_count", answer_items(F.col("response")).alias("a"))
    return rows.select("run_id", F.size("a.items").cast("long").alias("n_items"), F.col("a.salvaged").alias("salvaged"), F.col("a.error").alias("error"), F.col("item_count").cast("long").alias("item_count"))


def answer_items_valid(spark: SparkSession, d: str) -> DataFrame:
    """Items of the answers by schema: type repaired where unknown, without a statement dropped, and whether at least half of
    an answer's items are valid."""
    schema = "type string, statement string, stance string, provenance struct<quote:string,timestamp:string>"
    rows = load(spark, d, "extraction_runs").select("run_id", F.posexplode(answer_items(F.col("response"))["items"]).alias("pos", "json"))
    item = rows.select("run_id", "pos", F.from_json("json", schema).alias("i"))
    types = ("procedural", "conceptual", "declarative", "experiential", "heuristic", "opinion")
    checked = item.select("run_id", "pos", F.when(F.col("i.type").isin(*types), F.col("i.type")).otherwise("conceptual").alias("type"), (F.trim(F.coalesce("i.statement", F.lit(""))) != "").alias("valid"))
    return checked.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_items"), F.sum(F.col("valid").cast("long")).alias("n_valid"), F.countDistinct("type").alias("n_types")).withColumn("usable", F.col("n_valid") >= F.col("n_items") * 0.5)


def source_urls(spark: SparkSession, d: str) -> DataFrame:
    url = F.col("source_url")
    return load(spark, d, "jobs").filter(url.isNotNull()).select("source_url").distinct().select("source_url", is_allowed_host(url, HOSTS).alias("allowed"), video_id(url).alias("video_id"), watch_url(url, HOSTS).alias("watch_url"), playlist_id(url).alias("playlist_id"))


def upload_titles(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "jobs").filter("kind <> 'youtube'").select("payload", "title").distinct()
    return rows.select("payload", T.title_from_filename(F.col("payload")).alias("file_title"), T.display_title(F.col("payload"), F.col("title")).alias("shown"))


def job_latest(spark: SparkSession, d: str) -> DataFrame:
    """The last state of each job."""
    rows = load(spark, d, "jobs").withColumn("at", utc_timestamp(F.col("updated_at"))).select("job_id", "at", "phase_index", "status", "kind")
    return latest(rows, ["job_id"], ["at", "phase_index"]).select("job_id", "status", "kind", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("last_seen"))


def phase_minutes(spark: SparkSession, d: str) -> DataFrame:
    """Minutes from filing to the last change, by phase."""
    span = (F.unix_micros(utc_timestamp(F.col("updated_at"))) - F.unix_micros(utc_timestamp(F.col("created_at")))) / F.lit(60_000_000.0)
    rows = load(spark, d, "jobs").filter("current_phase is not null").select("job_id", "current_phase", span.alias("minutes")).distinct()
    return rows.groupBy("current_phase").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("minutes"), 3).alias("mean_minutes"), F.round(F.max("minutes"), 3).alias("max_minutes"))


def expired_leases(spark: SparkSession, d: str, as_of: str = "2025-06-30T00:00:00Z") -> DataFrame:
    """Jobs whose lease or deadline has passed at a fixed time, in their last state."""
    rows = load(spark, d, "jobs").withColumn("at", utc_timestamp(F.col("updated_at"))).select("job_id", "at", "phase_index", "status", "lease_expires_at", "collection_deadline")
    now = F.lit(as_of).cast("timestamp")
    last = latest(rows, ["job_id"], ["at", "phase_index"])
    lease, deadline = utc_timestamp(F.col("lease_expires_at")) < now, utc_timestamp(F.col("collection_deadline")) < now
    return last.select("job_id", "status", F.coalesce(lease, F.lit(False)).alias("lease_over"), F.coalesce(deadline, F.lit(False)).alias("deadline_over")).filter("lease_over or deadline_over")


def vector_latest(spark: SparkSession, d: str) -> DataFrame:
    """One vector row per key, the last embedded."""
    rows = load(spark, d, "item_vectors").withColumn("at", utc_timestamp(F.col("embedded_at"))).select("entry_id", "item_id", "embedding_model", "at")
    return latest(rows, ["entry_id", "item_id"], ["at", "embedding_model"]).select("entry_id", "item_id", "embedding_model")


def upsert_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The vectors with every fifth month embedded again by another model: rows per model."""
    rows = vector_latest(spark, d)
    again = rows.filter(F.col("item_id").endswith("5")).withColumn("embedding_model", F.lit("embed-next"))
    return upserted(rows, again, ["entry_id", "item_id"]).groupBy("embedding_model").agg(F.count(F.lit(1)).alias("n"))


def delete_entries(spark: SparkSession, d: str) -> DataFrame:
    """Vectors left after the deletions, per model; what was filed again isn't gone."""
    gone = load(spark, d, "entry_deletions").select("entry_id").join(load(spark, d, "entries").select("entry_id"), "entry_id", "left_anti")
    return deleted(load(spark, d, "item_vectors").distinct(), gone).groupBy("embedding_model").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("entry_id").alias("n_entries"))


def event_states(spark: SparkSession, d: str) -> DataFrame:
    """The last event of each user, and how many errors they had."""
    rows = load(spark, d, "events")
    return rows.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"), F.count(F.lit(1)).alias("n"), F.sum((F.col("event_type") == "error").cast("long")).alias("n_errors"))


def clean_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answer texts with item marks put in and taken out again."""
    rows = load(spark, d, "retrieved_items").select("retrieval_id", F.concat(F.trim("statement"), F.lit(" ["), "item_id", F.lit("] .")).alias("answer"))
    return rows.select("retrieval_id", T.without_citations(F.col("answer")).alias("clean"))


_S = r"[\s\x{00A0}\x{2007}\x{2009}\x{202F}]+"
_UTC = r"CASE WHEN regexp_matches({0}, '(Z|[+-]\d{{2}}:\d{{2}})$') THEN {0} ELSE {0} || 'Z' END::TIMESTAMPTZ"
_NORM = r"trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}_\s]+', ' ', 'g'), '\s+', ' ', 'g'))"
_CHUNKS = r"""WITH RECURSIVE s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(trim(text, chr(32)), '([.!?])\s+', '\1' || chr(30), 'g'), chr(30)), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents),
f(doc_id, l, i, chunk, cur) AS (SELECT doc_id, l, 1, 0, l[1] FROM s WHERE len(l) > 0
 UNION ALL SELECT doc_id, l, i + 1, CASE WHEN length(cur) + 1 + length(l[i + 1]) > 1000 THEN chunk + 1 ELSE chunk END, CASE WHEN length(cur) + 1 + length(l[i + 1]) > 1000 THEN l[i + 1] ELSE cur || ' ' || l[i + 1] END FROM f WHERE i < len(l)),
c AS (SELECT doc_id, chunk, arg_max(cur, i) AS t FROM f GROUP BY ALL)"""
_BLANK = "' ' || chr(9) || chr(11) || chr(12)"
_PARSED = rf"""WITH b AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '\r\n|\r|\n'), lambda x: trim(x) <> '') AS l FROM documents),
li AS (SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS x FROM b), w AS (SELECT doc_id, i, x, ltrim(x, {_BLANK}) AS y FROM li),
v AS (SELECT doc_id, i, trim(x) AS x, y, split_part(translate(y, chr(9), ' '), ' ', 1) AS tok FROM w),
z AS (SELECT *, length(tok) < length(y) AND regexp_full_match(tok, '[0-9][0-9]?(:[0-9][0-9]){{2}}([.,][0-9]+)?') AS long, regexp_extract(y, '^[0-9][0-9]?:[0-9][0-9]') AS ms FROM v),
ln AS (SELECT doc_id, list(struct_pack(x := x, long := long, h := lpad(split_part(replace(tok, ',', '.'), '.', 1), 8, '0'), r := trim(substr(y, length(tok) + 1)), short := ms <> '', sec := TRY_CAST(split_part(ms, ':', 1) AS INT) * 60 + TRY_CAST(split_part(ms, ':', 2) AS INT), s := trim(ltrim(substr(y, length(ms) + 1), {_BLANK}))) ORDER BY i) AS p FROM z GROUP BY doc_id),
f AS (SELECT b.*, coalesce(p, []) AS p, CASE WHEN len(l) = 0 THEN 'empty' WHEN len(list_filter(p, lambda q: q.long)) >= greatest(1, len(l) // 2) THEN 'inline' WHEN len(list_filter(p, lambda q: q.short)) >= greatest(1, len(l) // 2) THEN 'rolling' ELSE 'paragraphs' END AS format FROM b LEFT JOIN ln USING (doc_id)),
s AS (SELECT doc_id, format, CASE WHEN format = 'inline' THEN list_transform(p, lambda q: CASE WHEN q.long THEN struct_pack(ts := q.h, t := q.r) ELSE struct_pack(ts := NULL, t := q.x) END)
 WHEN format = 'rolling' AND len(list_filter(p, lambda q: NOT q.short)) = 0 AND list_sort(list_transform(p, lambda q: q.sec)) = list_transform(p, lambda q: q.sec) THEN list_transform(p, lambda q: struct_pack(ts := printf('%02d:%02d:%02d', q.sec // 3600, q.sec % 3600 // 60, q.sec % 60), t := q.s))
 WHEN format = 'paragraphs' THEN list_transform(regexp_split_to_array(trim(t), '\n[ \t]*(?:\n[ \t]*)+'), lambda p: struct_pack(ts := NULL::VARCHAR, t := array_to_string(list_filter(list_transform(regexp_split_to_array(p, '\r\n|\r|\n'), lambda x: trim(x)), lambda x: x <> '' AND NOT starts_with(x, '#')), ' '))) END AS seg FROM f),
k AS (SELECT doc_id, format, list_filter(seg, lambda x: x.t <> '') AS seg FROM s), n AS (SELECT *, coalesce(list_sum(list_transform(seg, lambda x: len(regexp_extract_all(x.t, '[^\s\x{{00A0}}\x{{2007}}\x{{2009}}\x{{202F}}]+')))), 0)::BIGINT AS n_words FROM k),
r AS (SELECT *, CASE WHEN format = 'empty' THEN 'empty' WHEN seg IS NULL THEN 'bad captions' WHEN len(seg) = 0 THEN 'no segments' WHEN n_words < 50 THEN 'too short' END AS reason FROM n)"""
_ANSWERS = r"""WITH a AS (SELECT run_id, item_count, response AS r, regexp_extract(response, '(?s)\[.*\]') AS whole, CASE WHEN strpos(response, '[') > 0 THEN substr(response, strpos(response, '[')) END AS tail FROM extraction_runs),
p AS (SELECT *, whole <> '' AND json_valid(whole) AS fine, regexp_split_to_array(tail, '\}\s*,\s*\{') AS parts FROM a),
c AS (SELECT *, list_filter(list_transform(range(1, len(parts)), lambda n: array_to_string(parts[1:n], '},{') || '}]') || [regexp_replace(tail, '[,\s`]*$', '') || ']'], lambda x: json_valid(x)) AS closed FROM p),
t AS (SELECT run_id, item_count, fine, CASE WHEN fine THEN whole WHEN len(closed) > 0 THEN closed[len(closed)] END AS items FROM c),
n AS (SELECT *, coalesce(json_array_length(items), 0)::BIGINT AS n_items FROM t)"""
_JOBS = "j AS (SELECT *, " + _UTC.format("updated_at") + " AS seen FROM jobs), l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seen DESC, phase_index DESC NULLS LAST, status DESC) AS r FROM j) WHERE r = 1)"


def queries() -> dict:
    return {f.__name__: f for f in (
        normalized_texts, document_words, exact_duplicates, chunk_documents, chunk_context, parsed_transcripts, rejected_transcripts, parsed_subtitles, staged_transcripts, segment_clocks, entity_listing, answer_arrays, answer_items_valid,
        source_urls, upload_titles, job_latest, phase_minutes, expired_leases, vector_latest, upsert_vectors, delete_entries, event_states, clean_answers,
    )}


def oracle_sql() -> dict[str, str]:
    return {
        "normalized_texts": f"SELECT doc_id, {_NORM} AS normalized FROM documents",
        "document_words": rf"SELECT doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '{_S}'), lambda x: x <> '')) AS n_words, len(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'))) AS n_tokens, length(coalesce(text, '')) AS n_chars FROM documents",
        "exact_duplicates": f"SELECT min(doc_id) AS doc_id, count(*) AS n, arg_min(title, doc_id) FILTER (title IS NOT NULL) AS title, count(DISTINCT source) AS n_sources FROM (SELECT *, {_NORM} AS k FROM documents) WHERE k <> '' GROUP BY k HAVING count(*) > 1",
        "chunk_documents": _CHUNKS + " SELECT doc_id, chunk::BIGINT AS chunk, t AS chunk_text FROM c",
        "chunk_context": _CHUNKS + ", b AS (SELECT doc_id, chunk, right(lag(t) OVER (PARTITION BY doc_id ORDER BY chunk), 120) AS tail FROM c) SELECT doc_id, chunk::BIGINT AS chunk, CASE WHEN strpos(tail, '. ') > 0 AND strpos(tail, '. ') < length(tail) - 1 THEN substr(tail, strpos(tail, '. ') + 2) ELSE tail END AS context FROM b",
        "parsed_transcripts": _PARSED + ", u AS (SELECT doc_id, format, generate_subscripts(seg, 1) - 1 AS no, unnest(seg) AS x FROM r WHERE reason IS NULL) SELECT doc_id, format, no, 'seg:' || no AS locator, x.ts AS ts, x.t AS text FROM u",
        "rejected_transcripts": _PARSED + " SELECT doc_id, format, n_words, reason FROM r WHERE reason IS NOT NULL",
        "segment_clocks": r"""WITH p AS (SELECT segment_id, string_split(regexp_replace(ts, '[.,]\d+$', ''), ':') AS p FROM segments WHERE ts IS NOT NULL), s AS (SELECT segment_id, CASE WHEN len(p) = 2 THEN p[1]::BIGINT * 60 + p[2]::BIGINT ELSE p[1]::BIGINT * 3600 + p[2]::BIGINT * 60 + p[3]::BIGINT END AS s FROM p)
SELECT segment_id, printf('%02d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) AS hms, printf('%02d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) AS padded, printf('%d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) AS spoken FROM s""",
        "parsed_subtitles": r"""WITH k AS (SELECT entry_id, regexp_extract(locator, '(\d+)\s*$', 1)::BIGINT AS no, arg_min(struct_pack(t := text, ts := ts), segment_id) AS r FROM segments GROUP BY ALL),
c AS (SELECT entry_id, regexp_replace(CASE WHEN length(r.ts) = 5 THEN '00:' || r.ts ELSE r.ts END, ',.*$', '') AS ts FROM k WHERE trim(r.t) <> '' AND r.ts IS NOT NULL) SELECT entry_id, count(*) AS n_cues, min(ts) AS first_ts, max(ts) AS last_ts FROM c GROUP BY entry_id""",
        "staged_transcripts": r"""WITH k AS (SELECT entry_id, regexp_extract(locator, '(\d+)\s*$', 1) AS no, arg_min(struct_pack(t := text, ts := ts), segment_id) AS r FROM segments GROUP BY ALL)
SELECT entry_id, count(*) AS n_lines, count(r.t) AS n_texts, sum(length(coalesce(r.t, '')))::BIGINT AS n_chars, count(r.ts) AS n_times FROM k GROUP BY entry_id""",
        "entity_listing": "WITH i AS (SELECT entry_id, unnest(knowledge_items) AS i FROM entries), m AS (SELECT entry_id, unnest(i.entity_mentions) AS m FROM i) SELECT m.kind AS kind, lower(m.name) AS name, count(*) AS n_mentions, count(DISTINCT entry_id) AS n_entries FROM m GROUP BY ALL",
        "answer_arrays": _ANSWERS + " SELECT run_id, n_items, coalesce(NOT fine AND n_items > 0, false) AS salvaged, NOT coalesce(fine, false) AND n_items = 0 AS error, item_count::BIGINT AS item_count FROM n",
        "answer_items_valid": _ANSWERS + """, i AS (SELECT run_id, unnest(json_extract(items, '$[*]')) AS i FROM n), x AS (SELECT run_id, CASE WHEN i->>'type' IN ('procedural', 'conceptual', 'declarative', 'experiential', 'heuristic', 'opinion') THEN i->>'type' ELSE 'conceptual' END AS type, trim(coalesce(i->>'statement', '')) <> '' AS valid FROM i)
SELECT run_id, count(*) AS n_items, count(*) FILTER (valid) AS n_valid, count(DISTINCT type) AS n_types, count(*) FILTER (valid) >= 0.5 * count(*) AS usable FROM x GROUP BY run_id""",
        "source_urls": r"""WITH u AS (SELECT DISTINCT source_url FROM jobs WHERE source_url IS NOT NULL), x AS (SELECT source_url, regexp_matches(source_url, '^https?://(www\.)?video\.example(/|$)') AS allowed, nullif(regexp_extract(source_url, '[?&]v=([^&#]*)', 1), '') AS video_id, nullif(regexp_extract(source_url, '[?&]list=([^&#]*)', 1), '') AS playlist_id FROM u)
SELECT source_url, allowed, video_id, CASE WHEN allowed THEN 'https://www.youtube.com/watch?v=' || video_id END AS watch_url, playlist_id FROM x""",
        "upload_titles": r"""WITH u AS (SELECT DISTINCT payload, title FROM jobs WHERE kind <> 'youtube'), f AS (SELECT *, coalesce(nullif(trim(regexp_replace(regexp_replace(regexp_replace(regexp_extract(trim(payload), '([^/]*)$', 1), '(?i)\.(txt|md|markdown|text|srt|vtt)$', ''), '\[[^\]]*\]|\([^)]*\)|\{[^}]*\}', ' ', 'g'), '[-_.\s]+', ' ', 'g'), ' -_.,'), ''), 'Pasted transcript') AS t FROM u)
SELECT payload, t AS file_title, coalesce(nullif(trim(title), ''), t) AS shown FROM f""",
        "job_latest": "WITH " + _JOBS + " SELECT job_id, status, kind, strftime(seen AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS last_seen FROM l",
        "phase_minutes": "WITH x AS (SELECT DISTINCT job_id, current_phase, date_diff('microsecond', " + _UTC.format("created_at") + ", " + _UTC.format("updated_at") + ") / 60000000.0 AS m FROM jobs WHERE current_phase IS NOT NULL) SELECT current_phase, count(*) AS n, round(avg(m), 3) AS mean_minutes, round(max(m), 3) AS max_minutes FROM x GROUP BY current_phase",
        "expired_leases": "WITH " + _JOBS + ", e AS (SELECT job_id, status, coalesce(" + _UTC.format("lease_expires_at") + " < '2025-06-30T00:00:00Z'::TIMESTAMPTZ, false) AS lease_over, coalesce(" + _UTC.format("collection_deadline") + " < '2025-06-30T00:00:00Z'::TIMESTAMPTZ, false) AS deadline_over FROM l) SELECT * FROM e WHERE lease_over OR deadline_over",
        "vector_latest": "SELECT entry_id, item_id, arg_max(embedding_model, struct_pack(t := " + _UTC.format("embedded_at") + ", m := embedding_model)) AS embedding_model FROM item_vectors GROUP BY ALL",
        "upsert_vectors": "WITH v AS (SELECT entry_id, item_id, arg_max(embedding_model, struct_pack(t := " + _UTC.format("embedded_at") + ", m := embedding_model)) AS m FROM item_vectors GROUP BY ALL) SELECT CASE WHEN item_id LIKE '%5' THEN 'embed-next' ELSE m END AS embedding_model, count(*) AS n FROM v GROUP BY 1",
        "delete_entries": "SELECT embedding_model, count(*) AS n, count(DISTINCT entry_id) AS n_entries FROM (SELECT DISTINCT * FROM item_vectors) WHERE entry_id NOT IN (SELECT entry_id FROM entry_deletions WHERE entry_id NOT IN (SELECT entry_id FROM entries)) GROUP BY 1",
        "event_states": "SELECT user_id, arg_max(event_type, struct_pack(t := ts, e := event_id)) AS last_type, count(*) AS n, count(*) FILTER (event_type = 'error') AS n_errors FROM events GROUP BY user_id",
        "clean_answers": r"SELECT retrieval_id, trim(regexp_replace(regexp_replace(trim(statement) || ' .', '[ \t]+([.,;:!?])', '\1', 'g'), '[ \t]{2,}', ' ', 'g')) AS clean FROM retrieved_items",
    }
