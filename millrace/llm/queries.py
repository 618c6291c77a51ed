"""Queries of the operators for training data, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.confusables import canonical_form, look_alike_pairs
from millrace.llm.language import document_languages, language_stretches
from millrace.llm.leaks import leaked_items
from millrace.llm.packing import fill_report, packed
from millrace.llm.probminhash import expand_pairs, groups, near_duplicates
from millrace.llm.splitting import split_items, too_small_counts, transcript_lengths, transcript_pieces
from millrace.llm.truncation import cut_share, cut_texts
from millrace.llm.turns import calibrated_pause, speaker_turns
from millrace.plans.session import load


def _restated(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = load(spark, d, "retrieved_items").select(F.col("retrieval_id").alias("id"), "statement", "quote")
    return near_duplicates(rows, F.concat_ws(" ", "statement", "quote"), similarity=0.7, shingle_words=1)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = expand_pairs(*_restated(spark, d))
    return pairs.select(F.col("id_a").alias("retrieval_id_a"), F.col("id_b").alias("retrieval_id_b"))


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every row with words and its group, named by the smallest retrieval_id in it."""
    return groups(*_restated(spark, d)).select(F.col("id").alias("retrieval_id"), "group_id")


def p1_weighted(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of different texts by weighted similarity of their shingles of five words: each text by its smallest id."""
    rows = load(spark, d, "retrieved_items").select(F.col("retrieval_id").alias("id"), "statement", "quote")
    _, pairs = near_duplicates(rows, F.concat_ws(" ", "statement", "quote"), weighted=True)
    return pairs.select("set_a", "set_b", F.round("similarity", 6).alias("similarity"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    turns = speaker_turns(load(spark, d, "segments"), load(spark, d, "speakers"), with_text=False)
    return turns.select("entry_id", "first_segment_id", "last_segment_id", "speaker_id")


def p2_turns(spark: SparkSession, d: str) -> DataFrame:
    """Turns with clean text, also split at pauses that are long for these transcripts."""
    segments = load(spark, d, "segments")
    return speaker_turns(segments, load(spark, d, "speakers"), pause=calibrated_pause(segments))


def _look_alike_texts(spark: SparkSession, d: str) -> DataFrame:
    return (
        load(spark, d, "retrieved_items").select(F.lit("retrieved_items").alias("table_name"), F.col("retrieval_id").alias("id"), F.col("quote").alias("text"))
        .unionAll(load(spark, d, "segments").select(F.lit("segments"), "segment_id", "text"))
    )


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return look_alike_pairs(_look_alike_texts(spark, d))


def p3_canonical(spark: SparkSession, d: str) -> DataFrame:
    """Every text with its one consistent form."""
    return canonical_form(_look_alike_texts(spark, d)).select("table_name", "id", "canonical", "changed")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    segments = load(spark, d, "segments")
    lengths = transcript_lengths(segments)
    record = lambda kind, key: [F.lit(kind).alias("record_kind"), F.col(key).alias("record_id")]
    long = split_items(segments, ["segment_id"], with_text=False).filter("piece = 1").select(*record("segment", "segment_id"))
    runs = too_small_counts(load(spark, d, "extraction_runs").select("run_id", "entry_id", "chunk_count"), lengths).select(*record("extraction", "run_id"))
    summaries = too_small_counts(load(spark, d, "narrative_summaries").select("summary_id", "entry_id", "chunk_count"), lengths).select(*record("summary", "summary_id"))
    return long.unionAll(runs).unionAll(summaries)


def p4_segment_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of every segment."""
    return split_items(load(spark, d, "segments"), ["segment_id"])


def p4_transcript_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of every entry's full transcript."""
    return transcript_pieces(load(spark, d, "segments"))


def _answers(spark: SparkSession, d: str) -> DataFrame:
    return (
        load(spark, d, "narrative_summaries").select(F.lit("narrative_summaries").alias("table_name"), F.col("summary_id").alias("id"), F.col("model").alias("source"), "text", F.lit(False).alias("structured"), "entry_id")
        .unionAll(load(spark, d, "extraction_runs").select(F.lit("extraction_runs"), "run_id", "model", "response", F.lit(True), "entry_id"))
    )


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return cut_texts(_answers(spark, d)).filter("cut").select("table_name", F.col("id").alias("row_id"))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    """Share of cut rows per model and per channel; a row whose entry isn't there has a null channel."""
    rows = _answers(spark, d)
    cut = cut_texts(rows)
    channels = load(spark, d, "entries").groupBy("entry_id").agg(F.min("source.channel").alias("channel"))
    of = rows.select("table_name", "id", "entry_id").join(channels, "entry_id", "left").select("table_name", "id", "channel")
    model = cut_share(cut, "source").select("table_name", F.lit("model").alias("kind"), F.col("source").alias("value"), "n_rows", "n_cut", "share")
    channel = cut_share(cut.join(of, ["table_name", "id"]), "channel").select("table_name", F.lit("channel").alias("kind"), F.col("channel").alias("value"), "n_rows", "n_cut", "share")
    return model.unionAll(channel)


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    return packed(load(spark, d, "documents"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers are."""
    return fill_report(packed(load(spark, d, "documents")))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    found = leaked_items(load(spark, d, "documents"), load(spark, d, "eval_items"), altered=False)
    return found.filter("exact").select("doc_id", "item_id")


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Exact and altered stretches of the items' passages, with their similarity."""
    return leaked_items(load(spark, d, "documents"), load(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    found = document_languages(language_stretches(load(spark, d, "documents")))
    unnamed = (F.col("lang") != "und") & ~F.col("lang").eqNullSafe(F.col("named"))
    return found.filter((F.col("n_letters") >= 150) & (F.col("share") >= 0.1) & unnamed).select("doc_id", "lang")


def p9_stretches(spark: SparkSession, d: str) -> DataFrame:
    """Every document's stretches of one language, with a confidence."""
    return language_stretches(load(spark, d, "documents")).drop("named")


def queries() -> dict:
    return {"p1_found": p1_found, "p1_groups": p1_groups, "p1_weighted": p1_weighted, "p2_found": p2_found, "p2_turns": p2_turns, "p3_found": p3_found, "p3_canonical": p3_canonical, "p4_found": p4_found, "p4_segment_pieces": p4_segment_pieces, "p4_transcript_pieces": p4_transcript_pieces, "p6_found": p6_found, "p6_report": p6_report, "p7_packed": p7_packed, "p7_fill": p7_fill, "p8_found": p8_found, "p8_leaks": p8_leaks, "p9_found": p9_found, "p9_stretches": p9_stretches}


_P1 = r"""
WITH RECURSIVE w AS (SELECT retrieval_id AS id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(concat_ws(' ', statement, quote)), '[^\p{L}\p{N}]+'), lambda x: x <> ''))) AS word FROM retrieved_items),
n AS (SELECT id, count(*) AS n FROM w GROUP BY id),
c AS (SELECT a.id AS a, b.id AS b, count(*) AS common FROM w a JOIN w b ON a.word = b.word AND a.id < b.id GROUP BY ALL),
p AS (SELECT a, b FROM c JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE common >= 0.7 * (x.n + y.n - common) - 1e-9)
"""


_P1_WEIGHTED = r"""
WITH w AS (SELECT retrieval_id AS id, list_filter(regexp_split_to_array(lower(concat_ws(' ', statement, quote)), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM retrieved_items),
l AS (SELECT id, CASE WHEN len(w) <= 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END AS l FROM w WHERE len(w) > 0),
r AS (SELECT min(id) AS id, list_sort(l) AS l FROM l GROUP BY list_sort(l)), s AS (SELECT id, unnest(l) AS s FROM r), c AS (SELECT id, s, count(*) AS n FROM s GROUP BY ALL),
p AS (SELECT a.id AS a, b.id AS b, sum(least(a.n, b.n)) AS m FROM c a JOIN c b ON a.s = b.s AND a.id < b.id GROUP BY ALL)
SELECT a AS set_a, b AS set_b, round(m / (len(x.l) + len(y.l) - m), 6) AS similarity FROM p JOIN r x ON x.id = a JOIN r y ON y.id = b WHERE m / (len(x.l) + len(y.l) - m) >= 0.8 - 1e-12"""


_P8 = r"""
WITH i AS (SELECT item_id, list_filter(regexp_split_to_array(lower(passage), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM eval_items),
d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
iw AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 9], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 8)) AS k FROM i)),
dw AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 9], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 8)) AS k FROM d))
SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (g)"""


_P4 = r"""
WITH k AS (SELECT entry_id, regexp_extract(locator, '(\d+)\s*$', 1)::BIGINT AS no, arg_min(coalesce(text, ''), segment_id) AS text FROM segments GROUP BY ALL),
t AS (SELECT entry_id, sum(length(text)) + count(*) - 1 AS n FROM k GROUP BY entry_id)
SELECT 'segment' AS record_kind, segment_id AS record_id FROM segments WHERE length(text) > 12000
UNION ALL SELECT 'extraction', run_id FROM extraction_runs JOIN t USING (entry_id) WHERE n > 12000 * chunk_count
UNION ALL SELECT 'summary', summary_id FROM narrative_summaries JOIN t USING (entry_id) WHERE n > 12000 * chunk_count"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _P1 + "SELECT a AS retrieval_id_a, b AS retrieval_id_b FROM p",
        "p1_groups": _P1 + """, e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r(id, other) AS (SELECT id, id FROM n UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.other)
SELECT id AS retrieval_id, min(other) AS group_id FROM r GROUP BY id""",
        "p1_weighted": _P1_WEIGHTED,
        "p4_found": _P4,
        "p8_found": _P8,
    }
