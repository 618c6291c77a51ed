"""Queries of similarity search, ranking and grouping over vectors, with their SQL.

The queries of a search are every row whose id is divisible by 20, against all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.times import feedback_factor, recency_factor
from millrace.functions.vectors import bow_cells, bow_embedding
from millrace.operators import knowledge as K  # noqa: N812
from millrace.operators import retrieval as S  # noqa: N812
from millrace.plans.session import load

#: Parameters of the searches over the test vectors, whose similarities are low.
FLOOR, GATE, AS_OF = 0.25, 0.30, "2024-07-01T00:00:00Z"


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").alias("group_id"))


def _queries(vectors: DataFrame) -> DataFrame:
    return vectors.filter(F.col("id") % 20 == 0)


def _weighted(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    score = F.when(F.col("id") % 6 > 0, (F.col("id") % 6).cast("int"))
    created = F.concat(F.date_format(F.date_add(F.lit("2023-01-01").cast("date"), (F.col("id") % 500).cast("int")), "yyyy-MM-dd"), F.lit("T00:00:00Z"))
    return v.withColumn("weight", feedback_factor(score) * recency_factor(created, F.lit(AS_OF).cast("timestamp")))


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    w = _weighted(spark, d)
    return S.top_k(_queries(w), w, 6)


def _shaped(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns, F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


def knn_ranked(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    return _shaped(S.top_k(_queries(v), v, 6), "query_id", "id")


def knn_composite(spark: SparkSession, d: str) -> DataFrame:
    return S.gate(_ranked(spark, d), GATE).select("query_id", "id", F.round("similarity", 6).alias("similarity"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def abstention_gate(spark: SparkSession, d: str) -> DataFrame:
    """A query is answered if one of its items or one of its concepts clears the gate."""
    return S.answered(_queries(_vectors(spark, d)), S.gate(_ranked(spark, d), 0.45), S.gate(_concepts(spark, d), 0.45))


def concept_centroids(spark: SparkSession, d: str) -> DataFrame:
    c = S.centroids(_vectors(spark, d))
    return c.select("group_id", "n", F.posexplode("vector").alias("pos", "x")).select("group_id", "n", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


def _centroid_hits(spark: SparkSession, d: str) -> DataFrame:
    """Similarity of every query to every concept's centroid: as many rows as queries times concepts."""
    v = _vectors(spark, d)
    c = S.centroids(v).select(F.col("group_id").alias("id"), "vector", "group_id")
    # A query's own id is no concept's id: shift the queries out of the way.
    q = _queries(v).select((F.col("id") + F.lit(1 << 40)).alias("id"), "vector")
    return S.best_members(q, c).withColumn("query_id", F.col("query_id") - F.lit(1 << 40))


def _concepts(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    return S.group_scores(_centroid_hits(spark, d), S.best_members(_queries(v), v))


def concept_rank(spark: SparkSession, d: str) -> DataFrame:
    """Concepts by the larger of the centroid's and the best member's similarity."""
    return _shaped(_concepts(spark, d), "query_id", "group_id")


def recruit_members(spark: SparkSession, d: str) -> DataFrame:
    cleared = _concepts(spark, d).filter(F.col("similarity") >= 0.42)
    return S.recruited(cleared, _vectors(spark, d), _ranked(spark, d)).select("query_id", "id", "group_id", F.round("similarity", 6).alias("similarity"))


def concept_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Concepts by similarity to the centroid, with those whose description shares a word with the item's."""
    nation = load(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("text"))
    v = _vectors(spark, d)
    groups = S.centroids(v).join(nation, F.col("group_id") == F.col("n_nationkey"), "left").select("group_id", "vector", "text")
    queries = _queries(v).withColumn("n_nationkey", (F.col("id") / 20 % 25).cast("long")).join(nation, "n_nationkey", "left").select("id", "vector", "text")
    return _shaped(K.candidates(queries, groups, FLOOR, 3, 5), "query_id", "group_id")


def concept_edges(spark: SparkSession, d: str) -> DataFrame:
    return _shaped(K.group_edges(S.centroids(_vectors(spark, d)), 0.05), "source", "target")


def entity_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The nearest vectors of the query's own kind (here: label): the kind is an equality inside the one search."""
    v = _vectors(spark, d).withColumnRenamed("group_id", "kind")
    q = _queries(v)
    found = S.top_k(q, v, 5, FLOOR).join(q.select(F.col("id").alias("query_id"), F.col("kind").cast("long").alias("group_id")), "query_id")
    return _shaped(found, "query_id", "group_id", "id")


def retract_recompute(spark: SparkSession, d: str) -> DataFrame:
    """Centroids after the items whose id is divisible by 7 are withdrawn."""
    v = _vectors(spark, d)
    left = K.retracted(v, v.filter("id % 7 = 0"))
    c = S.centroids(left)
    return c.select("group_id", "n", F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


def bow_cells_of_statements(spark: SparkSession, d: str) -> DataFrame:
    """Cells of the hashed bag of words of each statement."""
    cells = load(spark, d, "retrieved_items").select("retrieval_id", F.explode(bow_cells(F.col("statement"))).alias("c"))
    return cells.groupBy("retrieval_id", F.col("c.idx").cast("long").alias("idx")).agg(F.sum("c.sign").alias("value"))


def bow_search(spark: SparkSession, d: str) -> DataFrame:
    """The six statements nearest to each evaluation question whose id is divisible by 20, by bag-of-words vectors."""
    q = load(spark, d, "eval_items").filter("item_id % 20 = 0").select((-F.col("item_id")).alias("id"), bow_embedding(F.col("question")).alias("vector"))
    v = load(spark, d, "retrieved_items").select(F.col("retrieval_id").alias("id"), bow_embedding(F.col("statement")).alias("vector"))
    hits = S.top_k(q, v, 6)
    return hits.select((-F.col("query_id")).alias("item_id"), F.round("similarity", 5).alias("similarity"), F.col("rank").cast("long").alias("rank"))


def composite_rank(spark: SparkSession, d: str) -> DataFrame:
    """The recorded retrievals ranked again for each question: best six by score, then the gate on similarity."""
    from pyspark.sql import Window

    rows = load(spark, d, "retrieved_items").select(F.col("question_id").alias("query_id"), "retrieval_id", "similarity", "score")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "retrieval_id")
    best = rows.withColumn("rank", F.row_number().over(order).cast("long")).filter("rank <= 6")
    return S.gate(best, 0.35)


_Q = """WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vector, label AS group_id FROM embeddings), q AS (SELECT * FROM v WHERE id % 20 = 0)"""
_W = _Q + """, w AS (SELECT *, CASE WHEN id % 6 > 0 THEN 0.6 + (id % 6 - 1) * 0.2 ELSE 1.0 END * (0.5 + 0.5 * exp(-greatest(0, date_diff('day', DATE '2023-01-01' + (id % 500)::INT, DATE '2024-07-01')) / 180.0)) AS weight FROM v),
s AS (SELECT q.id AS query_id, w.id, list_cosine_similarity(q.vector, w.vector) AS sim, list_cosine_similarity(q.vector, w.vector) * weight AS sc FROM q JOIN w ON w.id <> q.id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sc DESC, id) AS rank FROM s), top AS (SELECT * FROM r WHERE rank <= 6)"""
_C = """, cell AS (SELECT group_id, generate_subscripts(vector, 1) - 1 AS pos, unnest(vector) AS x FROM v), m AS (SELECT group_id, pos, avg(x) AS x, count(*) AS n FROM cell GROUP BY ALL),
c AS (SELECT group_id, list(x ORDER BY pos) AS vector, max(n) AS n FROM m GROUP BY group_id), ch AS (SELECT q.id AS query_id, c.group_id, list_cosine_similarity(q.vector, c.vector) AS sim FROM q, c)"""
_G = _C + """, near AS (SELECT q.id AS query_id, v.group_id, list_cosine_similarity(q.vector, v.vector) AS sim FROM q JOIN v ON v.id <> q.id),
g AS (SELECT query_id, group_id, max(sim) AS sim FROM (SELECT query_id, group_id, greatest(sim, 0) AS sim FROM ch UNION ALL SELECT * FROM near) GROUP BY ALL), gr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, group_id) AS rank FROM g), g3 AS (SELECT * FROM gr WHERE rank <= 3)"""


def queries() -> dict:
    return {f.__name__: f for f in (
        knn_ranked, knn_composite, abstention_gate, concept_centroids, concept_rank, recruit_members, concept_candidates, concept_edges, entity_candidates, retract_recompute, bow_cells_of_statements,
        bow_search, composite_rank,
    )}


def oracle_sql() -> dict[str, str]:
    cells = r"(SELECT {id} AS id, unnest(regexp_extract_all(lower({t}), '[\p{{L}}\p{{N}}\p{{M}}_]+')) AS w FROM {f})"
    signed = "SELECT id, ('0x' || right(md5(w), 2))::INT % 64 AS idx, sum(CASE WHEN ('0x' || substr(md5(w), 30, 1))::INT % 2 = 0 THEN 1.0 ELSE -1.0 END)::DOUBLE AS value FROM {c} GROUP BY ALL"
    return {
        "knn_ranked": _Q + ", s AS (SELECT q.id AS query_id, v.id, list_cosine_similarity(q.vector, v.vector) AS sim FROM q JOIN v ON v.id <> q.id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rank FROM s) SELECT query_id, id, round(sim, 6) AS similarity, rank FROM r WHERE rank <= 6",
        "knn_composite": _W + " SELECT query_id, id, round(sim, 6) AS similarity, round(sc, 6) AS score, rank FROM top WHERE sim >= 0.3",
        "abstention_gate": _W + _G + " SELECT q.id AS query_id, EXISTS (SELECT 1 FROM top WHERE top.query_id = q.id AND top.sim >= 0.45) OR EXISTS (SELECT 1 FROM g3 WHERE g3.query_id = q.id AND g3.sim >= 0.45) AS answered FROM q",
        "concept_centroids": _Q + _C + " SELECT group_id, c.n, pos, round(m.x, 6) AS x FROM m JOIN c USING (group_id)",
        "concept_rank": _Q + _G + " SELECT query_id, group_id, round(sim, 6) AS similarity, rank FROM g3",
        "recruit_members": _W + _G + """, p AS (SELECT g3.query_id, v.id, g3.group_id, g3.sim FROM g3 JOIN v USING (group_id) WHERE g3.sim >= 0.42 AND NOT EXISTS (SELECT 1 FROM top WHERE top.query_id = g3.query_id AND top.id = v.id))
SELECT query_id, id, group_id, round(sim, 6) AS similarity FROM p""",
        "concept_candidates": _Q + _C + r""", tok AS (SELECT n_nationkey AS k, unnest(regexp_extract_all(lower(n_name), '[a-z0-9]+')) AS t FROM nation), ov AS (SELECT DISTINCT q.id AS query_id, b.k AS group_id FROM q JOIN tok a ON a.k = floor(q.id / 20)::BIGINT % 25 JOIN tok b USING (t)),
e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, group_id) AS r FROM ch WHERE sim >= 0.25) WHERE r <= 3), p AS (SELECT query_id, group_id, sim FROM e UNION SELECT ch.query_id, ch.group_id, sim FROM ch JOIN ov USING (query_id, group_id)),
z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, group_id) AS rank FROM p) SELECT query_id, group_id, round(sim, 6) AS similarity, rank FROM z WHERE rank <= 5""",
        "concept_edges": _Q + _C + ", e AS (SELECT a.group_id AS source, b.group_id AS target, list_cosine_similarity(a.vector, b.vector) AS sim FROM c a JOIN c b ON a.group_id <> b.group_id), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY sim DESC, target) AS rank FROM e WHERE sim >= 0.05) SELECT source, target, round(sim, 6) AS similarity, rank FROM r WHERE rank <= 3",
        "entity_candidates": _Q + ", s AS (SELECT q.id AS query_id, q.group_id, v.id, list_cosine_similarity(q.vector, v.vector) AS sim FROM q JOIN v ON v.group_id = q.group_id AND v.id <> q.id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rank FROM s WHERE sim >= 0.25) SELECT query_id, group_id, id, round(sim, 6) AS similarity, rank FROM r WHERE rank <= 5",
        "retract_recompute": _Q + ", cell AS (SELECT id, group_id, generate_subscripts(vector, 1) AS pos, unnest(vector) AS x FROM v WHERE id % 7 <> 0), m AS (SELECT group_id, pos, avg(x) AS x, count(*) AS n FROM cell GROUP BY ALL) SELECT group_id, max(n) AS n, round(sum(x), 6) AS total FROM m GROUP BY group_id",
        "bow_cells_of_statements": "SELECT id AS retrieval_id, idx::BIGINT AS idx, value FROM (" + signed.format(c=cells.format(id="retrieval_id", t="statement", f="retrieved_items")) + ")",
        "bow_search": "WITH a AS (" + signed.format(c=cells.format(id="item_id", t="question", f="eval_items")) + "), b AS (" + signed.format(c=cells.format(id="retrieval_id", t="statement", f="retrieved_items")) + """), an AS (SELECT id, sqrt(sum(value * value)) AS n FROM a GROUP BY id), bn AS (SELECT id, sqrt(sum(value * value)) AS n FROM b GROUP BY id),
dt AS (SELECT a.id AS item_id, b.id, sum(a.value * b.value) AS d FROM a JOIN b USING (idx) WHERE a.id % 20 = 0 GROUP BY ALL), s AS (SELECT item_id, d.id, coalesce(d / (an.n * bn.n), 0) AS sim FROM dt d JOIN an ON an.id = d.item_id JOIN bn ON bn.id = d.id WHERE an.n > 0 AND bn.n > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY sim DESC, id) AS rank FROM s) SELECT item_id, round(sim, 5) AS similarity, rank FROM r WHERE rank <= 6""",
        "composite_rank": "WITH r AS (SELECT question_id AS query_id, retrieval_id, similarity, score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, retrieval_id) AS rank FROM retrieved_items) SELECT * FROM r WHERE rank <= 6 AND similarity >= 0.35",
    }
