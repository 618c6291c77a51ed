import numpy as np

from millrace.operators import retrieval as S  # noqa: N812
from millrace.plans import search_queries as Q  # noqa: N812

RETRIEVED = "question_id long, retrieval_id long, similarity double, score double"


def test_every_question_is_ranked(spark, tmp_path):
    rows = [(q, 100 * q + i, 0.3 + 0.02 * (i % 5), float((i * 7 + q) % 9)) for q in (1, 7, 20, 33) for i in range(9)]
    spark.createDataFrame(rows, RETRIEVED).write.parquet(f"{tmp_path}/retrieved_items.parquet")
    want = []
    for q in {r[0] for r in rows}:
        best = sorted((r for r in rows if r[0] == q), key=lambda r: (-r[3], r[1]))[:6]
        want += [(q, r[1], n) for n, r in enumerate(best, 1) if r[2] >= 0.35]
    assert sorted(tuple(r) for r in Q.composite_rank(spark, str(tmp_path)).select("query_id", "retrieval_id", "rank").collect()) == sorted(want)


def test_a_concept_that_clears_the_gate_answers_the_query(spark, tmp_path):
    # Item 31 is near the query but weighs least (score 1); six others weigh more and lie below the gate.
    rows = [(20, [1.0, 0.0], 9), (31, [0.46, 0.888], 1)] + [(i, [0.44, 0.898], 2) for i in (5, 17, 23, 29, 35, 41)] + [(40, [0.0, 0.0], 9), (43, [-2.0, 0.0], 9)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label long").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert not S.gate(Q._ranked(spark, str(tmp_path)), 0.45).count()
    assert sorted(tuple(r) for r in Q.abstention_gate(spark, str(tmp_path)).collect()) == [(20, True), (40, False)]


def test_concepts_by_their_best_member_where_one_concept_is_crowded(spark, tmp_path):
    # Thirty members of concept 1 fill the first places of every query; the others' best members come after them.
    rng = np.random.default_rng(3)
    near = [(101 + 2 * i, [1.0, *rng.normal(0, 0.02, 5).tolist()], 1) for i in range(30)]
    rest = [(1001 + 2 * i, rng.normal(size=6).tolist(), 2 + i % 4) for i in range(40)] + [(1201, [0.0] * 6, 4), (1203, None, 5)]
    rows = near + rest + [(20 * i, [1.0, *rng.normal(0, 0.1, 5).tolist()], 2 + i % 4) for i in range(1, 7)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    cos = lambda a, b: float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b))) if b is not None and np.any(b) else 0.0
    members = {(q, g): max(cos(v, u) for i, u, h in rows if h == g and i != q) for q, v, _ in rows if q % 20 == 0 for g in {r[2] for r in rows}}
    df = Q._vectors(spark, str(tmp_path))
    for most in (4_000_000, 5):
        S.CELLS_PER_TASK, old = most, S.CELLS_PER_TASK
        try:
            got = {(r["query_id"], r["group_id"]): r["similarity"] for r in S.best_members(Q._queries(df), df).collect()}
        finally:
            S.CELLS_PER_TASK = old
        assert got.keys() == members.keys() and all(abs(got[k] - members[k]) < 1e-9 for k in got)
    centroid = {g: np.mean([u for _, u, h in rows if h == g and u is not None], axis=0) for g in {r[2] for r in rows}}
    want = []
    for q, v, _ in rows:
        if q % 20 == 0:
            scored = sorted((-round(max(cos(v, centroid[g]), members[q, g], 0.0), 6), g) for g in centroid)
            want += [(q, g, -s, n) for n, (s, g) in enumerate(scored[:3], 1)]
    found = Q.concept_rank(spark, str(tmp_path)).collect()
    assert sorted((r["query_id"], r["group_id"], r["similarity"], r["rank"]) for r in found) == sorted(want)
