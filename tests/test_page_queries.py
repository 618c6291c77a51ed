from millrace.plans import page_queries as Q  # noqa: N812

ENTRY = "entry_id string, knowledge_items array<struct<item_id:string,statement:string,entity_mentions:array<struct<name:string,kind:string,quote:string>>>>"


def test_evidence_has_every_statement_once(spark, tmp_path):
    item = lambda i, statement, *names: (f"k{i}", statement, [(n, "tool", "quote") for n in names])
    entries = [("e1", [item(i, f"Point {i}.", "Spark", "spark") for i in range(4)] + [item(9, "Other.", "Kafka")]), ("e2", [item(i, f"Point {i}.", "SPARK") for i in range(2, 9)])]
    spark.createDataFrame(entries, ENTRY).write.parquet(f"{tmp_path}/entries.parquet")
    got = {r["key"]: (r["evidence"], r["n_statements"]) for r in Q.entity_evidence(spark, str(tmp_path)).collect()}
    assert got == {"spark": (" ".join(f"Point {i}." for i in range(9)), 9), "kafka": ("Other.", 1)}
