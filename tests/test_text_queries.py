from millrace.plans import text_queries as Q  # noqa: N812


def test_entries_that_were_filed_again_keep_their_vectors(spark, tmp_path):
    write = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    write("entries", [("back",), ("kept",)], "entry_id string")
    write("entry_deletions", [("back",), ("gone",), ("gone",)], "entry_id string")
    write("item_vectors", [(e, f"k{i}", "m", "t") for e in ("back", "kept", "gone") for i in range(2)] + [("back", "k0", "m", "t"), (None, "k", "m", "t")], "entry_id string, item_id string, embedding_model string, embedded_at string")
    assert [tuple(r) for r in Q.delete_entries(spark, str(tmp_path)).collect()] == [("m", 5, 2)]
