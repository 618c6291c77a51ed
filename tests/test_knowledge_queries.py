from millrace.plans import knowledge_queries as Q  # noqa: N812

ENTRY = "entry_id string, knowledge_items array<struct<item_id:string>>, application_links array<struct<link_id:string,knowledge_item_ids:array<string>,linked_goal_id:string,application_form:string>>"


def test_links_of_stated_goals_whose_items_exist(spark, tmp_path):
    link = lambda i, goal, *items: (f"a{i}", list(items), goal, "form")
    entries = [("e1", [("k1",), ("k2",)], [link(i, "often", "k1", "k2") for i in range(40)] + [link(50 + i, "stray", "k1") for i in range(3)] + [link(60, "often", "k1", "k9")])]
    entries += [("e2", [("k9",)], [link(i, "seldom", "k9") for i in range(5)] + [("a9", None, "often", "form")])]
    spark.createDataFrame(entries, ENTRY).write.parquet(f"{tmp_path}/entries.parquet")
    got = sorted((r["entry_id"], r["link_id"]) for r in Q.goal_links(spark, str(tmp_path)).collect())
    assert got == sorted([("e1", f"a{i}") for i in range(40)] + [("e2", f"a{i}") for i in range(5)] + [("e2", "a9")])
