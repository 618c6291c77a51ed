import json

from pyspark.sql import functions as F

from millrace.functions.jsonx import read_object, relation_of, same_structure
from millrace.operators import canonical as C  # noqa: N812


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in schema.split()))


def test_decisions(spark):
    say = lambda *d: json.dumps([dict(zip(("item_id", "decision", "concept_id", "title"), x)) for x in d])
    answers = frame(spark, [("a", "Sure:\n```json\n" + say(("k1", "match", "g1"), ("k1", "new", None, "late"), ("k2", "match", "g2"), ("k3", "perhaps", "g1"), ("k9", "new", None, "T"), ("k4", "new", None, "T")) + "\n```"), ("b", "no array"), ("c", None), ("d", say(("k1", "new", None, "D")))], "entry_id response")
    items = frame(spark, [("a", f"k{i}") for i in range(1, 5)] + [("b", "k1"), ("c", "k1")], "entry_id item_id")
    offered = frame(spark, [("a", "k1", "g1"), ("a", "k2", "g1")], "entry_id item_id group_id")
    got = {(r["entry_id"], r["item_id"]): (r["action"], r["group_id"], r["title"]) for r in C.decisions(answers, items, offered).collect()}
    assert got == {("a", "k1"): ("match", "g1", None), ("a", "k2"): ("reject", None, None), ("a", "k3"): ("reject", None, None), ("a", "k4"): ("new", None, "T")}


def test_free_slugs(spark):
    wanted = spark.createDataFrame([("p", "top", 1), ("q", "top", 2), ("r", "top", 3), ("s", "top-2", 4), ("t", "own", 5), ("u", "top-4", 0)], "key string, base string, place int")
    got = {r["key"]: r["slug"] for r in C.free_slugs(wanted, frame(spark, [("top-3",), ("own",), ("own-2",), ("own-x",)], "slug")).collect()}
    assert got["p"] == "top" and got["q"] == "top-2" and got["u"] == "top-4" and got["t"] == "own-3"
    assert len(set(got.values())) == 6 and not set(got.values()) & {"top-3", "own", "own-2"}
    assert C.free_slugs(wanted.limit(0), frame(spark, [], "slug")).count() == 0


def test_a_run_and_the_same_run_again(spark):
    groups = frame(spark, [("keep", "Keep"), ("lost", "Lost"), ("empty", "Empty")], "group_id title")
    members = frame(spark, [("keep", "x", "k1"), ("keep", "a", "k1"), ("lost", "a", "k2")], "group_id entry_id item_id")
    entries = spark.createDataFrame([("a", 2), ("b", 1)], "entry_id string, place int")
    decided = frame(spark, [("a", "k1", "match", "keep", None), ("a", "k2", "match", "lost", None), ("a", "k3", "new", None, "Big idea!"), ("a", "k4", "new", None, "big  IDEA"), ("b", "k1", "new", None, "Big Idea"), ("b", "k2", "new", None, " "), ("b", "k3", "reject", None, None), ("b", "k4", "new", None, "語")], "entry_id item_id action group_id title")
    now = C.canonicalized(groups, members, entries, decided)
    want = {("keep", "x", "k1"), ("keep", "a", "k1"), ("big-idea-2", "a", "k3"), ("big-idea-2", "a", "k4"), ("big-idea", "b", "k1"), ("group", "b", "k4")}
    for _ in range(2):  # filed again, the run gives the same
        assert {tuple(r) for r in now[1].collect()} == want
        assert {r["group_id"] for r in now[0].collect()} == {"keep", "big-idea", "big-idea-2", "group"}
        assert {tuple(r) for r in now[2].collect()} == {("keep", "a"), ("big-idea-2", "a"), ("big-idea", "b"), ("group", "b")}
        now = C.canonicalized(now[0], now[1], entries, decided)
    kinds = C.canonicalized(groups, members, entries, decided.withColumn("kind", F.when(F.col("item_id") == "k4", "tool").otherwise("person")))
    assert len({r["group_id"] for r in kinds[1].filter("item_id in ('k3', 'k4') and entry_id = 'a'").collect()}) == 2


def test_edges_and_deletions(spark):
    edges = frame(spark, [("a", "b", "related"), ("b", "a", "related"), ("c", "gone", "related"), ("gone", "a", "related")], "source target relation")
    new = frame(spark, [("a", "c", "builds_on"), ("b", "c", "builds_on")], "source target relation")
    ready, groups = frame(spark, [("a",)], "group_id"), frame(spark, [("a",), ("b",), ("c",)], "group_id")
    assert {tuple(r) for r in C.replaced_edges(edges, new, ready, groups).collect()} == {("a", "c", "builds_on"), ("b", "a", "related")}
    pairs = frame(spark, [("a", "b"), ("a", "c"), ("b", "c"), ("c", "a")], "source target")
    answers = frame(spark, [("a", "b", '{"relation": "supports"}'), ("a", "c", "no idea"), ("b", "c", '{"relation": "likes"}')], "source target response")
    assert [tuple(r) for r in C.labelled(pairs, answers, C.ENTRY_RELATIONS).collect()] == [("a", "b", "supports")]
    members = frame(spark, [("g", "e1", "k"), ("g", "e2", "k"), ("h", "e1", "k")], "group_id entry_id item_id")
    tables, left, kept = C.delete_cascade(frame(spark, [("e1",), ("e1",), ("e9",)], "entry_id"), {"t": frame(spark, [("e1",), ("e2",)], "entry_id")}, members, frame(spark, [("g",), ("h",), ("bare",)], "group_id"))
    assert [r[0] for r in tables["t"].collect()] == ["e2"] and [r["entry_id"] for r in left.collect()] == ["e2"] and {r[0] for r in kept.collect()} == {"g", "bare"}


def test_objects_and_relations(spark):
    assert read_object('```json\n{"a": 1}\n```') == read_object('So {"a": 1} it is') == '{"a": 1}'
    assert read_object(None) is read_object("[1]") is read_object("{") is read_object("") is None
    texts = ['{"relation": "extends"}', '```json\n{"relation": "extends"}\n```', 'well, "relation" : "extends", I think', '{"relation": "extends"', '{"other": 1}', "nothing", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(relation_of(F.col("t"))).collect()] == ["extends"] * 4 + [None] * 4
    before = '{"id": "k", "parts": [{"text": "a", "n": 1}]}'
    assert same_structure(before, '```json\n{"id": "k", "parts": [{"text": "b", "n": 1}]}\n```', ("text",))
    for after in ('{"id": "z", "parts": [{"text": "b", "n": 1}]}', '{"id": "k", "parts": []}', '{"id": "k", "parts": [{"text": 5, "n": 1}]}', '{"id": "k", "parts": [{"text": "b", "n": true}]}', "half {", None):
        assert not same_structure(before, after, ("text",)), after


def test_citations(spark):
    df = spark.createDataFrame([(["a", "x", "a"], ["a", "b"]), (None, ["a"]), (["a"], None)], "c array<string>, r array<string>")
    grounded, ungrounded = C.split_citations(F.col("c"), F.col("r"))
    assert [tuple(r) for r in df.select(grounded, ungrounded).collect()] == [(["a", "a"], ["x"]), ([], []), ([], ["a"])]
