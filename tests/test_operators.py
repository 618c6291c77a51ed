import math
from datetime import datetime
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from millrace.functions import seams
from millrace.functions.jsonx import read_items
from millrace.functions.text import display_title, first_words, front_matter_field, humanize_tag, links_of, normalize_text, sentences, slugify, strip, title_from_filename, title_key, topics_capped, without_citations, without_fence, yaml_quoted
from millrace.functions.times import clock, feedback_factor, recency_factor
from millrace.functions.urls import video_id, watch_url
from millrace.functions.vectors import bow_embedding, cosine
from millrace.operators import items as I  # noqa: N812
from millrace.operators import knowledge as K  # noqa: N812
from millrace.operators import pages as P  # noqa: N812
from millrace.operators import preferences as R  # noqa: N812
from millrace.operators import retrieval as S  # noqa: N812
from millrace.sources.tables import deleted, latest, upserted, write_version


def one(spark, column, **values):
    schema = ", ".join(f"{k} {t}" for k, (t, _) in values.items())
    return spark.createDataFrame([tuple(v for _, v in values.values())], schema).select(column).first()[0]


def text(spark, make, value):
    return one(spark, make(F.col("x")), x=("string", value))


def test_text_functions(spark):
    assert text(spark, normalize_text, "  It’s 5-TIMES\n better! ") == "it s 5 times better" and text(spark, normalize_text, None) is None and text(spark, normalize_text, "—") == ""
    assert text(spark, strip, " \u2007a b\u00a0\n") == "a b" and text(spark, strip, None) is None
    assert text(spark, slugify, " Héllo, World -- 2! ") == "h-llo-world-2" and text(spark, slugify, "语") == ""
    assert text(spark, title_key, " Foo-Bar:  baz! ") == text(spark, title_key, "foo bar BAZ") == "foo bar baz" and text(spark, title_key, "语") == ""
    assert text(spark, humanize_tag, "llm_agents-and ui") == "LLM Agents And UI"
    assert text(spark, title_from_filename, "/a/b/My_talk [v2] (final).SRT") == "My talk" and text(spark, title_from_filename, "2024-05-01.a_b{draft}.txt") == "2024 05 01 a b" and text(spark, title_from_filename, "  ") == "Pasted transcript" and text(spark, title_from_filename, None) == "Pasted transcript"
    assert one(spark, display_title(F.col("a"), F.col("b")), a=("string", "x.txt"), b=("string", " ")) == "x"
    assert text(spark, lambda c: first_words(c, 2), "one  two three") == "one two" and text(spark, lambda c: first_words(c, 3), "one  two three") == "one  two three"
    assert text(spark, without_fence, "```json\n[1]\n```") == "[1]" and text(spark, without_citations, "So it is [k_01] . And [k_c00_k_02]  so") == "So it is. And so"
    assert text(spark, yaml_quoted, 'a "b"\n\\c') == '"a \\"b\\" \\\\c"'
    page = '---\ntype: source\ntitle: "a \\"b\\" c"\nempty:\n---\nbody [x](../concepts/c.md#top) `[no](code.md)` [m](mailto:a@b) [w](https://x.y)\n```\n[n](n.md)\n```\n'
    assert text(spark, lambda c: front_matter_field(c, "title"), page) == 'a "b" c' and text(spark, lambda c: front_matter_field(c, "empty"), page) is None
    assert text(spark, lambda c: front_matter_field(c, "type"), "no front matter") is None and text(spark, links_of, page) == ["../concepts/c.md"]
    assert text(spark, sentences, "One. Two?  Three") == ["One.", "Two?", "Three"] and text(spark, sentences, "  ") == []
    assert one(spark, topics_capped(F.col("x"), 2), x=("array<string>", [" A b!", "a_b", "--", "c", "d"])) == ["a_b", "c"]


def test_times_urls_and_vectors(spark):
    assert one(spark, clock(F.col("s")), s=("long", 3723)) == "01:02:03" and one(spark, clock(F.col("s")), s=("long", 360_000)) == "100:00:00"
    assert [one(spark, feedback_factor(F.col("s")), s=("int", v)) for v in (None, 1, 5)] == [1.0, 0.6, pytest.approx(1.4)]
    now = datetime(2024, 7, 1)
    rec = lambda v: one(spark, recency_factor(F.col("c"), F.col("n")), c=("string", v), n=("timestamp", now))
    assert rec("2024-06-21T00:00:00+00:00") == pytest.approx(0.5 + 0.5 * math.exp(-10 / 180)) and rec("2025-01-01") == 1.0 and rec("soon") == 1.0 and rec(None) == 1.0
    for url, want in (("https://youtu.be/abc?t=3", "abc"), ("www.youtube.com/watch?v=xyz&si=1", "xyz"), ("https://m.youtube.com/shorts/q1", "q1"), ("https://youtube.com/live/z/", "z"), ("https://youtube.com/", None)):
        assert text(spark, video_id, url) == want
    assert text(spark, watch_url, "https://other.site/watch?v=x") is None and text(spark, watch_url, "not a url") is None
    cos = lambda a, b: one(spark, cosine(F.col("a"), F.col("b")), a=("array<double>", a), b=("array<double>", b))
    assert cos([1.0, 0.0], [1.0, 1.0]) == pytest.approx(math.sqrt(0.5)) and cos([0.0], [1.0]) == 0 and cos([1.0], [1.0, 2.0]) == 0 and cos(None, [1.0]) == 0 and cos([], []) == 0
    v = text(spark, bow_embedding, "bread and bread")
    assert len(v) == 64 and sum(x * x for x in v) == pytest.approx(1) and not any(text(spark, bow_embedding, ""))


def test_answers():
    assert read_items('[{"a": 1}, {"b": 2}]') == (['{"a": 1}', '{"b": 2}'], False, False)
    assert read_items('```json\n[{"a": 1}]\n```')[0] == ['{"a": 1}'] and read_items('Here: [{"a": 1}] done')[0] == ['{"a": 1}']
    assert read_items('[{"a": 1}, {"b": 2}, {"c": ') == (['{"a": 1}', '{"b": 2}'], True, False)
    for bad in (None, "", "no array", '{"a": 1}', "[{"):
        assert read_items(bad)[2], bad


ITEM = "entry_id string, pos int, item_id string, statement string, rationale string, scope string, preconditions array<string>, gotchas array<string>, entity_mentions array<struct<name:string,kind:string>>, stance string, provenance struct<quote:string,timestamp:string,locator:string>"


def item(entry, pos, statement, quote=None, rationale=None, gotchas=(), mentions=(), ts=None, locator=None, stance="fact"):
    return (entry, pos, f"k_{pos:02d}", statement, rationale, None, [], list(gotchas), list(mentions), stance, (quote, ts, locator))


SEG = "segment_id long, entry_id string, text string, locator string, ts string"


def test_faithfulness_and_backfill(spark):
    items = spark.createDataFrame([item("a", 1, "s", "the RIVER, runs"), item("a", 2, "s", "made up words"), item("a", 3, "s", ""), item("a", 4, "s", "end of one start of two"), item("b", 1, "s", "the river runs"), item("a", 5, "s", "river runs deep in winter", ts="09:09:09")], ITEM)
    segments = spark.createDataFrame([(1, "a", "So, the river runs deep in winter, end of one", "seg:0", "00:00:01"), (2, "a", "Start of two: the river runs", "SEG: 1", None), (3, "a", "a repeat", "seg:1", None), (4, None, "x", None, None)], SEG)
    got = {(r["entry_id"], r["item_id"]): r["faithful"] for r in I.faithful(items, segments).collect()}
    assert got == {("a", "k_01"): True, ("a", "k_02"): False, ("a", "k_03"): False, ("a", "k_04"): True, ("b", "k_01"): False, ("a", "k_05"): True}
    filled = {(r["entry_id"], r["item_id"]): (r["locator"], r["ts"]) for r in I.backfilled(items, segments).collect()}
    assert filled[("a", "k_01")] == ("seg:0", "00:00:01") and filled[("a", "k_02")] == (None, None) and filled[("a", "k_05")] == ("seg:0", "09:09:09") and len(filled) == 6


def test_quotes_over_many_lines_and_lines_without_a_number(spark, monkeypatch):
    import random

    rng = random.Random(3)
    words = [f"w{i}" for i in range(50)]
    lines = [" ".join(rng.choices(words, k=rng.choice([0, 0, 1, 3]))) for _ in range(300)]
    numbers = sorted(rng.sample(range(5_000), 280))
    segments = [(1_000 + i, "a", line or None, f"seg:{numbers[i]}" if i < 280 else rng.choice([None, "intro"]), None) for i, line in enumerate(lines)]
    full = " ".join(" ".join(lines).split())
    quotes = []
    for _ in range(60):
        text = full.split()
        at, n = rng.randrange(len(text)), rng.choice([1, 3, 4, 9, 150])
        quotes.append(" ".join(text[at : at + n]))
        quotes.append(" ".join([*text[at : at + n - 1], rng.choice(words)]))
    items = spark.createDataFrame([item("a", i, "s", q) for i, q in enumerate(quotes)], ITEM)
    df = spark.createDataFrame(rng.sample(segments, len(segments)), SEG)
    for size in (4_096, 7):
        monkeypatch.setattr(I, "SECTION_LINES", size)
        got = {r["item_id"]: r["faithful"] for r in I.faithful(items, df).collect()}
        assert got == {f"k_{i:02d}": q in full for i, q in enumerate(quotes)} and {True, False} == set(got.values())
    assert I.transcript_sizes(df).first()["n_words"] == len(full.split())
    last = spark.createDataFrame([item("a", 1, "s", lines[290] or lines[291] or lines[292] or "none")], ITEM)
    assert I.backfilled(last, df.filter("segment_id >= 1280")).first()["no"] is None


def test_merging_repeats(spark):
    rows = [item("b", 1, "Same thing!", gotchas=["x", "z"], mentions=[("T", "tool")]), item("a", 2, "same   thing", gotchas=["y", "x"], rationale=None, mentions=[("T", "tool"), ("P", "person")]), item("a", 3, "SAME THING", rationale="why", gotchas=["z"]), item("c", 1, "other"), item("c", 2, None), item("c", 3, "")]
    got = {(r["entry_id"], r["key"]): r for r in I.merged_repeats(spark.createDataFrame(rows, ITEM)).collect()}
    m = got["a", "same thing"]
    assert (m["item_id"], m["rationale"], m["gotchas"], m["mentions"], m["n"]) == ("k_02", "why", ["y", "x", "z"], ["tool:T", "person:P"], 2)
    assert got["b", "same thing"]["n"] == 1  # another entry says it for itself
    assert got["c", "other"]["gotchas"] == [] and got["c", ""]["n"] == 2 and I.merged_repeats(spark.createDataFrame([], ITEM)).count() == 0
    leaders = spark.createDataFrame([("a", 2, 2), ("a", 3, 2), ("b", 1, 1)], "entry_id string, pos int, leader long")
    fold = {(r["entry_id"], r["leader"]): r for r in I.merged_restatements(spark.createDataFrame(rows, ITEM), leaders).collect()}
    assert fold["a", 2]["gotchas"] == ["y", "x", "z"] and fold["a", 2]["rationale"] == "why" and fold["b", 1]["n"] == 1


def test_mentions_in_order_however_many(spark):
    schema = "entry_id string, pos int, item_id string, entity_mentions array<struct<name:string,kind:string,quote:string>>"
    rows = [("e", 1, "k1", [(f"n{i}", "tool", "q") for i in range(1_500)]), ("e", 2, "k2", [("n0", "tool", " ".join("abcdefghijklmnopqrst")), ("x", "place", "q"), (" ", "tool", "q"), ("y", "tool", " ")])]
    found = K.entity_mentions(spark.createDataFrame(rows, schema)).orderBy("pos").collect()
    assert [r["name"] for r in found] == [f"n{i}" for i in range(1_500)] + ["n0"] and found[-1]["quote"] == "a b c d e f g h i j k l m n"


def test_sharing_tags_against_brute_force_with_a_hot_tag(spark):
    import random

    rng = random.Random(4)
    rows = [(f"e{i:03d}", ["hot"] * (i % 3 > 0) + rng.sample([f"t{k}" for k in range(30)], rng.randrange(4)), datetime(2024, 1, 1 + rng.randrange(28))) for i in range(300)] + [("n", None, None)]
    df = spark.createDataFrame(rows, "entry_id string, tags array<string>, created timestamp")
    got = sorted((r["query_id"], r["rank"], r["entry_id"], r["shared"]) for r in K.sharing_tags(df.filter("entry_id like '%0'"), df).collect())
    want = []
    for q, tags, _ in rows:
        if q.endswith("0"):
            near = sorted((-c.timestamp(), e, len(set(tags) & set(t))) for e, t, c in rows if e != q and t and set(tags) & set(t))
            want += [(q, n, e, k) for n, (_, e, k) in enumerate(near[:3], 1)]
    assert got == sorted(want)


def test_fuzzy_leaders_against_the_greedy_rule(spark):
    import random

    rng = random.Random(5)
    base = ["the quick brown fox jumps over the lazy dog", "a slow green turtle sleeps under an old tree", "we plan and review each budget before spring"]
    rows = []
    for g in ("p", "q"):
        for i in range(60):
            words = rng.choice(base).split()
            for _ in range(rng.choice([0, 1, 2, 3])):
                words[rng.randrange(len(words))] = rng.choice(["cat", "sun", "old", "x"])
            rows.append((g, i, " ".join(words) if i % 17 else None))
    want = {}
    for g in ("p", "q"):
        kept = []
        for _, i, t in (r for r in rows if r[0] == g):
            hit = next((j for j, k in kept if SequenceMatcher(None, t or "", k).ratio() >= 0.85), None)
            want[(g, i)] = i if hit is None else hit
            if hit is None:
                kept.append((i, t or ""))
    got = {(r["group_id"], r["pos"]): r["leader"] for r in I.fuzzy_leaders(spark.createDataFrame(rows, "group_id string, pos long, statement string"), chunk=16).collect()}
    assert got == want


def test_chunks(spark):
    df = spark.createDataFrame([(1, "One two. Three four. " + "x" * 30 + ". Five."), (2, ""), (3, None)], "id long, text string")
    chunks = I.greedy_chunks(df, "id", sentences(F.col("text")), 20)
    got = [r["text"] for r in chunks.filter("id = 1").orderBy("chunk").collect()]
    assert got == ["One two. Three four.", "x" * 30 + ".", "Five."] and chunks.count() == 3
    contexts = [r["context"] for r in I.chunk_contexts(chunks, "id", 15).orderBy("chunk").collect()]
    assert contexts == [None, "Three four.", "x" * 14 + "."]


VEC = "id long, vector array<double>, weight double, rank int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, w, 0) for i, v, w in rows], VEC)


def test_top_k_against_brute_force_and_ties(spark):
    import numpy as np

    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=8).tolist() if i % 11 else [0.0] * 8, float(rng.random())) for i in range(300)] + [(300, None, 1.0), (301, [1.0], 1.0)]
    rows += [(400 + i, rows[5][1], rows[5][2]) for i in range(4)]
    df = vectors(spark, rows)
    queries = df.filter("id % 20 = 0")
    got = {}
    for r in S.top_k(queries, df, 7).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"], round(r["score"], 9)))

    def cos(a, b):
        if a is None or b is None or len(a) != len(b) or not any(a) or not any(b):
            return 0.0
        return float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))

    for q, v, _ in rows:
        if q % 20 == 0:
            want = sorted(((-round(cos(v, u) * w, 9), i) for i, u, w in rows if i != q))[:7]
            assert [(i, s) for _, i, s in sorted(got[q])] == [(i, -s) for s, i in want], q
    assert S.top_k(queries.limit(0), df, 3).count() == 0
    assert all(r["similarity"] >= 0.5 for r in S.top_k(queries, df, 7, 0.5).collect())


def test_gate_groups_and_recruits(spark):
    ranked = spark.createDataFrame([(1, 10, 0.4), (1, 11, 0.2), (2, 12, 0.1)], "query_id long, id long, similarity double")
    queries = spark.createDataFrame([(1,), (2,)], "id long")
    assert {r["query_id"]: r["answered"] for r in S.answered(queries, S.gate(ranked, 0.35)).collect()} == {1: True, 2: False}
    group = "query_id long, group_id long, similarity double"
    scores = S.group_scores(spark.createDataFrame([(1, 1, -0.2), (1, 2, 0.3)], group), spark.createDataFrame([(1, 1, 0.5), (1, 3, -0.1)], group), 2)
    assert sorted((r["group_id"], r["similarity"]) for r in scores.collect()) == [(1, 0.5), (2, 0.3)]
    members = spark.createDataFrame([(1, 10), (1, 20), (2, 20), (2, 30)], "group_id long, id long")
    got = sorted(tuple(r) for r in S.recruited(scores, members, ranked).collect())
    assert got == [(1, 20, 1, 0.5), (1, 30, 2, 0.3)]
    c = S.centroids(spark.createDataFrame([(1, [1.0, 3.0]), (1, [3.0, 5.0]), (2, None)], "group_id long, vector array<double>")).collect()
    assert [(r["group_id"], r["vector"], r["n"]) for r in c] == [(1, [2.0, 4.0], 2)]


def test_candidates_against_brute_force_among_many_groups(spark):
    import numpy as np

    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(40)]
    groups = [(g, rng.normal(size=4).tolist() if g % 50 else None, " ".join(rng.choice(words, 3)) if g % 7 else None) for g in range(1_300)]
    queries = [(q, rng.normal(size=4).tolist(), f"{rng.choice(words).upper()}, the" if q % 5 else "") for q in range(20)]
    cos = lambda a, b: 0.0 if b is None else float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))
    want = []
    for q, v, t in queries:
        scored = sorted((-cos(v, u), g) for g, u, _ in groups)
        own = set(t.lower().replace(",", "").split())
        pool = {g for s, g in scored if -s >= 0.9} & {g for _, g in scored[:3]} | {g for g, _, d in groups if own & set((d or "").split())}
        want += [(q, g, n) for n, (_, g) in enumerate([x for x in scored if x[1] in pool][:5], 1)]
    found = K.candidates(spark.createDataFrame(queries, "id long, vector array<double>, text string"), spark.createDataFrame(groups, "group_id long, vector array<double>, text string").repartition(5), 0.9, 3, 5)
    assert sorted((r["query_id"], r["group_id"], r["rank"]) for r in found.collect()) == sorted(want) and len(want) > 60


def test_searches_within_a_kind(spark):
    rows = [(i, [1.0, i / 10], i % 3 if i % 8 else None) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, vector array<double>, kind int").repartition(4)
    got = S.top_k(df.filter("id < 12"), df, 3).collect()
    kind = {i: k for i, _, k in rows}
    assert all(kind[r["query_id"]] is not None and kind[r["query_id"]] == kind[r["id"]] and r["id"] != r["query_id"] for r in got)
    assert {r["query_id"] for r in got} == {i for i in range(12) if kind[i] is not None} and len(got) == 30


def test_candidates_edges_and_decisions(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 1.0]), (4, None)], "group_id long, vector array<double>")
    assert sorted((r["source"], r["target"]) for r in K.group_edges(v, 0.5).collect()) == [(1, 2), (2, 1)]
    answers = spark.createDataFrame([("a", 1, "Match", 5, None), ("a", 2, "new", None, "x"), ("b", 1, "match", 6, None), ("c", 1, "maybe", 5, None), ("d", 1, "new", None, "T")], "item_key string, seq int, action string, group_id long, title string")
    offered = spark.createDataFrame([("a", 5), ("b", 5), ("c", 5)], "item_key string, group_id long")
    assert {r["item_key"]: (r["action"], r["group_id"], r["title"]) for r in K.decided(answers, offered).collect()} == {"a": ("match", 5, None), "b": ("reject", None, None), "c": ("reject", None, None), "d": ("new", None, "T")}


def test_novelty(spark):
    links = spark.createDataFrame([("e", i, f"a{i}", i == 1) for i in range(5)] + [("f", 0, "a0", None)], "entry_id string, pos long, link_id string, novelty_flag boolean")
    flagged = lambda r: {(x["entry_id"], x["pos"]) for x in K.novelty_flags(links, r).collect() if x["novelty"]}
    assert flagged(0.4) == {("e", 0), ("e", 1), ("f", 0)} and flagged(0.0) == set() and flagged(0.2) == {("e", 1), ("f", 0)}


def test_preferences_equal_the_ordered_fold(spark):
    tags = [("e1", 5, None, "topics", "x"), ("e2", 3, None, "topics", "x"), ("e3", 4, None, "topics", "x"), ("e4", 1, "wrong_for_me", "topics", "y"), ("e5", 2, "already_knew", "topics", "z"), ("e6", 1, "bad_source", "topics", "x")]
    df = spark.createDataFrame(tags, "entry_id string, score int, reason string, dimension string, tag string")
    w = 0.0
    for a in (0.3, 0.03, 0.3):
        w = round(w + a * (1 - w), 6)
    assert R.affinities(df).first()["weight"] == pytest.approx(w, abs=1e-5) and R.affinities(df).count() == 1
    assert tuple(R.aversions(df).first()) == ("topics", "y", pytest.approx(0.3), 1) and [r[0] for r in R.known_topics(df).collect()] == ["z"]


def test_forms_that_new_links_brought_in(spark):
    schema = "entry_id string, feedback struct<score:int,reason:string,scored_at:string>, tags struct<topics:array<string>,knowledge_types:array<string>,application_forms:array<string>>, application_links array<struct<application_form:string,novelty_flag:boolean>>"
    entry = lambda e, score, when, forms, new: (e, (score, None, when), ([], [], forms), [(f, True) for f in new] + [("old", False)])
    rows = [entry("a", 5, "2024-01-01", ["use"], ["try", "use", None]), entry("b", 3, "2024-01-02", ["try"], ["lukewarm"]), entry("c", 4, "2024-01-03", ["late"], []), entry("d", 4, "2024-01-04", [], ["late"]), entry("e", None, None, ["x"], ["x"])]
    df = spark.createDataFrame(rows, schema)
    got = {r["tag"]: round(r["weight"], 6) for r in R.seeded_affinities(R.feedback_tags(df), R.novelty_seeds(df)).collect()}
    assert got == {"use": 0.3, "try": round(0.3 + 0.03 * 0.7, 6), "late": 0.3}
    low = spark.createDataFrame([("e", 1, "wrong_for_me", "topics", "y"), ("f", 2, "wrong_for_me", "topics", "y"), ("g", 2, "bad_source", "topics", "y")], "entry_id string, score int, reason string, dimension string, tag string")
    assert [tuple(r) for r in R.reason_counts(low).collect()] == [("topics", "y", {"wrong_for_me": 2})]


def test_lint_finds_one_violation_of_each_kind(spark):
    page = lambda kind, body="", extra="": f"---\ntype: {kind}\n{extra}---\n{body}\n" if kind else f"no front matter\n{body}\n"
    good = [("sources", "s1", page("source", "## Concepts covered\n[c](../concepts/c1.md)\n## Entities covered\n[e](../entities/e1.md)")), ("raw", "s1", page("raw-transcript")), ("concepts", "c1", page("concept", "## Sources\n[s](../sources/s1.md)", "videos: [s1]\n")), ("entities", "e1", page("entity", "## Sources\n[s](../sources/s1.md)", "videos: [s1]\n"))]
    listed = [("sources", "s1"), ("concepts", "c1"), ("entities", "e1")]
    frame = lambda rows: spark.createDataFrame(rows, "dir string, slug string, body string")
    names = lambda rows: spark.createDataFrame(rows, "dir string, slug string")
    assert P.lint(frame(good), names(listed)).collect() == []
    bad = good + [("sources", "s2", page(None, "[x](gone.md)")), ("concepts", "c2", page("entity", "## Sources\n[s](../sources/s1.md)", "videos: [s9]\n")), ("entities", "e2", page("concept", "## Sources\n[s](../sources/s1.md)", "videos: [s9]\n"))]
    codes = {r["code"] for r in P.lint(frame(bad), names(listed)).collect()}
    assert codes == {"E1", "E2", "E3", "E4", "E5", "E5b", "E6", "E7", "E8", "E9", "E9b", "E10", "E11", "E12"}


def test_lint_reads_pages_once(spark, monkeypatch):
    tables = []
    monkeypatch.setattr(P, "written", lambda df, real=P.written: tables.append(df) or real(df))
    pages = spark.createDataFrame([("sources", "s", "---\ntype: source\n---\n")], "dir string, slug string, body string")
    found = P.lint(pages, spark.createDataFrame([], "dir string, slug string"))
    assert sorted(r["code"] for r in found.collect()) == ["E3", "E4"] and len(tables) == 1
    assert "body" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_pages_indexes_and_notes(spark):
    member = "slug string, title string, type string, source string, quote string, listed boolean"
    rows = [("c", "B c", "concept", "s2", None, True), ("c", "B c", "concept", "s1", "said", True), ("c", "B c", "concept", "s3", None, False), ("d", "a d", None, "s1", None, True)]
    pages = P.group_pages(spark.createDataFrame(rows, member), "concepts")
    body = {r["slug"]: r["body"] for r in pages.collect()}
    assert body["c"] == '---\ntype: concept\ntitle: "B c"\nvideos: [s1, s2, s3]\n---\n\n# B c\n\n## Sources\n\n- [s1](../sources/s1.md): "said"\n- [s2](../sources/s2.md)\n' and "type:" not in body["d"]
    sources = spark.createDataFrame([("sources", "z", "# Z\n"), ("sources", "y", "# Y\n")], "dir string, slug string, body string")
    covered = spark.createDataFrame([("z", "concepts", "c"), ("z", "concepts", "c"), ("z", "entities", "e")], "slug string, dir string, target string")
    linked = P.with_backlinks(sources, covered)
    assert {r["slug"]: r["body"] for r in linked.collect()} == {"z": "# Z\n\n## Concepts covered\n\n- [c](../concepts/c.md)\n\n## Entities covered\n\n- [e](../entities/e.md)\n", "y": "# Y\n"}
    everything = linked.unionAll(pages).unionAll(P.raw_heads(sources.select("slug")))
    lines = {(r["dir"], r["nth"]): r["line"] for r in P.bundle_index(everything).collect()}
    assert lines == {("sources", 1): "- [y](y.md)", ("sources", 2): "- [z](z.md)", ("concepts", 1): "- [a d](d.md)", ("concepts", 2): "- [B c](c.md)", ("", 1): "- [concepts](concepts/index.md) (2)", ("", 2): "- [sources](sources/index.md) (2)"}
    left = P.without_pages(everything, spark.createDataFrame([("raw", "z"), ("raw", "none"), ("concepts", "c")], "dir string, slug string"))
    assert sorted((r["dir"], r["slug"]) for r in left.collect()) == [("concepts", "d"), ("raw", "y"), ("sources", "y"), ("sources", "z")]
    parts = spark.createDataFrame([("e", "caveats", 3, " mind it "), ("e", "core_takeaway", 0, "Core."), ("e", "key_points", 2, "two"), ("e", "key_points", 1, "one"), ("e", "how_to_apply", 4, " "), ("e", "how_to_apply", 5, None)], "entry_id string, section string, pos int, text string")
    note = P.note_markdown(parts, spark.createDataFrame([("e", None), ("f", "no parts")], "entry_id string, title string")).collect()
    assert [tuple(r) for r in note] == [("e", "# Untitled\n\n## Core takeaway\n\nCore.\n\n## Key points\n\n- one\n- two\n\n## Caveats\n\n- mind it\n")]


def test_slugs_and_parity(spark):
    rows = [("e-aaaaaaaa", ("Same title",), ("2024-01-02",)), ("e-bbbbbbbb", ("Same title!",), ("2024-01-01",)), ("e-cccccccc", ("语",), ("2024-01-01",)), ("x-bbaaaaaa", ("same-title",), ("2024-01-03",))]
    entries = spark.createDataFrame(rows, "entry_id string, source struct<title:string>, meta struct<created_at:string>")
    assert {r["entry_id"]: r["slug"] for r in P.entry_slugs(entries).collect()} == {"e-bbbbbbbb": "same-title", "e-aaaaaaaa": "same-title-aaaaaa", "e-cccccccc": "e-cccccccc", "x-bbaaaaaa": "same-title-bbaaaaaa"}
    a, b = spark.createDataFrame([("1",), ("2",), (None,), ("1",)], "k string"), spark.createDataFrame([("2",), ("3",)], "k string")
    assert sorted(tuple(r) for r in P.parity(a, b, "k").collect()) == [("1", "left only"), ("3", "right only")]


def test_tables(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, "old"), (1, 2, "new"), (2, None, "x")], "k long, t long, v string")
    assert sorted(tuple(r) for r in latest(rows, ["k"], ["t"]).collect()) == [(1, 2, "new"), (2, None, "x")]
    merged = upserted(latest(rows, ["k"], ["t"]), spark.createDataFrame([(2, 9, "y"), (3, 1, "z")], "k long, t long, v string"), ["k"])
    assert sorted(tuple(r) for r in merged.collect()) == [(1, 2, "new"), (2, 9, "y"), (3, 1, "z")]
    assert deleted(merged, spark.createDataFrame([(1,)], "k long")).count() == 2
    folder = write_version(merged, str(tmp_path), 3)
    assert write_version(merged, str(tmp_path), 3) == folder and spark.read.parquet(folder).count() == 3


def test_seams(spark):
    rows = spark.createDataFrame([(1, "ab"), (2, None)], "id long, text string")
    got = seams.embedded(rows, "id", "text", lambda: lambda texts: [[float(len(t))] for t in texts], "length").collect()
    assert [tuple(r) for r in got] == [(1, "length", [2.0])]
    prompts = spark.createDataFrame([(1, "p"), (2, "q")], "id long, prompt string")
    assert {r["id"]: r["answer"] for r in seams.completed(prompts, lambda: lambda ps: [p.upper() for p in ps]).collect()} == {1: "P", 2: "Q"}
    canned = spark.createDataFrame([(1, 1, "first"), (1, 2, "second")], "id long, seq int, answer string")
    assert {r["id"]: r["answer"] for r in seams.recorded(prompts, canned).collect()} == {1: "second", 2: None}
