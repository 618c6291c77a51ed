import random
import unicodedata

from millrace.llm.confusables import LOOK_ALIKES, canonical_form, look_alike_pairs, skeleton, with_skeleton

ROW = "table_name string, id long, text string, skeleton string, k1 long"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], ROW)


def pairs(spark, rows):
    return sorted(tuple(r) for r in look_alike_pairs(table(spark, rows)).collect())


def test_same_to_a_reader():
    for other in ("ｃａｆé 12", "café 12", "cаfé 12", "caf​é 12", "café 12", "café １２", "ca­fé 12", "café‎ 12"):
        assert skeleton(other) == skeleton("café 12"), other
    for other, text in (("ραιυ", "paiu"), ("гьѡ", "rbw"), ("ᎪᏴᎻᎡ", "ABHR"), ("a‒b", "a-b")):
        assert skeleton(other) == text, other
    assert skeleton("ﬁnd oﬀ") == skeleton("find off") and skeleton("part‑time") == "part-time" and skeleton("ﬆ") == "st"


def test_different_to_a_reader():
    for other in ("cafe 12", "Café 12", "café 12.", "café, 12", "café12", "càfé 12", "café 13", "café  12"):
        assert skeleton(other) != skeleton("café 12"), other
    assert skeleton("“a”") != skeleton('"a"') and skeleton("!") != skeleton("?") and skeleton("♪") != skeleton("")


def test_skeleton_is_stable():
    rng = random.Random(2)
    alphabet = [chr(c) for c in (*range(32, 0x250), *range(0x300, 0x330), *range(0x391, 0x460), *range(0x2000, 0x2070), *range(0xFB00, 0xFB07), *range(0xFF00, 0xFF5F))] + list(LOOK_ALIKES)
    for _ in range(500):
        text = "".join(rng.choices(alphabet, k=30))
        assert skeleton(skeleton(text)) == skeleton(text)
        assert skeleton(unicodedata.normalize("NFC", text)) == skeleton(unicodedata.normalize("NFD", text)) == skeleton(text)
    assert skeleton(None) is None and skeleton("") == ""


def test_pairs_against_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for i in range(300):
        text = f"text number {i % 60} é"
        for a, b in (("e", "е"), ("x", "х"), (" ", " "), ("m", "ｍ"), ("n", "n​")):
            if rng.random() < 0.2:
                text = text.replace(a, b)
        rows.append((rng.choice(["a", "b"]), i, rng.choice([text, text, None])))
    want = sorted((x[0], x[1], y[1]) for x in rows for y in rows if x[0] == y[0] and x[1] < y[1] and x[2] and y[2] and x[2] != y[2] and skeleton(x[2]) == skeleton(y[2]))
    assert pairs(spark, rows) == want and len(want) > 50


def test_hot_group_is_split(spark):
    rows = [("a", i, "hot" if i % 2 else "hоt") for i in range(1400)] + [("a", 5000 + i, f"other {i}") for i in range(50)]
    got = pairs(spark, rows)
    assert len(got) == len(set(got)) == 700 * 700


def test_edges(spark):
    assert pairs(spark, []) == []
    assert pairs(spark, [("a", 1, None), ("a", 2, None), ("a", 3, ""), ("a", 4, "​"), ("a", 5, ""), ("b", 6, "​")]) == [("a", 3, 4), ("a", 4, 5)]
    assert pairs(spark, [("a", 1, "x"), ("a", 1, "x"), ("a", 2, "х"), ("a", 2, "х")]) == [("a", 1, 2)]
    assert pairs(spark, [("a", 1, "х\x00y"), ("a", 2, "x\x00y"), ("a", 3, "\x00"), ("a", 4, "é"), ("a", 5, "e\u0301")]) == [("a", 1, 2), ("a", 4, 5)]
    long = "word " * 100_000
    assert pairs(spark, [("a", 1, long), ("a", 2, long + "​"), ("a", 3, long)]) == [("a", 1, 2), ("a", 2, 3)]


def test_columns(spark):
    got = with_skeleton(table(spark, [("a", 1, "ａ"), ("a", 2, None)]), "text")
    assert got.columns == ["table_name", "id", "text", "k1", "skeleton"] or got.columns == ["table_name", "id", "text", "skeleton", "k1"]
    assert {r["id"]: r["skeleton"] for r in got.collect()} == {1: "a", 2: None}
    forms = {r["id"]: (r["canonical"], r["changed"]) for r in canonical_form(table(spark, [("a", 1, "ｃafé"), ("a", 2, "plain"), ("a", 3, None)])).collect()}
    assert forms == {1: ("café", True), 2: ("plain", False), 3: (None, False)}
