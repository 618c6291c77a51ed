import json

import pytest

from millrace.llm.truncation import cut_share, cut_texts, open_structures, read_answer, read_prose

ROW = "table_name string, id long, source string, text string, structured boolean, reason string, cut int"
ITEM = {"type": "opinion", "statement": "A statement that ends.", "provenance": {"quote": "no end here", "timestamp": None}}


@pytest.mark.parametrize("text", ["Whole. It ends.", "It asks?", "He says “we stop.”", "(An aside.)", "**Bold end.**  \n", "- A list item.\n- Another!", "Das „Ende“ kommt.", "It's 5 o'clock (again).", "See [1]. Done.", 'It is 5" wide.', "Take x from [0, 1) or (0, 1].", "That failed :( but we go on.", "Two ** three is eight."])
def test_whole_prose(text):
    assert not any(read_prose(text)[:4])


@pytest.mark.parametrize("text", ["It stops in the mid", "It stops, then…", "It stops ...", "Number the [...]", "Whole.…", "An (open aside.", "He says “we.", "**Bold and.", "ends,", "A list.\n-", "half \\u00", "bad �", "for it lasts 8.", "as in, e.g.", "amp &am"])
def test_cut_prose(text):
    assert any(read_prose(text)[:4])


def test_automaton():
    assert open_structures("a (b [c] d") == ["("] and open_structures("“a” (b)") == [] and open_structures("**a** **b") == ["**"] and open_structures("\\( escaped") == [] and open_structures("closed only )") == []


def test_answers():
    whole = json.dumps([ITEM, ITEM])
    for text in (whole, f"```json\n{whole}\n```", f"Here:\n{whole}", f"{whole}\n\nLet me know", "[]", json.dumps({"items": [ITEM]}), json.dumps([ITEM], indent=1)):
        assert read_answer(text)[:4] == (False,) * 4, text
    for text in (whole[:-1], whole[:-30], whole[: len(whole) // 2], "```json\n" + whole[:-40] + "\n```", "[", "Here are", whole[:-1] + ", ...]", whole + "\n...", json.dumps([ITEM, {"type": "opinion"}]), json.dumps([ITEM | {"statement": ""}])):
        assert read_answer(text)[0], text
    assert read_answer(json.dumps([ITEM, ITEM | {"statement": "It ends in"}]))[2]
    assert not any(read_answer(json.dumps([ITEM | {"statement": "No end"}, ITEM]))[:4])  # only the last item's counts
    assert read_answer("")[:4] == (False,) * 4


def test_every_cut_of_a_whole_answer_is_found():
    whole = json.dumps([ITEM, ITEM])
    assert all(any(read_answer(whole[:n])[:4]) for n in range(1, len(whole)))


def test_baselines_and_edges(spark):
    rows = [("t", i, "bare", f"no terminator {i}", False) for i in range(100)] + [("t", 200 + i, "usual", "It ends.", False) for i in range(100)]
    rows += [("t", 301, "usual", "it does not", False), ("t", 302, None, None, False), ("t", 303, None, "", False), ("t", 304, "rare", "it does not", False), ("t", 305, "usual", "x " * 500_000 + "end.", False), ("t", 306, None, "half a", False), ("t", 301, "usual", "it does not", False)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], ROW)
    cut = cut_texts(df)
    assert sorted(r["id"] for r in cut.filter("cut").collect()) == [301, 301, 304, 306]
    assert cut.count() == len(rows) - 1
    share = {r["source"]: (r["n_rows"], r["n_cut"]) for r in cut_share(cut, "source").collect()}
    assert share == {"bare": (100, 0), "usual": (103, 2), None: (2, 1), "rare": (1, 1)}
    assert cut_texts(spark.createDataFrame([], ROW)).count() == 0


def test_prose_before_an_answer_may_hold_brackets():
    for lead in ("Note [1]: here is the answer: ", "As in {x} or [see below]\n"):
        assert not any(read_answer(lead + json.dumps([ITEM]))[:4]) and read_answer(lead + json.dumps([ITEM])[:-1])[0] and read_answer(lead + "[")[0]


def test_structures_left_open_before_a_finished_end_are_judged_by_the_source(spark):
    rows = [("t", i, "marks", "It starts **bold and ends.", False) for i in range(60)] + [("t", 100 + i, "plain", "It ends.", False) for i in range(60)]
    rows += [("t", 200, "plain", "It starts **bold and ends.", False), ("t", 201, "marks", "It starts **bold and", False), ("t", 202, "plain", "He says “we stop.", False)]
    cut = cut_texts(spark.createDataFrame([(*r, "x", 1) for r in rows], ROW)).filter("cut")
    assert sorted(r["id"] for r in cut.collect()) == [200, 201, 202]


def test_texts_are_read_once(spark, monkeypatch):
    from millrace.llm import truncation

    tables = []
    monkeypatch.setattr(truncation, "written", lambda df, real=truncation.written: tables.append(df) or real(df))
    cut = cut_texts(spark.createDataFrame([("t", 1, "s", "It ends.", False, "x", 1)], ROW))
    assert len(tables) == 1 and "MapInArrow" in tables[0]._jdf.queryExecution().toString() and "MapInArrow" not in cut._jdf.queryExecution().toString()
