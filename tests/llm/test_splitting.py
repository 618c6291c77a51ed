import random
import re

import pytest
from hypothesis import assume, given, settings
from hypothesis import strategies as st

from millrace.llm.splitting import _PLACES, _Packer, cutting_places, split_items, split_ranges, too_small_counts, transcript_lengths, transcript_pieces, transcript_sections

SEGMENT = "segment_id long, entry_id string, text string, locator string, piece int, start int"


def check(text, limit, overlap):
    pieces = split_ranges(text, limit, overlap)
    assert "".join(text[f:e] for _, e, f in pieces) == text
    assert all(e - s <= limit and s <= f and f - s <= overlap for s, e, f in pieces)
    assert all(b[2] == a[1] and a[2] < a[1] for a, b in zip(pieces, pieces[1:]))
    return [text[s:e] for s, e, _ in pieces]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab é.!?\n #語", max_size=300), st.integers(5, 60), st.integers(0, 4))
def test_pieces_make_up_the_text(text, limit, overlap):
    check(text, limit, overlap)


def test_natural_boundaries():
    text = "One two. Three four.\n\nFive six. Seven eight.\nNine ten."
    assert check(text, 30, 0) == ["One two. Three four.\n\n", "Five six. Seven eight.\n", "Nine ten."] or check(text, 30, 0)[0] == "One two. Three four.\n\n"
    assert check("x" * 25, 10, 0) == ["x" * 10, "x" * 10, "x" * 5]
    pieces = check("alpha beta gamma delta epsilon", 16, 6)
    assert all(not p.startswith("lpha") for p in pieces) and pieces[1].split()[0] in ("beta", "gamma")


def test_edges():
    assert split_ranges(None) == [] and split_ranges("") == [(0, 0, 0)] and len(split_ranges("y" * 12_000)) == 1 and len(split_ranges("y" * 12_001)) == 2
    with pytest.raises(ValueError):
        split_ranges("x", 10, 10)
    check("語 " * 40_000, 12_000, 1_200)


def test_items(spark):
    long = "A sentence of words. " * 2_000
    rows = [(1, "e", long, "seg:0"), (2, "e", None, "seg:1"), (3, "e", "", "seg:2"), (4, "e", "short", "x"), (4, "e", "short", "x")]
    got = split_items(spark.createDataFrame([(*r, 1, 1) for r in rows], SEGMENT), ["segment_id"]).collect()
    assert sorted(r["segment_id"] for r in got if r["piece"] == 0) == [1, 3, 4, 4]
    mine = sorted((r for r in got if r["segment_id"] == 1), key=lambda r: r["piece"])
    assert [r["piece_text"] for r in mine] == [long[s:e] for s, e, _ in split_ranges(long)] and {r["n_pieces"] for r in mine} == {len(mine)}
    assert split_items(spark.createDataFrame([], SEGMENT), ["segment_id"]).count() == 0


def test_transcripts_against_brute_force(spark):
    rng = random.Random(8)
    rows, full = [], {}
    for e, size in (("a", 9_000), ("b", 3), ("c", 1)):
        lines = ["word " * rng.randint(0, 6) for _ in range(size)]
        full[e] = "\n".join(lines)
        rows += [(i + 1 if e == "a" else 100_000 + i + ord(e) * 10, e, line or None, f"seg:{i}") for i, line in enumerate(lines)]
        rows.append((500_000 + ord(e), e, "a later copy", "SEG: 0"))
    rng.shuffle(rows)
    segments = spark.createDataFrame([(*r, 1, 1) for r in rows], SEGMENT)
    sections = {}
    for r in transcript_sections(segments).collect():
        sections.setdefault(r["entry_id"], []).append((r["section"]["no"], r["text"]))
    assert {e: "\n".join(t for _, t in sorted(s)) for e, s in sections.items()} == full and len(sections["a"]) == 36
    assert {r["entry_id"]: r["n_chars"] for r in transcript_lengths(segments).collect()} == {e: len(t) for e, t in full.items()}
    pieces = transcript_pieces(segments).orderBy("entry_id", "piece").collect()
    for e, t in full.items():
        assert [(r["start"], r["end"], r["fresh"], r["piece_text"]) for r in pieces if r["entry_id"] == e] == [(a, b, c, t[a:b]) for a, b, c in split_ranges(t)]
    n = len(full["a"])
    results = spark.createDataFrame([(1, "a", n // 12_000), (2, "a", n // 12_000 + 1), (3, "a", None), (4, "zz", 0), (5, "b", 0), (6, "c", 1)], "run_id long, entry_id string, chunk_count int")
    assert sorted(r["run_id"] for r in too_small_counts(results, transcript_lengths(segments)).collect()) == [1, 5]
    assert transcript_lengths(spark.createDataFrame([], SEGMENT)).count() == 0


def packed(text_lines, per_section, limit, overlap):
    """The packing of a transcript in sections of so many lines, without Spark."""
    packer = _Packer(limit, overlap)
    names = [x.split(" ")[0] for x in _PLACES.split(", ")]
    pieces = []
    for i in range(0, len(text_lines), per_section):
        packer.section(dict(zip(names, cutting_places("\n".join(text_lines[i : i + per_section]), limit - overlap, overlap))))
        pieces, packer.done = pieces + packer.done, []
    packer.finish()
    return pieces + packer.done


@settings(max_examples=600, deadline=None)
@given(st.lists(st.text(alphabet="ab. \n#\f", max_size=14), min_size=1, max_size=60), st.integers(1, 9), st.integers(8, 40), st.integers(0, 6))
def test_transcripts_are_cut_as_one_text(lines, per_section, limit, overlap):
    text = "\n".join(lines)
    # The exception: a line that only the empty lines behind it make too long.
    assume(not any(len(m[1]) + 1 <= limit - overlap <= len(m[0]) for m in re.finditer(r"([^\n\f]*)(\n+)", text)))
    assert packed(lines, per_section, limit, overlap) == split_ranges(text, limit, overlap)


def test_long_transcripts_are_cut_as_one_text():
    rng = random.Random(3)
    for shape in range(6):
        lines = []
        for _ in range(5_000):
            line = " ".join("".join(rng.choices("abcdefg", k=rng.randint(1, 9))) + rng.choice(["", "", "", "."]) for _ in range(rng.randint(0 if shape % 2 else 1, 14)))
            lines.append("# " + line if shape > 3 and rng.random() < 0.01 else line)
        if shape == 2:
            lines[700] = "x" * 40_000
            lines[3_000] = "word " * 9_000
        text = "\n".join(lines)
        for per_section in (1_024, 37):
            assert packed(lines, per_section, 12_000, 1_200) == split_ranges(text)


def test_transcript_edges(spark):
    rows = [(1, None, "of no entry", "seg:0"), (2, None, None, "seg:1"), (3, "e", None, None), (4, "e", "", None), (4, "e", "", None), (5, "f", None, "seg:9"), (6, "g", "x" * 30_000, "seg:1"), (7, "g", "语 " * 9_000, "seg:0")]
    got = transcript_pieces(spark.createDataFrame([(*r, 1, 1) for r in rows], SEGMENT)).orderBy("entry_id", "piece").collect()
    text = {None: "of no entry\n", "e": "\n", "f": "", "g": "语 " * 9_000 + "\n" + "x" * 30_000}
    assert {e: [r["piece_text"] for r in got if r["entry_id"] == e] for e in text} == {e: [t[a:b] for a, b, _ in split_ranges(t)] for e, t in text.items()}
    assert transcript_pieces(spark.createDataFrame([], SEGMENT)).count() == 0
    with pytest.raises(ValueError):
        transcript_pieces(spark.createDataFrame([], SEGMENT), 10, 10)
