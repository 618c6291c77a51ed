import random

from millrace.llm.turns import Roster, calibrated_pause, join_captions, overlap, read_segment, seconds_of, speaker_turns

SPEAKERS = [("s1", "C", 1, "host", "Anna Berger"), ("s2", "C", 2, "cohost", "Milan Okoro"), ("s3", "C", 3, "guest", "Suor Orheldro"), ("z1", "D", 1, "host", "Zed Zeller")]
SEGMENT = "segment_id long, entry_id string, channel string, text string, locator string, ts string, part int, who string"
SPEAKER = "speaker_id string, channel string, seat int, role string, display_name string, members string"
ROSTER = Roster([dict(zip(("speaker_id", "channel", "seat", "role", "display_name"), s)) for s in SPEAKERS[:3]])


def turns(spark, segments, **more):
    s = spark.createDataFrame([(*x, 1, "x") for x in segments], SEGMENT)
    return speaker_turns(s, spark.createDataFrame([(*x, "x") for x in SPEAKERS], SPEAKER), **more)


def found(spark, segments, **more):
    return sorted(tuple(r) for r in turns(spark, segments, **more).select("entry_id", "first_segment_id", "last_segment_id", "speaker_id").collect())


def test_labels_in_every_writing():
    for label in ("Anna Berger:", "ANNA:", "anna berger -", "[Anna Berger]", "(Anna)", "<v Anna Berger>", ">> Anna:", "A.B.:", "HOST:", "Speaker 1:", "SPK_01 -", "Ana Berger:", "Аnna Berger:", "An​na Berger:", "00:01:02 - Anna:"):
        parts = read_segment(f"{label} good morning", ROSTER)
        assert parts == [("s1", 2, "good morning")], (label, parts)
    assert [p[0] for p in read_segment("First part. Milan Okoro: second part. (Suor) third", ROSTER)] == [None, "s2", "s3"]
    assert [p[:2] for p in read_segment("Yes. M.O.: no. Oh! A.B.: Really? Note: well", ROSTER)] == [(None, 1), ("s2", 2), ("s1", 3)]
    assert read_segment("Co-Host: yes", ROSTER)[0][0] == "s2"


def test_what_is_no_label_and_no_word():
    assert read_segment("Note: keep this", ROSTER) == [(None, 3, "Note: keep this")]
    assert read_segment("see it (line 7, archive) there", ROSTER)[0][1] == 6
    assert [p[0] for p in read_segment("we met her (Anna) there", ROSTER)] == [None] and [p[0] for p in read_segment("It ends. (Anna) Yes", ROSTER)] == [None, "s1"]
    for nothing in (None, "", "  ", "[music]", "(applause)", "*clears throat*", "<cough>", "{static}", "♪ ♪", "um, uh", "Uhm... hmm", "[00:00:10]", "00:10 -", "er"):
        assert not any(n for _, n, _ in read_segment(nothing, ROSTER)), nothing
    assert read_segment("Anna: [laughs]", ROSTER) == [("s1", 0, "")]


def test_verbs_that_look_like_hesitations_and_sounds_no_list_names():
    assert read_segment("To err is human, errr, and eer um so", ROSTER) == [(None, 6, "To err is human, and so")]
    for text in ("It ends. (sirens wailing) Then we left", "It ends. *thunder* Then we left", "It ends. (sirens wailing)\nThen we left"):
        assert read_segment(text, ROSTER) == [(None, 5, "It ends. Then we left")], text
    for text in ("(two times, he said) We", "we saw (the old one) there", "It is *really* good", "It ends (see above). Then", "It ends. (Not here) Then"):
        assert "(" in read_segment(text, ROSTER)[0][2] or "*" in read_segment(text, ROSTER)[0][2], text


def test_turns_repeats_and_unknown(spark):
    segments = [
        (9, "e", "C", "late copy of zero", "seg:0", None), (1, "e", "C", "before any", "SEG:0", "00:01"), (2, "e", "C", "Anna: hello", "seg: 1", "00:00:02"), (3, "e", "C", "[music]", "seg:2", None),
        (4, "e", "C", "more", "seg:3", None), (5, "e", "C", "Anna: again. Milan: now me", "seg:10", None), (6, "e", "C", "Milan: um", "seg:4", None), (7, "f", "X", "Anna: no such channel", "seg:0", None), (8, None, "C", None, None, None),
    ]
    # Milan's label without words changes nobody's turn: Anna's goes on from segment 2 to 5.
    assert found(spark, segments) == [("e", 1, 1, "unknown"), ("e", 2, 5, "s1"), ("e", 5, 5, "s2"), ("f", 7, 7, "unknown")]


def test_empty_tables(spark):
    assert found(spark, []) == []
    assert calibrated_pause(spark.createDataFrame([], SEGMENT)) == 8.0


def test_sweep_over_many_partitions_against_one_pass(spark):
    rng = random.Random(11)
    segments, n = [], 0
    for entry, size in (("hot", 1500), ("b", 40), ("c", 3), ("d", 1)):
        for i in range(size):
            n += 1
            label = rng.choice(["", "", "", "Anna: ", "Milan: ", "Speaker 3: ", "[music]"])
            words = rng.choice(["", "some words here", "um", "one"])
            segments.append((n, entry, "C", label + words if rng.random() > 0.02 else None, f"seg:{i}", None))
    want, label, current = [], "unknown", None
    for entry in ("hot", "b", "c", "d"):
        label, current = "unknown", None
        for s in (x for x in segments if x[1] == entry):
            for who, k, _ in read_segment(s[3], ROSTER):
                label = who or label
                if k and current and current[3] == label:
                    current[2] = s[0]
                elif k:
                    current = [entry, s[0], s[0], label]
                    want.append(current)
    shuffled = segments[:]
    rng.shuffle(shuffled)
    for partitions, coalesce, advisory in (("13", "false", "64m"), ("40", "true", "3k"), ("5", "true", "64m")):
        conf = {"spark.sql.shuffle.partitions": partitions, "spark.sql.adaptive.coalescePartitions.enabled": coalesce, "spark.sql.adaptive.advisoryPartitionSizeInBytes": advisory, "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}
        old = {k: spark.conf.get(k, None) for k in conf}
        for k, v in conf.items():
            spark.conf.set(k, v)
        try:
            assert found(spark, shuffled, with_text=False) == sorted(map(tuple, want))
        finally:
            for k, v in old.items():
                spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_pauses_and_rolling_captions(spark):
    segments = [(1, "e", "C", "Anna: we go on and", "seg:0", "00:00:01"), (2, "e", "C", "we go on and then stop", "seg:1", "00:00:03"), (3, "e", "C", "after a while", "seg:2", "00:02:00,500")]
    got = [(r["first_segment_id"], r["last_segment_id"], r["text"], r["n_words"]) for r in turns(spark, segments, pause=20.0).orderBy("first_segment_id").collect()]
    assert got == [(1, 2, "we go on and then stop", 6), (3, 3, "after a while", 3)]
    assert len(found(spark, segments)) == 1
    assert overlap("a b c d".split(), "B c d e".split()) == 3 and overlap(["a", "b"], ["b", "c"]) == 0
    assert join_captions(None, "x") == ("x", 0) and join_captions("a b c", "a b c") == ("a b c", 3) and join_captions("a b c", "d") == ("a b c d", 0)


def test_times(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("01:02:03",), ("00:00:01,500",), ("02:03",), ("x",), (None,)], "ts string")
    assert [r[0] for r in df.select(seconds_of(F.col("ts"))).collect()] == [3723.0, 1.5, 123.0, None, None]


def test_very_long_text(spark):
    assert read_segment("word " * 200_000, ROSTER)[0][1] == 200_000
    assert found(spark, [(1, "e", "C", "Anna: " + "word " * 100_000, "seg:0", None)]) == [("e", 1, 1, "s1")]


def test_rolling_captions_that_repeat_many_words(spark):
    words = [f"word{i}" for i in range(900)]
    segments = [(1, "e", "C", " ".join(words[:300]), "seg:0", None), (2, "e", "C", " ".join(words[300:600]), "seg:1", None), (3, "e", "C", " ".join(words[50:900]).upper(), "seg:2", None)]
    assert [(r["text"].casefold(), r["n_words"]) for r in turns(spark, segments).collect()] == [(" ".join(words), 900)]
    assert join_captions(" ".join(words[:600]), " ".join(words[100:])) == (" ".join(words), 500)
    # The words are counted alike where the repeat is found between two partitions.
    long = [(i, "e", "C", " ".join(words[i : i + 6]), f"seg:{i}", None) for i in range(894)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert [(r["text"], r["n_words"]) for r in turns(spark, long).collect()] == [(" ".join(words[:899]), 899)]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_runs_between_pauses_before_a_partitions_first_label(spark):
    # One label at the start and one near the end: the partitions between them have pauses, but no label.
    clock = lambda s: f"{s // 3600:02}:{s // 60 % 60:02}:{s % 60:02}"
    label = {0: "Anna: ", 395: "Anna: ", 398: "Milan: "}
    segments = [(i, "e", "C", label.get(i, "") + "some words here", f"seg:{i}", clock(5 * i + 60 * (i // 4))) for i in range(400)]
    segments += [(1000 + i, "f", "C", "nobody is named", f"seg:{i}", clock(100 * i)) for i in range(60)]
    want = [("e", i, min(i + 3, 397), "s1") for i in range(0, 398, 4)] + [("e", 398, 399, "s2")] + [("f", 1000 + i, 1000 + i, "unknown") for i in range(60)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert found(spark, segments, pause=30.0) == want
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
