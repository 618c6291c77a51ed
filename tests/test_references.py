from datetime import datetime

from pyspark.sql import functions as F

from millrace.functions.times import utc_timestamp
from millrace.operators.references import orphan_references, orphan_report

REFS = "table_name string, row_key string, entry_id string, item_id string, own_time timestamp, key string, kind string"


def t(day):
    return datetime(2024, 1, day)


def run(spark, refs, entries, deletions, items):
    return {
        tuple(r)
        for r in orphan_references(
            spark.createDataFrame([(*r, "x", "y") for r in refs], REFS), spark.createDataFrame([(*e, 1) for e in entries], "entry_id string, created timestamp, tag int"),
            spark.createDataFrame([(d, "z") for d in deletions], "entry_id string, key string"), spark.createDataFrame(items, "entry_id string, item_id string"),
        ).collect()
    }


def test_all_kinds(spark):
    refs = [
        ("v", "a/1", "a", "1", t(9)), ("v", "a/2", "a", "2", t(9)), ("v", "a/1", "a", "1", t(9)), ("v", "b/1", "b", "1", t(3)), ("j", "1", "c", None, t(3)), ("j", "2", "d", None, t(3)),
        ("j", "3", None, None, t(3)), ("j", "4", "", None, None), ("j", "5", "A", None, t(3)), ("v", "d/1", "d", "1", t(4)), ("j", "6", "b", None, None),
    ]
    found = run(spark, refs, [("a", t(5)), ("a", t(5)), ("b", t(8)), ("e", None)], ["c", "a", None], [("a", "1"), ("b", "1"), ("a", None)])
    assert found == {
        ("v", "a/2", "item_id", "missing", "2024-01"), ("v", "b/1", "entry_id", "late", "2024-01"), ("j", "1", "entry_id", "deleted", "2024-01"), ("j", "2", "entry_id", "missing", "2024-01"),
        ("j", "4", "entry_id", "missing", None), ("j", "5", "entry_id", "missing", "2024-01"), ("v", "d/1", "entry_id", "missing", "2024-01"),
    }


def test_empty_tables(spark):
    assert run(spark, [], [], [], []) == set()
    assert run(spark, [("v", "a/1", "a", "1", t(9))], [], [], []) == {("v", "a/1", "entry_id", "missing", "2024-01")}


def test_hot_key_against_brute_force(spark):
    refs = [("v", f"h/{i % 50}", "hot", str(i % 50), t(1 + i % 20)) for i in range(3000)] + [("v", f"e{i}/1", f"e{i}", "1", t(5)) for i in range(300)]
    items = [("hot", str(i)) for i in range(0, 50, 2)] + [(f"e{i}", "1") for i in range(0, 300, 3)]
    entries = [("hot", t(10))] + [(f"e{i}", t(1)) for i in range(0, 300, 2)]
    want, there, have = set(), dict(entries), set(items)
    for name, key, entry, item, own in refs:
        if entry not in there:
            want.add((name, key, "entry_id", "missing", "2024-01"))
        else:
            if there[entry] > own:
                want.add((name, key, "entry_id", "late", "2024-01"))
            if (entry, item) not in have:
                want.add((name, key, "item_id", "missing", "2024-01"))
    assert run(spark, refs, entries, [], items) == want


def test_strange_ids_and_long_ones(spark):
    odd = ["x\x1f1", "x", "x\x00", "x" * 50_000, "ключ", " x"]
    found = run(spark, [("v", str(i), o, "1\x1f2", t(2)) for i, o in enumerate(odd)], [(o, t(1)) for o in odd[:2] + odd[3:]], [], [(o, "1\x1f2") for o in odd])
    assert found == {("v", "2", "entry_id", "missing", "2024-01")}


def test_report_and_times(spark):
    df = spark.createDataFrame([("2024-03-01T01:00:00+02:00",), ("2024-03-01T00:30:00",), ("2024-02-29T23:59:59Z",), ("nonsense",), ("2024-03-05",), (None,)], "s string").select(utc_timestamp(F.col("s")).alias("t"))
    got = [r[0] for r in df.select(F.date_format(F.to_utc_timestamp("t", F.current_timezone()), "yyyy-MM-dd HH:mm")).collect()]
    assert got == ["2024-02-29 23:00", "2024-03-01 00:30", "2024-02-29 23:59", None, "2024-03-05 00:00", None]
    orphans = spark.createDataFrame([("v", "1", "entry_id", "missing", "2024-01"), ("v", "2", "entry_id", "missing", "2024-01")], "table_name string, row_key string, field string, kind string, period string")
    assert [tuple(r) for r in orphan_report(orphans).collect()] == [("v", "entry_id", "missing", "2024-01", 2)]


def test_long_keys_do_not_widen_the_others():
    import numpy as np
    import pyarrow as pa

    from millrace.operators.references import _find, _keys

    short, mixed = _keys(pa.array(["b", "a", "c\x00"])), _keys(pa.array(["a", "z" * 10_000, "é", "c\x00", "c"]))
    assert short.dtype.kind == "S" and mixed.dtype == object
    for parents in (np.sort(short), np.sort(mixed)):
        for probes in (short, mixed):
            known = {bytes(k) for k in parents}
            assert [bytes(parents[i]) if i >= 0 else None for i in _find(parents, probes)] == [bytes(k) if bytes(k) in known else None for k in probes]
