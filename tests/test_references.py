import random
from datetime import datetime, timedelta

from glossmill.operators import joins
from glossmill.operators.references import orphan_references, orphan_report, references, validity

DAY = datetime(2024, 3, 1, 12)
REF = "rid string, key string, at timestamp_ntz, gone timestamp_ntz, ref_key string, has_parent string"
PARENT = "pid string, at timestamp_ntz, gone timestamp_ntz, alive_from int"


def run(spark, refs, parents):
    r = spark.createDataFrame([(*x, "clash", "clash") for x in refs], REF)
    p = spark.createDataFrame([(*x, 1) for x in parents], PARENT)
    return orphan_references([references(r, "t.key", "rid", "key", "p", "at", "gone")], [validity(p, "p", "pid", "at", "gone")])


def test_kinds_and_dirt(spark):
    refs = [
        ("ok", " A1 ", DAY, None), ("ok", " A1 ", DAY, None), ("missing", "zz", DAY, None), ("deleted", "B", DAY, None), ("late", "c", DAY, None), ("same_day", "d", DAY, None), ("null", None, DAY, None),
        ("blank", " 　\t", DAY, None), ("gone", "zz", DAY, DAY), ("again", "e", DAY, None), ("no_time", "c", None, None), (None, "zz", DAY, None), ("undated", "f", DAY, None),
    ]
    later = DAY + timedelta(days=1)
    parents = [("a1", DAY, None), ("b", DAY, DAY), ("B ", DAY, DAY), ("c", later, None), ("d", DAY + timedelta(hours=5), None), ("e", DAY, DAY), ("e", DAY - timedelta(days=9), None), ("f", None, None), (None, DAY, None)]
    got = {(r.record_id, r.ref_month, r.orphan_kind) for r in run(spark, refs, parents).collect()}
    assert got == {("missing", "2024-03", "missing"), ("deleted", "2024-03", "deleted"), ("late", "2024-03", "late"), (None, "2024-03", "missing")}


def test_empty_tables(spark):
    assert run(spark, [], []).count() == 0
    assert [r.orphan_kind for r in run(spark, [("a", "x", DAY, None)], []).collect()] == ["missing"]
    assert orphan_report(run(spark, [], [])).count() == 0


def test_hot_keys_are_salted_without_loss(spark, monkeypatch):
    rng = random.Random(1)
    refs = [(f"r{i}", "hot" if i % 3 == 0 else f"k{rng.randint(0, 300)}", DAY, None) for i in range(3000)]
    parents = [(f"k{i}", DAY + timedelta(days=i % 3 - 1), DAY if i % 7 == 0 else None) for i in range(250)] + [("hot", DAY + timedelta(days=2), None)]
    plain = {tuple(r) for r in run(spark, refs, parents).collect()}
    monkeypatch.setattr(joins, "HOT_ROWS", 100)
    assert {tuple(r) for r in run(spark, refs, parents).collect()} == plain
    assert sum(r[3] == "late" and int(r[2][1:]) % 3 == 0 for r in plain) == 1000
