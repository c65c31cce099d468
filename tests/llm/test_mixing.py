from collections import defaultdict

from glossmill.llm.mixing import mixture, shares, sized


def test_shares_and_repeats(spark):
    rows = [(i, "word " * (20 + i % 50), ("big", "mid", "tiny")[0 if i % 10 < 7 else 1 if i % 10 < 9 else 2]) for i in range(3000)]
    rows += [(0, "word " * 20, "big"), (9001, None, "big"), (None, "x", "big"), (9002, "x", None), (9003, "", "mid"), (9004, "x", "untargeted")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, n_tokens int")
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.2, 2), ("tiny", 0.2, 4), ("absent", 0.1, 3), ("none", 0.0, 1), (None, 0.3, 1)], "source string, target_share double, max_repeats int")
    s = sized(docs, targets, "doc_id", "text", "source")
    got = mixture(s).collect()
    used, copies = defaultdict(int), defaultdict(int)
    for r in got:
        used[r.source] += r.n_tokens
        copies[r.doc_id] = max(copies[r.doc_id], r.copy_no)
    total = sum(used.values())
    for source, share in (("big", 0.5), ("mid", 0.2), ("tiny", 0.2)):
        assert abs(used[source] / total - share / 0.9) < 0.01, (source, used[source] / total)
    most = {"big": 1, "mid": 2, "tiny": 4}
    assert all(r.copy_no <= most[r.source] for r in got) and len(got) == len({(r.doc_id, r.copy_no) for r in got})
    report = {r.source: r for r in shares(targets.filter("source is not null"), s, mixture(s)).collect()}
    assert report["absent"].actual_share == 0 and 2 <= report["tiny"].most_copies <= 4 and abs(sum(r.actual_share for r in report.values()) - 1) < 1e-9


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    assert mixture(sized(docs, targets, "doc_id", "text", "source")).count() == 0
