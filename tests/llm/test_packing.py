from collections import defaultdict

import numpy as np
import pytest

from glossmill.llm.packing import Index, content_keys, pack, pack_shard, pivot_table
from glossmill.llm.tokens import with_size


def whole(boxes, sizes, capacity):
    parts = defaultdict(list)
    for box in boxes:
        assert sum(n for _, _, n in box) <= capacity
        for i, at, n in box:
            parts[i].append((at, n))
    for i, size in enumerate(sizes):
        spans = sorted(parts[i])
        assert spans[0][0] == 0 and sum(n for _, n in spans) == size
        assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False))
        assert len(spans) == 1 or size > capacity


def test_every_document_once_and_little_space_unused():
    rng = np.random.default_rng(4)
    sizes = np.concatenate([rng.integers(1, 400, 400), rng.integers(400, 3000, 60), [0, 512, 1024, 513]])
    terms = [np.unique(rng.integers(0, 300, max(1, min(40, s)))) for s in sizes]
    index = Index(terms, [np.ones(len(t), np.int64) for t in terms], sizes)
    for capacity in (512, 2048, 1):
        boxes = pack_shard(index, sizes, capacity)
        whole(boxes, sizes, capacity)
        if capacity > 1:
            assert sizes.sum() >= 0.97 * (len(boxes) - 1) * capacity


def test_neighbours_share_terms():
    terms = [np.array([i % 5, 10 + i % 5]) for i in range(40)]
    sizes = np.full(40, 10)
    index = Index(terms, [np.ones(2, np.int64)] * 40, sizes)
    for box in pack_shard(index, sizes, 40):
        assert len({i % 5 for i, _, _ in box}) == 1


def test_documents_of_one_topic_follow_each_other():
    rng = np.random.default_rng(6)
    topic = rng.integers(0, 6, 600)
    terms = [np.unique(np.concatenate([100 * t + rng.integers(0, 100, 30), 900 + rng.integers(0, 90, 10)])).astype(np.int32) for t in topic]
    df = np.bincount(np.concatenate(terms), minlength=1000)
    tfs, weights = [np.ones(len(t), np.int32) for t in terms], np.log(1 + 600 / np.maximum(1, df)).astype(np.float32)
    keys = content_keys(terms, tfs, weights, pivot_table(terms[:40], tfs[:40], weights))
    ordered = topic[np.argsort(keys, kind="stable")]
    assert (ordered[1:] == ordered[:-1]).mean() > 0.8


def test_shards_of_a_stream_hold_every_document(spark):
    rows = [(i, f"{'红花绿叶' if i % 2 else 'tea and ginger'} {i} " * (1 + i % 7)) for i in range(5200)]
    got = pack(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", [("k", 256)])
    per = got.groupBy("doc_id").count().collect()
    assert len(per) == 5200 and got.selectExpr("max(likeness) > 0.2 as a").first().a
    assert got.groupBy("container_id").sum("n_tokens").selectExpr("max(`sum(n_tokens)`) as m").first().m <= 256
    assert got.select("container_id").distinct().filter("container_id like '%.0-%'").count() > 0


def test_table(spark):
    rows = [(i, f"文字{i} text number {i} " * (1 + i % 40)) for i in range(300)] + [(0, "文字0 text number 0 "), (500, None), (None, "x"), (501, ""), (502, "长" * 20_000)]
    df = spark.createDataFrame([(i, t, 1, "s") for i, t in rows], "doc_id long, text string, n_tokens int, shard string")
    got = pack(df, "doc_id", "text", [("short", 128), ("long", 1024)]).collect()
    sizes = {r.doc_id: r.n_tokens for r in with_size(df.filter("doc_id is not null and text is not null").select("doc_id", "text").dropDuplicates(["doc_id"]), "text").collect()}
    for kind, capacity in (("short", 128), ("long", 1024)):
        mine = [r for r in got if r.container_kind == kind]
        fill, size, places = defaultdict(int), defaultdict(int), defaultdict(set)
        for r in mine:
            fill[r.container_id] += r.n_tokens
            size[r.doc_id] += r.n_tokens
            assert r.position not in places[r.container_id]
            places[r.container_id].add(r.position)
        assert max(fill.values()) <= capacity and dict(size) == sizes
        assert sum(fill.values()) >= 0.9 * (len(fill) - 1) * capacity
    assert pack(df.limit(0), "doc_id", "text", [("a", 5)]).count() == 0
    with pytest.raises(ValueError):
        pack(df, "doc_id", "text", [("a", 0)])
