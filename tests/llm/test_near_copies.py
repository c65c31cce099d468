import itertools
import random
import re

import numpy as np
import pandas as pd

from glossmill.llm import near_copies as nc
from glossmill.llm.lookalikes import records


def similarity(a, b):
    x, y = (re.sub(r"\s+", "", t) for t in (a, b))
    x, y = ({t[i : i + 3] for i in range(max(1, len(t) - 2))} for t in (x, y))
    return len(x & y) / len(x | y)


def corpus(n=220, seed=3):
    rng = random.Random(seed)
    texts = []
    for i in range(n):
        if texts and rng.random() < 0.6:
            t = list(rng.choice(texts))
            for _ in range(rng.randint(0, 6)):
                t[rng.randrange(len(t))] = chr(rng.randint(0x4E00, 0x4E80))
            texts.append("".join(t))
        else:
            texts.append("".join(chr(rng.randint(0x4E00, 0x4E80)) for _ in range(rng.randint(30, 120))))
    return [(f"{i:04d}", t) for i, t in enumerate(texts)]


def test_pairs_against_brute_force(spark):
    rows = corpus() + [("z1", "甲乙"), ("z2", "甲 乙"), ("z3", "乙甲"), ("z4", None), (None, "甲乙"), ("z5", ""), ("z6", " "), ("z1", "甲乙")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "id string, text string, value_id string")
    got = {(r.id_a, r.id_b) for r in nc.near_copy_pairs(records(df, "f", "id", "text"), ["f"]).collect()}
    known = sorted({(i, t) for i, t in rows if i and t is not None})
    want = {(a, b) for (a, x), (b, y) in itertools.combinations(known, 2) if similarity(x, y) >= 0.7}
    assert got == want and ("z1", "z2") in got and ("z5", "z6") in got and ("z1", "z3") not in got


def test_minimum_hashes_of_texts_of_any_length():
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcd𢌱") for _ in range(n)) for n in (0, 1, 2, 3, 4, 700, 5, 3000, 40, 1024, 1026, 1)]
    alone = np.stack([nc.minimum_hashes([t])[0] for t in texts])
    assert (nc.minimum_hashes(texts) == alone).all()
    assert (nc.minimum_hashes(["abcabcabc"]) == nc.minimum_hashes(["abcabc"])).all() and (nc.minimum_hashes(["abc"]) != nc.minimum_hashes(["abd"])).any()


def test_sliced_distances_are_exact():
    rng = np.random.default_rng(1)
    sizes = np.array([90, 40, 7, 3, 2, 2])
    n = int(sizes.sum())
    base = rng.integers(0, 2**63, (n // 4 + 1, 2), dtype=np.int64)
    sketch = base[rng.integers(0, len(base), n)] ^ (rng.integers(0, 2**63, (n, 2)) & rng.integers(0, 2**63, (n, 2)) & rng.integers(0, 2**63, (n, 2)))
    group = np.repeat(np.arange(len(sizes)), sizes)
    i, j = nc.sliced_pairs(sketch, sizes)
    far = np.bitwise_count((sketch[:, None] ^ sketch[None]).view(np.uint64)).sum(axis=2)
    want = {(a, b) for a in range(n) for b in range(a + 1, n) if group[a] == group[b] and far[a, b] <= nc.RADIUS}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want and len(i) == len(want)


def test_large_buckets_are_cut_without_loss(spark, monkeypatch):
    rows = corpus(160, 5)
    items = records(spark.createDataFrame(rows, "id string, text string"), "f", "id", "text")
    whole = {tuple(r) for r in nc.near_copy_pairs(items, ["f"]).collect()}
    monkeypatch.setattr(nc, "CHUNK", 2)
    monkeypatch.setattr("glossmill.llm.pairing.CHUNK", 2)
    assert {tuple(r) for r in nc.near_copy_pairs(items, ["f"]).collect()} == whole


def test_a_bucket_that_spans_batches_is_handed_on_whole():
    rng = np.random.default_rng(2)
    rows = pd.DataFrame({"key": np.repeat([1, 2, 3, 4], [2, 25, 3, 9]), "value_id": np.arange(39), "s0": rng.integers(0, 9, 39), "s1": 0})
    for size in (1, 4, 7, 39):
        out = pd.concat(nc._buckets(8)(iter([rows.iloc[k : k + size].reset_index(drop=True) for k in range(0, 39, size)])))
        held, pairs = out[out["held"]], out[~out["held"]]
        assert sorted(held["a"]) == [*range(2, 27), *range(30, 39)]
        assert len(pairs) == 1 + 3 and pairs["a"].isin([0, 27, 28]).all()


def test_groups(spark):
    chain = "".join(chr(0x4E00 + i) for i in range(200))
    rows = [("a", chain[0:100]), ("b", chain[8:108]), ("c", chain[16:116]), ("d", chain[0:100]), ("e", "另一篇完全不同的文字"), ("f", None)]
    items = records(spark.createDataFrame(rows, "id string, text string"), "f", "id", "text")
    got = {r.item_id: (r.group_id, r.n_links) for r in nc.near_copy_groups(items, ["f"]).collect()}
    pairs = [(x, y) for x, y in (("a", "b"), ("b", "c"), ("a", "c")) if similarity(dict(rows)[x], dict(rows)[y]) >= 0.7]
    assert pairs and got["a"][0] == got["b"][0] == got["c"][0] == got["d"][0] == "a"
    assert got["a"][1] == got["d"][1] == sum("a" in p for p in pairs) and got["e"] == ("e", 0)


def test_empty_table(spark):
    items = records(spark.createDataFrame([], "id string, text string"), "f", "id", "text")
    assert nc.near_copy_pairs(items, ["f"]).count() == 0
