import numpy as np

from glossmill.llm import neighbours as nb
from glossmill.llm.neighbours import hilbert_keys, nearest


def test_hilbert_curve_visits_every_cell_by_single_steps():
    for dims, bits in ((2, 4), (3, 2)):
        side = 1 << bits
        cells = np.array(np.meshgrid(*[np.arange(side)] * dims)).reshape(dims, -1).T
        keys = hilbert_keys(cells, bits)
        assert sorted(keys.tolist()) == list(range(side**dims))
        walk = cells[np.argsort(keys)]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def brute(ids, x, k, least):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    c = x @ x.T
    out = {}
    for i, a in enumerate(ids):
        near = sorted((-round(c[i, j], 9), ids[j]) for j in range(len(ids)) if j != i)
        out[a] = [b for s, b in near[:k] if -s >= least - 1e-9]
    return out


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(300, 16))
    x = centres[rng.integers(0, 300, 1500)] + 0.25 * rng.normal(size=(1500, 16))
    ids = [f"{i:05d}" for i in range(len(x))]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "uid string, v array<float>")
    got = {(r.unit_id, r.neighbour_id) for r in nearest(df, "uid", "v", 5, 0.85, window=64).collect()}
    want = {(a, b) for a, near in brute(ids, x.astype(np.float32).astype(float), 5, 0.85).items() for b in near}
    assert len(got & want) >= 0.95 * len(want) and len(got - want) <= 0.02 * len(want)


def test_dirt_ties_and_copies(spark):
    rows = [(f"c{i}", [1.0, 0.0]) for i in range(9)] + [("c0", [1.0, 0.0]), ("n", None), ("z", [0.0, 0.0]), (None, [1.0, 0.0]), ("nan", [float("nan"), 1.0]), ("hole", [None, 1.0]), ("e", []), ("q", [1.0, 0.1]), ("o", [0.0, 1.0]), ("w", [1.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "uid string, v array<double>, cid string")
    near = {}
    for r in nearest(df, "uid", "v", 3, 0.85).collect():
        near.setdefault(r.unit_id, []).append(r.neighbour_id)
    assert sorted(near["c0"]) == ["c1", "c2", "c3"] and sorted(near["c8"]) == ["c0", "c1", "c2"]
    assert sorted(near["q"]) == ["c0", "c1", "c2"] and not {"n", "z", "nan", "hole", "e", "o", "w"} & set(near)
    assert nearest(df.limit(0), "uid", "v").count() == 0


def test_group_of_near_copies_far_larger_than_the_window(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 16))
    x[:1000] = x[0] / np.linalg.norm(x[0]) + 0.02 * rng.normal(size=(1000, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "uid int, v array<float>")
    unit = x.astype(np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    cosine = unit @ unit.T
    np.fill_diagonal(cosine, -9)
    top = np.argsort(-cosine, axis=1)[:, :5]
    for least in (0.85, -2.0):
        want = {(i, int(j)) for i in range(len(x)) for j in top[i] if cosine[i, j] >= least}
        got = {(r.unit_id, r.neighbour_id) for r in nearest(df, "uid", "v", 5, least, window=128).collect()}
        hot = {p for p in want if p[0] < 1000}
        assert len(got & want) >= 0.9 * len(want) and len(got & hot) >= 0.9 * len(hot)
    # A window over all rows finds all but ties within the rounding of codes.
    got = {(r.unit_id, r.neighbour_id) for r in nearest(df, "uid", "v", 5).collect()}
    assert len(got & want) >= 0.995 * len(want) and len(got) == len(want)


def test_rows_at_the_edges_of_partitions_meet(spark):
    """One order of points on a line, of which every partition holds a piece: neighbours across the edges are found by the stitching alone."""
    x = np.arange(400) * 0.003
    rows = [(i, 0, int(i), np.array([np.cos(a), np.sin(a)])) for i, a in enumerate(x)]
    df = spark.createDataFrame([(2, o, k, i, bytes(nb.coded(v[None])[0])) for i, o, k, v in rows], "width int, ord int, key long, cid long, code binary")
    passed = df.repartitionByRange(5, "key").sortWithinPartitions("key").mapInPandas(nb._windows(2, -2.0, 8), nb._PASSED).cache()
    assert passed.filter("edge = -1 and side = -1").count() == 400 and passed.filter("block >= 0").select("block").distinct().count() >= 50
    met = passed.filter("edge >= 0").groupBy("edge").applyInPandas(nb._stitched(2, -2.0), nb._LIST)
    lists = nb._merge(passed.filter("edge = -1 and side = -1").select("cid", "near", "cosine").unionByName(met), 2).collect()
    assert {r.cid: set(r.near) for r in lists} == {i: {i - 1, i + 1} if 0 < i < 399 else ({1, 2} if i == 0 else {397, 398}) for i in range(400)}


def test_best_columns():
    rng = np.random.default_rng(1)
    for m in (3, 16, 500, 1003):
        score = rng.normal(size=(7, m))
        for k in (1, 5):
            want = -np.sort(-score, axis=1)[:, :k]
            assert np.allclose(-np.sort(-np.take_along_axis(score, nb.best_columns(score, k), 1), axis=1), want)
