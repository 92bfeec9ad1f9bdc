"""The queries over vectors use every row of their lists."""

import numpy as np
import pytest

from rankweave.operators import semantic as S
from rankweave.plans import maintenance_queries as Q


@pytest.fixture
def folder(spark, tmp_path):
    def make(rows):
        spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
        return str(tmp_path)

    return make


def axis(i, n=8):
    return [float(k == i) for k in range(n)]


def test_cqopo_clusters_all_vectors(spark, folder):
    rows = [(i, axis(0), 1) for i in range(40)] + [(40 + i, axis(1), 1) for i in range(50)] + [(100 + i, axis(1), 2) for i in range(3)]
    got = [tuple(r) for r in Q.xr_cqopo(spark, folder(rows)).collect()]
    assert got == [(1, 2, 1.0)]  # the second cluster of label 1 lies after its first forty vectors


def test_clusters_without_a_square_matrix():
    rng = np.random.default_rng(3)
    for n in (1, 7, 60):
        v = rng.normal(size=(n, 6))
        u = v / np.linalg.norm(v, axis=1, keepdims=True)
        free, want = [True] * n, []
        for i in range(n):
            if free[i]:
                free[i], group = False, [i]
                for j in range(i + 1, n):
                    if free[j] and max(float(u[j] @ u[k]) for k in group) >= 0.5:
                        free[j] = False
                        group.append(j)
                want.append(group)
        assert S.clusters(v, 0.5) == want
        assert S._central(u, 4) == int((u @ u.T).sum(axis=1).argmax())


def test_mipo_assigns_whole_lists(spark, folder):
    first, second = [axis(i) for i in range(8)], [axis((i + 5) % 8) for i in range(8)]
    rows = [(100 * k + i, v, 1) for k, l in enumerate((first, second)) for i, v in enumerate(l)]
    got = [tuple(r) for r in Q.xr_mipo(spark, folder(rows)).collect()]
    assert got == [(1, 1, 1.0, 0.0, 0.0)]  # the first five of each list share only two


def test_cqmipo_and_csmpo_take_all_lists(spark, folder):
    """Against loops over all lists of seven; the sample of three is XR5's."""
    rng = np.random.default_rng(5)
    rows = [(100 * k + i, axis(int(rng.integers(0, 8))), 1 + i % 3) for k in range(7) for i in range(12)]
    lists: dict = {}
    for vec_id, v, label in rows:
        lists.setdefault(label, {}).setdefault(vec_id // 100, []).append(v)
    sf = folder(rows)
    score = lambda a, b: S.semantic_overlap(a, b, 0.3)
    mean = {(i, j): np.mean([score(a, b) for a in lists[i].values() for b in lists[j].values()]) for i in lists for j in lists}
    got = {(r["label_i"], r["label_j"]): r["cqmipo"] for r in Q.xr_cqmipo(spark, sf).collect()}
    assert got == {k: pytest.approx(v, abs=1e-6) for k, v in mean.items()}
    sample = {(r["label_i"], r["label_j"]): r["cqmipo"] for r in Q.xr_cqmipo_sample(spark, sf).collect()}
    assert set(sample) == set(mean) and all(sample[i, j] == sample[j, i] for i, j in sample)
    for r in Q.xr_csmpo(spark, sf).collect():
        v = [score(a, b) for g, a in lists[r["label"]].items() if g % 2 == 0 for h, b in lists[r["label"]].items() if h % 2]
        assert (r["n_pairs"], r["csmpo_mean"], r["csmpo_var"], r["csmpo_std"]) == (12, pytest.approx(np.mean(v), abs=1e-6), pytest.approx(np.var(v), abs=1e-6), pytest.approx(np.std(v), abs=1e-6))


def test_cells_outside_the_filter_are_zero(spark):
    x, y = [1.0, 0.0], [0.0, 1.0]
    l = spark.createDataFrame([("p", 1, [x], "A"), ("p", 2, [y], "A"), ("q", 1, [x], "A"), ("r", 1, [x], "B")], f"g string, i int, v {S.VECTORS}, t string")
    got = {(r["g_i"], r["g_j"]): (r["n_pairs"], r["mean"]) for r in S.cross_overlap(l, "g", "i", "v", within="t").collect()}
    assert got == {("p", "p"): (4, 0.5), ("p", "q"): (2, 0.5), ("q", "p"): (2, 0.5), ("q", "q"): (1, 1.0), ("r", "r"): (1, 1.0), **{k: (0, 0.0) for k in (("p", "r"), ("r", "p"), ("q", "r"), ("r", "q"))}}
