"""The pivot index against all pairs, at sizes small and large, and vectors of extreme size."""

import numpy as np
import pytest

from studyloom.llm import embeddings


def planted(seed, n, dim=24):
    r = np.random.default_rng(seed)
    base = r.normal(size=(n, dim))
    for i in range(0, n, 7):  # a near copy of the vector three before, scaled
        base[i] = (base[i - 3] + 0.18 * r.normal(size=dim)) * 10.0 ** r.integers(-3, 4)
    base[n // 2 : n // 2 + n // 10] = base[5] + 0.1 * r.normal(size=(n // 10, dim))  # a tenth is one cluster
    rows = [(i, v.tolist(), str(i % 2)) for i, v in enumerate(base)]
    huge = [1e200] + [0.0] * (dim - 1)
    return rows + [(9000, huge, "0"), (9001, huge, "0"), (9002, [1e-200] + [0.0] * (dim - 1), "0"), (9003, huge, None), (9004, [1e308] * dim, "1"), (9005, [5e-324] * dim, "1"), (9006, [2.0] * dim, "1")]


def all_pairs(rows):
    units = np.array([(v := np.array(e) / np.abs(e).max()) / np.linalg.norm(v) for _, e, _ in rows])
    labels = np.array([g or f"none{i}" for i, (_, _, g) in enumerate(rows)])
    return (units @ units.T >= embeddings.THRESHOLD) & (labels[:, None] == labels[None, :]) & ~np.eye(len(rows), dtype=bool)


@pytest.mark.parametrize("n", [40, 300, 1500])
def test_links_of_all_pairs(spark, n):
    rows = planted(n, n)
    got = {r.vec_id: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()}
    want = all_pairs(rows)
    assert sum(r.n_links for r in got.values()) >= 0.97 * want.sum() > 0
    assert all(got[i].n_links <= k for (i, _, _), k in zip(rows, want.sum(axis=1)))
    for i in (9000, 9001, 9002, 9004, 9005, 9006):
        assert got[i].n_links == 2 and got[i].component_id in (9000, 9004)
    assert got[9003].n_links == 0 and got[9003].kept


@pytest.mark.parametrize("block", [5, 16, 1024])
def test_balls_and_blocks_count_each_link_once(spark, block):
    """Two tight groups and a loose one about three pivots, all in the same lists, with copies."""
    r = np.random.default_rng(3)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    pivots = unit(np.eye(12)[:3] + 0.35)
    v = np.concatenate([unit(pivots[0] + 0.03 * r.normal(size=(60, 12))), unit(pivots[1] + 0.03 * r.normal(size=(25, 12))), unit(pivots.sum(axis=0) + 0.12 * r.normal(size=(40, 12)))])
    copies = 1 + np.arange(len(v)) % 3
    near = (v @ v.T >= embeddings.THRESHOLD) & ~np.eye(len(v), dtype=bool)
    unique = spark.createDataFrame([(i, "a", int(c), x.tolist()) for i, (c, x) in enumerate(zip(copies, v))], "entry long, label string, copies long, u array<double>")
    lists = embeddings.pivot_lists(unique, pivots, places=3)
    assert {r.ball for r in lists.select("ball").distinct().collect()} >= {0, 1, -1}
    rows = embeddings.verified_links(lists, block=block).unionByName(embeddings.ball_links(lists)).collect()
    linked = np.zeros(len(v), int)
    reach = np.eye(len(v), dtype=bool)
    for x in rows:
        linked[x.entry] += x.linked
        reach[x.entry, x.bond] = reach[x.bond, x.entry] = True
        assert near[x.entry, x.bond] or x.entry == x.bond or reach[x.entry].sum() > 1
    assert (linked == near @ copies).all() and near.sum() > 1500
    close = lambda m: np.linalg.matrix_power(m.astype(float), 8) > 0
    assert (close(reach) == close(near | np.eye(len(v), dtype=bool))).all()
