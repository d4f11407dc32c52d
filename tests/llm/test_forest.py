"""The projection forest against all pairs."""

import numpy as np
import pytest

from gaugework.llm import forest

VECTORS = "vec_id long, embedding array<double>, label int, note string, copies int"


def planted(seed, labels=3, noise=240, dim=16):
    """Vectors without neighbours, small groups, and one tight group of a third of all."""
    draw = np.random.default_rng(seed)
    rows = []
    for label in range(labels):
        own = [draw.standard_normal(dim) for _ in range(noise)]
        for _ in range(30):
            centre = draw.standard_normal(dim)
            own += [centre + draw.standard_normal(dim) * 0.12 for _ in range(int(draw.integers(2, 5)))]
        if label == 0:
            centre = draw.standard_normal(dim)
            own += [centre + draw.standard_normal(dim) * 0.1 for _ in range(400)]
        rows += [(v.tolist(), label) for v in own]
    return [(i, v, label, "x", 1) for i, (v, label) in enumerate(rows)]


def plain(rows, least=0.93):
    """(links, component) of each row, by comparing all."""
    links, near = [0] * len(rows), list(range(len(rows)))

    def root(i):
        while near[i] != i:
            i = near[i]
        return i

    def fine(v):
        return bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    units = [np.array(v) / np.linalg.norm(v) if fine(v) else None for _, v, *_ in rows]
    for i, a in enumerate(rows):
        for j in range(i):
            b = rows[j]
            told = a[2] is not None and a[2] == b[2] and units[i] is not None and units[j] is not None
            if told and len(units[i]) == len(units[j]) and units[i] @ units[j] >= least:
                links[i] += 1
                links[j] += 1
                near[root(i)] = root(j)
    names = {}
    for i, (name, *_) in enumerate(rows):
        if name is not None:
            names[root(i)] = min(name, names.get(root(i), name))
    return links, [names.get(root(i)) for i in range(len(rows))]


def shown(df):
    return sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in df.collect())


def wanted(rows):
    links, component = plain(rows)
    return sorted((str(r[0]), n, str(c), r[0] is not None and r[0] == c) for r, n, c in zip(rows, links, component, strict=True))


@pytest.mark.parametrize("how", [{}, {"leaf": 40, "shard": 150, "block": 60}])
def test_links_are_those_of_all_pairs(spark, how):
    rows = planted(1)
    assert shown(forest.near_duplicates(spark.createDataFrame(rows, VECTORS), **how)) == wanted(rows)


def test_recall_of_a_group_that_must_be_split(spark):
    """Chains of neighbours that no leaf holds whole: nothing wrong, and nine links in ten at least."""
    draw = np.random.default_rng(2)
    walk = np.cumsum(draw.standard_normal((1500, 12)) * 0.16, axis=0) + 1
    rows = [(i, v.tolist(), 1, None, None) for i, v in enumerate(walk)]
    links, component = plain(rows)
    found = forest.near_duplicates(spark.createDataFrame(rows, VECTORS), leaf=64, shard=500, block=50).collect()
    got = {r["vec_id"]: r["n_links"] for r in found}
    assert all(got[i] <= n for i, n in enumerate(links))
    assert sum(got.values()) >= 0.9 * sum(links) > 10_000


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0], 1, None, 7),
        (1, [1.0, -0.0], 1, "b", None),
        (1, [1.0, 0.0], 1, "b", None),
        (2, [2.0, 0.1], 1, None, None),
        (3, [1.0, 0.0], 2, None, None),
        (4, [1.0, 0.0], None, None, None),
        (5, None, 1, None, None),
        (6, [], 1, None, None),
        (7, [0.0, 0.0], 1, None, None),
        (8, [nan, 1.0], 1, None, None),
        (9, [1.0, None], 1, None, None),
        (10, [inf, 1.0], 1, None, None),
        (11, [1.0, 0.0, 0.0], 1, None, None),
        (None, [1.0, 0.0], 1, None, None),
        (None, [0.0, 1.0], 1, None, None),
        (12, [1e200, 1e198], 1, None, None),
        (13, [1e-200, 1e-201], 1, None, None),
    ]
    made = forest.near_duplicates(spark.createDataFrame(rows, VECTORS))
    assert made.columns == ["vec_id", "n_links", "component_id", "kept"]
    scaled = [(i, [x * 1e-200 for x in v] if i == 12 else [x * 1e200 for x in v] if i == 13 else v, *r) for i, v, *r in rows]
    assert shown(made) == wanted(scaled)
    assert forest.near_duplicates(spark.createDataFrame([], VECTORS)).collect() == []


def test_trees_shrink_even_without_spread():
    """Vectors that all project alike are still halved, by their ids."""
    units = np.tile([1.0, 0.0], (100, 1))
    leaves = list(forest.leaves_of(units, np.arange(100), (1,), 10, 0.05, 2.0))
    assert max(map(len, leaves)) <= 10 and set(np.concatenate(leaves).tolist()) == set(range(100))
