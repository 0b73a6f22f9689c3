"""Subspace pigeonhole join against all pairs."""

from __future__ import annotations

import numpy as np
import pytest

from emberfield.llm import subspace

SCHEMA = "vec_id long, embedding array<double>, label int, kept string, cls int, block int"


def all_pairs(rows, cosine=subspace.COSINE):
    """(vec_id, n_links, component_id, kept) of rows (vec_id, vector, label) with distinct ids."""
    ids = [r[0] for r in rows]
    x = np.array([r[1] for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    linked = (x @ x.T >= cosine) & (label[:, None] == label)
    np.fill_diagonal(linked, False)
    least = np.array(ids)
    while True:
        new = np.array([min([least[i], *least[linked[i]]]) for i in range(len(ids))])
        if (new == least).all():
            return {i: (int(n), int(c), i == int(c)) for i, n, c in zip(ids, linked.sum(1), least, strict=True)}
        least = new


def planted(seed, dimensions=24):
    """Structureless vectors, chains of near copies, one dense cluster with a third of the rows, one diffuse one."""
    draw = np.random.default_rng(seed)
    vectors = [draw.normal(size=dimensions) for _ in range(300)]
    for _ in range(20):
        v = draw.normal(size=dimensions)
        for _ in range(6):
            vectors.append(v)
            v = v + draw.normal(size=dimensions) * 0.3
    centre = draw.normal(size=dimensions)
    vectors += [centre + draw.normal(size=dimensions) * 0.08 for _ in range(250)]
    vectors += [centre + draw.normal(size=dimensions) * 0.35 for _ in range(150)]
    order = draw.permutation(len(vectors))
    return [(int(i) * 3 + 1, (vectors[i] * draw.uniform(0.1, 9)).tolist(), int(i) % 7 == 0) for i in order]


def found(spark, rows, **more):
    df = spark.createDataFrame([(i, v, int(x), "k", 1, 2) for i, v, x in rows], SCHEMA)
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in subspace.near_duplicates(df, **more).collect()}


@pytest.mark.parametrize(("seed", "cell", "tile"), [(0, 16, 40), (1, 4096, 4096)])
def test_equals_all_pairs(spark, monkeypatch, seed, cell, tile):
    monkeypatch.setattr(subspace, "CELL", cell)
    rows = planted(seed)
    assert found(spark, rows, tile=tile) == all_pairs(rows)


def test_without_bundles(spark, monkeypatch):
    monkeypatch.setattr(subspace, "DENSE", 10**9)
    monkeypatch.setattr(subspace, "CELL", 32)
    rows = planted(2)
    assert found(spark, rows, tile=64) == all_pairs(rows)


def test_driver_vectors(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in subspace.near_duplicates(df).collect()}
    assert got == all_pairs(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1), (6, [0.0, 0.0], 1),
        (7, [nan, 1.0], 1), (8, [inf, 1.0], 1), (9, [None, 1.0], 1), (10, [1.0], 1), (11, [5.0, 0.0], 1), (2, [1.0, 0.01], 1), (None, [1.0, 0.0], 1),
        (12, [], 1),
    ]
    df = spark.createDataFrame([(*r, "k", 1, 2) for r in rows], SCHEMA)
    got = sorted((tuple(r) for r in subspace.near_duplicates(df).collect()), key=repr)
    linked = {1: (3, 1, True), 2: (3, 1, False), 11: (3, 1, False)}
    want = [(i, *linked.get(i, (0, i, i is not None))) for i, _, _ in rows]
    assert got == sorted(want, key=repr)


def test_empty_table(spark):
    assert subspace.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
