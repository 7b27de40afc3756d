"""Embedding near-duplicates against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumatab.llm import embedding_dedup


def vectors(seed, n, dim):
    r = np.random.default_rng(seed)
    base = r.normal(size=(max(2, n // 4), dim))
    out = []
    for i in range(n):
        v = base[r.integers(len(base))] + r.normal(scale=r.choice([0.0, 0.05, 0.3, 0.45, 1.0]), size=dim)
        out.append((v * r.choice([1.0, 1e-3, 50.0])).astype(np.float32).tolist())
    return out


def brute(rows, threshold):
    good = [(k, np.array(v, np.float32).astype(float)) for k, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {k: set() for k in range(len(rows))}
    for a, x in good:
        for b, y in good:
            if a < b and len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= threshold:
                links[a].add(b)
                links[b].add(a)
    out = []
    for k, (vec_id, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        first = min(ids) if ids else None
        out.append((vec_id, len(links[k]), first, vec_id == first))
    return sorted(map(repr, out))


@pytest.mark.parametrize("seed, n, dim, settings", [(1, 300, 8, {}), (2, 300, 3, {"blocks": 9, "sample": 64, "products": 1500}), (3, 200, 16, {"block_bytes": 16 * 16 * 7, "max_cells": 9}), (4, 150, 2, {"threshold": 0.5, "blocks": 4, "products": 2000}), (5, 240, 5, {"blocks": 1}), (6, 200, 4, {"threshold": -1.0})])
def test_all_pairs(spark, seed, n, dim, settings):
    rows = list(enumerate(vectors(seed, n, dim)))
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4), **settings)
    assert sorted(map(repr, map(tuple, got.collect()))) == brute(rows, settings.get("threshold", 0.9))


def test_hard_rows(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v), (2, v), (2, v), (3, None), (4, []), (5, [0.0, 0.0, 0.0]), (6, [1.0, None, 2.0]), (7, [float("nan"), 1.0, 1.0]), (8, [float("inf"), 1.0, 1.0]), (9, [1.0, 2.0]), (10, [1.0, 2.0, 3.0, 0.0]), (None, [2.0, 4.0, 6.0]), (11, [1e-30, 2e-30, 3e-30]), (12, [-1.0, -2.0, -3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("cid", F.lit(1)).withColumn("n_links", F.lit("x"))
    assert sorted(map(repr, map(tuple, embedding_dedup.near_duplicates(df).collect()))) == brute(rows, 0.9)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0
    wide = spark.createDataFrame([(i, [float(i % 2), 1.0]) for i in range(6)], "vec_id int, embedding array<double>")
    assert embedding_dedup.near_duplicates(wide).where("kept").count() == 2


def test_large_group_of_copies(spark):
    r = random.Random(0)
    rows = [(i, [1.0, 0.0, 0.1 * (i % 3 == 0)]) for i in range(400)] + [(1000 + i, [r.gauss(0, 1), r.gauss(0, 1), r.gauss(0, 1)]) for i in range(40)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), blocks=12)
    assert got.where("vec_id < 1000 AND (n_links < 399 OR component_id <> 0)").count() == 0
    assert sorted(map(repr, map(tuple, got.collect()))) == brute(rows, 0.9)


def test_margin_bound():
    """No pair that is close enough lies across a border that one of them is too far from."""
    r = np.random.default_rng(5)
    x = embedding_dedup.unit(r.normal(size=(400, 6)))
    centres = embedding_dedup.fit(x, 12)
    cell = (x @ centres.T).argmax(axis=1)
    far = embedding_dedup.margins(x, cell, centres)
    for t in (0.9, 0.6):
        reach = np.sqrt(2 - 2 * t) + 1e-9
        a, b = np.nonzero(x @ x.T >= t)
        assert (far[a, cell[b]][cell[a] != cell[b]] <= reach).all()


def test_each_pair_of_blocks_meets_once():
    for g in range(1, 9):
        p = embedding_dedup.Plan(np.eye(g), np.ones(g, np.int64))
        p.pack(1)
        visits = p.visited(np.arange(g))
        assert (visits.astype(int) + visits.T == 1 - np.eye(g)).all()
        assert g % 2 == 0 or len(set(visits.sum(axis=1))) == 1


def test_lengths_mix(spark):
    """Vectors of several lengths in one table, near copies at a third of the rows."""
    rows = [(i, v) for i, v in enumerate(vectors(7, 90, 3) + vectors(8, 90, 5) + vectors(9, 3, 2))]
    rows += [(1000 + i, [1.0, 0.2, 0.001 * i]) for i in range(90)]
    for settings in ({}, {"blocks": 4, "products": 3000}, {"block_bytes": 16 * 3 * 8}):
        got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5), **settings)
        assert sorted(map(repr, map(tuple, got.collect()))) == brute(rows, 0.9)
