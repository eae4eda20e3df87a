"""Whitening against dense eigenvectors, hard negatives against all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.llm import negatives, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, key long, n string, block int"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], label, i, "x", 1) for i, v, label in rows], SCHEMA).repartition(3)


def usable(rows, d):
    return [(i, v, label) for i, v, label in rows if v is not None and len(v) == d and all(x is not None and math.isfinite(x) for x in v)]


def drawn(n, d, seed=1, spread=None):
    x = np.random.default_rng(seed).standard_normal((n, d)) * (np.linspace(3, 1, d) if spread is None else spread)
    return [(i, v.astype(np.float32).tolist(), i % 4) for i, v in enumerate(x)]


ODD = [(9001, None, 1), (9002, [], 1), (9003, [1.0, 2.0], 1), (9004, [None] + [0.0] * 39, 2), (9005, [math.nan] * 40, 2), (9006, [math.inf] + [0.0] * 39, 2), (None, [0.25] * 40, 3), (5000, [0.5] * 40, 1), (5000, [0.5] * 40, 1)]


def dense(rows, d):
    x = np.floor(64 * np.array([v for _, v, _ in usable(rows, d)], dtype=np.float32).astype(float)).astype(np.int64)
    n, s = len(x), x.sum(axis=0)
    c = (n * x - s) / n
    values, vectors = np.linalg.eigh(c.T @ c / n)
    return x, n, s, c, values[::-1], vectors[:, ::-1]


@pytest.mark.parametrize(("d", "k", "guard"), [(40, 8, 6), (40, 32, 24), (40, 32, 4)])
def test_whitening_of_awkward_rows(spark, d, k, guard, monkeypatch):
    monkeypatch.setattr(whitening.components, "__defaults__", (k, guard, whitening.DEGREE, whitening.ROUNDS))
    rows = drawn(300, d) + ODD
    got = whitening.whiten(table(spark, rows), k=k).toPandas()
    x, n, s, c, values, vectors = dense(rows, d)
    assert list(got.columns) == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert len(got) == n * k and set(got["n"]) == {n} and got["identity_error"].iloc[0] < 1e-9
    own = [(i if i is not None else -1) for i, *_ in usable(rows, d)]
    by_id = {i: j for j, i in enumerate(own)}
    deviation = ((n * x - s) ** 2).sum(axis=1)
    white = c @ vectors[:, :k] / np.sqrt(values[:k])
    got["row"] = [by_id[-1 if math.isnan(v) else int(v)] for v in got["vec_id"]]
    assert (got["deviation"] == deviation[got["row"]]).all()
    for component, part in got.groupby("component"):
        want = white[part["row"], component - 1]
        sign = np.sign((want * part["whitened"]).sum())
        assert np.abs(sign * part["whitened"] - want).max() < 1e-8
        assert abs(part["explained"].iloc[0] - values[component - 1] / values.sum()) < 1e-12


def test_whitening_with_flat_directions_and_few_dimensions(spark):
    flat = [(i, [*v, 1.0, v[0] * 0], 0) for i, v, _ in drawn(50, 5)]
    got = whitening.whiten(table(spark, flat))
    assert sorted(r["component"] for r in got.select("component").distinct().collect()) == [1, 2, 3, 4, 5]
    assert got.first()["identity_error"] < 1e-9
    wide = np.random.default_rng(2).standard_normal((200, 4)) @ np.random.default_rng(3).standard_normal((4, 90))
    few = [(i, (np.round(v) * 64).tolist(), 0) for i, v in enumerate(wide @ np.eye(90))]
    assert whitening.whiten(table(spark, few)).select("component").distinct().count() == 32
    exact = [(i, [float((i * 7 + j) % 3) if j < 3 else 0.0 for j in range(80)], 0) for i in range(60)]
    got = whitening.whiten(table(spark, exact)).toPandas()
    assert got["component"].max() == 2 and got["identity_error"].iloc[0] < 1e-4


def test_whitening_without_spread(spark):
    assert whitening.whiten(table(spark, [])).count() == 0
    assert whitening.whiten(table(spark, [(1, [0.5, 0.5], 0)])).count() == 0
    assert whitening.whiten(table(spark, [(i, [0.5, 0.25], 0) for i in range(5)])).count() == 0


def brute(rows, d, every):
    rows = [(i, np.floor(256 * np.array(v, dtype=np.float32).astype(float)).astype(np.int64), label) for i, v, label in usable(rows, d) if i is not None and label is not None]
    out = []
    for i, v, label in rows:
        if i % every:
            continue
        scored = [(-int(v @ w), j, other) for j, w, other in rows]
        for ps, j, _ in sorted(t for t in scored if t[2] == label and t[1] != i)[:5]:
            window = sorted((s, k) for s, k, other in scored if other != label and 50 * -ps <= 100 * -s <= 95 * -ps)[:3]
            out += [(i, j, rank + 1, k, -ps, -s) for rank, (s, k) in enumerate(window)]
    return sorted(out)


COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


@pytest.mark.parametrize(("block", "group"), [(16, 3), (1024, 256)])
def test_hard_negatives_of_awkward_rows(spark, block, group):
    r = np.random.default_rng(4)
    middle = r.standard_normal((12, 40))
    rows = [(i, (middle[i % 12] + r.standard_normal(40) * 0.4).tolist(), None if i % 50 == 3 else i % 5) for i in range(400)]
    rows += [(1000 + i, rows[7][1], rows[7][2]) for i in range(60)] + [(1100 + i, [0.0] * 40, 1) for i in range(5)] + ODD
    got = negatives.mine(table(spark, rows), F.col("vec_id") % 10 == 0, block=block, group=group)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect())) == brute(rows, 40, 10)


def test_few_rows_and_none(spark):
    assert negatives.mine(table(spark, []), F.col("vec_id") % 10 == 0).count() == 0
    assert negatives.mine(table(spark, [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1)]), F.col("vec_id") == 0).count() == 0
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.9, 0.1], 2), (3, [0.7, 0.0], 2), (4, [-1.0, 0.0], 1)]
    assert sorted(map(tuple, negatives.mine(table(spark, rows), F.col("vec_id") == 0).collect())) == brute(rows, 2, 1_000)


def test_zone_maps_leave_blocks_unread(spark):
    r = np.random.default_rng(6)
    rows = [(i, (np.eye(20)[i % 20] + r.standard_normal(20) * 0.01).tolist(), i % 20) for i in range(2000)]
    held = negatives.Blocks(table(spark, rows), F.col("vec_id") % 10 == 0, "vec_id", "embedding", "label", block=64, group=16)
    pairs = held.groups.count() * held.blocks.count()
    assert held.reads().count() * 4 < pairs
