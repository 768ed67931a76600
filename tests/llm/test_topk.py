from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledger_mart.llm import topk


def brute(rows, k, is_query):
    own = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    width = max((len(v) for _, v in own), default=0)
    own = [(i, v + [0] * (width - len(v))) for i, v in own]
    found = []
    for row, (q, x) in enumerate(own):
        if is_query(q):
            scored = sorted((-sum(a * b for a, b in zip(x, v)), i) for other, (i, v) in enumerate(own) if other != row)
            found += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(found)


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 7)
    monkeypatch.setattr(topk, "SHARD_VALUES", 150)
    monkeypatch.setattr(topk, "LOT_QUERIES", 8)
    monkeypatch.setattr(topk, "AT_ONCE", 3)
    monkeypatch.setattr(topk, "MOST_BOUNDS", 0 if seed == 2 else 1 << 22)
    rng = random.Random(seed)
    rows = [(i, [round(rng.gauss(0, 1), 2 if i % 3 else 0) for _ in range(6)]) for i in range(150)]
    rows += [(200, None), (205, []), (210, [1.0, None, 2.0]), (215, [float("nan")] * 6), (220, [float("inf")] * 6), (None, [1.0] * 6)]
    rows += [(230, [0.5, 0.5]), (5, rows[5][1]), (10, [9.0] * 6), (10, [8.5] * 6)] + [(300 + i, [0.25] * 6) for i in range(30)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x")).withColumn("shard", F.lit(1))
    got = sorted(tuple(r) for r in topk.top_k(frame, F.col("vec_id") % 5 == 0, k=5).collect())
    assert got == brute(rows, 5, lambda i: i % 5 == 0)


def test_fewer_candidates_than_k_and_none(spark):
    frame = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(frame, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 256 * 512)]
    assert topk.top_k(frame.where("false"), F.col("vec_id") == 0).collect() == []
    assert topk.top_k(frame.where("vec_id = 0"), F.col("vec_id") == 0).collect() == []


def test_copies_fill_blocks():
    rng = np.random.default_rng(0)
    x = np.repeat(rng.integers(-99, 99, (20, 8)), topk.BLOCK_ROWS, axis=0).astype(float)
    ids = np.arange(len(x))

    best, held = topk.best_of_shard(ids[:1], x[:1], ids, x, 3)
    want = np.argsort(-(x[1:] @ x[0]), kind="stable")[:3] + 1
    assert held.tolist() == [want.tolist()]


def test_queries_go_only_where_they_may_find_something(spark, monkeypatch):
    """Clusters of neighbouring ids, many shards and lots: what is shuffled stays far below all of either side for each part of the other."""
    monkeypatch.setattr(topk, "SHARD_VALUES", 128 * 8)
    monkeypatch.setattr(topk, "LOT_QUERIES", 64)
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 3, (40, 8))
    rows = [(i, (centres[i // 128] + rng.normal(0, 0.05, 8)).tolist()) for i in range(40 * 128)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    sizes = {}
    real = topk.written

    def counted(df, name):
        out = real(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(topk, "written", counted)
    got = sorted(tuple(r) for r in topk.top_k(frame, F.col("vec_id") % 4 == 0, k=5).collect())
    x = np.floor(256 * np.array([v for _, v in rows]))
    score = x[::4] @ x.T
    score[np.arange(len(score)), np.arange(0, len(x), 4)] = -np.inf
    order = np.lexsort((np.broadcast_to(np.arange(len(x)), score.shape), -score), axis=-1)[:, :5]
    assert got == sorted((4 * q, n + 1, int(i), int(score[q, i])) for q in range(len(score)) for n, i in enumerate(order[q]))
    queries, shards, lots = 10 * 128, 40, 20
    assert sizes["asked"] < 0.3 * queries * shards and sizes["tiles"] < 0.5 * shards * lots
