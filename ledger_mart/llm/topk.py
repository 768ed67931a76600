"""Exact top-k inner products by block-at-a-time pruning.

Candidates are numbered along their ids; blocks and shards are ranges of numbers. A range's greatest and least value
of each component bound what any of its vectors can score against a query. A first pass, over the rows
as they lie, gives each query a k-th score to beat, from the candidates of its own batch, and sends it to those shards only whose
bound reaches it. There each query visits the shard's blocks by falling bound and scores whole blocks from their
rows, until the bounds fall below its k-th score; a bound equal to it is still visited, as ties go to smaller ids.

Spark deals shards times lots of queries over the tasks, and merges the k best of each shard. A shard's rows go to the lots only
that have a query for it. Neither side is ever broadcast or gathered; the shards' bounds are sent while they are few.

Defined results: vectors that are null, empty or hold null or non-finite components take no part, nor
do rows without id; rows that share an id are candidates and queries of their own, each for all rows but itself;
shorter vectors count as filled up with zeros; an empty table gives no rows; other
columns of the input are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledger_mart.llm.common import joined, ranked, small, written

BLOCK_ROWS = 128
SHARD_VALUES = 1 << 21
LOT_QUERIES = 1 << 16
AT_ONCE = 2048  # queries of a lot
MOST_BOUNDS = 1 << 22  # values of the shards' bounds; beyond, every query goes to every shard
SCALE = 256


def matrix(vectors: list, width: int) -> np.ndarray:
    """Quantised vectors, filled up with zeros."""
    out = np.zeros((len(vectors), width))
    for i, x in enumerate(vectors):
        out[i, : len(x)] = x
    return np.floor(SCALE * out)


def bounds(q: np.ndarray, most: np.ndarray, least: np.ndarray) -> np.ndarray:
    """What no vector between ``least`` and ``most`` can score more than, for each query and each pair of them."""
    return np.maximum(q, 0) @ most.T + np.minimum(q, 0) @ least.T


def best_of_shard(
    q_rows: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, rows: np.ndarray | None = None, floor: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids of each query's k best of the shard; -inf where there are fewer. ``rows`` number the candidates (their ids if
    None), one with a query's own number is not its candidate; scores below a query's ``floor`` may be left out."""
    rows = ids if rows is None else rows
    starts = np.arange(0, len(ids), BLOCK_ROWS)
    ends = np.r_[starts[1:], len(ids)]
    bound = bounds(q, np.maximum.reduceat(x, starts), np.minimum.reduceat(x, starts))
    order = np.argsort(-bound, axis=1, kind="stable")
    best = np.full((len(q), k), -np.inf)
    held = np.full((len(q), k), np.iinfo(np.int64).max)
    floor = np.full(len(q), -np.inf) if floor is None else floor
    waiting = np.arange(len(q))
    for turn in range(len(starts)):
        at = order[waiting, turn]
        going = bound[waiting, at] >= np.maximum(best[waiting, -1], floor[waiting])
        waiting, at = waiting[going], at[going]
        if not len(waiting):
            break
        by_block = np.argsort(at, kind="stable")
        for some in np.split(by_block, np.flatnonzero(np.diff(at[by_block])) + 1):
            a, z = starts[at[some[0]]], ends[at[some[0]]]
            who = waiting[some]
            score = q[who] @ x[a:z].T
            score[q_rows[who][:, None] == rows[a:z]] = -np.inf
            hit = score.max(axis=1) >= np.maximum(best[who, -1], floor[who])
            who, score = who[hit], score[hit]
            if len(who):
                all_scores = np.hstack([best[who], score])
                all_ids = np.hstack([held[who], np.broadcast_to(ids[a:z], score.shape)])
                top = np.lexsort((all_ids, -all_scores), axis=-1)[:, :k]
                best[who] = np.take_along_axis(all_scores, top, 1)
                held[who] = np.take_along_axis(all_ids, top, 1)
    return best, held


def shard_bounds(rows: DataFrame, width: int) -> DataFrame:
    """(shard, most, least): of each component the greatest and the least value."""
    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, shard = matrix(batch.column("vector").to_pylist(), width), batch.column("shard").to_numpy()
            order = np.argsort(shard, kind="stable")
            if len(order):
                start = np.flatnonzero(np.r_[True, np.diff(shard[order]) > 0])
                ends = [np.maximum.reduceat(x[order], start), np.minimum.reduceat(x[order], start)]
                yield pa.record_batch([pa.array(shard[order][start]), *(pa.array(list(e), pa.list_(pa.float64())) for e in ends)], ["shard", "most", "least"])

    def merged(parts: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"shard": parts["shard"][:1], "most": [np.max(parts["most"].tolist(), axis=0)], "least": [np.min(parts["least"].tolist(), axis=0)]})

    schema = "shard long, most array<double>, least array<double>"
    return rows.select("shard", "vector").mapInArrow(of_batches, schema).groupBy("shard").applyInPandas(merged, schema)


def asked_of(rows: DataFrame, k: int, width: int, shards: int) -> DataFrame:
    """(row, vec_id, vector, floor, shard): each query with a score that its k best reach at least, for each shard that may hold one of
    them."""
    if 2 * width * shards <= MOST_BOUNDS:
        own = shard_bounds(rows, width).toArrow().sort_by("shard")
        most, least = (np.array(own[c].to_pylist()).reshape(-1, width) for c in ("most", "least"))
        sent = rows.sparkSession.sparkContext.broadcast((own["shard"].to_numpy(), most, least))
    else:
        sent = None

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            query = np.flatnonzero(batch.column("_query").to_numpy(zero_copy_only=False))
            x = matrix(batch.column("vector").to_pylist(), width)
            for low in range(0, len(query), AT_ONCE):
                own = query[low : low + AT_ONCE]
                score = x[own] @ x.T
                score[np.arange(len(own)), own] = -np.inf
                floor = np.partition(score, -k, axis=1)[:, -k] if score.shape[1] >= k else np.full(len(own), -np.inf)
                if sent:
                    name, most, least = sent.value
                    who, where = np.nonzero(bounds(x[own], most, least) >= floor[:, None])
                else:
                    name = np.arange(shards)
                    who, where = np.repeat(np.arange(len(own)), shards), np.tile(name, len(own))
                part = batch.select(["row", "vec_id", "vector"]).take(pa.array(own[who]))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(floor[who]), pa.array(name[where])], ["row", "vec_id", "vector", "floor", "shard"])

    return rows.drop("shard").mapInArrow(asked, "row long, vec_id long, vector array<double>, floor double, shard long")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k best among all rows but its own."""
    value = F.col(vector)
    fine = F.col("vec_id").isNotNull() & (F.size(value) > 0) & F.forall(
        value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    )
    rows = vectors.where(fine).select(
        F.col("vec_id").cast("long"), value.cast("array<double>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("_query")
    )
    rows = written(ranked(rows, [], ["vec_id"], "row"), "vectors")
    n, n_queries, width = rows.agg(F.count(F.lit(1)), F.count_if("_query"), F.max(F.size("vector"))).first()
    if not n_queries:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    size = max(BLOCK_ROWS, SHARD_VALUES // width // BLOCK_ROWS * BLOCK_ROWS)
    shards, lots = math.ceil(n / size), math.ceil(n_queries / LOT_QUERIES)
    rows = rows.withColumn("shard", F.floor(F.col("row") / size))
    # queries of a lot are neighbours, so that they may need the same shards
    asked = asked_of(rows, k, width, shards).withColumn("lot", F.floor(F.col("row") * lots / n).cast("int"))
    asked = written(asked, "asked")
    tiles = small(written(asked.select("shard", "lot").distinct(), "tiles"))
    data = joined(rows.select("row", "vec_id", "vector", "shard"), tiles, ["shard"])

    def search(queries: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values("row", ignore_index=True)
        x = matrix(shard["vector"].tolist(), width)
        own, ids = shard["row"].to_numpy(), shard["vec_id"].to_numpy()
        found = []
        for low in range(0, len(queries), AT_ONCE):
            some = queries[low : low + AT_ONCE]
            q_rows = some["row"].to_numpy()
            best, held = best_of_shard(q_rows, matrix(some["vector"].tolist(), width), ids, x, k, own, some["floor"].to_numpy())
            there = np.isfinite(best)
            of = lambda column: np.repeat(some[column].to_numpy(), k)[there.ravel()]
            found.append(pd.DataFrame({"row": of("row"), "query_id": of("vec_id"), "vec_id": held[there], "score": best[there].astype(np.int64)}))
        return pd.concat(found) if found else pd.DataFrame({"row": [], "query_id": [], "vec_id": [], "score": []}, dtype="int64")

    by = ("shard", "lot")
    found = asked.groupBy(*by).cogroup(data.groupBy(*by)).applyInPandas(search, "row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
