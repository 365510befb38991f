"""Exact top-k inner products by columnar branch and bound.

Queries and candidates meet in the cells of a grid: each candidate group is repeated once
per query group and the other way round, and a cell holds one group of each, so its size
is bounded. In a cell candidates lie dimension by dimension. Scores grow block by block of
dimensions; after each block the most that the remaining dimensions can add (the product
of the remaining norms) is compared with the k-th best complete score so far, and only
candidates that may still reach it are carried on.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gaugeline.llm.support import ship, shuffle_parts

QUERY_GROUP = 2048
CANDIDATE_GROUP = 16384
BLOCK = 16
# Queries whose first block of dimensions is scored at a time.
STRIP = 128


def quantized(vectors: DataFrame, vec_id: str, embedding: str, scale: float) -> DataFrame:
    """``vec_id`` and ``floor(scale * x)`` of every component; rows that take no part are left out."""
    cell = F.col(embedding)
    finite = F.forall(cell, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.filter(F.col(vec_id).isNotNull() & cell.isNotNull() & F.coalesce(finite, F.lit(False))).select(
        F.col(vec_id).cast("long").alias("id"), F.transform(cell, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("v")
    )


def search_cell(query_ids, queries, ids, vectors, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query in one cell: (query row, candidate row, score), exact integers."""
    dims = vectors.shape[1] if vectors.ndim == 2 else 0
    top = max(1, int(np.abs(queries).max(initial=0))) * max(1, int(np.abs(vectors).max(initial=0))) * max(1, dims)
    kind = np.float64 if top < 1 << 52 else object
    order = np.argsort(-(vectors.astype(float) ** 2).sum(axis=0), kind="stable")
    columns = np.ascontiguousarray(vectors[:, order].T.astype(kind))
    asked = queries[:, order].astype(kind)
    cuts = [*range(0, dims, BLOCK), dims]
    rest_c = [np.sqrt((columns[c:].astype(float) ** 2).sum(axis=0)) for c in cuts]
    rest_q = [np.sqrt((asked[:, c:].astype(float) ** 2).sum(axis=1)) for c in cuts]
    width = cuts[1] if dims else 0
    out_q, out_c, out_s = [], [], []
    for q in range(len(asked)):
        if q % STRIP == 0:
            first = asked[q : q + STRIP, :width] @ columns[:width] if dims else np.zeros((STRIP, len(ids)))
        alive = np.flatnonzero(ids != query_ids[q])
        score = first[q % STRIP, alive]
        # The most promising of the first block are completed to get a k-th best early.
        if len(alive) > k:
            seeds = alive[np.argpartition(-score.astype(float), min(4 * k, len(alive) - 1))[: 4 * k]]
            full = np.sort((asked[q] @ columns[:, seeds]).astype(float))
            least = full[-k]
        else:
            least = -np.inf
        for b in range(1, len(cuts)):
            bound = score.astype(float) + rest_q[b][q] * rest_c[b][alive]
            stay = bound >= least - 0.5 - 1e-9 * np.abs(bound)
            alive, score = alive[stay], score[stay]
            if b + 1 < len(cuts):
                score = score + asked[q, cuts[b] : cuts[b + 1]] @ columns[cuts[b] : cuts[b + 1], alive]
        best = np.lexsort((ids[alive], -score.astype(float) if kind is np.float64 else [-int(s) for s in score]))[:k]
        out_q.append(np.full(len(best), q))
        out_c.append(alive[best])
        out_s.append(np.array([int(s) for s in score[best]], np.int64))
    if not out_q:
        return (np.zeros(0, np.int64),) * 3
    return np.concatenate(out_q), np.concatenate(out_c), np.concatenate(out_s)


def _matrix(lists: pa.ChunkedArray) -> np.ndarray:
    flat = lists.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(lists), -1) if len(flat) else np.zeros((len(lists), 0), np.int64)


def _once(ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each id once, with the smallest of its vectors."""
    order = np.lexsort((*rows.T[::-1], ids))
    keep = order[np.flatnonzero(np.diff(ids[order], prepend=ids[order][0] - 1))] if len(ids) else order
    return ids[keep], rows[keep]


def top_k(
    vectors: DataFrame, k: int = 5, every: int = 50, vec_id: str = "vec_id", embedding: str = "embedding", scale: float = 256.0
) -> DataFrame:
    """The k highest scores of every row whose id is divisible by ``every``, against all other rows.

    Returns ``query_id``, ``rank`` (from 1), ``vec_id`` and ``score``; ties go to the smaller
    id. Rows with a null id or vector, or a null or non-finite component, take no part.
    Rows of one id are one vector, the smallest. Vectors are compared with those of their
    own length; components must let the product fit a long. Fewer candidates than k give
    fewer rows, an empty table none. Other columns are ignored.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = quantized(vectors, vec_id, embedding, scale)
    total, asked = rows.agg(F.count("*"), F.count_if(F.col("id") % every == 0)).first()
    query_groups = max(1, math.ceil(asked / QUERY_GROUP))
    groups = max(shuffle_parts(spark), math.ceil(total / CANDIDATE_GROUP))

    def spread(n: int, seed: int):
        return F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).cast("int")

    def all_of(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    size = F.size("v").alias("dims")
    sides = rows.filter(F.col("id") % every == 0).select(
        "id", "v", size, F.lit(True).alias("asks"), spread(query_groups, 1).alias("qg"), all_of(groups).alias("cg")
    ).unionByName(
        rows.select("id", "v", size, F.lit(False).alias("asks"), spread(groups, 2).alias("cg"), all_of(query_groups).alias("qg"))
    )

    def search(cell: pa.Table) -> pa.Table:
        asks = cell.column("asks").to_numpy()
        ids, matrix = cell.column("id").to_numpy(), _matrix(cell.column("v"))
        query_ids, queries = _once(ids[asks], matrix[asks])
        candidate_ids, candidates = _once(ids[~asks], matrix[~asks])
        q, c, score = search_cell(query_ids, queries, candidate_ids, candidates, k)
        return pa.table({"query_id": query_ids[q], "vec_id": candidate_ids[c], "score": score})

    found = sides.groupBy("qg", "cg", "dims").applyInArrow(search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
