"""Exact top-k by Fagin's threshold algorithm over sorted lists of each dimension.

Candidates and queries meet in blocks. A block sorts its candidates once for each
dimension. A query reads all lists from the end that its component favours, scores each
vector when it first sees it, and stops when the sum of the last values read, a bound for
every vector not yet seen, cannot beat its kth best score.
"""

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelweave.llm.common import hold


def threshold_search(queries: np.ndarray, own: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int):
    """For each query: positions and scores of its k best vectors, ties to the smaller id, without its own row (own: its position, or -1)."""
    n = len(vectors)
    order = np.ascontiguousarray(np.argsort(vectors, axis=0, kind="stable").T)
    for q, me in zip(queries, own, strict=True):
        used = np.flatnonzero(q)
        down = q[used] > 0
        seen, scores, scored = np.zeros(n, bool), np.zeros(n, vectors.dtype), 0
        depth, step, valid, bound = 0, 32, np.arange(n) != me, None
        while depth < n:
            if len(used):
                last = min(depth + step, n)
                for d, high in zip(used, down, strict=True):
                    seen[order[d, n - last : n - depth] if high else order[d, depth:last]] = True
                end = np.where(down, order[used, n - last], order[used, last - 1])
                depth, step, bound = last, step * 4, (vectors[end, used] * q[used]).sum()
            else:
                seen[:], depth, bound = True, n, None
            new = np.flatnonzero(seen & (scores == 0)) if scored else np.flatnonzero(seen)
            # a gather of most rows costs more than one pass over all; only seen rows' scores are used
            scores = np.where(seen, vectors @ q, scores) if len(new) > n // 4 else _put(scores, new, vectors[new] @ q)
            scored = 1
            found = np.flatnonzero(seen & valid)
            if len(found) > k:
                kth = np.partition(scores[found], len(found) - k)[len(found) - k]
                found = found[scores[found] >= kth]
                if bound is not None and kth > bound:
                    break
        best = found[np.lexsort((ids[found], -scores[found]))][:k]
        yield best, scores[best]


def _put(scores: np.ndarray, at: np.ndarray, values: np.ndarray) -> np.ndarray:
    scores[at] = values
    return scores


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of doubles; Python's integers where a long is too small."""
    with np.errstate(over="ignore"):
        y = np.floor(x * scale)
    if not y.size or np.abs(y).max() < 2**53:
        return y.astype(np.int64)
    whole = [int(b) if abs(a) < 2**53 else int(a) * scale for a, b in zip(x.ravel(), y.ravel(), strict=True)]
    return np.array(whole, object).reshape(x.shape)


def sortable(score: int) -> bytes:
    """Bytes that sort as the integers do: the length, turned round below 0, then the number's bytes in two's complement."""
    size = score.bit_length() // 8 + 1
    return (2**15 + (size if score >= 0 else -size)).to_bytes(2, "big") + (score % 256**size).to_bytes(size, "big")


def search(vectors: DataFrame, *, is_query, k: int = 5, id_column: str = "vec_id", vector_column: str = "embedding", scale: int = 256, block: int = 4096, query_block: int = 512) -> DataFrame:
    """query_id, rank, vec_id, score of the k best rows for each query row by integer inner product.

    Components become floor(scale * x), exact at any size. Null vectors, those with null or non-finite components and empty ones take no part. Scores
    rank as they are; one beyond a long is null in the result. Candidates are all other rows: rows that share an id, equal ones among them, are candidates of each other, and each query row has ranks of its own.
    Vectors of another length than the query's are no candidates. Fewer candidates than k give fewer rows; ties go to the smaller id,
    and an empty table gives no rows. Other columns, however named, stay out. A row of a block of candidates is dealt once; the
    queries (a stated set) go to every block, in parts of query_block: queries * blocks rows are moved, and each block's vectors once for each part.
    """
    x = F.col(vector_column)
    fine = x.isNotNull() & (F.size(x) > 0) & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.filter(fine & F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), x.cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    # a row's own number: equal rows differ in it. Held, so that a task that runs again does not number anew.
    rows = hold(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    n, asked = rows.agg(F.count("*"), F.count(F.when(F.col("q"), 1))).first()
    blocks, asked_blocks = max(1, math.ceil(n / block)), max(1, math.ceil(asked / query_block))
    key = F.xxhash64("row")
    left = rows.select(F.pmod(key, F.lit(blocks)).alias("b"), F.explode(F.sequence(F.lit(0), F.lit(asked_blocks - 1))).alias("qb"), "row", "id", "v")
    right = rows.filter("q").select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("b"), F.pmod(F.shiftright(key, 20), F.lit(asked_blocks)).cast("int").alias("qb"), "row", "id", "v")

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = [(np.zeros(0, np.int64),) * 3 + (np.zeros(0, object),)]
        for size, part in b.groupby(b.v.map(len)):
            same = a[a.v.map(len) == size]
            if len(same):
                vectors, queries = integers(np.stack(same.v.to_numpy()), scale), integers(np.stack(part.v.to_numpy()), scale)
                ids, at = same.id.to_numpy(np.int64), {r: i for i, r in enumerate(same.row)}
                limit = int(np.abs(vectors).max()) * int(np.abs(queries).max()) * int(size)
                kind = np.float32 if limit < 2**24 else np.float64 if limit < 2**53 else np.int64 if limit < 2**63 else object  # exact in each case
                own = [at.get(r, -1) for r in part.row]
                for row, query, (best, scores) in zip(part.row, part.id, threshold_search(queries.astype(kind), own, vectors.astype(kind), ids, k), strict=True):
                    out.append((np.full(len(best), row), np.full(len(best), query), ids[best], np.array([int(s) for s in scores], object)))
        row, query, found, score = (np.concatenate(c) for c in zip(*out, strict=True))
        fits = [s if -(2**63) <= s < 2**63 else None for s in score]
        return pd.DataFrame({"row": row, "query_id": query, "vec_id": found, "score": pd.array(fits, "Int64"), "place": [sortable(s) for s in score]})

    best = right.groupBy("b", "qb").cogroup(left.groupBy("b", "qb")).applyInPandas(lambda b, a: meet(a, b), "row long, query_id long, vec_id long, score long, place binary")
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("place"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
