"""Approximate nearest neighbours by permutations: vectors as ordered lists of their nearest pivots."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import stored

ENTRY = "vec_id long, vector binary, perm binary, posts array<int>"


def usable(vector: Column | str) -> Column:
    """Not null, not empty, no null or non-finite component, not all zero."""
    v = F.col(vector) if isinstance(vector, str) else vector
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(v.isNotNull() & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def choose_pivots(vectors: DataFrame, pivots: int, seed: int) -> np.ndarray:
    """Up to ``pivots`` distinct vectors of the commonest length, from a seeded sample of at most four times as many rows."""
    rows = vectors.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(4 * pivots).collect()
    if not rows:
        return np.zeros((0, 0))
    length = Counter(len(r.vector) for r in rows).most_common(1)[0][0]
    return np.array(list(dict.fromkeys(tuple(r.vector) for r in rows if len(r.vector) == length))[:pivots], dtype=np.float64)


def permutation_index(vectors: DataFrame, pivots: np.ndarray, prefix: int, posts: int) -> DataFrame:
    """For every vector its ``prefix`` nearest pivots in order (ties: lower pivot number), and the ``posts`` lists it is posted in."""
    length = pivots.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 4096):
                batch = whole.slice(begin, 4096)
                x = batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, length)
                far = (x * x).sum(axis=1)[:, None] - 2 * (x @ pivots.T) + (pivots * pivots).sum(axis=1)
                order = np.argsort(far, axis=1, kind="stable")[:, :prefix].astype(np.int16)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), pa.array([r.tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in order], pa.binary()), pa.array(order[:, :posts].astype(np.int32).tolist(), pa.list_(pa.int32()))],
                    names=["vec_id", "vector", "perm", "posts"],
                )

    return vectors.where(F.size("vector") == length).mapInArrow(run, ENTRY)


def _ranks(perm: pd.Series, pivots: int, prefix: int) -> tuple[np.ndarray, np.ndarray]:
    """(the ordered pivots, the rank of every pivot; ``prefix`` where it is not among them)."""
    order = np.frombuffer(b"".join(perm), dtype=np.int16).reshape(len(perm), -1)
    rank = np.full((len(perm), pivots), prefix, dtype=np.int16)
    np.put_along_axis(rank, order.astype(np.int64), np.arange(order.shape[1], dtype=np.int16)[None, :].repeat(len(perm), 0), 1)
    return order, rank


def search(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 10,
    pivots: int = 96,
    prefix: int = 32,
    posts: int = 12,
    rerank_share: float = 0.8,
    rerank_least: int = 200,
    list_rows: int = 2048,
    query_rows: int = 1024,
    seed: int = 3,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` nearest vectors found, nearest first, ties to the smaller vec_id.

    ``vectors`` and ``queries`` hold vec_id and vector (array of numbers). A query meets the lists of its ``posts`` nearest
    pivots. In each list the vectors are ranked by footrule distance (how far the query's ``prefix`` pivots are from
    their places in the vector's order), the first ``rerank_share`` of them, ``rerank_least`` at least, are ranked anew by
    Euclidean distance in double precision on the original vectors. A vector with the query's own id is never a candidate.
    Vectors that are null, zero, of another length than the commonest, or hold null or non-finite components take no part.
    A repeated row (same id) counts once, with its smallest vector. Fewer candidates: all. Empty tables: no rows. Other columns are ignored.

    Every row is posted; only the pivots are a sample (a bounded parameter). Long lists are cut into chunks of about
    ``list_rows`` and the queries of a list into chunks of about ``query_rows``, so a pivot that is near to a third of all vectors becomes many
    groups of bounded size. A pair that shares several lists is compared in one of them only. More pivots and fewer posts make it faster, fewer
    pivots and more posts raise recall; the defaults reach 0.9 on isotropic vectors of 64 components.
    """
    good = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("vector").cast("array<double>").alias("vector")).where(F.col("vec_id").isNotNull() & usable("vector"))
    spark = vectors.sparkSession
    chosen = choose_pivots(good(vectors), pivots, seed)
    result = "query_id long, vec_id long, score double"
    if not len(chosen):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    m, prefix = len(chosen), min(prefix, len(chosen))
    posts = min(posts, prefix)
    index = lambda df: stored(permutation_index(good(df).groupBy("vec_id").agg(F.min("vector").alias("vector")), chosen, prefix, posts), "permutations")
    index_v, index_q = index(vectors), index(queries)
    # one row per pivot
    size = lambda df, n: df.select(F.explode("posts").alias("pivot")).groupBy("pivot").agg(F.count("*").alias(n))
    sizes = size(index_v, "nv").join(size(index_q, "nq"), "pivot")
    sizes = F.broadcast(stored(sizes.select("pivot", F.ceil(F.col("nv") / list_rows).cast("int").alias("v_chunks"), F.ceil(F.col("nq") / query_rows).cast("int").alias("q_chunks")), "lists"))
    own = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    posted = lambda df: df.select("vec_id", "vector", "perm", F.explode("posts").alias("pivot")).join(sizes, "pivot")
    left = posted(index_v).select("pivot", own("v_chunks").alias("v_chunk"), every("q_chunks").alias("q_chunk"), "vec_id", "vector", "perm")
    right = posted(index_q).select("pivot", every("v_chunks").alias("v_chunk"), own("q_chunks").alias("q_chunk"), "vec_id", "vector", "perm")

    def compare(key, lists: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out: list[pd.DataFrame] = []
        if len(lists) and len(asked):
            pivot = int(key[0])
            lists = lists.sort_values("vec_id")
            ids = lists.vec_id.to_numpy()
            x = np.frombuffer(b"".join(lists.vector), dtype=np.float64).reshape(len(lists), -1)
            _, rank = _ranks(lists.perm, m, prefix)
            orders, _ = _ranks(asked.perm, m, prefix)
            for query, raw, order in zip(asked.vec_id, asked.vector, orders, strict=True):
                near = rank[:, order]
                here = int(np.flatnonzero(order[:posts] == pivot)[0])
                # compared here only if no nearer pivot of the query lists the vector as well
                mine = np.flatnonzero((near[:, :here] >= posts).all(axis=1) & (ids != query))
                foot = np.abs(near[mine] - np.arange(prefix, dtype=np.int16)).sum(axis=1)
                take = max(rerank_least, int(np.ceil(rerank_share * len(mine))))
                if take < len(mine):
                    mine = np.sort(mine[np.argsort(foot, kind="stable")[:take]])
                score = np.sqrt(((x[mine] - np.frombuffer(raw, dtype=np.float64)) ** 2).sum(axis=1))
                best = np.lexsort((ids[mine], score))[:k]
                out.append(pd.DataFrame({"query_id": query, "vec_id": ids[mine][best], "score": score[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})

    keys = ["pivot", "v_chunk", "q_chunk"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare, result)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
