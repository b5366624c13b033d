"""Exact vector search in four domains."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.attributes import DOMAINS
from ..functions.safety import classify, pair_sides, ranking_features, ranking_score, safety_violations, search_tier
from ..functions.vector import cosine, fused, unit

# Item types a requested type may be served by.
TYPE_FAMILIES = {
    "FLANGE": ("FLANGE", "FLANGE_WELD_NECK", "FLANGE_SLIP_ON", "FLANGE_BLIND"),
    "VALVE": ("VALVE", "GATE_VALVE", "BALL_VALVE", "GLOBE_VALVE"),
    "GATE_VALVE": ("GATE_VALVE",),
    "BALL_VALVE": ("BALL_VALVE",),
    "BOLT": ("BOLT", "STUD_BOLT"),
    "STUD_BOLT": ("STUD_BOLT",),
}
CUT = 0.70


def accepted_types(item_type):
    """Types that may serve a requested type; an unknown type serves itself."""
    chain = F.when(F.lit(False), F.array(F.lit("")))
    for kind, family in TYPE_FAMILIES.items():
        chain = chain.when(F.upper(item_type) == kind, F.array(*[F.lit(t) for t in family]))
    return chain.otherwise(F.array(item_type))


def _tiles(df: DataFrame, block: str, key: str, tile_rows: int, into: str) -> tuple[DataFrame, DataFrame]:
    """Cut each block into tiles of about ``tile_rows`` rows; also the number of tiles per block."""
    sizes = df.groupBy(block).agg(F.ceil(F.count("*") / tile_rows).cast("int").alias("__tiles_" + into))
    cut = df.join(sizes, block).withColumn(into, F.pmod(F.xxhash64(key), F.col("__tiles_" + into)).cast("int"))
    return cut.drop("__tiles_" + into), sizes


def first_places(scores: np.ndarray, keep: int) -> np.ndarray:
    """Of each row the places of its ``keep`` highest scores, highest first; equal scores by place. Only what reaches the last of them is sorted."""
    low = -scores
    if keep >= low.shape[1] or np.isnan(low).any():
        return np.argsort(low, axis=1, kind="stable")[:, :keep]
    row, place = np.nonzero(low <= np.partition(low, keep - 1, axis=1)[:, keep - 1 : keep])
    order = np.lexsort((place, low[row, place], row))
    row, place = row[order], place[order]
    first = np.searchsorted(row, np.arange(len(low)))
    return place[first[:, None] + np.arange(keep)]


def top_by_domain(
    queries: DataFrame, corpus: DataFrame, k: int, block: str = "block", query_id: str = "query_id", item_id: str = "item_id",
    domains=DOMAINS, tile_rows: int = 4096,
) -> DataFrame:
    """The ``k`` most similar items of each query in each domain, exactly: (query, domain, item, score).

    Both tables hold a block column (items serve queries of the same block) and one unit vector per
    domain. A block is cut into tiles of bounded size on both sides; each pair of tiles is one matrix
    product in numpy that gives only the best ``k`` per query. So a block with most of the
    vectors is spread over many tasks, no pair list is made, and the last step ranks
    ``k`` rows per tile.
    """
    q_cut, q_sizes = _tiles(queries, block, query_id, tile_rows, "q_tile")
    c_cut, c_sizes = _tiles(corpus, block, item_id, tile_rows, "c_tile")

    def spread(n):
        return F.explode_outer(F.sequence(F.lit(0), F.col(n) - 1))

    left = q_cut.join(c_sizes, block).withColumn("c_tile", spread("__tiles_c_tile")).select(block, "q_tile", "c_tile", query_id, *domains)
    right = c_cut.join(q_sizes, block).withColumn("q_tile", spread("__tiles_q_tile")).select(block, "q_tile", "c_tile", item_id, *domains)
    # fresh column ids, so that a table may be searched with its own rows
    right = right.select(*[F.col(n).alias(n) for n in right.columns])
    kinds = dict(queries.dtypes)
    schema = f"{query_id} {kinds[query_id]}, domain string, {item_id} {dict(corpus.dtypes)[item_id]}, score double"

    def best(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        parts = []
        if len(q) and len(c):
            ids = c[item_id].to_numpy()
            by_id = np.argsort(ids, kind="stable")
            ids = ids[by_id]
            keep = min(k, len(ids))
            for domain in domains:
                items = np.stack(c[domain].to_numpy()).astype(np.float64)[by_id]
                for at in range(0, len(q), 512):
                    rows = q.iloc[at : at + 512]
                    scores = np.stack(rows[domain].to_numpy()).astype(np.float64) @ items.T
                    order = first_places(scores, keep)
                    parts.append(
                        pd.DataFrame(
                            {
                                query_id: np.repeat(rows[query_id].to_numpy(), keep),
                                "domain": domain,
                                item_id: ids[order].ravel(),
                                "score": np.take_along_axis(scores, order, axis=1).ravel(),
                            }
                        )
                    )
        return pd.concat(parts) if parts else pd.DataFrame({query_id: [], "domain": [], item_id: [], "score": []})

    keys = [block, "q_tile", "c_tile"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(best, schema)
    rank = F.row_number().over(Window.partitionBy(query_id, "domain").orderBy(F.desc("score"), item_id))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def merge_domains(hits: DataFrame, query_id: str = "query_id", item_id: str = "item_id") -> DataFrame:
    """Hits of all domains as one row per (query, item) with a score map and the fused score."""
    rows = hits.groupBy(query_id, item_id).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("domain", "score")))).alias("domain_scores")
    )
    return rows.withColumn("cosine", fused(F.col("domain_scores")))


def search(
    queries: DataFrame, corpus: DataFrame, top_k: int = 10, rerank: bool = True, compat_unsorted: bool = False, families: bool = False, **options
) -> DataFrame:
    """Search with fusion, cut, safety, ranking score and tier.

    ``families`` looks up the items of all types that may serve the requested one, through inverted lists (see ``vector_lists``);
    without it both tables name the block to search in.

    With ``rerank`` five times ``top_k`` hits per domain are fetched. Without it the score is the fused
    cosine; ``compat_unsorted`` then keeps all fused hits instead of the best ``top_k``. Both tables
    may carry item_type, size_nb_mm, pressure_class, metallurgy, facing_end and standard.
    """
    query_id, item_id = options.get("query_id", "query_id"), options.get("item_id", "item_id")
    if families:
        from .vector_lists import search_lists

        hits = search_lists(queries, corpus, top_k * 5 if rerank else top_k, **options)
    else:
        hits = top_by_domain(queries, corpus, top_k * 5 if rerank else top_k, **options)
    # the window above ends here, so this cut is not repeated in it
    merged = merge_domains(hits, query_id, item_id).filter(F.col("cosine") >= CUT)
    names = ("item_type", "size_nb_mm", "pressure_class", "metallurgy", "facing_end", "standard")
    left = queries.select(query_id, *[F.col(n).alias("q_" + n) for n in names if n in queries.columns])
    right = corpus.select(item_id, *[F.col(n).alias("c_" + n) for n in names if n in corpus.columns])
    pairs = merged.join(left, query_id).join(right, item_id)
    q, c = pair_sides(pairs.columns)
    domain = {d: F.coalesce(F.try_element_at("domain_scores", F.lit(d)), F.lit(0.0)) for d in DOMAINS}
    score = ranking_score(ranking_features(q, c, F.col("cosine"), domain)) if rerank else F.col("cosine")
    scored = pairs.withColumns({"similarity": score, "violations": safety_violations(q, c)})
    scored = scored.withColumn("tier", search_tier(F.col("similarity"), F.col("violations")))
    if not rerank and compat_unsorted:
        return scored
    rank = F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("similarity"), item_id))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= top_k)


def classified(matches: DataFrame) -> DataFrame:
    """Classification of search results (tier, confidence, routing, reasons)."""
    q, c = pair_sides(matches.columns)
    return matches.withColumn("result", classify(q, c, F.col("similarity"), F.col("violations")))


def normalized(df: DataFrame, columns) -> DataFrame:
    return df.withColumns({c: unit(F.col(c)) for c in columns})


def pair_cosines(pairs: DataFrame, query: str = "q_", candidate: str = "c_", domains=DOMAINS) -> DataFrame:
    """Cosine of whole vectors and of each domain on a pair table."""
    out = {"cosine": cosine(F.col(query + "vector"), F.col(candidate + "vector"))}
    out |= {f"{d}_cosine": cosine(F.col(query + d), F.col(candidate + d)) for d in domains}
    return pairs.withColumns(out)
