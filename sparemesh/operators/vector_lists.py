"""Vector search over inverted lists, with type families.

A coarse quantiser (spherical k-means, one per domain) is fitted on a bounded sample; every item is posted under
(block, domain, nearest centroid). A query looks into the lists whose centroids are nearest to it. In
exact mode the lists left over are then ruled out: no item of a list can be nearer to the query than the angle to the
centroid less the list's own widest angle allows, and only lists that could still beat the query's k-th hit are searched too.

The lists of a block are laid end to end and cut into tiles of bounded size, the queries of a block likewise, so a list or a block
with most of the vectors is many tasks. A query travels to tiles, not to lists, and comes back with one row of at most ``k`` hits for
each; what is moved does not grow with the number of lists, however few of them can be ruled out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.attributes import DOMAINS
from ..session import checkpointed
from .vectors import accepted_types

MARGIN = 1e-9  # for rounding in the bound
ROUNDING = 1e-11  # more than scores change when they are rounded
ROWS, RUN = 512, 1024  # queries and items of one matrix product


def fit_centroids(corpus: DataFrame, domains=DOMAINS, item_id: str = "item_id", most_lists: int = 4096, least_rows: int = 64, per_list: int = 64, rounds: int = 8, seed: int = 3) -> dict[str, np.ndarray]:
    """Unit centroids of each domain.

    There are as many lists as the root of the number of items, but none of fewer than ``least_rows`` items on average and at
    most ``most_lists``. The fit sees at most ``per_list`` items for each list, those with the lowest seeded hash of
    their id; so what reaches the driver is bounded by ``most_lists * per_list`` vectors whatever the table's size.
    """
    n = corpus.count()
    lists = max(1, min(most_lists, math.isqrt(n), n // least_rows))
    sample = corpus.select(item_id, *domains).orderBy(F.xxhash64(F.col(item_id), F.lit(seed)), item_id).limit(lists * per_list).toPandas()
    out = {}
    for domain in domains:
        held = [np.asarray(v, dtype=np.float64) for v in sample[domain] if v is not None]
        if not held:
            out[domain] = np.zeros((1, 0))
            continue
        x = np.stack(held)
        centroids = x[: min(lists, len(x))].copy()  # the sample is in hash order
        for _ in range(rounds):
            nearest = np.argmax(x @ centroids.T, axis=1)
            sums = np.zeros_like(centroids)
            np.add.at(sums, nearest, x)
            length = np.linalg.norm(sums, axis=1, keepdims=True)
            centroids = np.where(length > 0, sums / np.where(length > 0, length, 1), centroids)
        out[domain] = centroids
    return out


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Vectors of one length as rows."""
    return vectors.flatten().to_numpy().reshape(len(vectors), -1)


def _nested(counts: np.ndarray, values: pa.Array) -> pa.Array:
    """``values`` as lists of the given lengths."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)


def _posted(items: DataFrame, key: str, centroids: dict[str, np.ndarray]) -> DataFrame:
    """A row per item and domain with its nearest list and the cosine to that."""
    domains = list(centroids)
    kinds = dict(items.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for domain in domains:
                part = batch.filter(batch.column(domain).is_valid())
                if not part.num_rows or not centroids[domain].size:
                    continue
                cosines = _matrix(part.column(domain)) @ centroids[domain].T
                nearest = np.argmax(cosines, axis=1)
                columns = [part.column(key), part.column("block"), pa.array([domain] * part.num_rows), part.column(domain), pa.array(nearest.astype(np.int32)), pa.array(np.take_along_axis(cosines, nearest[:, None], axis=1)[:, 0])]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "block", "domain", "vector", "list", "toward"])

    vectors = [F.col(d).cast("array<double>").alias(d) for d in domains]
    return items.select(key, "block", *vectors).mapInArrow(run, f"`{key}` {kinds[key]}, block string, domain string, vector array<double>, list int, toward double")


def list_sizes(posted: DataFrame) -> DataFrame:
    """(block, domain, list, n, before): items of each list, and of the lists before it in its block."""
    lists = posted.groupBy("block", "domain", "list").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("block", "domain").orderBy("list").rowsBetween(Window.unboundedPreceding, -1)
    return lists.withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0)))


def family_blocks(item_type: Column) -> Column:
    """Blocks a query of this type looks into; a query without a type looks into all, which ``search_lists`` fills in."""
    return F.when(F.coalesce(item_type, F.lit("")) != "", accepted_types(item_type))

def _asked(queries: DataFrame, blocks: Column | None, sizes: DataFrame, query_id: str, domains, tile_rows: int) -> DataFrame:
    """A row for each query, block and domain it looks into: (query, block, q_tile, domain, vector)."""
    # a query without a type meets every block, as it asks to
    everywhere = sizes.groupBy().agg(F.collect_set("block").alias("__all"))
    own = family_blocks(F.col("item_type")) if blocks is None else blocks
    asks = queries.withColumn("__own", own).join(F.broadcast(everywhere)).withColumn("__blocks", F.array_distinct(F.coalesce("__own", "__all")))
    # some tiles are made of small blocks too, so that they are worked on side by side
    count = F.count("*")
    tiles = F.greatest(F.ceil(count / tile_rows), F.least(F.lit(4), F.ceil(count * 32 / tile_rows))).cast("int")
    held = asks.select(F.explode_outer("__blocks").alias("block")).groupBy("block").agg(tiles.alias("__tiles"))
    vectors = F.array(*[F.struct(F.lit(d).alias("domain"), F.col(d).cast("array<double>").alias("vector")) for d in domains])
    rows = asks.select(query_id, vectors.alias("__v"), F.explode_outer("__blocks").alias("block")).select(query_id, "block", F.explode_outer("__v").alias("__v"))
    rows = rows.select(query_id, "block", "__v.domain", "__v.vector").filter("vector is not null")
    return rows.join(held, "block").withColumn("q_tile", F.pmod(F.xxhash64(query_id), F.col("__tiles")).cast("int")).select(query_id, "block", "q_tile", "domain", "vector")


def _nearest_lists(asked: DataFrame, sizes: DataFrame, centroids: dict[str, np.ndarray], mass: float, least: int, tile_rows: int) -> DataFrame:
    """``asked`` with ``lists``: of a block the nearest lists until they hold ``mass`` times the root of its items, ``least`` items at least.

    So a small block is searched nearly as a whole and a large one in a falling share. Also the ``tiles`` these lists lie in, the number of their
    items (``compared``) and of all items of the block (``possible``).
    """
    blocks = sizes.groupBy("block", "domain").agg(F.sort_array(F.collect_list(F.struct("list", "n", "before"))).alias("sizes"))
    right = asked.select("block", "domain", "q_tile").distinct().join(blocks, ["block", "domain"])
    right = right.select(*[F.col(c).alias(c) for c in right.columns])  # fresh column ids
    schema = ", ".join(f"`{c}` {t}" for c, t in asked.dtypes) + ", lists array<int>, tiles array<int>, compared bigint, possible bigint"
    result = asked.schema.names + ["lists", "tiles", "compared", "possible"]

    def choose(q: pa.Table, s: pa.Table) -> pa.Table:
        parts = []
        if q.num_rows and s.num_rows:
            held, n, before = (s.column("sizes").combine_chunks().flatten().field(c).to_numpy().astype(np.int64) for c in ("list", "n", "before"))
            tiles = np.arange((before[-1] + n[-1] - 1) // tile_rows + 1)
            spans = ((before // tile_rows)[:, None] <= tiles) & (tiles <= ((before + n - 1) // tile_rows)[:, None])
            nearby = centroids[q.column("domain")[0].as_py()][held].T
            wanted = max(least, mass * math.sqrt(n.sum()))
            for batch in q.to_batches(max_chunksize=ROWS):
                order = np.argsort(-(_matrix(batch.column("vector")) @ nearby), axis=1, kind="stable")
                near = np.zeros(order.shape, dtype=bool)
                np.put_along_axis(near, order, np.cumsum(n[order], axis=1) - n[order] < wanted, axis=1)
                meets = near.astype(np.float32) @ spans.astype(np.float32) > 0
                columns = [
                    _nested(near.sum(axis=1), pa.array(held[np.nonzero(near)[1]].astype(np.int32))), _nested(meets.sum(axis=1), pa.array(np.nonzero(meets)[1].astype(np.int32))),
                    pa.array(near @ n), pa.array(np.full(len(near), n.sum())),
                ]
                parts.append(pa.RecordBatch.from_arrays([*batch.columns, *columns], names=result))
        return pa.Table.from_batches(parts) if parts else pa.table({c: pa.array([], t) for c, t in zip(result, empty)})

    empty = to_arrow_schema(asked.withColumns({"lists": F.array().cast("array<int>"), "tiles": F.array().cast("array<int>"), "compared": F.lit(0).cast("long"), "possible": F.lit(0).cast("long")}).schema).types
    keys = ["block", "domain", "q_tile"]
    return asked.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(choose, schema)


class _Best:
    """The best ``k`` items of some queries, as positions in a tile; equal scores by rank of the item's id."""

    def __init__(self, vectors: np.ndarray, items: np.ndarray, id_rank: np.ndarray, k: int):
        self.vectors, self.items, self.id_rank, self.k = vectors, items, id_rank, k
        self.score = np.full((len(vectors), k), -np.inf)
        self.place = np.full((len(vectors), k), -1)

    @property
    def floor(self) -> np.ndarray:
        """The k-th score of each query, minus infinity while there are fewer."""
        return self.score[:, -1]

    def see(self, wanted: np.ndarray, starts: np.ndarray, list_of: np.ndarray) -> None:
        """Look into the ``wanted`` lists (queries by lists); list ``i`` holds the items from ``starts[i]`` to ``starts[i + 1]``."""
        low = 0
        while low < len(starts) - 1:
            high = max(low + 1, int(np.searchsorted(starts, starts[low] + RUN, "right")) - 1)
            rows = np.flatnonzero(wanted[:, low:high].any(axis=1))
            for at in range(starts[low], starts[high] if len(rows) else 0, RUN):
                end = min(at + RUN, starts[high])
                scores = self.vectors[rows] @ self.items[at:end].T
                open_ = (scores >= self.floor[rows][:, None] - ROUNDING) & wanted[rows][:, list_of[at:end]]
                if np.count_nonzero(open_) > 2 * self.k * len(rows) and end - at > self.k:
                    kth = np.partition(np.where(open_, scores, -np.inf), end - at - self.k, axis=1)[:, end - at - self.k]
                    open_ &= scores >= kth[:, None] - ROUNDING
                r, column = np.nonzero(open_)
                if len(r):
                    # equal vectors of two tiles may differ in the last bit, which must not decide a tie
                    self._take(rows[r], at + column, np.round(scores[r, column], 12) + 0.0)
            low = high

    def _take(self, row: np.ndarray, place: np.ndarray, score: np.ndarray) -> None:
        met = np.unique(row)
        r, c = np.nonzero(self.place[met] >= 0)
        row, place, score = np.concatenate([met[r], row]), np.concatenate([self.place[met][r, c], place]), np.concatenate([self.score[met][r, c], score])
        order = np.lexsort((self.id_rank[place], -score, row))
        row, place, score = row[order], place[order], score[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        keep = rank < self.k
        self.score[row[keep], rank[keep]] = score[keep]
        self.place[row[keep], rank[keep]] = place[keep]


def _best_of_tiles(asked: DataFrame, q_tiles: DataFrame, posted: DataFrame, sizes: DataFrame, centroids: dict[str, np.ndarray], k: int, exact: bool, query_id: str, item_id: str, tile_rows: int) -> DataFrame:
    """(query, domain, hits): the best ``k`` of every tile a query looks into. ``asked`` names its ``lists`` and ``tiles`` unless ``exact``."""
    block = ["block", "domain"]
    last = sizes.groupBy(*block).agg(F.floor((F.sum("n") - 1) / tile_rows).cast("int").alias("__last"))
    if exact:
        left = asked.join(last, block).withColumn("c_tile", F.explode_outer(F.sequence(F.lit(0), F.col("__last")))).drop("__last")
    else:
        left = asked.withColumn("c_tile", F.explode_outer("tiles")).select(*block, "q_tile", "c_tile", query_id, "vector", "lists")
    spot = F.col("before") + F.pmod(F.xxhash64(item_id), F.col("n"))
    right = posted.join(sizes, [*block, "list"]).withColumn("c_tile", F.floor(spot / tile_rows).cast("int")).join(q_tiles, block)
    # fresh column ids, so that a table may be searched with its own rows
    right = right.select(*[F.col(c).alias(c) for c in (*block, "q_tile", "c_tile", item_id, "vector", "list", "toward")])
    kinds = dict(left.dtypes) | dict(right.dtypes)
    schema = f"`{query_id}` {kinds[query_id]}, domain string, hits array<struct<away:double,item:{kinds[item_id]}>>"

    def best(q: pa.Table, c: pa.Table) -> pa.Table:
        asking, hits, counts = [], [], []
        c = c.sort_by([("list", "ascending"), (item_id, "ascending")])
        ids = c.column(item_id).combine_chunks()
        domain = None
        if q.num_rows and c.num_rows:
            domain = q.column("domain")[0].as_py()
            id_rank = np.empty(len(ids), dtype=np.int64)
            id_rank[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
            items = _matrix(c.column("vector").combine_chunks())
            lists, first, list_of = np.unique(c.column("list").to_numpy(), return_index=True, return_inverse=True)
            starts = np.append(first, len(ids))
            least = np.minimum.reduceat(c.column("toward").to_numpy(), first)
            n = np.diff(starts)
            for batch in q.combine_chunks().to_batches(max_chunksize=ROWS):
                found = _Best(_matrix(batch.column("vector")), items, id_rank, k)
                if exact:
                    # a first bound from the nearest lists
                    towards = found.vectors @ centroids[domain][lists].T
                    order = np.argsort(-towards, axis=1, kind="stable")
                    near = np.zeros(order.shape, dtype=bool)
                    np.put_along_axis(near, order, np.cumsum(n[order], axis=1) - n[order] < 2 * k, axis=1)
                    found.see(near, starts, list_of)
                    # the narrowest angle left between the query and an item of the list
                    angle = np.arccos(np.clip(towards, -1, 1)) - np.arccos(np.clip(least, -1, 1))
                    found.see(~near & (np.cos(np.maximum(angle, 0)) + MARGIN >= found.floor[:, None]), starts, list_of)
                else:
                    named = batch.column("lists")
                    row = np.repeat(np.arange(batch.num_rows), named.value_lengths().to_numpy())
                    at = np.searchsorted(lists, named.flatten().to_numpy())
                    here = at < len(lists)
                    here[here] = lists[at[here]] == named.flatten().to_numpy()[here]
                    near = np.zeros((batch.num_rows, len(lists)), dtype=bool)
                    near[row[here], at[here]] = True
                    found.see(near, starts, list_of)
                held = found.place >= 0
                asking.append(batch.column(query_id))
                counts.append(held.sum(axis=1))
                hits.append((-found.score[held] + 0.0, found.place[held]))
        away, place = (np.concatenate([h[i] for h in hits]) if hits else np.zeros(0, kind) for i, kind in ((0, np.float64), (1, np.int64)))
        rows = pa.StructArray.from_arrays([pa.array(away, pa.float64()), ids.take(pa.array(place, pa.int64()))], names=["away", "item"])
        count = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        asked_by = pa.chunked_array(asking, result.field(0).type)
        return pa.table([asked_by, pa.array([domain] * len(count), pa.string()), _nested(count, rows)], names=result.names)

    shape = F.array().cast(f"array<struct<away:double,item:{kinds[item_id]}>>")
    result = to_arrow_schema(left.select(query_id, "domain", shape.alias("hits")).schema)
    keys = [*block, "q_tile", "c_tile"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(best, schema)


def _ranked(hits: DataFrame, k: int, query_id: str, item_id: str) -> DataFrame:
    """Hits of all tiles as ranked rows; a query has at most ``k`` from each tile."""
    best = hits.groupBy(query_id, "domain").agg(F.slice(F.array_sort(F.flatten(F.collect_list("hits"))), 1, k).alias("hits"))
    rows = best.select(query_id, "domain", F.posexplode("hits").alias("__n", "__h"))
    return rows.select(query_id, "domain", F.col("__h.item").alias(item_id), (F.lit(0.0) - F.col("__h.away")).alias("score"), (F.col("__n") + 1).alias("rank"))


def search_lists(
    queries: DataFrame, corpus: DataFrame, k: int, blocks: Column | None = None, block: str = "item_type", mass: float = 18.0, exact: bool = True, query_id: str = "query_id",
    item_id: str = "item_id", domains=DOMAINS, tile_rows: int = 65536, **fit,
) -> DataFrame:
    """The ``k`` most similar items of each query in each domain: (query, domain, item, score, rank).

    ``corpus`` has a ``block`` column (null: an empty one); ``blocks`` gives the array of blocks of a query, null for all (default: the families of its
    ``item_type``). With ``exact`` every list that could hold a nearer item is searched, so the hits are those of a full
    comparison; without it only the nearest lists of a block are, until they hold ``mass`` times the root of its number of items.
    Vectors are of length one; null vectors take no part.
    """
    centroids = fit_centroids(corpus, domains, item_id, **fit)
    items = corpus.withColumn("block", F.coalesce(F.col(block).cast("string"), F.lit("")))
    posted = checkpointed(_posted(items, item_id, centroids))
    sizes = checkpointed(list_sizes(posted))
    asked = _asked(queries, blocks, sizes, query_id, domains, tile_rows)
    q_tiles = asked.select("block", "domain", "q_tile").distinct()
    if not exact:
        asked = _nearest_lists(asked, sizes, centroids, mass, 4 * k, tile_rows)
    return _ranked(_best_of_tiles(asked, q_tiles, posted, sizes, centroids, k, exact, query_id, item_id, tile_rows), k, query_id, item_id)


def pairs_compared(queries: DataFrame, corpus: DataFrame, k: int, mass: float = 18.0, blocks: Column | None = None, block: str = "item_type", query_id: str = "query_id", item_id: str = "item_id", domains=DOMAINS, tile_rows: int = 65536, **fit) -> DataFrame:
    """(domain, compared, possible): pairs of query and item that the nearest lists bring together, and those in the same blocks."""
    centroids = fit_centroids(corpus, domains, item_id, **fit)
    items = corpus.withColumn("block", F.coalesce(F.col(block).cast("string"), F.lit("")))
    sizes = checkpointed(list_sizes(_posted(items, item_id, centroids)))
    pairs = _nearest_lists(_asked(queries, blocks, sizes, query_id, domains, tile_rows), sizes, centroids, mass, 4 * k, tile_rows)
    return pairs.groupBy("domain").agg(F.sum("compared").alias("compared"), F.sum("possible").alias("possible"))
