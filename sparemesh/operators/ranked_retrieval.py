"""Candidates of a part request by how well they fit.

A stocked item of the request's tenant and type fits by its size (8), its metal (4), a class that reaches the requested one (2) and
the first word of the request in its description (1); the sum ranks it, equal sums by SKU. The best ``limit`` items
are candidates, and the table says how many more fit.

Items are counted by cells (tenant, type, size, class, metal, text) and cells by profiles (size, class, metal): the number of items of each
and, for each requested word, of those that have it. Words meet distinct texts. Shapes meet the profiles of their key, so the work follows distinct values,
not rows. Each shape adds up its profiles from the best fit down and stops at the level where ``limit`` items are reached; what is
below cannot come in, since a word only moves items inside a level. Only then are lists of lowest SKUs
made, of the profiles and words that some shape opens.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed, written
from .retrieval import KEYS, SUB_TYPES, ANY, contains_like, search_shapes
from .textjoin import grams, rarest_grams

SIZE, METAL, CLASS, WORD = 8, 4, 2, 1
TILE = 2048  # shapes that meet a key's profiles in one call


CELL = ["cpse", "item_type", "size", "class", "metal", "text"]


def stocked_items(inventory: DataFrame, shapes: DataFrame) -> DataFrame:
    """(CELL, cell, sku_code): items of the tenants and types that some shape asks for; ``cell`` tells items apart as far as a search does."""
    asked = shapes.groupBy("cpse").agg(F.collect_set("base_type").alias("__types"))  # tenants and types, not items
    items = inventory.select(
        "cpse", "item_type", F.col("size_nb_mm").cast("double").alias("size"), F.col("pressure_class").cast("int").alias("class"), F.lower("metallurgy").alias("metal"), F.lower("description").alias("text"), "sku_code"
    )
    wanted = F.coalesce(F.array_contains("__types", F.col("item_type")), F.lit(False)) | F.array_contains("__types", ANY)
    cell = F.xxhash64(*CELL, *[F.col(c).isNull() for c in CELL])  # a hash skips nulls, so it would not tell which column has one
    return items.join(F.broadcast(asked), "cpse").filter(wanted).select(*CELL, cell.alias("cell"), "sku_code")


def stocked_places(cells: DataFrame, shapes: DataFrame) -> DataFrame:
    """Cell rows (KEYS, text, size, class, metal, cell, n) under every key that some shape asks for."""
    subs = F.array(F.lit(""))
    for kind, words in SUB_TYPES.items():
        hits = F.array_compact(F.array(F.lit(""), *[F.when(F.col("text").contains(w.lower()), w) for w in words]))
        subs = F.when(F.col("item_type") == kind, hits).otherwise(subs)
    own = F.transform(subs, lambda s: F.struct(F.col("item_type").alias("base_type"), s.alias("sub_type")))
    places = F.concat(own, F.array(F.struct(F.lit(ANY).alias("base_type"), F.lit("").alias("sub_type"))))
    rows = cells.select("cpse", F.explode_outer(places).alias("__place"), "text", "size", "class", "metal", "cell", "n")
    rows = rows.select("cpse", "__place.base_type", "__place.sub_type", "text", "size", "class", "metal", "cell", "n")
    return rows.join(F.broadcast(shapes.select(*KEYS).distinct()), KEYS, "left_semi")


def word_hits(texts: DataFrame, shapes: DataFrame) -> DataFrame:
    """(KEYS, text, word): distinct texts that have a requested word; they meet on the word's rarest three letters."""
    words = shapes.filter("find_word is not null").select(*KEYS, F.col("find_word").alias("word")).distinct()
    # a wildcard matches anything, so only a plain run of the word can be looked up
    plain = words.withColumn("__run", F.regexp_extract("word", r"([^%_\\]+)", 1))
    anchored = checkpointed(rarest_grams(plain, "__run", texts, "text"))
    lengths = [r[0] for r in anchored.select(F.length("__gram")).distinct().collect()]  # 0 to 3
    opened = texts.withColumn("__gram", F.explode(grams(F.col("text"), lengths))) if lengths else texts.withColumn("__gram", F.lit(""))
    return opened.join(anchored, [*KEYS, "__gram"]).filter(contains_like(F.col("text"), F.col("word"))).select(*KEYS, "text", "word")


def _like(needle: str):
    """``contains_like`` on plain strings."""
    if not re.search(r"[%_\\]", needle):
        return lambda text: needle in text
    out, i = [], 0
    while i < len(needle):
        ch = needle[i]
        if ch == "\\" and i + 1 < len(needle):
            i += 1
            out.append(re.escape(needle[i]))
        else:
            out.append({"%": ".*", "_": "."}.get(ch, re.escape(ch)))
        i += 1
    pattern = re.compile("(?s).*" + "".join(out) + ".*")
    return lambda text: pattern.fullmatch(text) is not None


def _levels(limit: int, fill_below: int):
    """Per tile of shapes: the profiles whose items can be among the best ``limit``."""

    def choose(shapes: pa.Table, profiles: pa.Table) -> pa.Table:
        out = {"shape_id": [], "profile": [], "fit": [], "hits": [], "fill": []}
        if shapes.num_rows and profiles.num_rows:
            size, kind = (profiles[c].to_numpy().astype(float) for c in ("size", "class"))
            metals, n = profiles["metal"].to_pylist(), profiles["n"].to_numpy()
            ids = profiles["profile"].to_numpy()
            counted: dict[str, tuple[list, list]] = {}
            for row, listed in enumerate(profiles["words"].to_pylist()):
                for x in listed:
                    at, count = counted.setdefault(x["word"], ([], []))
                    at.append(row)
                    count.append(x["n"])
            served = {m: np.array([x is not None and fits(x) for x in metals]) for m in set(shapes["find_metal"].to_pylist()) - {None} for fits in [_like(m)]}
            none = np.zeros(len(n), dtype=bool)
            for shape, s, k, m, w in zip(*(shapes[c].to_pylist() for c in ("shape_id", "find_size", "find_class", "find_metal", "find_word"))):
                fit = SIZE * (size == s if s is not None else none) + CLASS * (kind >= k if k is not None else none) + METAL * served.get(m, none)
                at, count = counted.get(w, ([], []))
                word_only = int(np.array(count, dtype=np.int64)[fit[at] == 0].sum()) if at else 0
                direct = int(n[fit > 0].sum())
                hits = direct + word_only
                level = 0
                if direct >= limit:
                    by_fit = np.bincount(fit, weights=n, minlength=16)
                    level = int(np.flatnonzero(np.cumsum(by_fit[::-1])[::-1] >= limit)[-1])
                fill = hits < fill_below
                keep = np.flatnonzero(fit >= level)
                if level == 0 and not fill:
                    # items that only have the word, no item without any fit
                    keep = np.union1d(np.flatnonzero(fit > 0), np.array(at, dtype=np.int64)[fit[at] == 0] if at else [])
                keep = keep.astype(np.int64)
                out["shape_id"] += [shape] * len(keep)
                out["profile"].append(ids[keep])
                out["fit"].append(fit[keep])
                out["hits"] += [hits] * len(keep)
                out["fill"] += [fill] * len(keep)
        join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        return pa.table(
            [pa.array(out["shape_id"], pa.string()), pa.array(join(out["profile"]), pa.int64()), pa.array(join(out["fit"]), pa.int32()), pa.array(out["hits"], pa.int64()), pa.array(out["fill"], pa.bool_())],
            names=["shape_id", "profile", "fit", "hits", "fill"],
        )

    return choose


def ranked_by_shape(shapes: DataFrame, inventory: DataFrame, limit: int = 50, fill_below: int = 30) -> DataFrame:
    """(shape_id, sku_code, filled, fit, hits, cut) for the distinct shapes.

    ``hits`` is the number of items that fit at all and ``cut`` how many of them are not listed. Where fewer than ``fill_below``
    fit, other items of the type fill up to ``limit`` in SKU order (``filled`` = 1, fit 0).
    """
    attributes = [*KEYS, "size", "class", "metal"]
    shapes = checkpointed(shapes.select("shape_id", *KEYS, "find_size", "find_metal", "find_class", "find_word"))
    # one narrow row per item; all that is found out about items is found out about cells, far fewer where parts repeat
    coded = written(stocked_items(inventory, shapes))
    cells = coded.groupBy(*CELL, "cell").agg(F.count("*").alias("n"))
    places = written(stocked_places(cells, shapes).withColumn("profile", F.xxhash64(*attributes)))
    found = written(word_hits(places.select(*KEYS, "text").distinct(), shapes))
    worded = written(places.select(*KEYS, "text", "cell", "profile", "n").join(found, [*KEYS, "text"]).select("cell", "profile", "word", "n"))
    words = worded.groupBy("profile", "word").agg(F.sum("n").alias("n")).groupBy("profile").agg(F.collect_list(F.struct("word", "n")).alias("words"))
    none = F.array().cast("array<struct<word:string,n:bigint>>")
    profiles = places.groupBy("profile", *attributes).agg(F.sum("n").alias("n")).join(words, "profile", "left").withColumn("words", F.coalesce("words", none))
    asked = shapes.select("shape_id", *KEYS, "find_size", "find_class", "find_metal", "find_word")
    tiles = asked.groupBy(*KEYS).agg(F.ceil(F.count("*") / TILE).cast("int").alias("__tiles"))
    left = asked.join(tiles, KEYS).withColumn("tile", F.pmod(F.xxhash64("shape_id"), F.col("__tiles")).cast("int")).drop("__tiles")
    right = profiles.join(tiles, KEYS).withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("__tiles") - 1))).drop("__tiles")
    keys = [*KEYS, "tile"]
    chosen = checkpointed(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_levels(limit, fill_below), "shape_id string, profile long, fit int, hits long, fill boolean"))
    slim = ["shape_id", "fit", "hits"]
    # a list of lowest SKUs for each profile, and for each profile and word, that some shape opens; both are cut from the items at once
    list_of = F.xxhash64("profile", "word")
    no_word = F.lit(None).cast("string").alias("word")
    by_profile = chosen.filter((F.col("fit") > 0) | F.col("fill")).select(*slim, "profile", no_word)
    with_word = chosen.join(shapes.select("shape_id", F.col("find_word").alias("word")).filter("word is not null"), "shape_id").select("shape_id", (F.col("fit") + WORD).alias("fit"), "hits", "profile", "word")
    opened = written(by_profile.unionByName(with_word).select(*slim, list_of.alias("list")))
    wanted = places.select("cell", "profile", no_word).unionByName(worded.select("cell", "profile", "word")).select("cell", list_of.alias("list"))
    wanted = wanted.join(opened.select("list").distinct(), "list", "left_semi")
    lowest = F.row_number().over(Window.partitionBy("list").orderBy("sku_code"))
    lists = coded.select("cell", "sku_code").join(wanted, "cell").select("list", "sku_code").withColumn("__n", lowest).filter(F.col("__n") <= limit)
    lists = lists.groupBy("list").agg(F.array_sort(F.collect_list("sku_code")).alias("skus"))
    best = opened.join(lists, "list").select(*slim, F.explode_outer("skus").alias("sku_code"))
    best = best.groupBy("shape_id", "sku_code").agg(F.max("fit").alias("fit"), F.max("hits").alias("hits"))
    rank = F.row_number().over(Window.partitionBy("shape_id").orderBy(F.desc("fit"), "sku_code"))
    listed = best.withColumn("__n", rank).filter(F.col("__n") <= limit)
    return listed.select("shape_id", "sku_code", (F.col("fit") == 0).cast("int").alias("filled"), "fit", "hits", F.greatest(F.col("hits") - limit, F.lit(0)).alias("cut"))


def retrieve_ranked(requests: DataFrame, inventory: DataFrame, missing_type: str | None = None, with_item: bool = True, **options) -> DataFrame:
    """Candidates of each request: request columns, ``sku_code``, ``filled``, ``fit``, ``hits``, ``cut`` and the ``item`` as a struct (unless ``with_item`` is off)."""
    shaped = search_shapes(requests, missing_type)
    shapes = shaped.select("shape_id", *KEYS, "find_size", "find_metal", "find_class", "find_word").dropDuplicates(["shape_id"])
    found = ranked_by_shape(shapes, inventory, **options)
    if with_item:
        found = found.join(inventory.select("sku_code", F.struct(*inventory.columns).alias("item")), "sku_code")
    return shaped.select("shape_id", *requests.columns).join(found, "shape_id").drop("shape_id")
