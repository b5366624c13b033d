"""Candidate retrieval for a table of part requests.

A request asks for the stocked items of one tenant and type that share its size, carry its metal,
reach its pressure class or mention its first word: at most 50, filled up from the rest of the type
when fewer than 30 are found. Items count in SKU order, so the result is the same on every run.

Requests are reduced to their distinct search shapes, and of each search key (type and size, type and
class, ...) only the 50 lowest SKUs can ever be in a result. Items that agree in all a key looks at are cut to their 50 lowest first. The short lists
are built from these with a limited row number, which Spark cuts on the map side, and joined to the shapes on equal keys. Words meet distinct texts. No step pairs all
requests with all items of a type, and a popular type or shape adds rows only to its own short lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import first_true
from ..session import written
from .textjoin import anchor, pieces

# Words that narrow a valve or flange request to a kind, in this order.
SUB_TYPES = {"VALVE": ("GATE", "BALL", "GLOBE", "CHECK", "BUTTERFLY"), "FLANGE": ("WN", "BLIND", "SO")}
ANY = "*"
KEYS = ["cpse", "base_type", "sub_type"]


def resolve_type(raw: Column) -> tuple[Column, Column]:
    """(base type, sub type) of a requested type; null base for no type or ALL."""
    upper = F.upper(raw)
    wanted = (F.coalesce(raw, F.lit("")) != "") & (raw != "ALL")
    base = first_true(
        [
            (upper.contains("VALVE"), "VALVE"),
            (upper.contains("FLANGE"), "FLANGE"),
            (upper.contains("PIPE"), "PIPE"),
            (upper.contains("GASKET"), "GASKET"),
            (upper.contains("FASTENER") | upper.contains("BOLT"), "STUD_BOLT"),
            (upper.contains("FITTING"), "FITTING"),
        ],
        upper,
    )
    base = F.when(wanted, base)

    def sub(kind):
        return first_true([(upper.contains(w), w) for w in SUB_TYPES[kind]])

    return base, F.when(base == "VALVE", sub("VALVE")).when(base == "FLANGE", sub("FLANGE"))


def first_word(text: Column) -> Column:
    """First word of the query text when it has at least three characters."""
    word = F.regexp_extract(text, r"(?U)^\s*(\S+)", 1)
    return F.when(F.length(word) >= 3, F.lower(word))


def search_shapes(requests: DataFrame, missing_type: str | None = None) -> DataFrame:
    """Requests with their search key columns and the id of their shape.

    ``missing_type="GENERAL"`` searches type GENERAL when a request has no type; by default such
    a request searches all types.
    """
    kind = F.coalesce(F.nullif(F.col("item_type"), F.lit("")), F.lit(missing_type).cast("string"))
    base, sub = resolve_type(kind)
    out = requests.withColumns(
        {
            "base_type": F.coalesce(base, F.lit(ANY)),
            "sub_type": F.coalesce(sub, F.lit("")),
            "find_size": F.col("size_nb_mm"),
            "find_metal": F.lower(F.nullif(F.col("metallurgy"), F.lit(""))),
            "find_class": F.when(F.col("pressure_class") != 0, F.col("pressure_class")),
            "find_word": first_word(F.col("query_text")),
        }
    )
    parts = ["cpse", "base_type", "sub_type", "find_size", "find_metal", "find_class", "find_word"]
    return out.withColumn("shape_id", row_key(parts))


def row_key(parts: list[str]) -> Column:
    """Key of a combination of columns.

    Never null, so a join on it needs no null check; such a check would be pushed down and repeat the
    expressions behind the key.
    """
    return F.coalesce(F.md5(F.to_json(F.struct(*parts))), F.lit(""))


def contains_like(text: Column, needle: Column) -> Column:
    """``text ILIKE '%needle%'`` for lower-case columns; wildcards in the needle keep their meaning."""
    plain = ~needle.rlike(r"[%_\\]")
    return F.when(plain, text.contains(needle)).otherwise(
        F.like(text, F.concat(F.lit("%"), needle, F.lit("%")))
    )


def _lowest(df: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """The ``limit`` lowest SKUs of each key."""
    order = Window.partitionBy(*keys).orderBy("sku_code")
    return df.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= limit).drop("__n")


def _sub_types(text: Column) -> Column:
    """The sub types of ``item_type`` an item is found under; the empty one is all of them."""
    subs = F.array(F.lit(""))
    for kind, words in SUB_TYPES.items():
        hits = F.array_compact(F.array(F.lit(""), *[F.when(text.contains(w.lower()), w) for w in words]))
        subs = F.when(F.col("item_type") == kind, hits).otherwise(subs)
    return subs


# Arrays are unfolded with ``explode_outer`` here and in the other operators: for a plain ``explode`` Spark
# adds a filter on the array's size, pushes it down and so computes the array twice.
def _under_keys(items: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows with cpse, item_type and subs under every (type, sub type) key of ``asked``."""
    places = F.concat(
        F.transform("subs", lambda s: F.struct(F.col("item_type").alias("base_type"), s.alias("sub_type"))),
        F.array(F.struct(F.lit(ANY).alias("base_type"), F.lit("").alias("sub_type"))),
    )
    rest = [c for c in items.columns if c not in ("cpse", "item_type", "subs")]
    opened = items.select("cpse", F.explode_outer(places).alias("__place"), *rest)
    return opened.select("cpse", "__place.base_type", "__place.sub_type", *rest).join(asked, KEYS, "left_semi")


def _word_search(texts: DataFrame, shapes: DataFrame, broadcast_words: int) -> DataFrame:
    """(KEYS, value, text): the requested words in the distinct texts of each key.

    The distinct words travel to the texts as a broadcast while there are at most
    ``broadcast_words`` of them (counted first). Beyond that, words and texts meet on a
    three-letter piece of the word, so the work is a shuffle join on equal keys.
    """
    words = shapes.filter("find_word is not null").select(*KEYS, "find_word").distinct()
    if words.limit(broadcast_words + 1).count() <= broadcast_words:
        grouped = words.groupBy(*KEYS).agg(F.collect_set("find_word").alias("__asked"))
        hits = F.filter("__asked", lambda w: contains_like(F.col("text"), w))
        found = texts.join(F.broadcast(grouped), KEYS).select(*KEYS, F.explode_outer(hits).alias("value"), "text")
        return found.filter("value is not null")
    run = F.regexp_extract("find_word", r"([^%_\\]{3,})", 1)
    return (
        texts.withColumn("__piece", F.explode_outer(pieces(F.col("text"))))
        .join(words.withColumn("__piece", anchor(run)), [*KEYS, "__piece"])
        .filter(contains_like(F.col("text"), F.col("find_word")))
        .select(*KEYS, F.col("find_word").alias("value"), "text")
    )


def candidates_by_shape(
    shapes: DataFrame, inventory: DataFrame, limit: int = 50, fill_below: int = 30, broadcast_words: int = 10_000
) -> DataFrame:
    """(shape_id, sku_code, filled) for the distinct shapes; ``filled`` marks items added to fill up."""
    # both are read several times: written, the stock is derived once
    shapes = written(shapes.select("shape_id", *KEYS, "find_size", "find_metal", "find_class", "find_word"))
    items = inventory.select(
        "cpse", "item_type", "sku_code", F.lower("description").alias("text"), F.col("size_nb_mm").cast("double").cast("string").alias("size"),
        F.col("pressure_class").cast("string").alias("class"), F.lower("metallurgy").alias("metal"),
    )
    items = written(items.withColumn("subs", _sub_types(F.col("text"))))
    keys_asked = F.broadcast(shapes.select(*KEYS).distinct())

    def entry(arm, value):
        return F.struct(F.lit(arm).alias("arm"), value.alias("value"))

    # only the lowest SKUs of equal items can be among the lowest of a list, so most items end here, before they are put under their keys
    kind = ["cpse", "item_type", "subs"]
    alike = written(_under_keys(_lowest(items.drop("text"), [*kind, "size", "class", "metal"], limit), keys_asked))
    told = _under_keys(_lowest(items.select(*kind, "text", "sku_code").filter("text is not null"), [*kind, "text"], limit), keys_asked)
    told = written(told)
    worded = _word_search(told.select(*KEYS, "text").distinct(), shapes, broadcast_words).join(told, [*KEYS, "text"])
    lists = F.array(
        entry("pool", F.lit("")),
        entry("size", F.col("size")),
        entry("class", F.col("class")),
        entry("metal", F.col("metal")),
    )
    listed = alike.select(*KEYS, "sku_code", F.explode_outer(lists).alias("__e")).select("__e.arm", *KEYS, "__e.value", "sku_code").filter("value is not null")
    listed = listed.unionByName(worded.select(F.lit("word").alias("arm"), *KEYS, "value", "sku_code"))
    skus = F.array_sort(F.collect_list("sku_code"))  # at most ``limit`` per key
    short = _lowest(listed, ["arm", *KEYS, "value"], limit).groupBy("arm", *KEYS, "value").agg(skus.alias("skus"))
    # what the shapes ask for; classes and metals are first widened to the stocked values that serve them
    asks = F.array(
        entry("pool", F.lit("")),
        entry("size", F.col("find_size").cast("string")),
        entry("class", F.col("find_class").cast("string")),
        entry("metal", F.col("find_metal")),
        entry("word", F.col("find_word")),
    )
    asked = shapes.select("shape_id", *KEYS, F.explode_outer(asks).alias("__a")).select("shape_id", "__a.arm", *KEYS, F.col("__a.value").alias("ask")).filter("ask is not null")
    distinct = asked.select("arm", *KEYS, "ask").distinct()
    stocked = (
        alike.select(*KEYS, F.explode_outer(F.array(entry("class", F.col("class")), entry("metal", F.col("metal")))).alias("__e"))
        .select("__e.arm", *KEYS, "__e.value")
        .filter("value is not null")
        .distinct()
    )
    serves = F.when(F.col("arm") == "class", F.col("value").cast("int") >= F.col("ask").cast("int")).otherwise(
        contains_like(F.col("value"), F.col("ask"))
    )
    widened = distinct.join(stocked, ["arm", *KEYS]).filter(serves)
    equal = distinct.filter(~F.col("arm").isin("class", "metal")).withColumn("value", F.col("ask"))

    def lowest_of(lists):
        return F.slice(F.array_sort(F.array_distinct(F.flatten(lists))), 1, limit)

    answers = (
        widened.unionByName(equal)
        .join(short, ["arm", *KEYS, "value"])
        .groupBy("arm", *KEYS, "ask")
        .agg(lowest_of(F.collect_list("skus")).alias("skus"))
    )
    # five short lists per shape become its candidates inside one row
    merged = (
        asked.join(answers, ["arm", *KEYS, "ask"])
        .groupBy("shape_id")
        .agg(
            lowest_of(F.collect_list(F.when(F.col("arm") != "pool", F.col("skus")))).alias("hits"),
            F.flatten(F.collect_list(F.when(F.col("arm") == "pool", F.col("skus")))).alias("pool"),
        )
    )
    room = F.lit(limit) - F.size("hits")
    fill = F.when(F.size("hits") < fill_below, F.slice(F.array_except("pool", "hits"), F.lit(1), room)).otherwise(
        F.array().cast("array<string>")
    )

    def tagged(skus, filled):
        return F.transform(skus, lambda s: F.struct(s.alias("sku_code"), F.lit(filled).alias("filled")))

    picked = merged.select("shape_id", F.explode_outer(F.concat(tagged("hits", 0), tagged(fill, 1))).alias("__c"))
    return picked.select("shape_id", "__c.sku_code", "__c.filled").filter("sku_code is not null")


def retrieve(requests: DataFrame, inventory: DataFrame, **options) -> DataFrame:
    """Candidates of each request: request columns, ``sku_code``, ``filled`` and the ``item`` as a struct."""
    missing = options.pop("missing_type", None)
    shaped = search_shapes(requests, missing)
    shapes = shaped.select("shape_id", *KEYS, "find_size", "find_metal", "find_class", "find_word").dropDuplicates(["shape_id"])
    found = candidates_by_shape(shapes, inventory, **options)
    items = inventory.select("sku_code", F.struct(*inventory.columns).alias("item"))
    return shaped.select("shape_id", *requests.columns).join(found.join(items, "sku_code"), "shape_id").drop("shape_id")
