"""Training sets, splits and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.attributes import metallurgy_of, normalize_pressure, normalize_size
from ..functions.values import number_in
from ..session import checkpointed, written
from .ordering import hash_order, hash_positions, same_keys_join

# Spellings used when spans of known attributes are looked up in descriptions.
TYPE_SPELLINGS = {
    "FLANGE_WELD_NECK": ("FLG WN", "FLANGE WELD NECK", "FLANGE, WELDING NECK", "FLG-WN", "WELD NECK FLANGE", "FLG"),
    "FLANGE_BLIND": ("FLG BLD", "BLIND FLANGE", "FLANGE, BLIND", "FLG-BLD", "BLD FLG"),
    "FLANGE_SLIP_ON": ("FLG SO", "SLIP ON FLANGE", "FLANGE, SLIP-ON", "FLG-SO", "SO FLG"),
    "GATE_VALVE": ("VLV GT", "GATE VALVE", "VALVE, GATE", "VLV-GT", "GT VLV", "VALVE GATE"),
    "BALL_VALVE": ("VLV BL", "BALL VALVE", "VALVE, BALL", "VLV-BL", "BL VLV"),
    "GLOBE_VALVE": ("VLV GLB", "GLOBE VALVE", "VALVE, GLOBE", "VLV-GL", "GLB VLV"),
    "SPIRAL_WOUND_GASKET": ("GSKT SPWD", "SPIRAL WOUND GASKET", "GASKET, SPIRAL WOUND", "GSKT-SW", "SPWD GSKT"),
    "STUD_BOLT": ("STUDBLT", "STUD BOLT", "STUD BOLT WITH NUTS", "BLT-STUD", "STUD BOLTS"),
}
FACING_SPELLINGS = {
    "RF": ("RF", "RAISED FACE", "RF FACING", "WNRF"), "RTJ": ("RTJ", "RING TYPE JOINT", "RTJ FACING"),
    "FF": ("FF", "FLAT FACE", "FF FACING"), "BW": ("BW", "BUTT WELD", "BW ENDS"),
    "SW": ("SW", "SOCKET WELD", "SW ENDS"), "THRD": ("THRD", "THREADED", "NPT THREADED"),
}
CLASS_SPELLINGS = {
    150: ("150#", "150LB", "CLASS 150", "CL150", "PN20", "150 LBS", "CL-150"),
    300: ("300#", "300LB", "CLASS 300", "CL300", "PN50", "300 LBS", "CL-300"),
    600: ("600#", "600LB", "CLASS 600", "CL600", "PN100", "600 LBS", "CL-600"),
    900: ("900#", "900LB", "CLASS 900", "CL900", "PN150", "900 LBS", "CL-900"),
    1500: ("1500#", "1500LB", "CLASS 1500", "CL1500", "PN250", "1500 LBS", "CL-1500"),
}
METAL_SPELLINGS = {
    "ASTM A105": ("A105", "ASTM A105", "ASTM A105N", "CS A105", "CARBON STEEL A105"),
    "ASTM A350 LF2": ("A350-LF2", "A350LF2", "ASTM A350 LF2", "LF2", "LTCS A350 LF2"),
    "ASTM A182 F304": ("SS304", "ASTM A182 F304", "F304", "AISI 304", "SS-304"),
    "ASTM A182 F316": ("SS316", "ASTM A182 F316", "F316", "AISI 316", "SS-316", "SS316L"),
    "ASTM A216 WCB": ("WCB", "ASTM A216 WCB", "A216-WCB", "CAST STEEL WCB"),
    "SS316 / GRAPHITE": ("SS316/GRAF", "SS316-GR", "SS316 / GRAPHITE", "316SS/GRAPHITE"),
    "SS304 / GRAPHITE": ("SS304/GRAF", "SS304-GR", "SS304 / GRAPHITE"),
    "ASTM A193 B7 / A194 2H": ("B7/2H", "B7-2H", "ASTM A193 B7", "GR B7 / 2H"),
    "ASTM A320 L7 / A194 7": ("L7/GR7", "L7-GR7", "ASTM A320 L7", "GR L7 / 7"),
}
# The canonical master's axes.
SIZES = (
    (15.0, '1/2"', "DN15"), (25.0, '1"', "DN25"), (40.0, '1.5"', "DN40"), (50.0, '2"', "DN50"), (80.0, '3"', "DN80"),
    (100.0, '4"', "DN100"), (150.0, '6"', "DN150"), (200.0, '8"', "DN200"), (250.0, '10"', "DN250"), (300.0, '12"', "DN300"),
)
MASTER_CLASSES = (150, 300, 600, 900, 1500)
MASTER_TYPES = (
    ("FLANGE_WELD_NECK", "FLANGE, WELD NECK", ("ASTM A105", "ASTM A350 LF2", "ASTM A182 F304", "ASTM A182 F316"), ("RF", "RTJ"), ("ASME B16.5",), "40171501", "GEM-FLANGE-WN"),
    ("FLANGE_BLIND", "FLANGE, BLIND", ("ASTM A105", "ASTM A350 LF2", "ASTM A182 F316"), ("RF", "RTJ"), ("ASME B16.5",), "40171501", "GEM-FLANGE-BL"),
    ("FLANGE_SLIP_ON", "FLANGE, SLIP ON", ("ASTM A105", "ASTM A182 F304", "ASTM A182 F316"), ("RF", "FF"), ("ASME B16.5",), "40171501", "GEM-FLANGE-SO"),
    ("GATE_VALVE", "VALVE, GATE", ("ASTM A216 WCB", "ASTM A105", "ASTM A182 F316"), ("RF", "BW"), ("API 600", "API 6D"), "40141611", "GEM-VALVE-GATE"),
    ("BALL_VALVE", "VALVE, BALL", ("ASTM A216 WCB", "ASTM A182 F316"), ("RF", "BW"), ("API 6D",), "40141604", "GEM-VALVE-BALL"),
    ("GLOBE_VALVE", "VALVE, GLOBE", ("ASTM A216 WCB", "ASTM A105"), ("RF",), ("BS 1873", "ASME B16.34"), "40141602", "GEM-VALVE-GLOBE"),
    ("SPIRAL_WOUND_GASKET", "GASKET, SPIRAL WOUND", ("SS316 / GRAPHITE", "SS304 / GRAPHITE"), ("RF",), ("ASME B16.20",), "31161618", "GEM-GASKET-SW"),
    ("STUD_BOLT", "STUD BOLT WITH 2 HEAVY HEX NUTS", ("ASTM A193 B7 / A194 2H", "ASTM A320 L7 / A194 7"), ("THRD",), ("ASME B18.2.1",), "31161501", "GEM-BOLT-STUD"),
)
# Commodity and category trees (code, title, level, parent) and (id, name, parent).
COMMODITIES = (
    ("40000000", "Industrial Manufacturing and Processing Machinery and Accessories", "Segment", "ROOT"),
    ("40140000", "Fluid and gas distribution", "Family", "40000000"), ("40141600", "Valves", "Class", "40140000"),
    ("40141611", "Gate valves", "Commodity", "40141600"), ("40141604", "Ball valves", "Commodity", "40141600"),
    ("40141602", "Globe valves", "Commodity", "40141600"), ("40141601", "Check valves", "Commodity", "40141600"),
    ("40141603", "Butterfly valves", "Commodity", "40141600"), ("40171500", "Industrial pipe fittings", "Class", "40140000"),
    ("40171501", "Pipe flanges", "Commodity", "40171500"), ("40171502", "Pipe elbows", "Commodity", "40171500"),
    ("40171503", "Pipe tees", "Commodity", "40171500"), ("40171504", "Pipe reducers", "Commodity", "40171500"),
    ("31000000", "Manufacturing Components and Supplies", "Segment", "ROOT"),
    ("31160000", "Hardware and fasteners", "Family", "31000000"), ("31161500", "Bolts", "Class", "31160000"),
    ("31161501", "Stud bolts", "Commodity", "31161500"), ("31161600", "Gaskets and seals", "Class", "31160000"),
    ("31161618", "Spiral wound gaskets", "Commodity", "31161600"), ("31161601", "Ring joint gaskets", "Commodity", "31161600"),
)
CATEGORIES = (
    ("GEM-IND-001", "Industrial Goods & Mechanical Spares", "ROOT"), ("GEM-VALVE-001", "Industrial Valves", "GEM-IND-001"),
    ("GEM-VALVE-GATE", "Gate Valves - Cast & Forged Steel", "GEM-VALVE-001"),
    ("GEM-VALVE-BALL", "Ball Valves - High Pressure Hydrocarbon", "GEM-VALVE-001"),
    ("GEM-VALVE-GLOBE", "Globe Valves - Industrial Process", "GEM-VALVE-001"),
    ("GEM-FLANGE-001", "Steel Pipe Flanges & Fittings", "GEM-IND-001"),
    ("GEM-FLANGE-WN", "Weld Neck Flanges - ASME B16.5", "GEM-FLANGE-001"),
    ("GEM-FLANGE-BL", "Blind Flanges - ASME B16.5", "GEM-FLANGE-001"),
    ("GEM-FLANGE-SO", "Slip-On Flanges - ASME B16.5", "GEM-FLANGE-001"),
    ("GEM-GASKET-001", "Industrial Gaskets & Jointing Materials", "GEM-IND-001"),
    ("GEM-GASKET-SW", "Spiral Wound Gaskets Metallic", "GEM-GASKET-001"),
    ("GEM-FASTENER-001", "High Tensile Fasteners & Studs", "GEM-IND-001"),
    ("GEM-BOLT-STUD", "Alloy Steel Stud Bolts with Nuts - ASTM A193", "GEM-FASTENER-001"),
)
SPEC = ["size_nb_mm", "pressure_class", "metallurgy"]


def mine_pairs(items: DataFrame, item_id: str = "item_id", positives: int = 5, negatives: int = 15, seed: int = 42, replacement: bool = False) -> DataFrame:
    """Positive and hard negative partners of each item: (query, candidate, label).

    Positives share type, size, class and metal; hard negatives share the type only. An item
    alone in its specification is its own positive; an item whose type has one specification gets
    negatives of other types. Items without a type are a type of their own. Sampling is without replacement, so a small group gives fewer partners;
    with ``replacement`` each draw is a hash of its own (item, kind, number) taken to a place in the group, and every item gets all its
    positives and negatives, repeated rows included.

    Nothing lists the pairs of a group. Items get a position: types in order, specifications inside a
    type, hash order inside a specification. An item's partners are positions computed from its own
    (the next ones in its specification; spread steps through the rest of its type), and a join on
    positions fetches them. So the work is (positives + negatives) rows per item, however large a group is.
    """
    spec = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in SPEC])
    base = items.withColumns({"__spec": spec, "__h": hash_order(F.col(item_id), seed=seed)})
    placed = hash_positions(base, ["item_type", "__spec"], "__h", "__in_spec", "__spec_size")
    blocks = base.groupBy("item_type", "__spec").agg(F.count("*").alias("__rows"))
    # running sums over the blocks: one row per specification, ordered inside a type
    by_type = Window.partitionBy("item_type").orderBy("__spec")
    blocks = blocks.withColumn("__spec_start", F.coalesce(F.sum("__rows").over(by_type.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    types = base.groupBy("item_type").agg(F.count("*").alias("__type_size"))
    first = Window.partitionBy(F.lit(0)).orderBy("item_type")  # one row per item type
    types = types.withColumns(
        {
            "__type_start": F.coalesce(F.sum("__type_size").over(first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "__all": F.sum("__type_size").over(Window.partitionBy(F.lit(0))),
        }
    )
    placed = same_keys_join(placed, blocks.drop("__rows"), ["item_type", "__spec"])
    placed = same_keys_join(placed, types, ["item_type"])
    placed = placed.withColumn("__pos", F.col("__type_start") + F.col("__spec_start") + F.col("__in_spec"))
    m, n = F.col("__spec_size"), F.col("__type_size")
    spec_at = F.col("__type_start") + F.col("__spec_start")
    own_type = n > m

    def spread(count, room, draw):
        """``count`` different offsets below ``room``, starting at a drawn one."""
        step = F.greatest(F.lit(1), F.floor(room / count))
        return F.transform(
            F.sequence(F.lit(0), F.greatest(F.least(F.lit(count).cast("long"), room) - 1, F.lit(0))),
            lambda j: (draw + j * step) % F.greatest(room, F.lit(1)),
        )

    draw = F.conv(F.substring("__h", 4, 12), 16, 10).cast("long")
    plus = F.when(
        m > 1,
        F.transform(
            F.sequence(F.lit(1), F.greatest(F.least(F.lit(positives).cast("long"), m - 1), F.lit(1))),
            lambda j: spec_at + (F.col("__in_spec") + j) % m,
        ),
    ).otherwise(F.array(F.col("__pos")))
    outside_spec = F.transform(
        spread(negatives, n - m, draw % F.greatest(n - m, F.lit(1))),
        lambda o: F.col("__type_start") + F.when(o < F.col("__spec_start"), o).otherwise(o + m),
    )
    others = F.col("__all") - n
    outside_type = F.transform(
        spread(negatives, others, draw % F.greatest(others, F.lit(1))),
        lambda o: F.when(o < F.col("__type_start"), o).otherwise(o + n),
    )
    minus = F.when(own_type, outside_spec).when(others > 0, outside_type).otherwise(F.array().cast("array<bigint>"))
    if replacement:

        def drawn(kind, count, room, place):
            """``count`` independent places below ``room``."""

            def one(j):
                digits = F.substring(hash_order(F.col(item_id), F.concat(F.lit(kind), j.cast("string")), seed=seed), 1, 12)
                return place(F.conv(digits, 16, 10).cast("long") % F.greatest(room, F.lit(1)))

            return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), one)

        plus = drawn("p", positives, m - 1, lambda d: F.when(m > 1, spec_at + (F.col("__in_spec") + 1 + d) % m).otherwise(F.col("__pos")))
        outside_spec = drawn("n", negatives, n - m, lambda d: F.col("__type_start") + F.when(d < F.col("__spec_start"), d).otherwise(d + m))
        outside_type = drawn("n", negatives, others, lambda d: F.when(d < F.col("__type_start"), d).otherwise(d + n))
        minus = F.when(own_type, outside_spec).otherwise(outside_type)
    wanted = placed.filter((n > m) | (others > 0)).select(
        F.col(item_id).alias("query_id"),
        F.explode_outer(
            F.concat(
                F.transform(plus, lambda p: F.struct(p.cast("long").alias("pos"), F.lit(1).alias("label"))),
                F.transform(minus, lambda p: F.struct(p.cast("long").alias("pos"), F.lit(0).alias("label"))),
            )
        ).alias("w"),
    )
    at = placed.select(F.col("__pos").cast("long").alias("pos"), F.col(item_id).alias("candidate_id"))
    return wanted.select("query_id", F.col("w.pos").alias("pos"), F.col("w.label").alias("label")).join(at, "pos").select(
        "query_id", "candidate_id", "label"
    )


def pair_features_table(pairs: DataFrame, items: DataFrame, item_id: str, text: str = "canonical_description") -> DataFrame:
    """Mined pairs with the attributes of both sides."""
    q = items.select(F.col(item_id).alias("query_id"), *[F.col(c).alias("q_" + c) for c in items.columns if c != item_id])
    c = items.select(F.col(item_id).alias("candidate_id"), *[F.col(c).alias("c_" + c) for c in items.columns if c != item_id])
    return pairs.join(q, "query_id").join(c, "candidate_id")


def stratified_split(rows: DataFrame, row_id: str, label: str = "label", share: float = 0.2, seed: int = 42) -> DataFrame:
    """Add ``split``: ceil(share) of each label for validation, by hash order. Rows without a label are split like a label."""
    placed = hash_positions(rows.withColumn("__h", hash_order(F.col(row_id), seed=seed)), [label], "__h", "__pos", "__n")
    # share as a ratio of integers keeps the ceiling exact
    held = F.greatest(F.lit(1), F.ceil(F.col("__n") * F.lit(int(round(share * 100))) / 100))
    return placed.withColumn("split", F.when(F.col("__pos") < held, "validation").otherwise("train")).drop("__h", "__pos", "__n")


def check_labels(rows: DataFrame, label: str = "label") -> None:
    """At least two rows of each of the labels 0 and 1."""
    counts = {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count("*").alias("n")).limit(3).collect()}
    if set(counts) != {0, 1} or min(counts.values()) < 2:
        raise ValueError(f"labels 0 and 1 need two rows each, found {counts}")


def group_split(rows: DataFrame, group: str = "canonical_id", share: float = 0.15, seed: int = 42) -> DataFrame:
    """Add ``split`` so that no group is on both sides; at least one group on each. Rows without a group are one group."""
    groups = rows.select(group).distinct().withColumn("__h", hash_order(F.col(group), seed=seed)).withColumn("__one", F.lit(0))
    placed = hash_positions(groups, ["__one"], "__h", "__pos", "__n")
    held = F.least(F.col("__n") - 1, F.greatest(F.lit(1), F.bround(F.col("__n") * share).cast("long")))
    sides = placed.select(group, F.when(F.col("__pos") < held, "heldout").otherwise("train").alias("split"))
    return same_keys_join(rows, sides, [group])


def area_under_curve(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Rank-based AUC, ties count half.

    Counts per distinct score come from a map-side aggregate and are range-partitioned by score into
    the checkpoint folder. Negatives below a score are a running sum inside its partition plus the
    sums of the partitions before, which are one row per partition.
    """
    counts = scored.groupBy(score).agg(
        F.count_if(F.col(label) == 1).alias("__p"), F.count_if(F.col(label) == 0).alias("__n")
    )
    parts = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    banded = checkpointed(counts.repartitionByRange(parts, score).withColumn("__band", F.spark_partition_id()))
    inside = Window.partitionBy("__band").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    bands = banded.groupBy("__band").agg(F.sum("__n").alias("__band_n"))
    across = Window.partitionBy(F.lit(0)).orderBy("__band").rowsBetween(Window.unboundedPreceding, -1)  # one row per band
    bands = bands.select("__band", F.coalesce(F.sum("__band_n").over(across), F.lit(0)).alias("__before"))
    below = F.coalesce(F.sum("__n").over(inside), F.lit(0))
    joined = banded.withColumn("__below", below).join(F.broadcast(bands), "__band")
    wins = F.sum(F.col("__p") * (F.col("__below") + F.col("__before") + F.col("__n") * 0.5))
    return joined.agg(
        F.try_divide(wins, (F.sum("__p") * F.sum("__n")).cast("double")).alias("auc"), F.sum("__p").alias("positives"), F.sum("__n").alias("negatives")
    )


def retrieval_tables(records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(queries, corpus, relevance) of contrastive records (record_id, anchor, positive, canonical_id)."""
    doc = F.coalesce(F.nullif(F.col("canonical_id").cast("string"), F.lit("")), F.concat(F.lit("document-"), F.col("record_id").cast("string")))
    query = F.concat(F.lit("query-"), F.col("record_id").cast("string"))
    rows = records.withColumns({"document_id": doc, "query_id": query})
    corpus = rows.groupBy("document_id").agg(F.max_by("positive", "record_id").alias("text"))
    return rows.select("query_id", F.col("anchor").alias("text")), corpus, rows.select("query_id", "document_id")


def retrieval_metrics(ranked: DataFrame, relevance: DataFrame, query_id: str = "query_id", item_id: str = "document_id", by: tuple[str, ...] = ()) -> DataFrame:
    """Recall at 1, 5 and 10 and mean reciprocal rank at 10 of ranked hits (query, item, rank).

    With ``by`` both tables carry these columns and there is one row for each of their values.
    """
    hits = relevance.join(ranked.select(*by, query_id, item_id, "rank"), [*by, query_id, item_id], "left")
    best = hits.groupBy(*by, query_id).agg(F.min("rank").alias("rank"))
    return best.groupBy(*by).agg(
        F.count("*").alias("queries"),
        *[F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)).alias(f"recall_at_{k}") for k in (1, 5, 10)],
        F.avg(F.when(F.col("rank") <= 10, 1.0 / F.col("rank")).otherwise(0.0)).alias("mrr_at_10"),
    )


def train_ranker(rows: DataFrame, features: str = "features", label: str = "label", row_id: str = "row_id", trees: int = 500, depth: int = 5, rate: float = 0.05):
    """Boosted trees on the ranking features with the validation split: (model, AUC table).

    The rows are written once with their split: the label check, both sides of the training and the check of the model read them.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    parts = written(stratified_split(rows.select(row_id, label, features), row_id, label))
    check_labels(parts, label)
    parts = parts.withColumn("__v", array_to_vector(F.col(features))).withColumn("__check", F.col("split") == "validation")
    learner = GBTClassifier(
        featuresCol="__v", labelCol=label, maxIter=trees, maxDepth=depth, stepSize=rate, seed=42, validationIndicatorCol="__check"
    )
    model = learner.fit(parts)
    held = model.transform(parts.filter("__check")).withColumn("score", vector_to_array("probability")[1])
    return model, area_under_curve(held, "score", label)


def bio_tags(tokens: DataFrame, spans: DataFrame) -> DataFrame:
    """B/I/O label of each token from labelled spans; a later span overwrites an earlier one.

    tokens: text_id, token_no, start, end. spans: text_id, span_no, start, end, label.
    """
    s = spans.select("text_id", "span_no", F.col("start").alias("s"), F.col("end").alias("e"), "label")
    hits = tokens.join(s, "text_id").filter((F.col("end") > F.col("s")) & (F.col("start") < F.col("e")))
    first = F.row_number().over(Window.partitionBy("text_id", "span_no").orderBy("token_no")) == 1
    marked = hits.withColumn("tag", F.concat(F.when(first, "B-").otherwise("I-"), F.col("label")))
    last = marked.groupBy("text_id", "token_no").agg(F.max_by("tag", "span_no").alias("tag"))
    return tokens.join(last, ["text_id", "token_no"], "left").withColumn("tag", F.coalesce("tag", F.lit("O")))


def entity_scores(predicted: DataFrame, truth: DataFrame, labels) -> DataFrame:
    """F1 per label over exact spans (text_id, start, end, label) and the macro mean over all labels."""
    keys = ["text_id", "start", "end", "label"]
    sides = predicted.select(*keys).distinct().withColumn("p", F.lit(1)).join(truth.select(*keys).distinct().withColumn("t", F.lit(1)), keys, "full")
    counts = sides.groupBy("label").agg(
        F.count_if(F.col("p").isNotNull() & F.col("t").isNotNull()).alias("tp"),
        F.count_if(F.col("p").isNotNull() & F.col("t").isNull()).alias("fp"),
        F.count_if(F.col("p").isNull() & F.col("t").isNotNull()).alias("fn"),
    )
    spark = predicted.sparkSession
    all_labels = spark.createDataFrame([(x,) for x in labels], "label string")
    zero = F.lit(0)
    rows = all_labels.join(counts, "label", "left").select(
        "label", *[F.coalesce(c, zero).alias(c) for c in ("tp", "fp", "fn")]
    )
    f1 = F.coalesce(F.try_divide(F.col("tp") * 2.0, (F.col("tp") * 2 + F.col("fp") + F.col("fn")).cast("double")), F.lit(0.0))
    rows = rows.withColumn("f1", f1)
    macro = rows.agg(F.lit("macro").alias("label"), *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")], F.avg("f1").alias("f1"))
    return rows.unionByName(macro)


def canonical_master(spark: SparkSession) -> DataFrame:
    """Canonical materials: type x size x class x metal x facing x standard, numbered in this order."""
    kinds = spark.createDataFrame(
        [(i, t, n, list(m), list(f), list(s), u, g) for i, (t, n, m, f, s, u, g) in enumerate(MASTER_TYPES)],
        "type_no int, item_type string, type_name string, metals array<string>, facings array<string>, standards array<string>, unspsc_code string, gem_category_id string",
    )
    sizes = F.array(*[F.struct(F.lit(mm).alias("mm"), F.lit(inch).alias("inch"), F.lit(dn).alias("dn")) for mm, inch, dn in SIZES])
    rows = kinds.select("*", F.posexplode(sizes).alias("size_no", "size"))
    rows = rows.select("*", F.posexplode(F.array(*[F.lit(c) for c in MASTER_CLASSES])).alias("class_no", "pressure_class"))
    rows = rows.select("*", F.posexplode("metals").alias("metal_no", "metallurgy"))
    rows = rows.select("*", F.posexplode("facings").alias("facing_no", "facing_end"))
    rows = rows.select("*", F.posexplode("standards").alias("standard_no", "standard"))
    # a fixed product of short lists (1,750 rows), so one ordered window numbers it
    order = Window.partitionBy(F.lit(0)).orderBy("type_no", "size_no", "class_no", "metal_no", "facing_no", "standard_no")
    rows = rows.withColumn("n", F.row_number().over(order))
    text = F.concat(
        F.col("type_name"), F.lit(", "), F.col("size.inch"), F.lit(" ("), F.col("size.dn"), F.lit("), CLASS "), F.col("pressure_class").cast("string"),
        F.lit(", "), F.col("metallurgy"), F.lit(", "), F.col("facing_end"), F.lit(" FACING, "), F.col("standard"),
    )
    return rows.select(
        F.format_string("CAN-%06d", "n").alias("canonical_id"), "item_type", F.col("size.mm").alias("size_nb_mm"),
        F.col("size.inch").alias("size_inch"), F.col("size.dn").alias("dn_code"), "pressure_class", "metallurgy", "facing_end",
        "standard", text.alias("canonical_description"), "unspsc_code", "gem_category_id",
    )


def type_codes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, u, g) for t, _, _, _, _, u, g in MASTER_TYPES], "item_type string, unspsc_code string, gem_category_id string")


def commodities(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(COMMODITIES), "code string, title string, level string, parent_code string")


def categories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CATEGORIES), "code string, title string, parent_code string")


def ancestor_paths(tree: DataFrame, view: str = "sparemesh_tree") -> DataFrame:
    """Depth and path from the root of every code of a taxonomy."""
    tree.createOrReplaceTempView(view)
    return tree.sparkSession.sql(
        f"""WITH RECURSIVE walk(code, title, depth, path) AS (
                SELECT code, title, 1, code FROM {view} WHERE parent_code = 'ROOT'
                UNION ALL
                SELECT c.code, c.title, w.depth + 1, concat(w.path, '/', c.code)
                FROM walk w JOIN {view} c ON c.parent_code = w.code
            ) SELECT code, title, depth, path FROM walk"""
    )


def spellings(spark: SparkSession) -> DataFrame:
    """(label, value, spelling) of all known spellings."""
    rows = []
    for label, table in (
        ("ITEM_TYPE", TYPE_SPELLINGS), ("FACING_END", FACING_SPELLINGS), ("PRESSURE_RATING", CLASS_SPELLINGS), ("METALLURGY", METAL_SPELLINGS),
    ):
        rows += [(label, str(value), s) for value, words in table.items() for s in words]
    return spark.createDataFrame(rows, "label string, value string, spelling string")


def label_spans(descriptions: DataFrame, text_id: str = "text_id", text: str = "text") -> DataFrame:
    """Spans of known attributes in descriptions: the earliest, then longest spelling per label.

    The attributes come as columns item_type, pressure_class, metallurgy and facing_end; the spellings are a
    fixed list, held as literal arrays per value.
    """
    columns = {"ITEM_TYPE": "item_type", "FACING_END": "facing_end", "PRESSURE_RATING": "pressure_class", "METALLURGY": "metallurgy"}
    tables = {"ITEM_TYPE": TYPE_SPELLINGS, "FACING_END": FACING_SPELLINGS, "PRESSURE_RATING": CLASS_SPELLINGS, "METALLURGY": METAL_SPELLINGS}
    found = []
    for label, column in columns.items():
        known = F.create_map(*[x for v, words in tables[label].items() for x in (F.lit(str(v)), F.array(*[F.lit(w) for w in words]))])
        value = F.col(column).cast("string")
        words = F.coalesce(F.try_element_at(known, value), F.array(value))
        spans = F.filter(
            F.transform(
                words,
                lambda w: F.struct(F.instr(F.col(text), w).alias("at"), (-F.length(w)).alias("shorter"), w.alias("word")),
            ),
            lambda s: s["at"] > 0,
        )
        best = F.try_element_at(F.array_sort(spans), F.lit(1))
        found.append(
            F.when(
                best.isNotNull(),
                F.struct(F.lit(label).alias("label"), (best["at"] - 1).alias("start"), (best["at"] - 1 - best["shorter"]).alias("end"), best["word"].alias("word")),
            )
        )
    spans = F.array_compact(F.array(*found))
    return descriptions.select(text_id, F.explode_outer(spans).alias("s")).select(text_id, "s.label", "s.start", "s.end", "s.word").filter("label is not null")



# Entity labels and the attribute each one fills.
ENTITY_FIELDS = {
    "ITEM_TYPE": "item_type", "SIZE": "size_nb_mm", "PRESSURE_RATING": "pressure_class", "METALLURGY": "metallurgy",
    "FACING_END": "facing_end", "STANDARD": "standard", "INDIAN_STANDARD": "indian_standard", "OISD_STANDARD": "oisd_standard",
    "EIL_SPECIFICATION": "eil_specification", "GEM_CATEGORY": "gem_category", "GEM_BID_NUMBER": "gem_bid_number",
    "CPPP_TENDER_ID": "cppp_tender_id", "MESC_CODE": "mesc_code", "MANUFACTURER": "manufacturer", "PRODUCT_FORM": "product_form",
    "COATING": "coating", "INSPECTION_CLASS": "inspection_class", "DOCUMENT_NUMBER": "document_number", "PROJECT": "project",
    "END_CONNECTION": "end_connection", "TEMPERATURE_RATING": "temperature_rating", "PURCHASE_ORDER": "purchase_order",
    "CERTIFICATE_NUMBER": "certificate_number", "BID_NUMBER": "bid_number", "INSPECTION_AGENCY": "inspection_agency",
}


def merge_entities(attributes: DataFrame, entities: DataFrame, text_id: str) -> DataFrame:
    """Tagged entities (text_id, label, word) over pattern attributes: a tag wins, patterns fill the rest.

    The last entity of a label counts, by ``entity_no`` where given.
    """
    order = F.col("entity_no") if "entity_no" in entities.columns else F.col("word")
    labels = list(ENTITY_FIELDS)
    wide = entities.groupBy(F.col("text_id").alias(text_id)).agg(
        *[F.max_by("word", F.when(F.col("label") == lb, order)).alias("__" + lb) for lb in labels]
    )
    out = attributes.join(wide, text_id, "left")
    readers = {"SIZE": normalize_size, "PRESSURE_RATING": normalize_pressure, "METALLURGY": metallurgy_of, "TEMPERATURE_RATING": number_in}
    made = {}
    for label, name in ENTITY_FIELDS.items():
        if name in attributes.columns:
            word = F.nullif(F.col("__" + label), F.lit(""))
            made[name] = F.coalesce(readers[label](word) if label in readers else word, F.col(name))
    if "material_grade" in attributes.columns and "metallurgy" in made:
        made["material_grade"] = F.coalesce(metallurgy_of(F.nullif(F.col("__METALLURGY"), F.lit(""))), F.col("material_grade"))
    return out.withColumns(made).drop(*["__" + lb for lb in labels])
