"""Tables of the product's data model derived from the given star schema.

Every view is a plain DataFrame over whole tables; `oracle_views` holds the same definitions as SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..operators.catalog import lifecycle_status
from ..session import spread

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages",
    "benchmark", "labels", "conversations",
)
DAY_ZERO = 1004918400  # 2001-11-05, just after the last ship date
METALS = ("ASTM A105", "ASTM A350 LF2", "SS304", "SS304L", "SS316", "ASTM A182 F51", "ASTM A335 P11", None)
CLASSES = (150, 300, 600, 900, 1500, 2500)
TYPES = {"ECONOMY": "FLANGE", "STANDARD": "PIPE", "PROMO": "VALVE", "LARGE": "GASKET", "MEDIUM": "STUD_BOLT"}
VALVES = ("GATE", "BALL", "GLOBE", "CHECK", "BUTTERFLY")
FLANGES = ("WN", "BLIND", "SO")
FACINGS = ("RF", "RTJ", "FF", None)
STANDARDS = ("API 600", "API 608", "ASME B16.5", None)
INDIAN = ("IS 2062", "IS 14846", None, None, None)
LOCAL = ("Class-I", "Class-II", None)
GRADES = ("ASTM A105", "ASTM A350 LF2", "A182 F304", "A182 F316L", "A193 B7")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts dealt over all cores: reading their texts takes far longer than reading the file."""
    return spread(table(spark, sf_dir, "part"), "p_partkey")


def pick(key: Column, values) -> Column:
    """One of the values by ``key`` modulo their number."""
    kind = "int" if all(v is None or isinstance(v, int) for v in values) else "string"
    return F.get(F.array(*[F.lit(v).cast(kind) for v in values]), F.pmod(key, F.lit(len(values))).cast("int"))


def _key() -> Column:
    return F.col("p_partkey")


def base_type() -> Column:
    chain = None
    for kind, name in TYPES.items():
        chain = F.when(F.col("p_type") == kind, name) if chain is None else chain.when(F.col("p_type") == kind, name)
    return chain.otherwise("FITTING")


def sub_word() -> Column:
    return F.when(F.col("p_type") == "PROMO", pick(_key(), VALVES)).when(F.col("p_type") == "ECONOMY", pick(_key(), FLANGES))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with engineering attributes."""
    k = _key()
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        base_type().alias("item_type"),
        F.concat_ws(" ", "p_name", sub_word(), base_type()).alias("description"),
        (F.col("p_size") * F.lit(10.0)).alias("size_nb_mm"),
        pick(k, CLASSES).alias("pressure_class"),
        pick(k, METALS).alias("metallurgy"),
        pick(k, FACINGS).alias("facing_end"),
        pick(k, STANDARDS).alias("standard"),
        pick(k, INDIAN).alias("indian_standard"),
        pick(k, LOCAL).alias("make_in_india_class"),
        (F.lit(30.0) + F.pmod(k, F.lit(70))).alias("local_content_percentage"),
        F.col("p_retailprice").alias("unit_cost_inr"),
    )


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier sites: tenant from the region, depot from the nation."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    depots = geo.depots(spark).select("ord", F.col("name").alias("depot_name"))
    rows = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(depots), F.col("ord") == F.col("s_nationkey"))
    region = F.col("n_regionkey").cast("string")
    return rows.select(
        "s_suppkey",
        F.concat(F.lit("T"), region).alias("cpse"),
        F.concat(F.lit("D"), F.col("s_nationkey").cast("string")).alias("depot_id"),
        F.concat("depot_name", F.lit(" Depot, Zone "), region).alias("depot_location"),
    )


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stock of each part at each supplier."""
    stock = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(
        F.sum("l_quantity").alias("qty"),
        F.floor((F.lit(DAY_ZERO) - F.unix_timestamp(F.max("l_shipdate").cast("timestamp"))) / F.lit(86400)).cast("int").alias("days_idle"),
    )
    # sites first: the wide columns of the parts come last and are not shuffled again
    rows = stock.join(sites(spark, sf_dir), F.col("l_suppkey") == F.col("s_suppkey")).join(
        parts(spark, sf_dir), F.col("l_partkey") == F.col("p_partkey")
    )
    quantity = F.col("qty").cast("int")
    return rows.select(
        F.concat(F.lit("SKU-"), F.col("l_partkey").cast("string"), F.lit("-"), F.col("l_suppkey").cast("string")).alias("sku_code"),
        F.concat(F.lit("CAN-"), F.col("l_partkey").cast("string")).alias("canonical_id"),
        "cpse", "depot_id", "depot_location", "item_type", "description", "size_nb_mm", "pressure_class", "metallurgy",
        "facing_end", "standard", "indian_standard", "make_in_india_class", "local_content_percentage",
        quantity.alias("quantity"), "unit_cost_inr", (quantity * F.col("unit_cost_inr")).alias("total_value_inr"), "days_idle",
        lifecycle_status(F.col("days_idle")).alias("status"), (F.col("days_idle") >= 180).alias("is_broadcasted_surplus"),
        F.concat(F.lit("PO-"), F.col("l_suppkey").cast("string")).alias("po_no"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One part request per part."""
    k = _key()
    named = F.pmod(k, F.lit(4)) != 0
    kind = (
        F.when((F.col("item_type") == "VALVE") & named, F.concat(pick(k, VALVES), F.lit("_VALVE")))
        .when((F.col("item_type") == "FLANGE") & named, F.concat(F.lit("FLANGE_"), pick(k, FLANGES)))
        .when((F.col("item_type") == "STUD_BOLT") & named, "FASTENER")
        .otherwise(F.col("item_type"))
    )
    name = F.regexp_extract("description", r"^(\S+ \S+)", 1)
    # dealt over all cores, since the query texts are parsed next
    return spread(parts(spark, sf_dir), "p_partkey").select(
        F.concat(F.lit("R-"), k.cast("string")).alias("request_id"),
        F.concat(F.lit("T"), F.pmod(k, F.lit(5)).cast("string")).alias("cpse"),
        F.concat(name, pick(k, (" IS 2062", " IS 14846", "", "", "", ""))).alias("query_text"),
        kind.alias("item_type"), "size_nb_mm", "pressure_class", "metallurgy",
        pick(k, ("RF", None, None)).alias("facing_end"),
        pick(k, STANDARDS).alias("standard"),
    )


def requisitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One requisition per order with lines; its SKU is the lowest part and supplier of the lines."""
    wide = 1_000_000_000
    line = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min(F.col("l_partkey") * F.lit(wide) + F.col("l_suppkey")).alias("ps"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    depots = geo.depots(spark).select("ord", F.col("name").alias("target_name"))
    rows = (
        table(spark, sf_dir, "orders")
        .join(line, F.col("o_orderkey") == F.col("l_orderkey"))
        .join(sites(spark, sf_dir), F.pmod(F.col("ps"), F.lit(wide)) == F.col("s_suppkey"))
        .join(c, F.col("o_custkey") == F.col("c_custkey"))
        .join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(F.broadcast(depots), F.col("ord") == F.col("c_nationkey"))
    )
    status = F.when(F.col("o_orderstatus") == "F", "DELIVERED").when(F.col("o_orderstatus") == "O", "PENDING_APPROVAL").otherwise("APPROVED")
    return rows.select(
        F.concat(F.lit("REQ-"), F.col("o_orderkey").cast("string")).alias("requisition_id"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
        F.concat(
            F.lit("SKU-"), F.floor(F.col("ps") / F.lit(wide)).cast("long").cast("string"), F.lit("-"), F.pmod(F.col("ps"), F.lit(wide)).cast("string")
        ).alias("sku_code"),
        F.col("cpse").alias("source_cpse"), F.col("depot_location").alias("source_depot"),
        F.concat(F.lit("T"), F.col("n_regionkey").cast("string")).alias("target_cpse"),
        F.concat("target_name", F.lit(" Works")).alias("target_depot"),
        (F.pmod(F.col("o_orderkey"), F.lit(40)) + 1).cast("int").alias("required_qty"),
        F.concat(F.lit("user-"), F.pmod(F.col("o_custkey"), F.lit(97)).cast("string")).alias("requested_by"),
        status.alias("status"),
    )


# Steps of the derived requisition history: kind, days after the order, rule on the order key (divisor, remainder, equal).
STEPS = (
    ("CREATE", 0, 1, 0, True), ("APPROVE", 1, 2, 0, True), ("REJECT", 2, 5, 0, True), ("GATE_PASS", 3, 3, 0, False),
    ("DISPATCH", 4, 4, 3, False), ("DELIVER", 5, 7, 0, False), ("APPROVE", 6, 11, 0, True), ("GATE_PASS", 7, 13, 0, True),
)


def requisition_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workflow events of each order's requisition."""
    k = F.col("o_orderkey")
    steps = []
    for i, (kind, days, divisor, rest, equal) in enumerate(STEPS):
        hit = F.pmod(k, F.lit(divisor)) == rest if equal else F.pmod(k, F.lit(divisor)) != rest
        steps.append(F.when(hit, F.struct(F.lit(i).alias("no"), F.lit(kind).alias("event_type"), F.lit(days).alias("days"))))
    rows = table(spark, sf_dir, "orders").withColumn("e", F.explode(F.array_compact(F.array(*steps))))
    return rows.select(
        (k * 10 + F.col("e.no")).alias("event_id"),
        F.concat(F.lit("REQ-"), k.cast("string")).alias("requisition_id"),
        F.timestamp_add("DAY", F.col("e.days"), F.col("o_orderdate").cast("timestamp")).alias("ts"),
        F.col("e.event_type").alias("event_type"),
        F.concat(F.lit("P-"), F.floor(F.col("o_custkey") / 10).cast("string")).alias("sku_code"),
        (F.pmod(k, F.lit(40)) + 1).cast("int").alias("quantity"),
        F.concat(F.lit("user-"), F.pmod(F.col("o_custkey") + F.col("e.no"), F.lit(97)).cast("string")).alias("actor"),
    )


def stock_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requisition_events(spark, sf_dir).filter(F.col("event_type").isin("CREATE", "REJECT", "DELIVER"))


def opening_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stock of each requested SKU: one group of ten customers shares a SKU."""
    c = table(spark, sf_dir, "customer")
    group = F.floor(F.col("c_custkey") / 10)
    return c.groupBy(group.alias("g")).agg(F.count("*").alias("n")).select(
        F.concat(F.lit("P-"), F.col("g").cast("string")).alias("sku_code"), (F.pmod(F.col("g") * 37, F.lit(400)) + 100).cast("int").alias("quantity")
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users: one per (customer key mod 97), with a tenant and a depot."""
    c = table(spark, sf_dir, "customer").select(F.pmod("c_custkey", F.lit(97)).alias("u")).distinct()
    depots = geo.depots(spark).select("ord", F.col("name").alias("depot_id"))
    rows = c.join(F.broadcast(depots), F.col("ord") == F.pmod(F.col("u"), F.lit(25)))
    return rows.select(
        F.concat(F.lit("user-"), F.col("u").cast("string")).alias("username"),
        F.concat(F.lit("T"), F.pmod(F.col("u"), F.lit(5)).cast("string")).alias("cpse"), "depot_id",
    )


def ledger_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as ledger entries without hashes."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("log_id"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.upper("event_type").alias("action_category"), F.col("event_type").alias("action_name"),
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("actor_name"), F.lit("OPERATOR").alias("actor_role"),
        F.concat(F.lit("T"), F.pmod(F.col("user_id"), F.lit(5)).cast("string")).alias("cpse"), F.lit("D0").alias("depot"),
        F.concat(F.lit("REF-"), F.pmod(F.col("event_id"), F.lit(1000)).cast("string")).alias("reference_id"),
        F.col("props").alias("details"),
    )


def certificates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mill certificate per part, with the values it was written from."""
    k = _key()

    def two(n):
        return F.lpad(n.cast("string"), 2, "0")

    c, mn, cr, mo = F.pmod(k, F.lit(30)) + 10, F.pmod(k, F.lit(90)) + 40, F.pmod(k, F.lit(20)), F.pmod(k, F.lit(35))
    ys, ts, el = F.pmod(k, F.lit(200)) + 180, F.pmod(k, F.lit(300)) + 400, F.pmod(k, F.lit(30)) + 10
    grade = pick(k, GRADES)

    def line(label, *value):
        return F.concat(F.lit(label + ": "), *value)

    text = F.concat_ws(
        "\n",
        line("Certificate No", F.lit("MTC-"), k.cast("string")),
        line("Material Grade", grade),
        line("Heat No", F.lit("H-"), (k * 7).cast("string")),
        line("Manufacturer", F.lit("Works "), F.pmod(k, F.lit(9)).cast("string")),
        F.lit("Chemical Analysis"),
        line("Carbon", F.lit("0."), two(c), F.lit(" %")),
        line("Manganese", F.floor(mn / 100).cast("string"), F.lit("."), two(F.pmod(mn, F.lit(100))), F.lit(" %")),
        line("Chromium", cr.cast("string"), F.lit(".0 %")),
        line("Molybdenum", F.floor(mo / 10).cast("string"), F.lit("."), F.pmod(mo, F.lit(10)).cast("string"), F.lit(" %")),
        F.lit("Mechanical Properties"),
        line("Yield Strength (MPa)", ys.cast("string")),
        line("Tensile Strength (MPa)", ts.cast("string")),
        line("Elongation (%)", el.cast("string"), F.lit(".5")),
    )
    return dealt_parts(spark, sf_dir).select(F.col("p_partkey").alias("doc_id"), text.alias("text"), grade.alias("grade"))


def table_certificates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Certificates of two grades with a chemistry table and a mechanical table; every second F316 one conforms."""
    k = _key()

    def hundredths(n):
        return F.format_string("%.2f", n / 100.0)

    good = F.pmod(k, F.lit(2)) == 0
    chemistry = F.concat_ws(
        " ", hundredths(F.when(good, 3).otherwise(12)), hundredths(F.pmod(k, F.lit(50)) + 100), hundredths(F.pmod(k, F.lit(30)) + 20), F.lit("0.030"), F.lit("0.010"),
        hundredths(F.pmod(k, F.lit(100)) + 1650), hundredths(F.pmod(k, F.lit(60)) + 220), hundredths(F.pmod(k, F.lit(200)) + 1100),
    )
    mechanical = F.concat_ws("\n", (F.pmod(k, F.lit(90)) + 210).cast("string"), (F.pmod(k, F.lit(80)) + 520).cast("string"), F.concat((F.pmod(k, F.lit(9)) + 30).cast("string"), F.lit(".5")))
    text = F.concat(
        F.lit("MATERIAL TEST CERTIFICATE\nCertificate No: TAB-"), k.cast("string"), F.lit("\nMaterial Grade: ASTM "), pick(F.floor(k / 2), ("A182 F316", "A105")),
        F.lit("\nChemical Composition (%)\nC | Mn | Si | P | S | Cr | Mo | Ni\n"), chemistry, F.lit("\nMechanical test results\nYield (MPa)\nTensile (MPa)\nElongation (%)\nHardness (HBW)\n"), mechanical, F.lit("\n156"),
    )
    return dealt_parts(spark, sf_dir).select(k.alias("doc_id"), text.alias("text"))


def procurement_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptions that carry every extended field."""
    k = _key().cast("string")
    parts = [
        F.concat(F.lit("IS "), (F.pmod(_key(), F.lit(9000)) + 1000).cast("string")), F.concat(F.lit("OISD-STD-"), (F.pmod(_key(), F.lit(300)) + 100).cast("string")),
        F.concat(F.lit("EIL SPEC 6-44-"), k), F.concat(F.lit("GEM CATEGORY ID: CAT-"), k), F.concat(F.lit("GEM BID NO: GB-"), k), F.concat(F.lit("CPPP TENDER ID: CT-"), k),
        F.concat(F.lit("MESC 76.10."), k), F.concat(F.lit("MANUFACTURER: WORKS "), F.pmod(_key(), F.lit(9)).cast("string")), F.concat(F.lit("PRODUCT FORM: "), pick(_key(), ("FORGED", "CAST", "SEAMLESS"))),
        F.concat(F.lit("COATING "), pick(_key(), ("FBE", "3LPE", "EPOXY"))), F.concat(F.lit("INSPECTION CLASS: IC-"), F.pmod(_key(), F.lit(4)).cast("string")), F.concat(F.lit("DOCUMENT NO: DOC-"), k),
        F.concat(F.lit("PROJECT: UNIT "), F.pmod(_key(), F.lit(12)).cast("string")), F.concat(F.lit("END CONNECTION "), pick(_key(), ("FLANGED", "THREADED"))), F.concat(F.lit("PO-"), k),
        F.concat(F.lit("CERTIFICATE NO: CRT-"), k), F.concat(F.lit("TPI: AGENCY "), pick(_key(), ("NORTH", "SOUTH"))),
    ]
    return dealt_parts(spark, sf_dir).select("p_partkey", F.concat_ws("\n", *parts).alias("description"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as recognised text blocks of one page."""
    t = F.col("turn")
    y = t * 20.0
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc_id"), F.lit(1).alias("page"), t.alias("block_no"), "text",
        ((F.pmod(t, F.lit(7)) + 3) / 10.0).alias("score"), F.pmod(t * 37, F.lit(100)).cast("double").alias("x"), y.alias("y"),
        y.alias("top"), (y + 12.0 + F.pmod(t, F.lit(3)) * 6.0).alias("bottom"), F.lit(200.0).alias("page_height"),
        F.col("role"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as four domain vectors of length one, with the attributes of the part of the same number."""
    from ..functions.vector import domain_slices, unit

    e = table(spark, sf_dir, "embeddings")
    slices = domain_slices(F.col("embedding"), 16)
    rows = e.select("vec_id", F.col("label").alias("block"), *[unit(v).alias(d) for d, v in slices.items()])
    return rows.join(parts(spark, sf_dir).withColumnRenamed("p_partkey", "vec_id").select(
        "vec_id", "item_type", "size_nb_mm", "pressure_class", "metallurgy", "facing_end", "standard"
    ), "vec_id", "left")


def outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change feed of inventory items: one record per user."""
    kind = F.col("event_type")
    operation = F.when(kind == "signup", "INSERT").when(kind == "error", "DELETE").otherwise("UPDATE")
    sku = F.concat(F.lit("SKU-"), F.col("user_id").cast("string"))
    payload = F.to_json(
        F.struct(
            sku.alias("sku_code"),
            F.concat(F.lit("T"), F.pmod(F.col("user_id"), F.lit(5)).cast("string")).alias("cpse"),
            F.concat(F.lit("D"), F.pmod(F.col("event_id"), F.lit(25)).cast("string")).alias("depot_id"),
            (F.pmod(F.col("event_id"), F.lit(6)) * 50.0 + 50.0).alias("size_nb_mm"),
            pick(F.col("event_id"), CLASSES).alias("pressure_class"),
            F.pmod(F.col("event_id"), F.lit(90)).cast("int").alias("quantity"),
        )
    )
    broken = F.pmod(F.col("event_id"), F.lit(101)) == 100
    return spread(table(spark, sf_dir, "events"), "event_id").select(
        F.col("event_id").alias("id"), F.lit("inventory_items").alias("table_name"), operation.alias("operation"), sku.alias("record_id"),
        F.when(broken, F.lit("{broken")).otherwise(payload).alias("payload"), F.col("ts").cast("timestamp").alias("created_at"),
    )


def catalog_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dialect descriptions written from part attributes, beside those attributes."""
    k = _key()
    words = ("FLG", "PIPE", "GATE VALVE", "GASKET", "STUD BOLT", "ELBOW")
    types = ("FLANGE", "PIPE", "GATE_VALVE", "GASKET", "STUD_BOLT", "ELBOW")
    metal_words = ("A105", "WCB", "SS316", "LF2", "INCONEL 625", "DUPLEX")
    metals = ("ASTM_A105", "ASTM_A216_WCB", "SS316", "ASTM_A350_LF2", "INCONEL_625", "DUPLEX_SS")
    face_words = ("RF", "RTJ", "BW", "SW", "FF")
    faces = ("RAISED_FACE", "RING_TYPE_JOINT", "BUTT_WELD", "SOCKET_WELD", "FLAT_FACE")
    size = F.col("p_size") * 10
    pressure = pick(k, CLASSES)
    text = F.concat_ws(
        " ",
        pick(k, words), F.concat(F.lit("DN"), size.cast("string")), F.concat(pressure.cast("string"), F.lit("#")), pick(k, metal_words),
        pick(k, face_words), F.concat(F.lit("IS "), (F.pmod(k, F.lit(9000)) + 1000).cast("string")), F.lit("API 600"),
        F.concat(F.lit("MESC 76.10."), (F.pmod(k, F.lit(90)) + 10).cast("string")), F.concat(F.lit("PO-"), k.cast("string")),
        F.concat(F.lit("TEMP "), F.pmod(k, F.lit(400)).cast("string"), F.lit(" C")),
    )
    return dealt_parts(spark, sf_dir).select(
        "p_partkey", text.alias("description"), pick(k, types).alias("item_type"), size.cast("double").alias("size_nb_mm"),
        pressure.alias("pressure_class"), pick(k, metals).alias("metallurgy"), pick(k, faces).alias("facing_end"),
    )
