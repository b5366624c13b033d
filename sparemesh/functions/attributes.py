"""Engineering attributes read from free-text descriptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import normalize_text
from .values import NOCASE, NOCASE_LINES, first_group, first_true, group, lookup, no_zero, not_blank, quoted, squeeze

# Words that name an item type.
ITEM_TYPES = {
    "FLG": "FLANGE", "FLANGE": "FLANGE", "GATE VALVE": "GATE_VALVE", "BALL VALVE": "BALL_VALVE",
    "GLOBE VALVE": "GLOBE_VALVE", "VALVE": "VALVE", "VLV GT": "VALVE", "VLV BL": "VALVE",
    "VLV GL": "VALVE", "VLV CHK": "VALVE", "VLV PSV": "VALVE", "VLV": "VALVE",
    "GATE": "GATE_VALVE", "BALL": "BALL_VALVE", "BOLT": "BOLT", "STUD BLT": "STUD_BOLT",
    "STUD BOLT": "STUD_BOLT", "STUD": "STUD_BOLT", "CHECK VALVE": "CHECK_VALVE",
    "NRV": "CHECK_VALVE", "BUTTERFLY VALVE": "BUTTERFLY_VALVE", "PIPE": "PIPE", "TUBE": "TUBE",
    "GASKET": "GASKET", "TEE": "TEE", "ELBOW": "ELBOW", "REDUCER": "REDUCER",
}
# Flange facing marks, tried in this order.
FACINGS = {
    "WN": "WELD_NECK", "WNRF": "WELD_NECK_RAISED_FACE", "RF": "RAISED_FACE",
    "RTJ": "RING_TYPE_JOINT", "BW": "BUTT_WELD", "SW": "SOCKET_WELD", "FF": "FLAT_FACE",
}
# Grade marks.
METALS = {
    "A105N": "ASTM_A105N", "AISI 316": "SS316", "SS316": "SS316", "316L": "SS316L",
    "A105": "ASTM_A105", "WCB": "ASTM_A216_WCB", "B7": "ASTM_A193_B7", "316": "SS316",
    "IS 2062": "IS_2062", "IS2062": "IS_2062", "LF2": "ASTM_A350_LF2", "LF-2": "ASTM_A350_LF2",
    "A350 LF2": "ASTM_A350_LF2", "INCONEL 625": "INCONEL_625",
    "HASTELLOY C-276": "HASTELLOY_C276", "DUPLEX": "DUPLEX_SS", "SUPER DUPLEX": "SUPER_DUPLEX_SS",
}
# Nominal pressure (PN) to pressure class.
PN_CLASS = {
    6: 150, 10: 150, 16: 150, 25: 300, 40: 300, 50: 300, 63: 600, 64: 600, 80: 600, 100: 600,
    150: 900, 250: 1500, 320: 2500, 420: 2500,
}
# PN in bar to class, and inches to nominal bore, as used for dialect text.
PN_BAR_CLASS = {
    10: 150, 16: 150, 20: 150, 25: 150, 40: 300, 50: 300, 100: 600, 160: 900, 250: 1500, 420: 2500,
}
INCH_BORE = {
    0.5: 15.0, 0.75: 20.0, 1.0: 25.0, 1.25: 32.0, 1.5: 40.0, 2.0: 50.0, 2.5: 65.0, 3.0: 80.0,
    4.0: 100.0, 5.0: 125.0, 6.0: 150.0, 8.0: 200.0, 10.0: 250.0, 12.0: 300.0, 14.0: 350.0,
    16.0: 400.0, 18.0: 450.0, 20.0: 500.0, 24.0: 600.0,
}
# Patterns of the further fields.
FIELD_PATTERNS = {
    "indian_standard": r"\bIS\s*(?:CODE\s*)?[-:]?\s*\d{3,5}(?:\s*[:/-]\s*\d{2,4})?\b",
    "oisd_standard": r"\bOISD(?:\s*[-/]?\s*(?:STD|RP|GDN))?\s*[-:]?\s*\d{1,4}(?:\s*[/.-]\s*\d{2,4})?\b",
    "eil_specification": r"\bEIL(?:\s+(?:SPEC(?:IFICATION)?|STD))?\s*[-:/ ]+\s*[A-Z0-9][A-Z0-9./-]*",
    "gem_category": r"\bGEM\s+CATEGORY(?:\s*(?:ID|CODE))?\s*[:#-]?\s*([A-Z0-9][A-Z0-9./_-]*)",
    "gem_bid_number": r"\bGEM\s+BID\s*(?:NO\.?|NUMBER|ID|#)?\s*[:#-]?\s*([A-Z0-9][A-Z0-9_./-]*)",
    "cppp_tender_id": r"\b(?:CPPP(?:\s+TENDER)?|CENTRAL\s+PUBLIC\s+PROCUREMENT\s+PORTAL)\s*(?:TENDER\s*)?(?:ID|NO\.?)?\s*[:#-]?\s*([A-Z0-9][A-Z0-9_./-]*)",
    "mesc_code": r"\bMESC\s*[-:]?\s*([A-Z0-9][A-Z0-9./-]*)",
    "manufacturer": r"\b(?:MANUFACTURER|MFR\.?|MAKE)\s*[:#-]?\s*(.+?)(?=\s+(?:PRODUCT\s+FORM|COATING|INSPECTION\s+CLASS|TPI|INSPECTION\s+AGENCY|DOCUMENT\s+NO|PROJECT|END\s+CONNECTION|TEMPERATURE|PO\s*[-:]|CERTIFICATE)|$)",
    "product_form": r"\b(?:PRODUCT\s+FORM|FORM)\s*[:#-]?\s*(FORGED|CAST|WROUGHT|SEAMLESS|WELDED|PLATE|BAR|PIPE|TUBE)\b",
    "coating": r"\b(3LPE|3LPP|FBE|EPOXY|GALVANI[ZS]ED|HOT[- ]DIP\s+GALVANI[ZS]ED|PTFE|NYLON|RUBBER[- ]LINED)\b",
    "inspection_class": r"\b(?:INSPECTION|ITP|QC)\s+CLASS\s*[:#-]?\s*([A-Z0-9-]+)",
    "document_number": r"\b(?:DOCUMENT|DOC\.?)\s*(?:NO\.?|NUMBER|#)\s*[:#-]?\s*([A-Z0-9][A-Z0-9_./-]*)",
    "project": r"\bPROJECT\s*[:#-]?\s*(.+?)(?=\s+(?:END\s+CONNECTION|TEMPERATURE|PO\s*[-:]|CERTIFICATE|BID\s*(?:NO|NUMBER))|$)",
    "end_connection": r"\b(FLANGED|BUTT[- ]WELD(?:ED)?|SOCKET[- ]WELD(?:ED)?|THREADED|NPT|BSP)\b",
    "purchase_order": r"\b(?:(?:PURCHASE\s+ORDER|P\.?O\.?)\s*(?:NO\.?|NUMBER|#)?\s*[:#-]?\s*)?(PO[-/][A-Z0-9][A-Z0-9_./-]*)|\b(?:PURCHASE\s+ORDER|P\.?O\.?)\s*(?:NO\.?|NUMBER|#)\s*[:#-]?\s*([A-Z0-9][A-Z0-9_./-]*)",
    "certificate_number": r"\b(?:CERTIFICATE|CERT\.?)\s*(?:(?:NO\.?|NUMBER|#)\s*[:#-]?\s*)?([A-Z0-9][A-Z0-9_./-]*\d[A-Z0-9_./-]*)",
    "bid_number": r"\b(?:BID|TENDER)\s*(?:NO\.?|NUMBER|ID|#)\s*[:#-]?\s*([A-Z0-9][A-Z0-9_./-]*)",
    "inspection_agency": r"\b(?:TPI|INSPECTION\s+AGENCY)\s*[:#-]?\s*([A-Z][A-Z0-9 &.-]+?)(?=\s+(?:INSPECTION\s+CLASS|DOCUMENT\s+NO|PROJECT)|$)",
}
TEMPERATURE_PATTERN = r"\b(?:TEMPERATURE|TEMP\.?)\s*(?:RATING)?\s*[:#-]?\s*(-?\d+(?:\.\d+)?)\s*(?:°?\s*[CF])?\b"
STANDARD_PATTERN = r"\b((?:ASME|API|ASTM|NACE|BS|DIN|EN|ISO)\s*[A-Z]{0,4}\s*\d+[A-Z]?(?:[./:-]\d+[A-Z0-9]*)*)"
PRESSURE_MASK = r"\b(?:CLASS|CL)\s*-?\s*\d+|\bPN\s*-?\s*\d+|\b\d+\s*(?:#|LBS?)(?![A-Z])"
PRESSURE_TOKEN = r"\b((?:CLASS|CL)\s*-?\s*\d+|PN\s*-?\s*\d+|\d+\s*(?:#|LBS?))(?=\s|$|[,;/])"
SIZE_TOKEN = (
    r"\b((?:(?:DN|NB)\s*)?(?:\d+\s+\d+/\d+|\d+/\d+|\d+(?:\.\d+)?)"
    r"\s*(?:MM|MILLIMETERS?|MILLIMETRES?|IN|INCH(?:ES)?|[\"'])?(?:\s*NB)?)(?=\s|$|[,;/)])"
)
SIZE_WHOLE = (
    r"^\s*(?:(?:DN|NB)\s*)?(\d+\s+\d+/\d+|\d+/\d+|\d+(?:\.\d+)?)"
    r"\s*(MM|MILLIMETERS?|MILLIMETRES?|IN|INCH(?:ES)?|[\"'])?\s*(?:NB)?\s*$"
)
# Fields whose digits must not be read as a size.
MASKED_FIELDS = (
    "indian_standard", "oisd_standard", "eil_specification", "gem_category", "gem_bid_number",
    "cppp_tender_id", "mesc_code", "document_number", "purchase_order", "certificate_number",
    "bid_number",
)
ATTRIBUTE_FIELDS = (
    "item_type", "size_nb_mm", "pressure_class", "metallurgy", "facing_end", "standard",
    "material_grade", *FIELD_PATTERNS, "temperature_rating",
)


def size_number(raw: Column) -> Column:
    return group(raw, NOCASE + SIZE_WHOLE, 1)


def size_unit(raw: Column) -> Column:
    return F.upper(group(raw, NOCASE + SIZE_WHOLE, 2))


def size_in_mm(number: Column, unit: Column) -> Column:
    """Nominal size in mm; a fraction or an inch unit means inches."""
    whole = F.coalesce(group(number, r"^(\d+)\s+\d+/\d+$").cast("double"), F.lit(0.0))
    top = group(number, r"(\d+)/\d+$").cast("double")
    bottom = no_zero(group(number, r"/(\d+)$").cast("double"))
    value = F.when(number.contains("/"), whole + top / bottom).otherwise(number.try_cast("double"))
    inches = F.coalesce(unit.isin("IN", "INCH", "INCHES", '"', "'"), F.lit(False)) | number.contains("/")
    return value * F.when(inches, 25.4).otherwise(1.0)


def normalize_size(raw: Column) -> Column:
    return size_in_mm(size_number(raw), size_unit(raw))


def normalize_pressure(raw: Column) -> Column:
    """Pressure class from a PN designation when it is mapped, else from a class or pound mark."""
    nominal = group(raw, NOCASE + r"\bPN\s*[-]?\s*(\d+)\b").try_cast("int")
    marked = NOCASE + r"\b(?:CLASS|CL)\s*-?\s*(\d+)\b|\b(\d+)\s*(?:#|LBS?)(?![A-Z])"
    return F.coalesce(
        lookup(PN_CLASS, nominal), group(raw, marked, 1).try_cast("int"), group(raw, marked, 2).try_cast("int")
    )


def _longest_first(mapping: dict) -> list:
    return sorted(mapping.items(), key=lambda kv: len(kv[0]), reverse=True)


def metallurgy_of(raw: Column) -> Column:
    return first_true(
        [(raw.rlike(f"(?i)(?<![A-Z0-9]){quoted(k)}(?![A-Z0-9])"), v) for k, v in _longest_first(METALS)]
    )


def item_type_of(upper_text: Column) -> Column:
    return first_true([(upper_text.rlike(rf"(?U)\b{quoted(k)}\b"), v) for k, v in _longest_first(ITEM_TYPES)])


def facing_of(upper_text: Column) -> Column:
    return first_true([(upper_text.rlike(rf"(?U)\b{quoted(k)}\b"), v) for k, v in FACINGS.items()])


def standard_of(upper_text: Column) -> Column:
    return F.trim(group(upper_text, NOCASE + STANDARD_PATTERN))


def field_of(text: Column, name: str) -> Column:
    """First filled group of the field's pattern, or the whole match when it has no group."""
    pattern = NOCASE_LINES + FIELD_PATTERNS[name]
    if name == "purchase_order":
        value = F.coalesce(group(text, pattern, 1), group(text, pattern, 2))
    else:
        value = group(text, pattern, 0 if "(" not in FIELD_PATTERNS[name].replace("(?", "") else 1)
    return F.regexp_replace(value, r"^[ \t:;,.]+|[ \t:;,.]+$", "")


def temperature_of(text: Column) -> Column:
    return group(text, NOCASE + TEMPERATURE_PATTERN).try_cast("double")


def without_codes(upper_text: Column) -> Column:
    """Text with reference codes, standards and pressure marks blanked out."""
    masked = upper_text
    for pattern in (*[FIELD_PATTERNS[n] for n in MASKED_FIELDS], STANDARD_PATTERN, PRESSURE_MASK):
        masked = F.regexp_replace(masked, NOCASE + pattern, " ")
    return masked


def with_attributes(df: DataFrame, description: str, prefix: str = "", fields=ATTRIBUTE_FIELDS) -> DataFrame:
    """Add the attributes of a description as columns ``prefix + name``.

    Plain columns in two steps, not one struct: the optimiser would inline a struct into every use
    of its fields and so repeat the patterns.
    """
    text, raw = F.col("__text"), F.col(description)
    step = df.withColumn("__text", F.upper(squeeze(raw)))
    if "size_nb_mm" in fields:
        step = step.withColumn("__size", group(without_codes(text), NOCASE + SIZE_TOKEN)).withColumns(
            {"__number": size_number(F.col("__size")), "__unit": size_unit(F.col("__size"))}
        )
    if "pressure_class" in fields:
        step = step.withColumn("__class", group(text, NOCASE + PRESSURE_TOKEN))
    makers = {
        "item_type": lambda: item_type_of(text),
        "size_nb_mm": lambda: F.coalesce(
            group(text, r"(?U)\bSIZE_NB_MM\s*=\s*(\d+(?:\.\d+)?)").try_cast("double"),
            F.round(group(text, r"(?U)\bSIZE_IN\s*=\s*(\d+(?:\.\d+)?)").try_cast("double") * 25.4, 2),
            size_in_mm(F.col("__number"), F.col("__unit")),
        ),
        "pressure_class": lambda: F.coalesce(
            group(text, r"(?U)\bCLASS\s*=\s*(\d+)\b").try_cast("int"), normalize_pressure(F.col("__class"))
        ),
        "metallurgy": lambda: metallurgy_of(text),
        "facing_end": lambda: facing_of(text),
        "standard": lambda: standard_of(text),
        "temperature_rating": lambda: temperature_of(raw),
    }
    made = {}
    for name in fields:
        if name == "material_grade":
            continue
        made[prefix + name] = makers[name]() if name in makers else field_of(raw, name)
    out = step.withColumns(made).drop("__text", "__size", "__number", "__unit", "__class")
    if "material_grade" in fields:
        out = out.withColumn(prefix + "material_grade", F.col(prefix + "metallurgy"))
    return out


def dialect_attributes(description: Column, base, normalized: Column) -> dict[str, Column]:
    """Attributes of dialect text; ``base[name]`` are the attributes of the normalised text."""
    upper = F.upper(description)
    kind = first_true(
        [
            (upper.contains("STUD") | upper.contains("BOLT"), "STUD_BOLT"),
            (upper.contains("FLG") | upper.contains("FLANGE"), "FLANGE"),
            (upper.contains("PIPE"), "PIPE"),
            (upper.contains("VLV") | upper.contains("VALVE"), "VALVE"),
        ],
        base["item_type"],
    )
    bore = group(upper, r"(?U)\b(\d+(?:\.\d+)?)\s*(?:MM\s+NB|NB)\b").try_cast("double")
    inch = group(upper, r"(?U)\b(\d+(?:\.\d+)?)\s*(?:IN|INCH(?:ES)?|\")\b").try_cast("double")
    size = F.coalesce(bore, lookup(INCH_BORE, inch), base["size_nb_mm"])
    bar = group(upper, r"(?U)\bPN\s*(\d+(?:\.\d+)?)\b").try_cast("double")
    marked = first_group(
        upper, r"(?U)\((\d+)[#]\)", r"(?U)\bCLASS\s*(\d+)\b", r"(?U)\b(\d+)\s*#\b"
    ).try_cast("int")
    known = F.coalesce(marked, base["pressure_class"])
    from_bar = F.when(
        bar != 0, F.coalesce(lookup(PN_BAR_CLASS, bar.cast("int")), (bar * 6).cast("int"))
    )
    pressure = F.when(known != 0, known).otherwise(F.coalesce(from_bar, known))
    mesc = base["mesc_code"]
    code = F.when(
        mesc.isNotNull(),
        F.when(F.size(F.split(mesc, r"\.")) >= 4, F.array_join(F.slice(F.split(mesc, r"\."), 1, 4), ".")).otherwise(mesc),
    ).otherwise(group(upper, r"(?U)\b(\d{2}\.\d{2}\.\d{2}\.\d{2})(?:\.\d{2})?\b"))
    named = base["indian_standard"]
    marked_is = group(upper, NOCASE + r"\b(IS\s+\d+(?:\s+Part\s+\d+)?(?:\s+Grade\s+[A-Z0-9]+)?)\b")
    indian = F.when(named.contains("IS"), named).otherwise(F.coalesce(marked_is, named))
    specs = F.concat_ws(" / ", base["oisd_standard"], base["eil_specification"])
    oil_spec = F.coalesce(
        F.nullif(specs, F.lit("")),
        group(upper, NOCASE + r"\b(OISD-[A-Z0-9-]+(?:\s*/\s*EIL\s*[0-9A-Z-]+)?|EIL\s*[0-9A-Z-]+)\b"),
    )
    local = F.coalesce(group(upper, NOCASE + r"\b(Class-I|Class-II|Non-Local)\b"), F.lit("Class-I"))
    return {
        "normalized_text": normalized,
        "item_type": kind,
        "size_nb_mm": size,
        "pressure_class": pressure,
        "pressure_rating_bar": bar,
        "oil_material_code": code,
        "indian_standard": indian,
        "oil_std_spec": oil_spec,
        "make_in_india_class": first_true(
            [(F.lower(local) == "class-i", "Class-I"), (F.lower(local) == "class-ii", "Class-II")], local
        ),
        "metallurgy": F.coalesce(base["metallurgy"], base["material_grade"]),
        "facing_end": F.coalesce(base["facing_end"], base["end_connection"]),
        "standard": base["standard"],
        "sour_service": upper.contains("NACE") | upper.contains("SOUR"),
    }


def with_dialect(df: DataFrame, description: str, prefix: str = "") -> DataFrame:
    """Add the dialect attributes of ``description`` as columns ``prefix + name``.

    Each step is a projection of its own, so a pattern runs once per row however often its result
    is used.
    """
    base_names = [n for n in ATTRIBUTE_FIELDS]
    step = df.withColumn("__norm", normalize_text(F.col(description)))
    step = with_attributes(step, "__norm", "__b_", base_names)
    base = {n: F.col("__b_" + n) for n in base_names}
    made = dialect_attributes(F.col(description), base, F.col("__norm"))
    extra = [n for n in base_names if n not in made]
    keep = [c for c in df.columns if c not in {prefix + n for n in (*made, *extra)}]
    return step.select(
        *keep,
        *[c.alias(prefix + n) for n, c in made.items()],
        *[base[n].alias(prefix + n) for n in extra],
    )


# Fields of the four search domains, in order.
DOMAINS = ("dim", "met", "pt", "std")
DOMAIN_FIELDS = {
    "dim": ("size_nb_mm", "size_inch", "dn_code", "dimension", "schedule", "end_connection"),
    "met": ("metallurgy", "material_grade", "coating", "product_form"),
    "pt": ("pressure_class", "temperature_rating", "pressure_rating"),
    "std": (
        "standard", "indian_standard", "oisd_standard", "eil_specification", "gem_category",
        "gem_bid_number", "cppp_tender_id", "mesc_code",
    ),
}


def domain_texts(columns, description: Column) -> dict[str, Column]:
    """Text of each search domain from the fields at hand, else the description."""
    out = {}
    for domain, fields in DOMAIN_FIELDS.items():
        parts = [
            F.when(
                not_blank(F.col(f).cast("string")).isNotNull(),
                F.concat(F.lit(f.replace("_", " ") + ": "), F.col(f).cast("string")),
            )
            for f in fields
            if f in columns
        ]
        joined = F.nullif(F.concat_ws("; ", *parts), F.lit("")) if parts else F.lit(None).cast("string")
        out[domain] = F.coalesce(joined, F.trim(description))
    return out
