"""Catalog harmonisation and intake."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.attributes import with_dialect
from ..functions.values import first_true

# The canonical columns, their mandatory part and the supplementary columns.
CANONICAL = (
    "sku_code", "canonical_id", "cpse", "depot_id", "depot_location",
    "item_type", "description", "size_nb_mm", "pressure_class", "pressure_rating_bar", "metallurgy", "facing_end", "schedule",
    "standard", "indian_standard", "oil_std_spec", "make_in_india_class", "local_content_percentage",
    "oil_material_code", "gem_category_id", "cppp_tender_ref", "po_no",
    "quantity", "unit_cost_inr", "status", "days_idle", "is_broadcasted_surplus",
)
MANDATORY = ("sku_code", "cpse", "depot_location", "description", "quantity", "unit_cost_inr")
SUPPLEMENTARY = ("heat_no", "gem_product_id", "pressure_rating_psi", "location_state", "hsn_code", "unspsc_code")
TENANTS = ("IOCL", "ONGC", "BPCL", "HPCL", "GAIL", "OIL", "NRL")
# Other spellings of the canonical headers.
HEADER_ALIASES = {
    "cpse": ("cpse_name", "organization", "company", "enterprise", "psu"),
    "description": ("raw_description", "item_description", "material_description", "canonical_description", "material_desc", "item_name"),
    "sku_code": ("local_code", "material_code", "item_code", "part_number", "part_no"),
    "size_nb_mm": ("nominal_bore_mm", "size_mm", "nb_mm", "size_nb", "extracted_size_nb_mm"),
    "item_type": ("extracted_item_type", "material_type", "equipment_type"),
    "pressure_class": ("extracted_pressure_class", "rating_class", "class"),
    "pressure_rating_bar": ("rating_bar", "pn_bar"),
    "metallurgy": ("extracted_metallurgy", "material_grade", "material", "grade"),
    "facing_end": ("extracted_facing", "facing", "end_connection"),
    "standard": ("extracted_standard", "std", "design_standard"),
    "days_idle": ("idle_days", "aging_days"),
    "oil_material_code": ("mesc_code", "sap_material_code"),
    "gem_category_id": ("gem_category", "gem_cat"),
    "cppp_tender_ref": ("cppp_tender_id", "tender_ref", "tender_id"),
    "is_broadcasted_surplus": ("is_surplus", "surplus", "surplus_flag"),
}
ALIAS_OF = {alias: name for name, aliases in HEADER_ALIASES.items() for alias in aliases}
# Legacy columns dropped when the canonical one is there too.
LEGACY = {
    "gem_category": "gem_category_id", "mesc_code": "oil_material_code", "cppp_tender_id": "cppp_tender_ref",
    "cpse_name": "cpse", "raw_description": "description", "nominal_bore_mm": "size_nb_mm",
    "local_code": "sku_code", "idle_days": "days_idle",
}
KINDS = {
    "size_nb_mm": "double", "pressure_class": "int", "pressure_rating_bar": "double",
    "local_content_percentage": "double", "quantity": "int", "unit_cost_inr": "double", "days_idle": "int",
    "is_broadcasted_surplus": "boolean", "pressure_rating_psi": "double",
}


class ForeignTenantError(ValueError):
    """A catalog declares tenants other than the session's."""


def rename_headers(df: DataFrame) -> DataFrame:
    """Headers to their canonical names, unless the canonical column is there already."""
    taken, renames = set(df.columns), {}
    for column in df.columns:
        target = ALIAS_OF.get(column.strip().lower())
        if target and target != column and target not in taken:
            renames[column] = target
            taken.add(target)
    return df.withColumnsRenamed(renames)


def drop_legacy(df: DataFrame) -> DataFrame:
    return df.drop(*[old for old, new in LEGACY.items() if old in df.columns and new in df.columns])


def depot_id_of(cpse: Column, location: Column) -> Column:
    place = F.upper(F.replace(F.trim(F.split(F.coalesce(location, F.lit("CENTRAL")), ",")[0]), F.lit(" "), F.lit("_")))
    return F.concat(F.coalesce(F.nullif(cpse, F.lit("")), F.lit("CPSE")), F.lit("_"), place)


def lifecycle_status(days: Column) -> Column:
    idle = F.coalesce(days, F.lit(0))
    return F.when(idle >= 365, "SURPLUS_DECLARED").when(idle >= 180, "POTENTIAL_SURPLUS").otherwise("TO_BE_CONSUMED")


def canonical_rows(df: DataFrame) -> DataFrame:
    """Rows of any catalog in the canonical schema, unmapped columns as a property map.

    When several columns carry the same canonical name, the last filled one of a row wins.
    """
    def filled(column):
        text = F.col(f"`{column}`").cast("string")
        return F.when(~text.isin("NaN", "nan"), text)

    sources: dict[str, list[str]] = {}
    extras: dict[str, str] = {}
    for column in df.columns:
        if column == "properties":
            continue
        clean = column.strip().lower()
        target = ALIAS_OF.get(clean, clean)
        if target in CANONICAL or target in SUPPLEMENTARY:
            sources.setdefault(target, []).append(column)
        else:
            extras[clean] = column
    out = {n: F.coalesce(*[filled(c) for c in reversed(cols)]) for n, cols in sources.items()}

    def value(name):
        return out.get(name, F.lit(None).cast("string"))

    cpse = F.upper(F.trim(value("cpse")))
    depot = F.coalesce(F.nullif(value("depot_id"), F.lit("")), depot_id_of(cpse, value("depot_location")))
    days = value("days_idle").try_cast("double").cast("int")
    given = F.nullif(value("status"), F.lit(""))
    flag = value("is_broadcasted_surplus").try_cast("boolean")
    forced = given.isNull() & (F.coalesce(days, F.lit(0)) >= 180)
    out |= {
        "cpse": cpse,
        "depot_id": depot,
        "status": F.coalesce(given, lifecycle_status(days)),
        "is_broadcasted_surplus": F.when(forced, True).otherwise(F.when(given.isNull(), F.coalesce(flag, F.lit(False))).otherwise(flag)),
    }
    pairs = F.array_compact(
        F.array(
            *[
                F.when(filled(c).isNotNull(), F.struct(F.lit(k).alias("key"), filled(c).alias("value")))
                for k, c in extras.items()
            ]
        )
    ) if extras else None
    bag = F.map_from_entries(pairs) if extras else F.create_map().cast("map<string,string>")
    if "properties" in df.columns:
        own = F.coalesce(F.col("properties"), F.create_map().cast("map<string,string>"))
        base = bag
        bag = F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(own, k)), own)

    def typed(name):
        column = out.get(name, F.lit(None).cast("string"))
        kind = KINDS.get(name, "string")
        if name == "is_broadcasted_surplus":
            return column
        if kind == "int":
            return column.try_cast("double").cast("int")
        return column.try_cast(kind)

    names = [*CANONICAL, *[s for s in SUPPLEMENTARY if s in out]]
    return df.select(*[typed(n).alias(n) for n in names], bag.alias("properties"))


def normalize_catalog(df: DataFrame) -> DataFrame:
    """File-level normalisation: headers, legacy columns, tenant, depot id, status."""
    out = drop_legacy(rename_headers(df))
    if "cpse" in out.columns:
        out = out.withColumn("cpse", F.upper(F.trim(F.col("cpse").cast("string"))))
    if "depot_id" not in out.columns and {"depot_location", "cpse"} <= set(out.columns):
        out = out.withColumn("depot_id", depot_id_of(F.col("cpse"), F.col("depot_location")))
    if "status" not in out.columns and "days_idle" in out.columns:
        days = F.col("days_idle").cast("string").try_cast("double").cast("int")
        out = out.withColumns(
            {"status": lifecycle_status(days), "is_broadcasted_surplus": F.coalesce(days, F.lit(0)) >= 180}
        )
    return out


def foreign_tenants(df: DataFrame, session_cpse: str) -> DataFrame:
    """Declared tenants other than the session's, each once."""
    declared = F.upper(F.trim(F.col("cpse").cast("string")))
    return df.select(declared.alias("cpse")).filter((F.col("cpse") != "") & (F.col("cpse") != session_cpse.strip().upper())).distinct()


def reject_foreign_tenants(df: DataFrame, session_cpse: str) -> None:
    if "cpse" in df.columns:
        found = [r["cpse"] for r in foreign_tenants(df, session_cpse).limit(20).collect()]
        if found:
            raise ForeignTenantError(f"catalog declares tenants outside {session_cpse}: {sorted(found)}")


def intake_rows(df: DataFrame, session_cpse: str) -> DataFrame:
    """Upload projection with defaults; ``error`` names the first value that cannot be read."""
    lower = df.withColumnsRenamed({c: c.strip().lower() for c in df.columns})
    have = set(lower.columns)

    def raw(name):
        if name not in have:
            return F.lit(None).cast("string")
        text = F.col(name).cast("string")
        return F.when(~text.isin("NaN", "nan", ""), text)

    def text(name, default):
        # an absent column takes the default; a blank cell reads as "nan" in the intake
        return F.trim(F.coalesce(raw(name), F.lit("nan"))) if name in have else F.lit(default)

    def number(name, kind, default=None):
        value = raw(name).try_cast("double")
        value = value.cast("int") if kind == "int" else value
        return value if name in have else F.lit(default).cast(kind)

    stock = "available_qty" if "available_qty" in have else "quantity"
    days = number("days_idle", "int", 0)
    bad = first_true(
        [
            (raw(n).isNotNull() & raw(n).try_cast("double").isNull(), n)
            for n in ("size_nb_mm", "pressure_class", stock, "days_idle", "unit_cost_inr")
            if n in have
        ]
        + [(raw(n).isNull(), n) for n in (stock, "days_idle") if n in have]
        + [(F.lit(False), "")]
    )
    return lower.select(
        F.trim(raw("sku_code")).alias("sku_code"),
        F.lit(session_cpse.strip().upper()).alias("cpse"),
        text("depot_id", "DEFAULT_DEPOT").alias("depot_id"),
        text("depot_location", "Main Plant").alias("depot_location"),
        text("description", "").alias("description"),
        F.upper(text("item_type", "GENERAL")).alias("item_type"),
        number("size_nb_mm", "double").alias("size_nb_mm"),
        number("pressure_class", "int").alias("pressure_class"),
        *[raw(n).alias(n) for n in ("schedule", "metallurgy", "facing_end", "standard")],
        number(stock, "int", 1).alias("quantity"),
        days.alias("days_idle"),
        F.coalesce(number("unit_cost_inr", "double", 0.0), F.lit(0.0)).alias("unit_cost_inr"),
        F.when(days >= 90, "SURPLUS").otherwise("ACTIVE").alias("status"),
        bad.alias("error"),
        *([F.col("row_id")] if "row_id" in have else []),
    )


def new_rows(intake: DataFrame, ledger: DataFrame, order: str = "row_id") -> DataFrame:
    """Readable rows whose SKU is not in the ledger; of several rows of one SKU the first counts.

    The first row per SKU is an aggregate with map-side combine, so a repeated SKU costs one row
    per task.
    """
    usable = intake.filter((F.coalesce("sku_code", F.lit("")) != "") & F.col("error").isNull())
    rest = [c for c in usable.columns if c != "sku_code"]
    first = usable.groupBy("sku_code").agg(F.min_by(F.struct(*rest), F.col(order)).alias("__row")).select("sku_code", "__row.*")
    return first.join(ledger.select("sku_code").distinct(), "sku_code", "left_anti")


def intake_counts(intake: DataFrame, added: DataFrame) -> DataFrame:
    """Processed rows, imported rows and unreadable rows."""
    seen = intake.agg(
        F.count("*").alias("rows_processed"),
        F.count_if((F.coalesce("sku_code", F.lit("")) != "") & F.col("error").isNotNull()).alias("errors_count"),
    )
    return seen.crossJoin(F.broadcast(added.agg(F.count("*").alias("imported_count"))))


def conformance_checks(df: DataFrame, tenants=TENANTS) -> dict[str, Column]:
    """Failed contract checks by name."""
    checks = {f"missing_{n}": F.col(n).isNull() for n in MANDATORY if n in df.columns}
    checks |= {
        "blank_cpse": F.trim(F.col("cpse")) == "",
        "negative_quantity": F.col("quantity") < 0,
        "negative_unit_cost": F.col("unit_cost_inr") < 0,
        "unknown_cpse": ~F.upper(F.trim(F.col("cpse"))).isin(*tenants),
    }
    return {k: F.coalesce(v, F.lit(False)) for k, v in checks.items()}


def conformance_report(df: DataFrame, tenants=TENANTS) -> DataFrame:
    """One row with the count of each failed check, in one pass."""
    checks = conformance_checks(df, tenants)
    any_failed = F.lit(False)
    for failed in checks.values():
        any_failed = any_failed | failed
    return df.agg(
        F.count("*").alias("total_rows"),
        F.count_if(any_failed).alias("rejected_rows"),
        *[F.count_if(v).alias(k) for k, v in checks.items()],
    )


def rejected_rows(df: DataFrame, tenants=TENANTS) -> DataFrame:
    failed = F.array_compact(F.array(*[F.when(v, k) for k, v in conformance_checks(df, tenants).items()]))
    return df.withColumn("failed_checks", failed).filter(F.size("failed_checks") > 0)


ENRICHED = ("item_type", "size_nb_mm", "pressure_class", "metallurgy", "facing_end", "indian_standard", "oil_std_spec", "oil_material_code")


def enrich(df: DataFrame, prefer: str = "supplied") -> DataFrame:
    """Fill catalog rows from their descriptions.

    ``prefer="supplied"`` keeps given values; ``"extracted"`` lets the description decide type, size,
    class, grade and facing, and sets the status from the idle days.
    """
    out = with_dialect(df, "description", "__x_")
    given = set(df.columns)
    made = {}
    for name in ENRICHED:
        own = F.col(name) if name in given else F.lit(None)
        if name in given and dict(df.dtypes)[name] == "string":
            own = F.nullif(own, F.lit(""))
        elif name in given:
            own = F.when(own != 0, own)
        extracted = F.col("__x_" + name)
        decided = prefer == "extracted" and name in ENRICHED[:5]
        made[name] = extracted if decided else F.coalesce(own, extracted)
    made["item_type"] = F.coalesce(made["item_type"], F.lit("EQUIPMENT"))
    local = F.nullif(F.col("make_in_india_class"), F.lit("")) if "make_in_india_class" in given else F.lit(None)
    if prefer == "extracted":
        made["make_in_india_class"] = F.coalesce(local, F.col("__x_make_in_india_class"), F.lit("Class-I"))
        made["status"] = lifecycle_status(F.col("days_idle"))
        made["is_broadcasted_surplus"] = F.coalesce(F.col("days_idle"), F.lit(0)) >= 180
    else:
        made["make_in_india_class"] = F.coalesce(local, F.lit("Class-I"))
    share = F.when(F.col("local_content_percentage") != 0, F.col("local_content_percentage")) if "local_content_percentage" in given else F.lit(None)
    made["local_content_percentage"] = F.coalesce(share, F.lit(75.0))
    names = [c[4:] for c in out.columns if c.startswith("__x_")]
    extracted = F.map_from_entries(
        F.array_compact(
            F.array(
                *[
                    F.when(F.col("__x_" + n).isNotNull(), F.struct(F.lit(n).alias("key"), F.col("__x_" + n).cast("string").alias("value")))
                    for n in names
                ]
            )
        )
    )
    out = out.withColumn("__found", extracted)
    base = F.coalesce(F.col("properties"), F.create_map().cast("map<string,string>")) if "properties" in given else F.create_map().cast("map<string,string>")
    made["properties"] = F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(F.col("__found"), k)), F.col("__found"))
    return out.withColumns(made).drop("__found", *["__x_" + n for n in names])


def assign_codes(rows: DataFrame, codes: DataFrame) -> DataFrame:
    """Commodity and category code of each canonical row by item type."""
    return rows.join(codes, "item_type", "left")


def contrastive_pairs(catalog: DataFrame, master: DataFrame) -> DataFrame:
    """Catalog descriptions beside the canonical text they stand for."""
    right = master.select("canonical_id", "canonical_description", "item_type", "size_nb_mm", "pressure_class")
    return catalog.select("canonical_id", "cpse", "description").join(right, "canonical_id").select(
        F.concat(F.col("cpse"), F.lit(": "), F.col("description")).alias("anchor"),
        F.concat(F.lit("CANONICAL: "), F.col("canonical_description")).alias("positive"),
        "canonical_id", "item_type", "size_nb_mm", "pressure_class",
    )


