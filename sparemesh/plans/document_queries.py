"""Descriptions, certificates and recognised text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import chemistry
from ..functions.attributes import DOMAINS, FIELD_PATTERNS, domain_texts, field_of, normalize_pressure, normalize_size, with_attributes, with_dialect
from ..functions.safety import metal_rank
from ..functions.text import clean_lines, normalize_text
from ..operators import catalog, certificates, documents, matching, training
from . import oracle_views as O
from . import views as V
from .registry import query

WORDS = ("FLG", "PIPE", "GATE VALVE", "GASKET", "STUD BOLT", "ELBOW")
LONG_WORDS = ("FLANGE", "PIPE", "GATE VALVE", "GASKET", "STUD BOLT", "ELBOW")
TYPES = ("FLANGE", "PIPE", "GATE_VALVE", "GASKET", "STUD_BOLT", "ELBOW")
METAL_WORDS = ("A105", "WCB", "SS316", "LF2", "INCONEL 625", "DUPLEX")
METALS = ("ASTM_A105", "ASTM_A216_WCB", "SS316", "ASTM_A350_LF2", "INCONEL_625", "DUPLEX_SS")
LONG_FACES = ("RAISED FACE", "RING TYPE JOINT", "BUTT WELD", "SOCKET WELD", "FLAT FACE")
FACES = ("RAISED_FACE", "RING_TYPE_JOINT", "BUTT_WELD", "SOCKET_WELD", "FLAT_FACE")
K = "p_partkey"
# IS 2062 is a steel grade too, and its mark is longer than the one it stands beside
METAL = f"CASE WHEN p_partkey % 9000 = 1062 THEN 'IS_2062' ELSE {O.pick('p_partkey', METALS)} END"
# the header parser stops at the first word of a grade that is not GR or CLASS
HEADER_GRADE = O.pick("{0}", ("ASTM A105", "ASTM A350", "A182", "A182", "A193"))
IS_NO = f"CAST({K} % 9000 + 1000 AS VARCHAR)"
MESC = f"'76.10.' || ({K} % 90 + 10)"


@query(
    "x1_normalized_text",
    O.sql(
        "",
        f"""SELECT {K}, {O.pick(K, LONG_WORDS)} || ' SIZE_NB_MM=' || (p_size * 10) || ' CLASS=' || {O.pick(K, V.CLASSES)} || ' ' || {O.pick(K, METAL_WORDS)} || ' ' || {O.pick(K, LONG_FACES)}
              || ' IS ' || {IS_NO} || ' AMERICAN PETROLEUM INSTITUTE 600 MATERIAL ENGINEERING SPECIFICATION ' || {MESC} || ' PO-' || {K} || ' TEMP ' || ({K} % 400) || ' C' AS text FROM part""",
    ),
)
def normalized(spark, sf_dir):
    return V.catalog_text(spark, sf_dir).select(K, normalize_text(F.col("description")).alias("text"))


@query(
    "x10_attributes",
    O.sql(
        "",
        f"""SELECT {K}, {O.pick(K, TYPES)} AS item_type, (p_size * 10)::DOUBLE AS size_nb_mm, {O.pick(K, V.CLASSES)} AS pressure_class, {METAL} AS metallurgy, {O.pick(K, FACES)} AS facing_end,
              'API 600' AS standard, 'IS ' || {IS_NO} AS indian_standard, {MESC} AS mesc_code, 'PO-' || {K} AS purchase_order, ({K} % 400)::DOUBLE AS temperature_rating, NULL AS manufacturer, NULL AS coating FROM part""",
    ),
)
def attributes(spark, sf_dir):
    fields = ("item_type", "size_nb_mm", "pressure_class", "metallurgy", "facing_end", "standard", "indian_standard", "mesc_code", "purchase_order", "temperature_rating", "manufacturer", "coating")
    text = V.catalog_text(spark, sf_dir).select(K, "description")
    return with_attributes(text, "description", fields=fields).select(K, *fields)


@query(
    "x8_extended_fields",
    O.sql(
        "",
        f"""SELECT {K}, 'IS ' || ({K} % 9000 + 1000) AS indian_standard, 'OISD-STD-' || ({K} % 300 + 100) AS oisd_standard, 'EIL SPEC 6-44-' || {K} AS eil_specification, 'CAT-' || {K} AS gem_category,
              'GB-' || {K} AS gem_bid_number, 'CT-' || {K} AS cppp_tender_id, '76.10.' || {K} AS mesc_code, 'WORKS ' || ({K} % 9) AS manufacturer, {O.pick(K, ("FORGED", "CAST", "SEAMLESS"))} AS product_form,
              {O.pick(K, ("FBE", "3LPE", "EPOXY"))} AS coating, 'IC-' || ({K} % 4) AS inspection_class, 'DOC-' || {K} AS document_number, 'UNIT ' || ({K} % 12) AS project, {O.pick(K, ("FLANGED", "THREADED"))} AS end_connection,
              'PO-' || {K} AS purchase_order, 'CRT-' || {K} AS certificate_number, 'GB-' || {K} AS bid_number, 'AGENCY ' || {O.pick(K, ("NORTH", "SOUTH"))} AS inspection_agency FROM part""",
    ),
)
def extended_fields(spark, sf_dir):
    """All eighteen fields of descriptions that carry them."""
    return V.procurement_text(spark, sf_dir).select(K, *[field_of(F.upper("description"), name).alias(name) for name in FIELD_PATTERNS])


@query(
    "p1_parsed_requests",
    O.sql(
        "",
        f"""SELECT {K}, CASE WHEN {K} % 5 = 0 THEN 'PIPE' WHEN {K} % 6 = 0 THEN 'FLANGE' WHEN {K} % 6 = 2 THEN 'VALVE' ELSE {O.pick(K, TYPES)} END AS item_type, CASE WHEN {K} % 3 = 0 THEN 77.0 ELSE (p_size * 10)::DOUBLE END AS size_nb_mm,
              {O.pick(K, V.CLASSES)} AS pressure_class, {METAL} AS metallurgy, 'IS ' || {IS_NO} AS indian_standard, CASE WHEN {K} % 4 = 0 THEN 'true' END AS sour_service,
              CASE {K} % 3 WHEN 0 THEN '0.4' WHEN 1 THEN '0.43' END AS ce_max, CASE {K} % 3 WHEN 2 THEN 'false' ELSE 'true' END AS weldability FROM part""",
    ),
)
def parsed_requests(spark, sf_dir):
    """Requests in words: a given value wins, the rest is read from the text, flags become properties."""
    k = F.col(K)
    asked = V.catalog_text(spark, sf_dir).select(
        K, F.col("description").alias("query_text"), F.when(F.pmod(k, F.lit(5)) == 0, "PIPE").otherwise(F.when(F.pmod(k, F.lit(5)) == 1, "")).alias("item_type"),
        F.when(F.pmod(k, F.lit(3)) == 0, 77.0).otherwise(F.lit(0.0)).alias("size_nb_mm"), (F.pmod(k, F.lit(4)) == 0).alias("sour_service"), V.pick(k, ("HIGH_WELDABILITY", "STANDARD", "NON_WELDABLE")).alias("weldability_class"),
    )
    out = matching.parse_requests(asked)
    return out.select(K, "item_type", "size_nb_mm", "pressure_class", "metallurgy", "indian_standard", *[F.try_element_at("props", F.lit(n)).alias(n) for n in ("sour_service", "ce_max", "weldability")])


@query(
    "x11_dialect",
    O.sql(
        "",
        f"""SELECT {K}, CASE WHEN {K} % 6 = 0 THEN 'FLANGE' WHEN {K} % 6 = 2 THEN 'VALVE' ELSE {O.pick(K, TYPES)} END AS item_type, (p_size * 10)::DOUBLE AS size_nb_mm, {O.pick(K, V.CLASSES)} AS pressure_class,
              {METAL} AS metallurgy, 'IS ' || {IS_NO} AS indian_standard, 'Class-I' AS make_in_india_class, false AS sour_service FROM part""",
    ),
)
def dialect(spark, sf_dir):
    names = ("item_type", "size_nb_mm", "pressure_class", "metallurgy", "indian_standard", "make_in_india_class", "sour_service")
    return with_dialect(V.catalog_text(spark, sf_dir).select(K, "description"), "description").select(K, *names)


@query(
    "x2_sizes",
    O.sql(
        "",
        f"""SELECT {K}, round(CASE {K} % 7 WHEN 0 THEN p_size::DOUBLE WHEN 1 THEN p_size * 25.4 WHEN 2 THEN p_size / 8.0 * 25.4 WHEN 3 THEN (p_size + 0.5) * 25.4 WHEN 4 THEN p_size::DOUBLE END, 6) AS size FROM part""",
    ),
)
def sizes(spark, sf_dir):
    n = F.col("p_size").cast("string")
    forms = F.array(
        F.concat(n, F.lit(" mm")), F.concat(n, F.lit("inch")), F.concat(n, F.lit('/8"')), F.concat(n, F.lit(" 1/2 IN")), F.concat(F.lit("DN"), n), F.concat(n, F.lit(" kg")), F.concat(n, F.lit('/0"')),
    )
    raw = F.get(forms, F.pmod(K, F.lit(7)).cast("int"))
    return V.dealt_parts(spark, sf_dir).withColumn("raw", raw).select(K, F.round(normalize_size(F.col("raw")), 6).alias("size"))


PN = (6, 10, 16, 25, 40, 50, 63, 64, 80, 100, 150, 250, 320, 420, 37)
PN_CLASSES = (150, 150, 150, 300, 300, 300, 600, 600, 600, 600, 900, 1500, 2500, 2500, None)


@query("x3_pressures", O.sql("", f"SELECT {K}, CASE WHEN {K} % 4 = 3 THEN coalesce({O.pick(K, PN_CLASSES)}, 300) WHEN {K} % 4 = 2 THEN 600 WHEN {K} % 4 = 1 THEN NULL ELSE {O.pick(K, PN_CLASSES)} END AS class FROM part"))
def pressures(spark, sf_dir):
    pn = V.pick(F.col(K), PN).cast("string")
    forms = F.array(F.concat(F.lit("PN "), pn), F.concat(F.lit("XPN"), pn), F.lit("600 lbs"), F.concat(F.lit("pn-"), pn, F.lit(", CLASS 300")))
    raw = F.get(forms, F.pmod(K, F.lit(4)).cast("int"))
    return V.dealt_parts(spark, sf_dir).withColumn("raw", raw).select(K, normalize_pressure(F.col("raw")).alias("class"))


@query("x15_metal_ranks", O.sql("parts", "SELECT p_partkey, CASE metallurgy WHEN 'ASTM A105' THEN 0 WHEN 'ASTM A350 LF2' THEN 1 WHEN 'SS304' THEN 2 WHEN 'SS304L' THEN 2 WHEN 'SS316' THEN 2 END AS rank FROM parts"))
def metal_ranks(spark, sf_dir):
    return V.parts(spark, sf_dir).select("p_partkey", metal_rank(F.col("metallurgy")).alias("rank"))


@query(
    "x13_domain_texts",
    O.sql(
        "parts",
        """SELECT p_partkey, 'size nb mm: ' || size_nb_mm AS dim, coalesce('metallurgy: ' || metallurgy, description) AS met, 'pressure class: ' || pressure_class AS pt,
             coalesce(nullif(concat_ws('; ', 'standard: ' || standard, 'indian standard: ' || indian_standard), ''), description) AS std FROM parts""",
    ),
)
def domains(spark, sf_dir):
    parts = V.parts(spark, sf_dir)
    texts = domain_texts(parts.columns, F.col("description"))
    return parts.select("p_partkey", *[texts[d].alias(d) for d in DOMAINS])


@query(
    "x12_merged_entities",
    O.sql(
        "",
        f"""SELECT {K}, CASE WHEN {K} % 3 = 0 THEN 'PUMP' ELSE {O.pick(K, TYPES)} END AS item_type, CASE WHEN {K} % 4 = 0 THEN 80.0 ELSE p_size * 10.0 END::DOUBLE AS size_nb_mm, {METAL} AS metallurgy FROM part""",
    ),
)
def merged_entities(spark, sf_dir):
    text = V.catalog_text(spark, sf_dir).select(K, "description")
    key = F.col(K)
    found = text.select(
        F.col(K).alias("text_id"),
        F.explode(
            F.array_compact(
                F.array(
                    F.when(F.pmod(key, F.lit(3)) == 0, F.struct(F.lit("ITEM_TYPE").alias("label"), F.lit("PUMP").alias("word"))),
                    F.when(F.pmod(key, F.lit(4)) == 0, F.struct(F.lit("SIZE").alias("label"), F.lit("80 MM").alias("word"))),
                )
            )
        ).alias("e"),
    ).select("text_id", "e.label", "e.word")
    fields = ("item_type", "size_nb_mm", "metallurgy")
    base = with_attributes(text, "description", fields=fields)
    return training.merge_entities(base, found, K).select(K, *fields)


@query(
    "n12_enriched",
    O.sql(
        "",
        f"""SELECT {K}, CASE WHEN {K} % 2 = 0 THEN 'GIVEN' WHEN {K} % 6 = 0 THEN 'FLANGE' WHEN {K} % 6 = 2 THEN 'VALVE' ELSE {O.pick(K, TYPES)} END AS item_type, CASE WHEN {K} % 5 = 0 THEN 7.0 ELSE p_size * 10.0 END::DOUBLE AS size_nb_mm,
              75.0::DOUBLE AS local_content_percentage, 'Class-I' AS make_in_india_class FROM part""",
    ),
)
def enriched(spark, sf_dir):
    rows = V.catalog_text(spark, sf_dir).select(K, "description").withColumns(
        {"item_type": F.when(F.pmod(K, F.lit(2)) == 0, "GIVEN"), "size_nb_mm": F.when(F.pmod(K, F.lit(5)) == 0, 7.0)}
    )
    return catalog.enrich(rows).select(K, "item_type", "size_nb_mm", "local_content_percentage", "make_in_india_class")


@query(
    "n15_enriched_by_text",
    O.sql("", f"SELECT {K}, CASE WHEN {K} % 6 = 0 THEN 'FLANGE' WHEN {K} % 6 = 2 THEN 'VALVE' ELSE {O.pick(K, TYPES)} END AS item_type, (p_size * 10.0)::DOUBLE AS size_nb_mm, CASE WHEN {K} % 500 >= 365 THEN 'SURPLUS_DECLARED' WHEN {K} % 500 >= 180 THEN 'POTENTIAL_SURPLUS' ELSE 'TO_BE_CONSUMED' END AS status FROM part"),
)
def enriched_by_text(spark, sf_dir):
    rows = V.catalog_text(spark, sf_dir).select(K, "description").withColumns({"item_type": F.lit("GIVEN"), "days_idle": F.pmod(K, F.lit(500)).cast("int")})
    return catalog.enrich(rows, prefer="extracted").select(K, "item_type", "size_nb_mm", "status")


@query(
    "n14_clean_documents",
    r"""SELECT doc_id, md5(cleaned) AS cleaned_md5, length(cleaned) AS n FROM (SELECT doc_id, array_to_string(list_filter(list_transform(
          string_split(regexp_replace(translate(text, '×″’', 'x"'''), '[ \t\x0b\x0c]+', ' ', 'g'), chr(10)), lambda x: trim(x, ' ')), lambda x: x <> ''), chr(10)) AS cleaned FROM documents)""",
)
def clean_documents(spark, sf_dir):
    docs = V.table(spark, sf_dir, "documents").withColumn("cleaned", clean_lines(F.col("text")))
    return docs.select("doc_id", F.md5("cleaned").alias("cleaned_md5"), F.length("cleaned").cast("long").alias("n"))


@query(
    "c9_upload_classes",
    r"""SELECT doc_id, false AS is_scanned, 'DIGITAL_VECTOR_PDF' AS doc_type, length(trim(text, e' \n\r\t')) < 5 OR doc_id % 13 = 0 AS is_unreadable,
          CASE WHEN length(trim(text, e' \n\r\t')) > 40 THEN 'digital_vector' ELSE 'raster_scan' END AS source_class FROM documents WHERE doc_id % 2 = 1
        UNION ALL SELECT doc_id, true, 'SCANNED_PDF', length(trim(text, e' \n\r\t')) < 5 OR doc_id % 13 = 0, CASE WHEN length(trim(text, e' \n\r\t')) > 40 THEN 'digital_vector' ELSE 'raster_scan' END FROM documents WHERE doc_id % 2 = 0""",
)
def upload_classes(spark, sf_dir):
    docs = V.table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.when(F.pmod("doc_id", F.lit(13)) == 0, 0.0).otherwise(0.9).alias("confidence"),
        F.when(F.pmod("doc_id", F.lit(2)) == 0, "PaddleOCR").otherwise("native").alias("method"),
    )
    return certificates.classify_uploads(docs).select("doc_id", "is_scanned", "doc_type", "is_unreadable", "source_class")


@query(
    "c11_methods",
    "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'native_pdf' WHEN 1 THEN 'ocr_image' WHEN 2 THEN 'ocr_image' WHEN 3 THEN 'hybrid_ocr' ELSE 'other' END AS method, CASE doc_id % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 0.82 WHEN 2 THEN 0.82 WHEN 3 THEN 0.75 ELSE 0.7 END::DOUBLE AS confidence FROM documents",
)
def methods(spark, sf_dir):
    raw = V.pick(F.col("doc_id"), ("pymupdf", "paddleocr", "easyocr", "hybrid_ocr", "other"))
    docs = V.table(spark, sf_dir, "documents").select("doc_id", certificates.public_method(raw).alias("method"))
    return docs.withColumn("confidence", certificates.method_confidence(F.col("method")))


@query("k9_document_ledger", "SELECT doc_id, md5(text) AS raw_text_md5 FROM documents")
def document_ledger(spark, sf_dir):
    rows = certificates.ledger_rows(V.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", F.md5("raw_text").alias("raw_text_md5"))


@query("f13_newest_documents", "SELECT doc_id, lang, source FROM documents ORDER BY doc_id DESC LIMIT 20 OFFSET 40")
def newest_documents(spark, sf_dir):
    rows = V.table(spark, sf_dir, "documents").withColumnRenamed("text", "raw_text")
    return documents.list_documents(rows, 40, 20).select("doc_id", "lang", "source")


@query("f13_document_preview", "SELECT doc_id, substring(text, 1, 1000) AS raw_text_preview FROM documents WHERE doc_id = 7")
def document_preview(spark, sf_dir):
    rows = V.table(spark, sf_dir, "documents").withColumnRenamed("text", "raw_text")
    return documents.preview(rows, 7).select("doc_id", "raw_text_preview")


# ---- certificates ------------------------------------------------------------------------------------


@query("m7_records", O.sql("certificates", "SELECT doc_id, cert_no, grade AS material_grade, heat_no, c AS carbon, mn AS manganese, cr AS chromium, mo AS molybdenum, ys AS yield_strength, ts AS tensile_strength, el AS elongation FROM certificates"))
def records(spark, sf_dir):
    out = certificates.parse_records(V.certificates(spark, sf_dir).select("doc_id", "text"))

    def element(name):
        return F.try_element_at(F.filter("chemical_composition", lambda e: e["element"] == name), F.lit(1))["value"].alias(name.lower())

    def mechanical(name):
        return F.try_element_at(F.filter("mechanical_properties", lambda e: e["property"] == name), F.lit(1))["value"].alias(name)

    return out.select(
        "doc_id", "cert_no", "material_grade", "heat_no", *[element(n) for n in ("Carbon", "Manganese", "Chromium", "Molybdenum")],
        *[mechanical(n) for n in ("yield_strength", "tensile_strength", "elongation")],
    )


def hundredths(sql):
    return f"round(({sql}) / 100.0, 2)::DOUBLE"


TABLED = f"""SELECT p_partkey AS doc_id, 'TAB-' || p_partkey AS cert_no, CASE WHEN p_partkey // 2 % 2 = 0 THEN 'ASTM A182 F316' ELSE 'ASTM A105' END AS grade, {hundredths("CASE WHEN p_partkey % 2 = 0 THEN 3 ELSE 12 END")} AS c,
      {hundredths("p_partkey % 50 + 100")} AS mn, {hundredths("p_partkey % 30 + 20")} AS si, 0.03::DOUBLE AS p, 0.01::DOUBLE AS s, {hundredths("p_partkey % 100 + 1650")} AS cr, {hundredths("p_partkey % 60 + 220")} AS mo, {hundredths("p_partkey % 200 + 1100")} AS ni,
      (p_partkey % 90 + 210)::DOUBLE AS ys, (p_partkey % 80 + 520)::DOUBLE AS ts, p_partkey % 9 + 30.5::DOUBLE AS el FROM part"""


def table_records(spark, sf_dir):
    return certificates.parse_records(V.table_certificates(spark, sf_dir))


@query(
    "m5_chemistry_tables",
    f"SELECT doc_id, cert_no, grade AS material_grade, c, mn, si, p, s, cr, mo, ni, 8::BIGINT AS elements FROM ({TABLED})",
)
def chemistry_tables(spark, sf_dir):
    """Composition from a header row of symbols and a row of values."""
    names = {"c": "Carbon", "mn": "Manganese", "si": "Silicon", "p": "Phosphorus", "s": "Sulfur", "cr": "Chromium", "mo": "Molybdenum", "ni": "Nickel"}
    values = F.map_from_entries(F.transform("chemical_composition", lambda e: F.struct(e["element"], e["value"])))
    out = table_records(spark, sf_dir).withColumn("m", values)
    return out.select("doc_id", "cert_no", "material_grade", *[F.try_element_at("m", F.lit(name)).alias(n) for n, name in names.items()], F.size("m").cast("long").alias("elements"))


@query("m3_mechanical_tables", f"SELECT doc_id, ys AS yield_strength, ts AS tensile_strength, el AS elongation, 'MPa' AS unit FROM ({TABLED})")
def mechanical_tables(spark, sf_dir):
    """Mechanical values from header lines and the same number of value lines."""
    values = F.map_from_entries(F.transform("mechanical_properties", lambda e: F.struct(e["property"], e["value"])))
    out = table_records(spark, sf_dir).withColumns({"m": values, "unit": F.try_element_at(F.filter("mechanical_properties", lambda e: e["property"] == "yield_strength"), F.lit(1))["unit"]})
    return out.select("doc_id", *[F.try_element_at("m", F.lit(n)).alias(n) for n in ("yield_strength", "tensile_strength", "elongation")], "unit")


CE = "c + mn / 6.0 + (cr + mo) / 5.0"


@query(
    "c2_formulas",
    O.sql("certificates", f"SELECT doc_id, round({CE}, 9) AS ce, CASE WHEN round({CE}, 9) <= 0.43 THEN 'STANDARD_WELDABLE' ELSE 'PREHEAT_REQUIRED_HIGH_CE' END AS weldability, round(cr + 3.3 * mo, 9) AS pren FROM certificates"),
)
def formulas(spark, sf_dir):
    out = certificates.parse_records(V.certificates(spark, sf_dir).select("doc_id", "text"))
    out = out.withColumn("m", chemistry.symbol_values(F.col("chemical_composition")))
    out = out.select("doc_id", F.round(chemistry.carbon_equivalent(F.col("m"), None), 9).alias("ce"), F.round(chemistry.pitting_number(F.col("m"), None), 9).alias("pren"))
    return out.withColumn("weldability", chemistry.weldability(F.col("ce")))


def limit_case(symbol, low_high):
    """Number of limit breaches of a symbol by grade."""
    column = {"C": "c", "Mn": "mn", "Cr": "cr", "Mo": "mo"}[symbol]
    return O.case([(f"grade LIKE '%{g}%' AND ({column} < {lo} OR {column} > {hi})", "1") for g, (lo, hi) in low_high.items()], "0")


# F316L text is tested against the F316 limits, the first name found inside it
GRADE_NAMES = {"A105": "A105", "A350 LF2": "A350 LF2", "A182 F304": "A182 F304", "A182 F316": "A182 F316", "A193 B7": "A193 B7"}
BREACHES = " + ".join(
    limit_case(s, {g: chemistry.COMPOSITION_LIMITS[n][s] for g, n in GRADE_NAMES.items() if s in chemistry.COMPOSITION_LIMITS[n]}) for s in ("C", "Mn", "Cr", "Mo")
)
WEAK = " + ".join(O.case([(f"grade LIKE '%{g}%' AND {col} < {chemistry.MECHANICAL_LIMITS[n][i]}", "1") for g, n in GRADE_NAMES.items()], "0") for i, col in enumerate(("ys", "ts", "el")))


def value_maps(spark, sf_dir):
    docs = certificates.parse_records(V.certificates(spark, sf_dir))
    chem = chemistry.symbol_values(F.col("chemical_composition"))
    mech = F.map_from_entries(F.transform("mechanical_properties", lambda e: F.struct(e["property"].alias("key"), e["value"].alias("value"))))
    return docs.select("doc_id", chem.alias("chem"), mech.alias("mech"), F.col("material_grade").alias("grade"))


@query("c5_composition_check", O.sql("certificates", f"SELECT doc_id, n = 0 AS ok, n AS breaches FROM (SELECT doc_id, {BREACHES} AS n FROM certificates)"))
def composition_check(spark, sf_dir):
    out = value_maps(spark, sf_dir).withColumn("r", chemistry.check_composition(F.col("chem"), F.col("grade")))
    return out.select("doc_id", F.col("r.ok").alias("ok"), F.size("r.messages").alias("breaches"))


@query("c6_mechanical_check", O.sql("certificates", f"SELECT doc_id, n = 0 AS ok, n AS breaches FROM (SELECT doc_id, {WEAK} AS n FROM certificates)"))
def mechanical_check(spark, sf_dir):
    out = value_maps(spark, sf_dir).withColumn("r", chemistry.check_mechanical(F.col("mech"), F.col("grade")))
    return out.select("doc_id", F.col("r.ok").alias("ok"), F.size("r.messages").alias("breaches"))


F316 = chemistry.COMPOSITION_LIMITS["A182 F316"]
A105 = chemistry.COMPOSITION_LIMITS["A105"]


def warned(limits):
    known = {"C": "c", "Mn": "mn", "Cr": "cr", "Mo": "mo"}
    return " + ".join(f"CASE WHEN {known[e]} BETWEEN {lo} AND {hi} THEN 0 ELSE 1 END" if e in known else "1" for e, (lo, hi) in limits.items())


def tabled_warned(limits):
    known = {"C": "c", "Mn": "mn", "Si": "si", "P": "p", "S": "s", "Cr": "cr", "Mo": "mo", "Ni": "ni"}
    return " + ".join(f"CASE WHEN {known[e]} BETWEEN {lo} AND {hi} THEN 0 ELSE 1 END" if e in known else "1" for e, (lo, hi) in limits.items())


@query(
    "c7_document_conformance",
    O.sql(
        "certificates",
        f"""SELECT doc_id, true AS is_certificate, false AS conforming, true AS requires_hitl, CASE WHEN grade LIKE '%F316%' THEN {warned(F316)} WHEN grade LIKE '%A105%' THEN {warned(A105)} ELSE 1 END AS warnings FROM certificates""",
    ),
)
def conformance(spark, sf_dir):
    out = certificates.ingest_documents(V.certificates(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "is_certificate", "conforming", "requires_hitl", F.size("warnings").alias("warnings"))


@query(
    "c7_table_conformance",
    f"""SELECT doc_id, n = 0 AS conforming, n > 0 AS requires_hitl, n AS warnings FROM (SELECT doc_id, CASE WHEN grade LIKE '%F316%' THEN {{F316_WARNED}} ELSE {{A105_WARNED}} END AS n FROM ({TABLED}))""".format(F316_WARNED=tabled_warned(F316), A105_WARNED=tabled_warned(A105)),
)
def table_conformance(spark, sf_dir):
    """Conformance of certificates with full tables; some of them conform."""
    out = certificates.ingest_documents(V.table_certificates(spark, sf_dir))
    return out.select("doc_id", "conforming", "requires_hitl", F.size("warnings").alias("warnings"))


@query("c8_prose_documents")
def prose(spark, sf_dir):
    """Whole prose documents through the same ingestion: what is read as a certificate and what goes to review."""
    out = certificates.ingest_documents(V.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "is_certificate", "requires_hitl", F.size("chemical_composition").alias("elements"), F.size("mechanical_properties").alias("properties"))


@query("m8_header_fields", O.sql("certificates", "SELECT doc_id, cert_no AS certificate_no, heat_no, " + HEADER_GRADE.replace("{0}", "doc_id") + " AS material_grade, maker AS manufacturer FROM certificates"))
def headers(spark, sf_dir):
    docs = V.certificates(spark, sf_dir)
    fields = certificates.header_fields(F.col("text"))
    return docs.select("doc_id", *[fields[n].alias(n) for n in ("certificate_no", "heat_no", "material_grade", "manufacturer")])


def symbol_docs(spark, sf_dir):
    """Certificates in symbol form."""
    k = F.col("p_partkey")

    def two(n):
        return F.lpad(n.cast("string"), 2, "0")

    text = F.concat(
        F.lit("Grade: "), V.pick(k, V.GRADES), F.lit("\nFLANGE DN"), F.col("p_size").cast("string"), F.lit(" CLASS 300 SCH 40 RF\nC: 0."), two(F.pmod(k, F.lit(30)) + 10), F.lit("% Mn = "),
        (F.pmod(k, F.lit(50))).cast("string"), F.lit(" Cr: "), F.pmod(k, F.lit(20)).cast("string"), F.lit(".5\nYield Strength: "), (F.pmod(k, F.lit(200)) + 180).cast("string"), F.lit(" MPa\nElongation: 26 %"),
    )
    return V.dealt_parts(spark, sf_dir).select(F.col("p_partkey").alias("doc_id"), text.alias("text"))


@query("m9_symbol_chemistry", O.sql("", "SELECT p_partkey AS doc_id, (p_partkey % 30 + 10) / 100.0::DOUBLE AS c, CASE WHEN p_partkey % 50 <= 35 THEN (p_partkey % 50)::DOUBLE END AS mn, p_partkey % 20 + 0.5::DOUBLE AS cr, (p_partkey % 200 + 180)::DOUBLE AS ys, 26.0::DOUBLE AS el FROM part"))
def symbol_chemistry(spark, sf_dir):
    out = symbol_docs(spark, sf_dir).withColumns({"m": certificates.symbol_chemistry(F.col("text")), "p": certificates.labelled_mechanics(F.col("text"))})
    return out.select(
        "doc_id", *[F.try_element_at("m", F.lit(s)).alias(s.lower()) for s in ("C", "Mn", "Cr")],
        F.try_element_at("p", F.lit("yield_strength_mpa")).alias("ys"), F.try_element_at("p", F.lit("elongation_pct")).alias("el"),
    )


@query(
    "m12_full_parse",
    O.sql("", "SELECT p_partkey AS doc_id, 'FLANGE' AS item_type, p_size::DOUBLE AS size_nb_mm, 300 AS pressure_class, 'SCH 40' AS schedule, 'RF' AS facing_end, 0 AS missing, p_partkey % 3 = 0 AS is_incomplete FROM part"),
)
def full_parse(spark, sf_dir):
    docs = symbol_docs(spark, sf_dir).withColumn("confidence", F.when(F.pmod("doc_id", F.lit(3)) == 0, 0.6).otherwise(0.9))
    out = certificates.parse_full(docs, confidence="confidence")
    return out.select("doc_id", "item_type", "size_nb_mm", "pressure_class", "schedule", "facing_end", F.size("missing_attributes").alias("missing"), "is_incomplete")


@query("m13_certified_parts", O.sql("", f"SELECT p_partkey AS doc_id, 'FLANGE' AS item_type, {HEADER_GRADE.replace('{0}', 'p_partkey')} AS metallurgy, p_size::DOUBLE AS size_nb_mm FROM part"))
def certified_parts(spark, sf_dir):
    out = certificates.material_attributes(certificates.parse_full(symbol_docs(spark, sf_dir)))
    return out.select("doc_id", "item_type", "metallurgy", "size_nb_mm")


@query("m14_dashboard", O.sql("certificates", "SELECT doc_id, cert_no AS certificate_number, heat_no, grade AS material_grade, maker, ys AS yield_strength_mpa, ts AS tensile_strength_mpa, el AS elongation_pct FROM certificates"))
def dashboard(spark, sf_dir):
    out = certificates.dashboard_metadata(V.certificates(spark, sf_dir).select("doc_id", "text"))
    return out.select(
        "doc_id", "certificate_number", F.array_join("heat_numbers", ",").alias("heat_no"), "material_grade", F.array_join("manufacturer_list", ",").alias("maker"),
        "yield_strength_mpa", "tensile_strength_mpa", "elongation_pct",
    )


@query("a10_distinct_spellings", "SELECT conv_id, string_agg(role, ',' ORDER BY first_turn) AS roles FROM (SELECT conv_id, lower(role) AS k, arg_min(role, turn) AS role, min(turn) AS first_turn FROM conversations GROUP BY 1, 2) GROUP BY conv_id")
def distinct_spellings(spark, sf_dir):
    c = V.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("t"))
    spelled = F.transform("t", lambda x: x["role"])
    return c.select("conv_id", F.array_join(certificates.distinct_ignoring_case(spelled), ",").alias("roles"))


# ---- recognised blocks -------------------------------------------------------------------------------


@query("f15_confident_blocks", O.sql("blocks", "SELECT doc_id, block_no, score FROM blocks WHERE score >= 0.4"))
def confident(spark, sf_dir):
    return documents.confident_blocks(V.blocks(spark, sf_dir)).select("doc_id", "block_no", "score")


@query("a7_document_confidence", O.sql("blocks", "SELECT d.doc_id, round(coalesce(avg(score), 0), 9) AS confidence FROM documents d LEFT JOIN blocks b ON b.doc_id = d.doc_id GROUP BY d.doc_id"))
def document_confidence(spark, sf_dir):
    out = documents.document_confidence(V.table(spark, sf_dir, "documents"), V.blocks(spark, sf_dir))
    return out.select("doc_id", F.round("confidence", 9).alias("confidence"))


@query(
    "a13_document_methods",
    """SELECT conv_id AS doc_id, CASE WHEN count(*) FILTER (turn % 3 <> 0) = 0 THEN 'pymupdf' WHEN conv_id % 2 = 0 OR count(DISTINCT CASE turn % 3 WHEN 1 THEN 'a' WHEN 2 THEN 'b' END) > 1 THEN 'hybrid_ocr'
            ELSE max(CASE turn % 3 WHEN 1 THEN 'paddleocr' WHEN 2 THEN 'easyocr' END) END AS extraction_method, count(*)::INT AS page_count,
          md5(string_agg(trim(text, e' \\n\\r\\t'), e'\\n\\n' ORDER BY turn) FILTER (trim(text, e' \\n\\r\\t') <> '')) AS text_md5 FROM conversations GROUP BY conv_id""",
)
def document_methods(spark, sf_dir):
    pages = V.table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), "text", V.pick(F.col("turn"), (None, "paddleocr", "easyocr")).alias("engine"),
        V.pick(F.col("conv_id"), ("pdf", "image")).alias("source_type"),
    )
    out = documents.document_methods(pages)
    return out.select("doc_id", "extraction_method", "page_count", F.md5("raw_text").alias("text_md5"))


@query("w8_page_regions", O.sql("blocks", "SELECT doc_id, CASE WHEN y <= 40 THEN 'header' ELSE 'body' END AS label, string_agg(CAST(block_no AS VARCHAR), ',' ORDER BY block_no) AS blocks FROM blocks GROUP BY ALL"))
def regions(spark, sf_dir):
    out = documents.page_regions(V.blocks(spark, sf_dir))
    return out.select("doc_id", "label", F.array_join("block_indexes", ",").alias("blocks"))


@query("w11_bucket_lines", O.sql("blocks", "SELECT doc_id, md5(string_agg(text, chr(10) ORDER BY round_even(y / 8, 0), x, block_no)) AS text_md5 FROM blocks WHERE score >= 0.4 GROUP BY doc_id"))
def lines(spark, sf_dir):
    return documents.bucket_lines(V.blocks(spark, sf_dir)).select("doc_id", F.md5("text").alias("text_md5"))


@query("w7_reading_order")
def reading(spark, sf_dir):
    return documents.reading_order(V.blocks(spark, sf_dir)).select("doc_id", "block_no", "reading_position")
