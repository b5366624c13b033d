"""Quick safety checks, tiers, ranking features and reasons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .attributes import DOMAINS
from .values import clamp01, first_true, group, let, lookup, not_blank, quoted

# Corrosion rank of a grade word.
METAL_RANKS = {
    "CARBON": 0, "A105": 0, "A105N": 0, "WCB": 0, "A216": 0, "LF2": 1, "F11": 1, "F22": 1,
    "304": 2, "304L": 2, "SS304": 2, "SS304L": 2, "316": 2, "316L": 2, "SS316": 2, "SS316L": 2,
    "DUPLEX": 3, "2205": 3, "SUPER DUPLEX": 4, "2507": 4, "INCONEL": 5, "HASTELLOY": 5,
}
# Valve family of an API standard number.
VALVE_STANDARDS = {
    "594": "check", "600": "gate", "602": "gate", "603": "gate", "604": "plug", "608": "ball",
    "609": "butterfly", "623": "globe", "6D": "pipeline",
}
# Approved alloy upgrades (requested grade, spelled exactly so, to candidates).
ALLOY_UPGRADES = {
    "304": ("304L", "316", "316L"),
    "304L": ("316", "316L"),
    "316": ("316L",),
    "A105": ("F316", "F316L"),
}


# Reason of a decision that refuses.
REFUSED = {"size": "size mismatch", "pressure": "pressure downgrade rejected", "metallurgy": "unapproved alloy substitution"}


def metal_rank(value: Column) -> Column:
    text = F.trim(F.regexp_replace(F.regexp_replace(F.upper(value), "[^A-Z0-9 ]", " "), r"(?U)\s+", " "))
    ordered = sorted(METAL_RANKS.items(), key=lambda kv: len(kv[0]), reverse=True)

    def rank(t):
        pairs = [(t.rlike(f"(?<![A-Z0-9]){quoted(word)}(?![A-Z0-9])"), r) for word, r in ordered]
        return first_true(pairs + [(t.rlike("(?<![A-Z0-9])STAINLESS(?![A-Z0-9])"), 2)])

    return let(text, rank)


def metals_compatible(query: Column, candidate: Column, query_rank: Column, candidate_rank: Column) -> Column:
    same = F.lower(F.trim(query)) == F.lower(F.trim(candidate))
    return same | query_rank.isNull() | candidate_rank.isNull() | (candidate_rank >= query_rank)


def valve_family(standard: Column) -> Column:
    number = group(standard, r"(?iU)\bAPI\s*[-.]?\s*(594|600|602|603|604|608|609|623|6D)\b")
    return lookup(VALVE_STANDARDS, F.upper(number))


def item_family(kind: Column) -> Column:
    text = F.regexp_replace(F.upper(kind), "[^A-Z0-9]", "")
    return first_true(
        [
            (text.startswith("FLANGE") | (text == "FLG"), "FLANGE"),
            (text.startswith("VALVE") | text.endswith("VALVE"), "VALVE"),
        ],
        text,
    )


def rank_columns(df, metal: str, into: str):
    """Add the metal rank once per row of a table, before it is joined into pairs."""
    return df.withColumn(into, metal_rank(F.col(metal)))


def side_columns(df):
    """Add what the checks read from one side alone (metal rank, families, known attributes) once per row of a table, before it is joined into pairs."""
    side = PairSide("", df.columns)
    return df.withColumns({"metal_rank": side.rank, "item_family": side.item_family, "valve_family": side.valve_family, "known_bits": side.known})


class PairSide:
    """Columns of one side of a pair; what ``side_columns`` adds may be at hand from before the join."""

    def __init__(self, prefix: str, columns=()):
        def column(name, kind):
            full = prefix + name
            return F.col(full) if not columns or full in columns else F.lit(None).cast(kind)

        self.item_type = column("item_type", "string")
        self.size = column("size_nb_mm", "double")
        self.pressure = column("pressure_class", "int")
        metal = column("metallurgy", "string")
        if columns and prefix + "material_grade" in columns:
            metal = F.coalesce(F.nullif(metal, F.lit("")), F.col(prefix + "material_grade"))
        self.metal = metal
        self.facing = column("facing_end", "string")
        self.standard = column("standard", "string")

        def made(name, value):
            return F.col(prefix + name) if columns and prefix + name in columns else value

        self.rank = made("metal_rank", metal_rank(metal))
        self.item_family = made("item_family", item_family(self.item_type))
        self.valve_family = made("valve_family", valve_family(self.standard))
        # one bit for each attribute that is given and not blank
        given = [not_blank(self.item_type), self.size, self.pressure, not_blank(self.metal), not_blank(self.facing), not_blank(self.standard)]
        bits = sum((F.when(value.isNotNull(), 1 << i).otherwise(0) for i, value in enumerate(given)), F.lit(0))
        self.known = made("known_bits", bits)


def pair_sides(columns=(), query="q_", candidate="c_") -> tuple[PairSide, PairSide]:
    return PairSide(query, columns), PairSide(candidate, columns)


def shown(value: Column) -> Column:
    return value.cast("string")


def gathered(*entries: tuple[Column, Column]) -> Column:
    """The texts whose condition holds, as an array, each once. There is no lambda in it, so that it is compiled with the rest of the row."""
    return F.array_except(F.array(*[F.when(holds, text) for holds, text in entries]), F.array(F.lit(None).cast("string")))


def quick_checks(q: PairSide, c: PairSide) -> list[tuple[Column, Column]]:
    """The five quick checks as (fails, message)."""
    present = (F.coalesce(q.metal, F.lit("")) != "") & (F.coalesce(c.metal, F.lit("")) != "")
    typed = (F.coalesce(q.item_type, F.lit("")) != "") & (F.coalesce(c.item_type, F.lit("")) != "")
    is_valve = F.coalesce(F.upper(q.item_type).contains("VALVE"), F.lit(False)) | F.coalesce(
        F.upper(c.item_type).contains("VALVE"), F.lit(False)
    )
    return [
        (q.size != c.size, F.concat(F.lit("size mismatch: "), shown(q.size), F.lit(" mm vs "), shown(c.size), F.lit(" mm"))),
        (c.pressure < q.pressure, F.concat(F.lit("pressure downgrade: "), shown(q.pressure), F.lit(" to "), shown(c.pressure))),
        (
            present & ~metals_compatible(q.metal, c.metal, q.rank, c.rank),
            F.concat(F.lit("metallurgy downgrade: "), q.metal, F.lit(" to "), c.metal),
        ),
        (typed & (q.item_family != c.item_family), F.concat(F.lit("item type mismatch: "), q.item_type, F.lit(" vs "), c.item_type)),
        (is_valve & (q.valve_family != c.valve_family), F.concat(F.lit("incompatible standards: "), q.standard, F.lit(" vs "), c.standard)),
    ]


def safety_violations(q: PairSide, c: PairSide) -> Column:
    """Messages of the five quick checks that fail."""
    return gathered(*quick_checks(q, c))


def search_tier(score: Column, violations: Column) -> Column:
    """Tier of the vector search; it never gives Tier-2."""
    return (
        F.when(F.size(violations) > 0, "Tier-4-Reject")
        .when(score >= 0.85, "Tier-1")
        .when(score >= 0.60, "Tier-3")
        .otherwise("Tier-4-Reject")
    )


def alloy_upgrade_allowed(requested: Column, candidate: Column) -> Column:
    targets = F.create_map(*[x for grade, names in ALLOY_UPGRADES.items() for x in (F.lit(grade), F.array(*[F.lit(n.upper()) for n in names]))])
    allowed = F.coalesce(F.array_contains(F.try_element_at(targets, requested), F.upper(candidate)), F.lit(False))
    blank = (F.coalesce(requested, F.lit("")) == "") | (F.coalesce(candidate, F.lit("")) == "")
    return blank | (F.lower(requested) == F.lower(candidate)) | allowed


def decisions(q: PairSide, c: PairSide) -> dict[str, tuple[Column, Column]]:
    """Size, class and alloy decisions as (allowed, reason)."""
    size_known = q.size.isNotNull() & c.size.isNotNull()
    class_known = q.pressure.isNotNull() & c.pressure.isNotNull()
    same_metal = (
        (F.coalesce(q.metal, F.lit("")) == "") | (F.coalesce(c.metal, F.lit("")) == "") | (F.lower(q.metal) == F.lower(c.metal))
    )
    size_ok = F.when(size_known, q.size == c.size).otherwise(True)
    class_ok = F.when(class_known, c.pressure >= q.pressure).otherwise(True)
    metal_ok = alloy_upgrade_allowed(q.metal, c.metal)
    return {
        "size": (size_ok, F.when(~size_known, "size not provided").when(size_ok, "exact size match").otherwise(REFUSED["size"])),
        "pressure": (
            class_ok,
            F.when(~class_known, "pressure class not provided")
            .when(class_ok, "pressure upgrade allowed")
            .otherwise(REFUSED["pressure"]),
        ),
        "metallurgy": (
            metal_ok,
            F.when(same_metal, "metallurgy matches or is not provided")
            .when(metal_ok, "approved alloy upgrade")
            .otherwise(REFUSED["metallurgy"]),
        ),
    }


def all_violations(q: PairSide, c: PairSide, earlier: Column | None = None) -> Column:
    """Earlier violations, those of the quick checks and the refusals, each once, in this order."""
    refused = [(~ok, F.lit(REFUSED[name])) for name, (ok, _) in decisions(q, c).items()]
    found = gathered(*quick_checks(q, c), *refused)
    return found if earlier is None else F.array_distinct(F.concat(earlier, found))


def tier_columns(tier: Column, similarity: Column) -> dict[str, Column]:
    """Confidence and routing that follow from a tier."""
    return {
        "confidence": F.when(tier == "Tier-4-Reject", 0.0).otherwise(similarity),
        "routing": F.when(tier == "Tier-1", "auto-link").when(tier == "Tier-4-Reject", "manual-entry").otherwise("hitl"),
    }


def classify(q: PairSide, c: PairSide, similarity: Column, earlier: Column) -> Column:
    """Classification of one candidate: struct(tier, confidence, routing, reasons, violations)."""
    violations = all_violations(q, c, earlier)
    tier = search_tier(similarity, violations)
    return F.struct(
        tier.alias("tier"),
        *[made.alias(name) for name, made in tier_columns(tier, similarity).items()],
        F.concat(F.array(*[why for _, why in decisions(q, c).values()]), violations).alias("reasons"),
        violations.alias("violations"),
    )


def classify_pairs(pairs, similarity: str, earlier: Column | None = None):
    """``pairs`` (sides ``q_`` and ``c_``) with the fields of ``classify`` as columns, each made from those before it.

    A table is classified with this one: violations are found once for a pair, and fields nobody reads are not made.
    """
    q, c = pair_sides(pairs.columns)
    out = pairs.withColumn("violations", all_violations(q, c, earlier))
    out = out.withColumn("tier", search_tier(F.col(similarity), F.col("violations")))
    reasons = F.concat(F.array(*[why for _, why in decisions(q, c).values()]), "violations")
    return out.withColumns({**tier_columns(F.col("tier"), F.col(similarity)), "reasons": reasons})


def _or_half(holds: Column) -> Column:
    """1 or 0, and 0.5 where a missing value leaves it open."""
    return F.coalesce(holds.cast("double"), F.lit(0.5))


def value_match(a: Column, b: Column) -> Column:
    return _or_half(F.lower(F.trim(a)) == F.lower(F.trim(b)))


def _known(*values: Column) -> Column:
    out = F.lit(True)
    for v in values:
        out = out & v.isNotNull()
    return out


def ranking_features(q: PairSide, c: PairSide, cosine: Column, domain_scores: dict[str, Column] | None = None) -> Column:
    """The 13 ranking features, in order."""
    score = clamp01(cosine)
    shared = F.bit_count(q.known.bitwiseAND(c.known))
    # Relative tolerance 1e-9 or absolute 1e-6, whichever is larger.
    near = F.abs(q.size - c.size) <= F.greatest(F.lit(1e-6), F.lit(1e-9) * F.greatest(F.abs(q.size), F.abs(c.size)))
    return F.array(
        score,
        _or_half(near),
        _or_half(q.pressure == c.pressure),
        _or_half(c.pressure >= q.pressure),
        F.when(
            _known(q.metal, c.metal), metals_compatible(q.metal, c.metal, q.rank, c.rank).cast("double")
        ).otherwise(0.5),
        value_match(q.item_type, c.item_type),
        value_match(q.facing, c.facing),
        value_match(q.standard, c.standard),
        shared.cast("double") / 6.0,
        *[clamp01(F.coalesce(domain_scores[d], score)) if domain_scores else score for d in DOMAINS],
    )


def ranking_score(features: Column) -> Column:
    """Half the cosine plus half the mean of the other features."""
    # a plain sum instead of a fold: a lambda would keep all that the features are made of from being compiled
    rest = sum((features[i] for i in range(1, 13)), F.lit(0.0))
    return clamp01(features[0] * 0.5 + (rest / 12.0) * 0.5)


def estimated_cosine(q: PairSide, c: PairSide) -> Column:
    """Share of the comparable main attributes that agree; 0.85 when none is comparable."""
    def same_text(a, b):
        return F.upper(F.trim(a.cast("string"))) == F.upper(F.trim(b.cast("string")))

    agree = {
        "t": (q.item_type, c.item_type, same_text(q.item_type, c.item_type)),
        "s": (q.size, c.size, F.abs(q.size - c.size) <= F.greatest(F.lit(1e-5), F.lit(1e-9) * F.greatest(F.abs(q.size), F.abs(c.size)))),
        "p": (q.pressure, c.pressure, q.pressure == c.pressure),
        "m": (q.metal, c.metal, same_text(q.metal, c.metal)),
    }
    total = sum((F.when(_known(a, b), 1).otherwise(0) for a, b, _ in agree.values()), F.lit(0))
    matched = sum((F.when(eq, 1).otherwise(0) for _, _, eq in agree.values()), F.lit(0))
    return F.when(total > 0, matched.cast("double") / total.cast("double")).otherwise(0.85)


def match_reasons(q: PairSide, c: PairSide) -> Column:
    """Reasons shown to a reviewer."""
    def arrow(a, b, tail=")"):
        return F.concat(shown(a), F.lit(" → "), shown(b), F.lit(tail))

    present = (F.coalesce(q.metal, F.lit("")) != "") & (F.coalesce(c.metal, F.lit("")) != "")
    return F.array_compact(
        F.array(
            F.when(
                q.size == c.size, F.concat(F.lit("✓ Exact size match ("), F.format_string("%.1f", c.size), F.lit(" mm)"))
            ).when(q.size != c.size, F.concat(F.lit("✗ Size mismatch ("), arrow(q.size, c.size, " mm)"))),
            F.when(c.pressure < q.pressure, F.concat(F.lit("✗ Pressure class downgrade ("), arrow(q.pressure, c.pressure)))
            .when(c.pressure > q.pressure, F.concat(F.lit("✓ Pressure class upgrade ("), arrow(q.pressure, c.pressure)))
            .when(c.pressure == q.pressure, F.concat(F.lit("✓ Exact pressure class match ("), shown(q.pressure), F.lit(")"))),
            F.when(
                present,
                F.concat(
                    F.when(metals_compatible(q.metal, c.metal, q.rank, c.rank), "✓").otherwise("✗"),
                    F.lit(" Metallurgy: "), q.metal, F.lit(" → "), c.metal,
                ),
            ),
        )
    )
