"""Hashes of ledger rows, gate passes and requests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GENESIS = "0" * 64
LEDGER_FIELDS = ("log_id", "timestamp", "actor_name", "action_name", "reference_id", "details")
SEAL_FIELDS = (
    "gate_pass_no", "vehicle_no", "driver_id", "sku_code", "quantity", "issuing_officer", "timestamp",
)


def _joined(*parts: Column) -> Column:
    # concat_ws would skip nulls and so shift the fields
    return F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("None")) for p in parts])


def sealed(*parts: Column) -> Column:
    return F.sha2(_joined(*parts), 256)


def ledger_hash(previous: Column, row=F.col) -> Column:
    return sealed(previous, *[row(f) for f in LEDGER_FIELDS])


def gate_pass_seal(row=F.col) -> Column:
    return sealed(*[row(f) for f in SEAL_FIELDS])


def json_text(value: Column) -> Column:
    """A string as a JSON literal (only printable text without control marks is expected)."""
    escaped = F.regexp_replace(F.regexp_replace(value, r"\\", r"\\\\\\\\"), '"', r'\\\\"')
    return F.concat(F.lit('"'), escaped, F.lit('"'))


def review_id(query: Column, canonical_id: Column) -> Column:
    """Id of a review item: hash of the JSON array [query, canonical id] without blanks."""
    text = F.regexp_replace(F.to_json(F.array(query, canonical_id)), "\n", "")
    return F.sha2(text, 256)


def sorted_json(columns: dict[str, Column]) -> Column:
    """JSON object of string, number and null columns with sorted keys and Python's separators."""
    parts = []
    for i, name in enumerate(sorted(columns)):
        lead = ("" if i == 0 else ", ") + f'"{name}": '
        parts += [F.lit(lead), F.coalesce(F.to_json(F.struct(columns[name].alias("v"))), F.lit(""))]
        parts[-1] = F.coalesce(F.nullif(F.regexp_replace(parts[-1], r'^\{("v":)?|\}$', ""), F.lit("")), F.lit("null"))
    return F.concat(F.lit("{"), *parts, F.lit("}"))
