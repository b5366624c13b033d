"""Engineering compatibility rules as columns."""

from .verdict import evaluate, evaluate_tables, prepare_side, shorthand_attributes

__all__ = ["evaluate", "evaluate_tables", "prepare_side", "shorthand_attributes"]
