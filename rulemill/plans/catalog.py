"""All registered queries over the tables."""

from . import rules_to_metrics, tables_to_features, text_to_rules
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "rules_to_metrics", "tables_to_features", "text_to_rules"]
