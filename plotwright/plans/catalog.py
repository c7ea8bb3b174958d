"""Every query of the land-record engine by name, with the SQL that checks it."""

from . import q_enrich, q_geo, q_records, q_rules, q_scans, q_text  # noqa: F401  each registers its queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
