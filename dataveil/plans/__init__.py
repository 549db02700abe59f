"""The registered queries; importing this package fills the registry."""

from dataveil.plans import (  # noqa: F401
    classification, compliance, events, governance, health, inventory, lineage, masking, streams,
)
from dataveil.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
