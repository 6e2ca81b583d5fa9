"""Named queries, each with the SQL that it is checked against."""

from . import audits, bundles, catalog, fixtures, grounding, history, identities, intake, modelling, reports, rules, slots, streams, tables
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "audits", "bundles", "catalog", "fixtures", "grounding", "history", "identities", "intake", "modelling", "reports", "rules", "slots", "streams", "tables"]
