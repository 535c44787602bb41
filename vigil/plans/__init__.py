"""Registered queries over the driver tables, each with its SQL twin."""

from vigil.plans import domain, evaluation, files, ingest, learned, models, operational, rules, stored, streams, temporal
from vigil.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "domain", "evaluation", "files", "ingest", "learned", "models", "operational", "rules", "stored", "streams", "temporal"]
