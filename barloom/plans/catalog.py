"""Importing this module fills the registry."""

from barloom.plans import backtests, combined, evaluation, evidence, features, fundamentals, ingest, labels, modelling, patterns, quality, reports, results, rotation, rules, selection  # noqa: F401
from barloom.plans.registry import REGISTRY  # noqa: F401
