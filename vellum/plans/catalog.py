"""Imports every query module so that the registry is filled."""

from vellum.plans import q_features, q_model, q_models, q_reports, q_text, q_topics  # noqa: F401
from vellum.plans.registry import ORACLE, QUERIES  # noqa: F401
