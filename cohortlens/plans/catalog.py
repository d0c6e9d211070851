"""Imports every module that registers queries."""

from cohortlens.plans import agreement, flagship, ml, models, rollup, stats, text  # noqa: F401
from cohortlens.plans.registry import QUERIES, SQL  # noqa: F401

FLAGSHIP = "cohort_text_profile"
