"""All registered queries. Importing this module fills the registry."""

from airframe.plans import continuous, files, readings, regress, shift, texts, usage, workflows  # noqa: F401
from airframe.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
