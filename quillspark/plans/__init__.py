"""Registered queries over the driver's tables, and the SQL that checks them."""

from quillspark.plans import answers, documents, normalised, text
from quillspark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "answers", "documents", "normalised", "text"]
