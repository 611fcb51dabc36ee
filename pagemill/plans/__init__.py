"""Named queries over the driver's tables."""

from pagemill.plans import answers, catalogue, chunks, documents, pages
from pagemill.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "answers", "catalogue", "chunks", "documents", "pages"]
