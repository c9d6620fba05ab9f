"""All registered queries of the library."""

from . import catalog_captures, catalog_documents, catalog_series, catalog_streams  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
