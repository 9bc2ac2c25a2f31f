"""Registered queries of the assimilation engine, and the SQL that their results are compared with."""

from . import analyses, core, sources
from .core import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "analyses", "core", "sources"]
