"""The four programs of a cycle as functions of tables: prepare, calculate, update, diagnose."""

from .cycle import System, calculate, diagnose, prepare, update

__all__ = ["System", "calculate", "diagnose", "prepare", "update"]
