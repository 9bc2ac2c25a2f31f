"""Operators of the assimilation engine."""
