"""Functions of the assimilation engine."""
