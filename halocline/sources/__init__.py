"""Sources of the assimilation engine."""
