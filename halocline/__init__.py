"""Halocline: ensemble data assimilation and corpus preparation expressed as Spark DataFrame plans."""
