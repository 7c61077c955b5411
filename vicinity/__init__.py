"""Spatio-temporal risk analytics expressed as lazy Spark DataFrame plans."""
