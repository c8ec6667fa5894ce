"""Diachronic collocation analytics on Spark."""
