"""Spatial feature graph engine on PySpark."""
