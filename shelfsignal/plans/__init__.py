"""Bindings of the driver tables and the catalogue of queries."""
