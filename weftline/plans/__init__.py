"""Queries of the library's operators on the driver tables, by family."""
