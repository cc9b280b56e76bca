"""Scalar functions: column builders (text) and the few that need Python (udfs)."""
