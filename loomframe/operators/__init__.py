"""Relational, quality and entity operators (DataFrame -> DataFrame)."""
