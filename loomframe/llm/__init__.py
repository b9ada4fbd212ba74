"""Operators for training data: similarity graphs, entity matching, splitting, packing, text forms."""
