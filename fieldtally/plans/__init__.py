"""Staged models, their checks, and the bindings of every operator to concrete tables."""
