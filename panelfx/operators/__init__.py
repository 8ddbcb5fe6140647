"""Operators on indexed panels: validation, distances, weights, estimators, search, resampling, diagnostics."""
