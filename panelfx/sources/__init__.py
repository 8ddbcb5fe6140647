"""Readers that make panels of tables."""
