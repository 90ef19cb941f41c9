"""Readers of raw stores: lines, JSON records and SQLite tables as DataFrames, with diagnostics instead of exceptions."""
