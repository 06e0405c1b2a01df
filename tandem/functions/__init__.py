"""Expressions on columns: diffs, paths, times, vectors, code text."""
