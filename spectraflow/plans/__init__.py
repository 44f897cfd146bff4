"""Whole runs: from files to feature tables."""
