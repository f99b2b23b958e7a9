"""Whole runs: from documents to a merged text, a tree or a report."""
