"""Readers of dated, annotated documents, writers of results, and adapters from the test tables."""
