"""Readers: works, PDF layout, lookups over HTTP, the corpus derived from the test tables."""
