"""Keyed writes, enrichment and relinking."""
