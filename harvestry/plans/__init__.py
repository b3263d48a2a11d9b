"""Analytical queries over the job model."""
