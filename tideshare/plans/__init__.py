"""Composites: series arrays, trajectories, likelihood, fit, search, reports."""
