"""Outlier detectors, fitted and applied per (model, state)."""
