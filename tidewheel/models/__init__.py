"""Scalers, thresholds, isolation forests, sequence models and their stacking."""
