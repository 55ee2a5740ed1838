"""Operators for preparing large text and vector collections for model training."""
