"""Spark ML steps: splits, sampling, preparation, models."""
