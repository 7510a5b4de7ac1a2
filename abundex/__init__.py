"""Longitudinal abundance, exposure and posterior analytics on Spark."""
