"""Talent analytics on Spark."""
