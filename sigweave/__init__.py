"""Signalling correlation, root-cause analysis and corpus preparation on Spark."""
