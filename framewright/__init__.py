"""Framewright: quality analytics for episodic time series, planned by Spark."""

__version__ = "0.1.0"
