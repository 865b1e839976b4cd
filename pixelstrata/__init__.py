"""Repeated-frame measurement, pair quality and dataset curation as Spark jobs.

Frames are rows of pixel tiles; every statistic is a DataFrame aggregation,
window or join, so Catalyst plans it and executors hold only bounded groups.
"""

__version__ = "0.1.0"
