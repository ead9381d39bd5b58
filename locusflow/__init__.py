"""locusflow: summary-statistics and LD-block analytics as Spark jobs."""

__version__ = "0.1.0"
