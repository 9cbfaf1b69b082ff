"""tarsift: static threat analytics over package archives, as Spark jobs."""

__version__ = "0.1.0"
