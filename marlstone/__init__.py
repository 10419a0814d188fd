"""marlstone: record curation, reconciliation, audit and ranking on PySpark."""

__version__ = "0.1.0"
