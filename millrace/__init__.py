"""millrace: declarative message pipelines and a JSON mapping language, planned by Spark."""

__version__ = "0.1.0"
