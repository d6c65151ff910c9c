"""Code-findings analytics over many projects, written as Spark jobs."""

__version__ = "0.1.0"
