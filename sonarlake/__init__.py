"""Side-scan-sonar survey analytics on Spark tables."""

__version__ = "0.1.0"
