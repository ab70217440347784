"""DataFrame operators for multi-fidelity experiment data on Apache Spark."""

__version__ = "0.1.0"
