"""Tandem: a Spark-first engine for software-evolution (co-change) analytics."""

__version__ = "0.1.0"
