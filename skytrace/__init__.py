"""Spark-native analytics for vehicle-swarm telemetry."""

__version__ = "0.1.0"
