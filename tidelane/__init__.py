"""Spark-first engine for temporal game-telemetry analytics."""
