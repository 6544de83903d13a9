"""A Spark-native engine for composed queries, records and their relations, and table upkeep."""

from tidewater.sources.engine import Engine, session

__all__ = ["Engine", "session"]
