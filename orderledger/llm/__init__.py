"""Operators of a training-data pipeline over document tables, each a Spark job of its own."""
