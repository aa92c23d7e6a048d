"""Operators for training-data pipelines over text: each a Spark job, each in a module of its own."""
