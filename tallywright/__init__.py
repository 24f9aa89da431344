"""Evaluation analytics and training-data operators on PySpark."""
