"""Spark-native operators for pre-game features, ratings, fixtures, quality gates and model evaluation.

Every public operator is a plain ``DataFrame -> DataFrame`` function.
"""
