"""Spark-native engine for preparing, mining and evaluating training data of neural rankers."""
