"""Spark-native message risk analytics and corpus preparation."""
