"""Spark-native analytics over collections of SQL scripts and classifier runs."""
