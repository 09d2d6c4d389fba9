"""Spark-native analytics over an append-only ledger of observations."""
