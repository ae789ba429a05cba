"""Sentence-level vocabulary analytics as composable Spark DataFrame operators."""
