"""Mnemospark: analytics over agent memory, written as Spark DataFrame jobs."""
