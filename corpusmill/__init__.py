"""Corpus preparation, sampling, dialogue memory and evaluation on Spark."""
