"""Spark operators over corpora of recorded step sequences."""
