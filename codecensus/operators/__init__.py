"""Operators over corpus, artifact, log and attempt tables."""
