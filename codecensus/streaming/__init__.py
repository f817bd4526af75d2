"""Structured Streaming jobs and the batch forms they must agree with."""
