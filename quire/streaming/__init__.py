"""Structured Streaming forms of the observation and job operators."""
