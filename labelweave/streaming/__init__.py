"""Structured Streaming forms of scoring, checking and annotation intake."""
