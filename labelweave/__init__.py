"""Labelled-text analytics as DataFrame-to-DataFrame operators on Spark."""
