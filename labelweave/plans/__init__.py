"""User-level flows built from the operators."""
