"""Labelled text, labelled vectors and grouped cross-validation on Spark."""
