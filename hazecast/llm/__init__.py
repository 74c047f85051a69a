"""Operators for language-model training data, and the pipeline's queries."""
