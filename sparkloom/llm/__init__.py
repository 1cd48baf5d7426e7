"""Operators for preparing language-model training corpora."""
