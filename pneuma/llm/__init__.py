"""Operators that prepare text, vectors and pages for model training."""
