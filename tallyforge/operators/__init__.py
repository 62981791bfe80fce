"""Operators on logs and states: folds, reads, indexes, rankings, sketches."""
