"""Operators that prepare text corpora for training. Nothing else in geoloom imports this package."""
