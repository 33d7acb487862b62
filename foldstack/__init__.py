"""Labelled feature windows on Spark: contracts, folds, out-of-fold stacking, metrics, audits."""

__version__ = "0.1.0"
