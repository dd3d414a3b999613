"""Encoding, training, ensembling and scoring with Spark ML."""
