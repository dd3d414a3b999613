"""Operators of a training-data pipeline; nothing else in the library imports this subpackage."""

from . import (  # noqa: F401
    bag_minhash, bpe, line_dedup, online_packing, packing, pii, recurrent_lm, spelling, suffix_dedup, toxicity,
    vector_dedup, vector_search, whitening)
from .common import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
