"""Log-odds arithmetic for blending scores."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as fv
from .casts import column


def clip(c, low, high) -> Column:
    return F.greatest(F.least(column(c), F.lit(high)), F.lit(low))


def sigmoid(x) -> Column:
    return 1.0 / (1.0 + F.exp(-clip(x, -fv.SIGMOID_CLIP, fv.SIGMOID_CLIP)))


def logit(p) -> Column:
    p = clip(p, fv.LOGIT_CLIP, 1.0 - fv.LOGIT_CLIP)
    return F.log(p / (1.0 - p))


def logit_product(first_log_odds, second_log_odds) -> Column:
    """Log-odds of the product of two probabilities given as log-odds."""
    return logit(sigmoid(first_log_odds) * sigmoid(second_log_odds))


def weighted_sum(weights) -> Column:
    """Sum of weight * column over a {column: weight} mapping."""
    terms = [F.lit(float(w)) * column(c) for c, w in weights.items()]
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return total
